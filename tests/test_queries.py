import pytest

import __spark_entry__ as driver
from cardloom import queries
from tests.oracle import DATA, both, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(con, spark, name):
    ours, theirs = both(con, spark, queries.QUERIES[name], queries.ORACLE[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_has_rows(con, spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(con, spark):
    frame = driver.entry(spark)
    assert frame.columns == ["query_id", "note_id", "score", "tier", "signal", "at", "rank"]
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_search_notes_embeds_whole_texts(spark, tmp_path):
    same = "word " * 100  # 500 characters that both texts share
    docs = [(1, same + "first end", "en", "s", 509), (2, same + "other end", "en", "s", 509)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(9, 1, 0)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(7, same + "other end")], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.note_id: r for r in queries.QUERIES["search_notes"](spark, str(tmp_path)).collect()}
    assert got[2].semantic == 1.0 and "text" in got[2].signals.split(",")
    assert 1 not in got or got[1].semantic is None
