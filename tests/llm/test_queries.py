import re

import pytest

from cardloom.llm import queries
from tests.llm import test_decontaminate, test_mixing, test_simhash
from tests.oracle import DATA, both, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(con, spark, name):
    ours, theirs = both(con, spark, queries.QUERIES[name], queries.ORACLE[name])
    assert ours == theirs


@pytest.fixture(scope="module")
def documents(con):
    return con.sql("select doc_id, text, source from documents order by doc_id").fetchall()


def test_token_counts_equal_the_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t, _ in documents}
    got = queries.QUERIES["op2_token_counts"](spark, DATA).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {d: len((t or "").encode()) for d, t, _ in documents}


def test_encoded_texts_equal_the_library(spark, documents):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t, _ in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.QUERIES["op12_bpe_codec"](spark, DATA).collect())) == want


def test_near_duplicates_equal_brute_force(spark, documents):
    got = sorted(map(tuple, queries.QUERIES["op3_simhash_near_dedup"](spark, DATA).collect()), key=str)
    assert got == test_simhash.brute([(d, t) for d, t, _ in documents])


def test_mix_equals_the_model(spark, documents):
    got = queries.QUERIES["op1_source_mix"](spark, DATA).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in documents}
    sources = {}
    for d, _, s in documents:
        sources[s] = sources.get(s, 0) + size[d]
    of = {d: s for d, _, s in documents}
    want, taken = test_mixing.model(sources), dict.fromkeys(sources, 0)
    for r in got:
        assert r.size == size[r.doc_id] and abs(r.target - want[of[r.doc_id]]) < 1e-6 and r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) < 1.001 for s in want)


def test_decontamination_finds_what_brute_force_finds(spark, con, documents):
    items = con.sql("select item_id, text from benchmark").fetchall()
    got = {r.doc_id: sorted((x.item_id, round(x.similarity, 9), x.word_from) for x in r["items"]) for r in queries.QUERIES["op6_decontaminate"](spark, DATA).collect()}
    short = [(d, t) for d, t, _ in documents if len(t or "") < 2500]
    assert {d: got[d] for d, _ in short} == {d: test_decontaminate.brute(t, items) for d, t in short}


def test_toxicity_on_all_labels(spark, con):
    toxic = dict(con.sql("select doc_id, toxic from labels").fetchall())
    got = {r.doc_id: r.toxic for r in queries.QUERIES["op4_toxicity"](spark, DATA).collect()}
    right = sum(got[d] == bool(t) for d, t in toxic.items())
    assert right / len(toxic) > 0.9  # some labels are of junk without any word to tell


def test_surrogates_leave_no_entity_and_keep_the_rest(spark, documents):
    own = {d: t for d, t, _ in documents}
    for r in queries.QUERIES["op9_pii_surrogates"](spark, DATA).collect():
        for e in r.entities:
            assert own[r.doc_id][e.start : e.end] not in r.text
        if not r.entities:
            assert r.text == own[r.doc_id]
