import base64
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardloom.functions import vectors
from cardloom.operators import filters, mutate, stats
from cardloom.plans.collection import Collection, list_profiles
from cardloom.sources import notes as sources


@pytest.fixture
def collection(spark, tmp_path):
    media = tmp_path / "media"
    media.mkdir()
    (media / "a.png").write_bytes(b"png")
    (media / "lost.mp3").write_bytes(b"mp3")
    return Collection(spark, str(tmp_path / "c"), str(media))


def basic(front, back="", deck="Langs::Spanish", **more):
    return {"note_type": "Basic", "deck": deck, "fields": {"Front": front, "Back": back}, **more}


def test_upsert_results_in_order(collection):
    items = [
        basic("hola", tags=["verb", "es::noun"]), basic("hola"), basic(""), basic("x", deck=""), {"note_type": "Nope", "deck": "D", "fields": {"Front": "a"}},
        {"note_type": "Basic", "deck": "D", "fields": {"Bad": "a"}}, {"note_type": "Cloze", "deck": "D", "fields": {"Text": "no cloze"}}, basic("{{c1::x}}"),
        {"note_type": "Cloze", "deck": "D", "fields": {"Text": "{{c1::ok}}"}}, {"id": 99, "fields": {"Front": "z"}}, {"note_type": "Basic", "deck": "#77", "fields": {"Front": "deckless"}},
    ]
    dry = collection.upsert_notes(items, dry_run=True)
    assert [r["status"] for r in dry][:2] == ["ok", "ok"] and collection.table("notes").count() == 0
    got = collection.upsert_notes(items)
    assert [(r["status"], r["reason"]) for r in got] == [
        ("created", None), ("error", "duplicate"), ("error", "empty"), ("error", None), ("error", "unknown_note_type"),
        ("error", "unknown_field"), ("error", "missing_cloze"), ("error", "notetype_not_cloze"), ("created", None), ("error", None), ("error", None),
    ]
    assert got[5]["error"] == "type Basic has no field Bad, but Front, Back"
    assert got[3]["error"] == "a new note needs a deck" and got[9]["error"] == "there is no note 99" and got[10]["error"] == "there is no deck #77"
    first = got[0]["id"]
    assert collection.upsert_notes([basic("hola")], "skip")[0]["status"] == "skipped" and collection.upsert_notes([basic("hola")], "allow")[0]["status"] == "created"
    changed = collection.upsert_notes([{"id": first, "fields": {"Back": "hello"}}, {"id": first, "note_type": "Cloze"}])
    assert [r["status"] for r in changed] == ["updated", "error"]
    row = collection.table("notes").where(F.col("note_id") == first).first()
    assert {f["name"]: f.value for f in row.fields} == {"Front": "hola", "Back": "hello"} and row.tags == ["verb", "es::noun"]
    assert {r.name for r in collection.table("decks").collect()} >= {"Default", "Langs::Spanish", "D"}


def test_reads_changes_and_packages(spark, collection, tmp_path):
    made = collection.upsert_notes([basic("uno <img src='a.png'>", "one", tags=["num", "es::a"]), basic("dos", "two [sound:gone.mp3]", tags=["num"]), basic("tres", "three", deck="Other"), basic("&nbsp;<br>x", " ")])
    one, two, three, four = (r["id"] for r in made)
    ids = lambda df: sorted(r.note_id for r in df.collect())
    assert ids(collection.list_notes(deck="langs")[0]) == [one, two, four] and ids(collection.list_notes(tags=["num", "-es"])[0]) == [two]
    assert collection.list_notes(ids=[one, two, three], limit=2)[1] == 2 and collection.list_notes(deck="Langs", limit=1)[1] == 3
    with pytest.raises(ValueError, match="at least one"):
        collection.list_notes()
    assert ids(collection.collection_query("is:new -deck:Other two")[0]) == [two]
    info = collection.collection_info(["all"])
    assert list(info) == list(stats.SECTIONS) and info["summary"].first().notes == 4
    assert {r.name: r.notes for r in info["decks"].collect()}["Other"] == 1

    embed = vectors.synthetic_embedder(8)
    found = collection.search_notes(["three", "Name: nothing"], embed=embed, limit=3)
    assert found["matches"].where("query_id = 0 and rank = 1").first().note_id == three and not found["stale"] and found["complete"]
    assert collection.search_notes(["on"])["message"]
    near = collection.search_notes(ids=[one], embed=embed, threshold=-1.0)["matches"].collect()
    assert one not in {r.note_id for r in near} and near[0].source_label == f"note #{one}"

    assert {(r.name, r.status) for r in collection.collection_check().collect()} == {("lost.mp3", "unused"), ("gone.mp3", "missing")}
    assert collection.update_note_tags([one, 999], add=["new"], remove=["num"]) == {"notes_modified": 1, "not_found": [999]}
    assert collection.rename_tag("es", "spanish") == 1 and collection.rename_tag("num", "number", [two, three]) == 1
    tags = {r.note_id: r.tags for r in collection.table("notes").collect()}
    assert tags[one] == ["spanish::a", "new"] and tags[two] == ["number"]
    assert collection.find_replace_notes("t(h?)", r"T\1", regex=True, field="Back", dry_run=True, ids=[two, three])["changed"] == 2
    assert collection.find_replace_notes("TWO", "deux", match_case=False, deck="Langs")["changed"] == 1
    pruned = collection.collection_prune(dry_run=True)
    assert pruned["unused_tags"] == [] or set(pruned["unused_tags"]) <= {"num", "es::a"}
    assert pruned["unused_media"] == ["lost.mp3"] and pruned["empty_notes"] == []

    package = str(tmp_path / "package")
    assert collection.export_package(package, deck="Langs") == 3
    other = Collection(spark, str(tmp_path / "d"))
    assert other.import_package(package) == {"new": 3} and other.import_package(package) == {"duplicate": 3} and other.import_package(package, "always") == {"updated": 3}
    assert collection.delete_notes([one, 12345]) == {one: "deleted", 12345: "not_found"}
    assert collection.delete_decks(["Other", "Nope"]) == {"Other": "not_empty", "Nope": "not_found"}
    renamed = collection.upsert_decks([{"name": "Fresh"}, {"id": 1, "name": "Fresh2"}, {"id": 1, "name": "Other"}, {"name": ""}])
    assert [r["status"] for r in renamed] == ["created", "updated", "error", "error"]


def test_types(collection):
    made = collection.upsert_note_types([{"name": "Vocab", "fields": ["Word", "Meaning"]}, {"name": "Vocab", "fields": ["Meaning", "Word"]}])
    assert [m["status"] for m in made] == ["created", "error"]
    note = collection.upsert_notes([{"note_type": "Vocab", "deck": "D", "fields": {"Word": "w", "Meaning": "m"}}])[0]["id"]
    collection.update_note_type_fields("Vocab", [{"op": "rename", "name": "Word", "new_name": "Term"}, {"op": "add", "name": "Extra", "position": 0}, {"op": "reposition", "name": "Meaning", "position": 0}])
    row = collection.table("notes").where(F.col("note_id") == note).first()
    assert [(f["name"], f.value) for f in row.fields] == [("Meaning", "m"), ("Extra", ""), ("Term", "w")]
    with pytest.raises(ValueError, match="at least|must stay|not found"):
        mutate.structure_ops(["a"], [{"op": "remove", "name": "a"}])
    collection.update_note_type_templates("Vocab", [{"op": "add", "name": "Card 2"}])
    assert collection.find_replace_note_types("{{", "[[", dry_run=True)[0]["replacements"] > 0
    collection.update_note_type_field_metadata("Vocab", {"Term": {"font": "Arial", "size": 20}})
    report = collection.migrate_note_type([note], "Basic", {"Term": "Front"})
    assert report["dropped_fields"] == ["Meaning", "Extra"] and report["new_empty_fields"] == ["Back"]
    row = collection.table("notes").where(F.col("note_id") == note).first()
    assert row.note_type == "Basic" and [(f["name"], f.value) for f in row.fields] == [("Front", "w"), ("Back", "")]
    vocab = collection.table("types").where("name = 'Vocab'").first().type_id
    assert collection.delete_note_types([vocab, 1, 404]) == {vocab: "deleted", 1: "error", 404: "not_found"}


def test_media(collection):
    listed, total = collection.list_media("*.png")
    assert total == 1 and listed.first().mime == "image/png"
    assert {(r.name, r.status) for r in collection.fetch_media(["a.png", "b.png"]).collect()} == {("a.png", "found"), ("b.png", "missing")}
    data = base64.b64encode(b"x").decode()
    assert {r.name: r.status for r in collection.store_media({"n.png": data, "..": data, "a.png": data, "bad.png": "%%"}).collect()} == {"n.png": "stored", "..": "error", "a.png": "replaced", "bad.png": "error"}
    assert (Path(collection.media) / "n.png").read_bytes() == base64.b64decode(data) == (Path(collection.media) / "a.png").read_bytes()
    assert {r.name for r in collection.list_media()[0].collect()} == {"a.png", "lost.mp3", "n.png"}
    assert {r.name: r.status for r in collection.delete_media(["lost.mp3", "zz"]).collect()} == {"lost.mp3": "deleted", "zz": "not_found"}
    assert collection.list_media()[1] == 2
    assert list_profiles({"b": "2", "a": "1"}) == [("a", "1"), ("b", "2")]


@pytest.mark.parametrize("bad", ["", "(", "a OR", "deck:", "nope:x", "is:what", "nid:x", "-", "a)", "prop:x=1"])
def test_malformed_queries(spark, bad):
    with pytest.raises(filters.QueryError):
        filters.parse_query(bad)


def test_deck_references(spark):
    decks = spark.createDataFrame([(5, "Five"), (6, "12")], "deck_id long, name string")
    names = lambda r: [x.name for x in filters.resolve_deck(r, decks).collect()]
    assert (names("#5"), names("#9"), names("5"), names("12"), names("Any")) == (["Five"], [], ["Five"], ["12"], ["Any"])
    assert filters.cutoff("2024-01-01").isoformat() == filters.cutoff("2024-01-01T00:00:00Z").isoformat()


def test_scan_keeps_the_asked_order(spark):
    notes = spark.createDataFrame([(1, "Basic", [(0, "F", "a")]), (2, "Basic", [(0, "F", "b")])], "note_id long, note_type string, fields array<struct<ord:int,name:string,value:string>>")
    assert [r.note_id for r in sources.scan_fields(notes, [2, 9, 1]).collect()] == [2, 1]


def test_templates_show_fields():
    from cardloom.operators.cards import shown_fields

    assert shown_fields("{{A}} {{#B}}{{hint:C}}{{^D}}{{cloze:E}}{{/D}}{{/B}} x") == [((), "A", False), ((("B", True),), "C", False), ((("B", True), ("D", False)), "E", True)]
    assert shown_fields("") == [] == shown_fields("plain")
    for bad in ("{{#A}}", "{{/A}}", "{{#A}}{{^B}}{{/A}}{{/B}}"):
        with pytest.raises(ValueError, match="section"):
            shown_fields(bad)


def test_prune_finds_empty_cards(spark, collection):
    made = collection.upsert_notes([basic("one"), {"note_type": "Cloze", "deck": "D", "fields": {"Text": "{{c1::ok}}"}}])
    assert collection.collection_prune("empty_cards")["empty_cards"] == []
    collection._save(cards=spark.createDataFrame([(1, made[0]["id"], 0, 1, 0, "new"), (2, made[0]["id"], 1, 1, 0, "new"), (3, made[1]["id"], 0, 1, 0, "new"), (4, made[1]["id"], 1, 1, 0, "new")], collection.table("cards").schema))
    assert collection.collection_prune("empty_cards")["empty_cards"] == [4]
