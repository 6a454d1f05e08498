"""Bulk changes as functions from tables to (new table, results); a dry run returns the results with the old table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.text import is_blank, replace_literal, replace_regex, strip_html
from cardloom.operators.filters import has_tag
from cardloom.operators.tags import prefixes, unused_tags

#: What is said of an item that fails a check; ``%s`` stands for the names that it is about.
MESSAGES = {
    "empty": "the first field has no content",
    "missing_cloze": "a note of a cloze type needs a cloze such as {{c1::...}} in its cloze field",
    "notetype_not_cloze": "clozes need a note type for clozes",
    "field_not_cloze": "a cloze stands in a field that takes none",
    "duplicate": "another note of this type begins with the same field",
    "unknown_field": "type %s has no field %s, but %s",
    "unknown_deck": "there is no deck %s",
    "unknown_type": "there is no note type %s",
    "unknown_note": "there is no note %s",
    "unknown_deck_id": "there is no deck with id %s",
    "other_type": "an update keeps the note type %s and can't make it %s",
    "taken": "another deck is called %s",
}


def _said(what: str, *columns: Column | str) -> Column:
    return F.format_string(MESSAGES[what], *columns)


_CLOZE = r"(?s)\{\{c\d+::.*?\}\}"


def first_key(value: Column) -> Column:
    """What makes first fields alike: their text without markup."""
    return F.trim(strip_html(value))


def upsert_classify(items: DataFrame, notes: DataFrame, types: DataFrame, decks: DataFrame, duplicates: str = "error", dry_run: bool = False, first_new_id: int = 1) -> DataFrame:
    """(index, status, id, action, reason, error) and what would be written, for each item of a batch.

    ``items``: index, id, note_type, deck, fields (map), tags. With an id it is an update of the named fields; else a create,
    whose checks run in order: what is missing, unknown type, deck and field, the field checks, duplicates. In a real run
    items that are written come before later ones; a dry run compares with stored notes alone.
    """
    if duplicates not in ("error", "skip", "allow"):
        raise ValueError(f"unknown duplicate policy {duplicates!r}")
    old = notes.select(F.col("note_id").alias("old_id"), F.col("note_type").alias("old_type"))
    kinds = types.select(F.col("name").alias("type_name"), "kind", F.transform("fields", lambda f: f["name"]).alias("names"))
    number = F.regexp_extract("deck", r"^#?(\d+)$", 1)
    rows = items.join(old, items["id"] == F.col("old_id"), "left").withColumn("own_type", F.when(F.col("id").isNotNull(), F.col("old_type")).otherwise(F.col("note_type")))
    rows = rows.join(kinds, F.col("own_type") == F.col("type_name"), "left")
    rows = rows.join(decks.select(F.col("deck_id"), F.col("name").alias("deck_by_id")), F.when(number != "", number).cast("long") == F.col("deck_id"), "left")
    is_new, given = F.col("id").isNull(), F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = rows.withColumns({
        "deck_name": F.coalesce("deck_by_id", F.when(~F.col("deck").startswith("#") | (number == ""), F.col("deck"))),
        "unknown": F.array_min(F.array_except(F.map_keys(given), F.coalesce("names", F.array().cast("array<string>")))),
        "values": F.transform("names", lambda n: F.coalesce(given[n], F.lit(""))),
    })
    first = F.get("values", F.lit(0))
    others = F.slice("values", 2, F.greatest(F.size("values") - 1, F.lit(0)))
    clozes = F.exists("values", lambda v: v.rlike(_CLOZE))
    missing = F.lit(None).cast("string")
    for name, test in (("fields", F.size(given) == 0), ("deck", F.coalesce("deck", F.lit("")) == ""), ("note_type", F.coalesce("note_type", F.lit("")) == "")):
        missing = F.when(test, F.lit(f"a new note needs a {name}")).otherwise(missing)
    listed = F.array_join("names", ", ")
    no_field = _said("unknown_field", "own_type", "unknown", listed)
    no_deck = F.when(F.col("deck").isNotNull() & F.col("deck_name").isNull(), _said("unknown_deck", "deck"))
    structural = (
        F.when(first_key(first) == "", F.when(is_blank(first), F.lit("empty")))
        .when((F.col("kind") == "cloze") & ~first.rlike(_CLOZE) & ~clozes, F.lit("missing_cloze"))
        .when((F.col("kind") != "cloze") & clozes, F.lit("notetype_not_cloze"))
        .when((F.col("kind") == "cloze") & F.exists(others, lambda v: v.rlike(_CLOZE)), F.lit("field_not_cloze"))
    )
    rows = rows.withColumn("problem", F.when(is_new, structural))
    error = F.when(is_new, F.coalesce(missing, F.when(F.col("type_name").isNull(), _said("unknown_type", "note_type")), no_deck, F.when(F.col("unknown").isNotNull(), no_field)))
    changed = _said("other_type", "old_type", "note_type")
    error = F.coalesce(error, F.when(~is_new, F.coalesce(F.when(F.col("old_id").isNull(), _said("unknown_note", F.col("id").cast("string"))), F.when(F.col("note_type") != F.col("old_type"), changed), F.when(F.col("unknown").isNotNull(), no_field), no_deck)))
    for problem in ("empty", "missing_cloze", "notetype_not_cloze", "field_not_cloze"):
        error = F.coalesce(error, F.when(F.col("problem") == problem, F.lit(MESSAGES[problem])))
    reason = F.when(is_new & missing.isNull() & F.col("type_name").isNull(), "unknown_note_type").when(F.col("type_name").isNotNull() & F.col("unknown").isNotNull() & (~is_new | missing.isNull()) & F.when(is_new, no_deck.isNull()).otherwise(F.col("note_type").isNull() | (F.col("note_type") == F.col("old_type"))), "unknown_field")
    rows = rows.withColumns({"error": error, "reason": F.coalesce(reason, F.when(missing.isNull() & no_deck.isNull() & F.col("unknown").isNull(), F.col("problem"))), "key": first_key(first)})
    stored = notes.select(F.col("note_type").alias("own_type"), first_key(F.get("fields", F.lit(0))["value"]).alias("key"), F.lit(True).alias("stored")).distinct()
    rows = rows.join(stored, ["own_type", "key"], "left")
    creates = F.when(is_new & F.col("error").isNull(), F.lit(1))
    earlier = F.lit(0) if dry_run else F.coalesce(F.count(creates).over(Window.partitionBy("own_type", "key").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("twin", (creates == 1) & (F.coalesce("stored", F.lit(False)) | (earlier > 0)))
    twin = F.coalesce("twin", F.lit(False)) if duplicates != "allow" else F.lit(False)
    status = F.when(F.col("error").isNotNull(), "error").when(twin, "skipped" if duplicates == "skip" else "error").when(F.lit(dry_run), "ok").when(is_new, "created").otherwise("updated")
    rows = rows.withColumn("status", status)
    written = F.col("status").isin("created", "updated")
    return rows.select(
        "index", "status",
        F.when(F.col("status") == "created", F.lit(first_new_id) + F.col("index")).when(written, F.col("id")).alias("id"),
        F.when(F.col("status") == "ok", F.when(is_new, "create").otherwise("update")).alias("action"),
        F.when(F.col("error").isNotNull(), F.col("reason")).when(twin, "duplicate").alias("reason"),
        F.when(F.col("error").isNotNull(), F.col("error")).when(twin & F.lit(duplicates == "error"), F.lit(MESSAGES["duplicate"])).alias("error"),
        F.col("own_type").alias("note_type"), F.col("deck_name").alias("deck"), "fields", "names", "tags",
    )


def upsert_notes(items: DataFrame, notes: DataFrame, types: DataFrame, decks: DataFrame, duplicates: str = "error", dry_run: bool = False, first_new_id: int = 1, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes after the batch, results by index)."""
    judged = upsert_classify(items, notes, types, decks, duplicates, dry_run, first_new_id)
    results = judged.select("index", "status", "id", "action", "reason", "error")
    if dry_run:
        return notes, results
    now = F.current_timestamp() if now is None else now
    given = F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    made = judged.where("status = 'created'").select(
        F.col("id").cast("long").alias("note_id"), F.sha2(F.col("id").cast("string"), 256).alias("guid"), "note_type", "deck", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), now.alias("modified"),
        F.transform("names", lambda n, i: F.struct(i.cast("int").alias("ord"), n.alias("name"), F.coalesce(given[n], F.lit("")).alias("value"))).alias("fields"),
    )
    # the last update of a note wins; named fields alone change
    edits = judged.where("status = 'updated'").groupBy(F.col("id").cast("long").alias("note_id")).agg(F.max_by(F.struct("fields", "deck", "tags"), "index").alias("edit"))
    held = notes.join(edits, "note_id", "left")
    fields = F.transform("fields", lambda f: F.struct(f["ord"].alias("ord"), f["name"].alias("name"), F.coalesce(F.try_element_at("edit.fields", f["name"]), f["value"]).alias("value")))
    after = held.select(
        "note_id", "guid", "note_type", F.coalesce("edit.deck", "deck").alias("deck"), F.coalesce("edit.tags", "tags").alias("tags"), F.when(F.col("edit").isNotNull(), now).otherwise(F.col("modified")).alias("modified"),
        F.when(F.col("edit.fields").isNotNull(), fields).otherwise(F.col("fields")).alias("fields"),
    )
    return after.unionByName(made), results


def delete_notes(notes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes left, (note_id, status deleted/not_found))."""
    asked = ids.select("note_id").distinct()
    told = asked.join(notes.select("note_id", F.lit(True).alias("there")), "note_id", "left").select("note_id", F.when(F.col("there"), "deleted").otherwise("not_found").alias("status"))
    return notes.join(asked, "note_id", "left_anti"), told


def update_tags(notes: DataFrame, ids: DataFrame, set_tags: list[str] | None = None, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """All tags replaced, or some removed and then some added, on the ids."""
    array = lambda tags: F.array(*map(F.lit, tags)).cast("array<string>")
    new = array(set_tags) if set_tags is not None else F.array_union(F.array_except("tags", array(remove)), array(add))
    marked = notes.join(ids.select("note_id").distinct().withColumn("hit", F.lit(True)), "note_id", "left")
    return marked.withColumn("tags", F.when(F.col("hit"), new).otherwise(F.col("tags"))).select(notes.columns)


def rename_tag(notes: DataFrame, old: str, new: str, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes, changed note_ids). Everywhere, tags below the old one move along; on ids, the very tag alone is renamed."""
    low = old.lower()

    def moved(t: Column) -> Column:
        own = F.when(F.lower(t) == low, F.lit(new))
        if ids is None:
            own = own.when(F.lower(t).startswith(low + "::"), F.concat(F.lit(new), F.substring(t, len(old) + 1, 1 << 20)))
        return own.otherwise(t)

    hit = has_tag(old) if ids is None else F.exists("tags", lambda t: F.lower(t) == low)
    if ids is not None:
        notes = notes.join(ids.select("note_id").distinct().withColumn("asked", F.lit(True)), "note_id", "left")
        hit = hit & F.coalesce("asked", F.lit(False))
    marked = notes.withColumn("hit", hit)
    after = marked.withColumn("tags", F.when(F.col("hit"), F.array_distinct(F.transform("tags", moved))).otherwise(F.col("tags")))
    return after.drop("hit", "asked"), marked.where("hit").select("note_id")


def find_replace(notes: DataFrame, search: str, replacement: str, regex: bool = False, match_case: bool = True, field: str | None = None, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes, changed (note_id, before, after)): replaced in all fields, or one, of the notes (or the ids)."""
    swap = (lambda v: replace_regex(v, search, replacement, not match_case)) if regex else (lambda v: replace_literal(v, search, replacement, not match_case))
    scoped = notes if ids is None else notes.join(ids.select("note_id").distinct().withColumn("asked", F.lit(True)), "note_id", "left")
    here = lambda f: f["name"] == field if field else F.lit(True)
    after = F.transform("fields", lambda f: F.struct(f["ord"].alias("ord"), f["name"].alias("name"), F.when(here(f), swap(f["value"])).otherwise(f["value"]).alias("value")))
    done = scoped.withColumn("after", after if ids is None else F.when(F.col("asked"), after).otherwise(F.col("fields")))
    changed = done.where("after <> fields").select("note_id", F.col("fields").alias("before"), "after")
    return done.withColumn("fields", F.col("after")).select(notes.columns), changed


def migrate_note_type(notes: DataFrame, ids: DataFrame, types: DataFrame, target: str, field_map: dict[str, str], dry_run: bool = False) -> tuple[DataFrame, dict]:
    """(notes, report): notes of one type get another, fields by an injective map; others are dropped, or new and empty."""
    asked = ids.select("note_id").distinct()
    found = asked.join(notes.select("note_id", "note_type"), "note_id", "left").groupBy("note_type").count().limit(3).collect()
    if any(r.note_type is None for r in found):
        raise ValueError("some notes weren't found")
    if len(found) != 1:
        raise ValueError("all notes must share one note type to migrate together")
    source = found[0].note_type
    names = {r["name"]: [f["name"] for f in sorted(r["fields"], key=lambda f: f["ord"])] for r in types.where(F.col("name").isin(source, target)).collect()}
    if target not in names:
        raise ValueError(f"note type {target!r} not found")
    if source == target:
        raise ValueError(f"notes already use note type {target!r}")
    if not field_map:
        raise ValueError("field_map must not be empty")
    for old, new in field_map.items():
        if old not in names[source] or new not in names[target]:
            raise ValueError(f"no such fields: {old!r} to {new!r}")
    if len(set(field_map.values())) < len(field_map):
        raise ValueError("several source fields go to one target field")
    back = {new: old for old, new in field_map.items()}
    report = {"from": source, "to": target, "dropped_fields": [n for n in names[source] if n not in field_map], "new_empty_fields": [n for n in names[target] if n not in back], "dry_run": dry_run}
    if dry_run:
        return notes, report
    value = lambda old: F.coalesce(F.get(F.transform(F.filter("fields", lambda f: f["name"] == old), lambda f: f["value"]), F.lit(0)), F.lit(""))
    fields = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), (value(back[n]) if n in back else F.lit("")).alias("value")) for i, n in enumerate(names[target])))
    marked = notes.join(asked.withColumn("hit", F.lit(True)), "note_id", "left")
    return marked.withColumns({"fields": F.when(F.col("hit"), fields).otherwise(F.col("fields")), "note_type": F.when(F.col("hit"), target).otherwise(F.col("note_type"))}).select(notes.columns), report


def upsert_decks(items: DataFrame, decks: DataFrame, first_new_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(decks, results (index, status, id, name, error)): with an id a rename, which never merges two decks; else a create."""
    by_name = decks.select(F.lower("name").alias("low"), F.col("deck_id").alias("taken"))
    rows = items.join(decks.select(F.col("deck_id").alias("known"), F.col("name").alias("old_name")), items["id"] == F.col("known"), "left").join(by_name, F.lower(items["name"]) == F.col("low"), "left")
    first = F.min("index").over(Window.partitionBy(F.lower("name")))
    error = F.when(F.coalesce("name", F.lit("")) == "", "name is required").when(F.col("id").isNotNull() & F.col("known").isNull(), _said("unknown_deck_id", F.col("id").cast("string"))).when(F.col("id").isNotNull() & (F.col("taken") != F.col("id")), _said("taken", "name"))
    rows = rows.withColumns({"error": error, "first": first})
    own = F.coalesce("id", "taken", F.lit(first_new_id) + F.col("first"))
    fresh = F.col("id").isNull() & F.col("taken").isNull()
    results = rows.select("index", F.when(F.col("error").isNotNull(), "error").when(fresh & (F.col("index") == F.col("first")), "created").otherwise("updated").alias("status"), F.when(F.col("error").isNull(), own).cast("long").alias("id"), "name", "error", "old_name")
    renames = results.where("status = 'updated' and old_name is not null").select("old_name", F.col("name").alias("new_name"))
    # children follow their parent's name: the nearest renamed ancestor decides
    up = decks.select("deck_id", "name", F.explode(prefixes("name")).alias("old_name")).join(renames, "old_name").groupBy("deck_id", "name").agg(F.max_by(F.struct("old_name", "new_name"), F.length("old_name")).alias("r"))
    moved = up.select("deck_id", F.concat("r.new_name", F.expr("substring(name, length(r.old_name) + 1)")).alias("moved"))
    after = decks.join(moved, "deck_id", "left").select("deck_id", F.coalesce("moved", "name").alias("name"))
    return after.unionByName(results.where("status = 'created'").select(F.col("id").alias("deck_id"), "name")), results.drop("old_name")


def delete_decks(references: DataFrame, decks: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decks left, (name, status deleted/not_found/not_empty)): a deck goes only if its family has no card."""
    both = cards.select("deck_id").unionByName(cards.where("original_deck_id <> 0").select(F.col("original_deck_id").alias("deck_id"))).distinct()
    full = both.join(decks, "deck_id").select(F.explode(prefixes("name")).alias("full")).distinct()
    asked = references.select("name").distinct().join(decks, "name", "left").join(full, F.col("name") == F.col("full"), "left")
    told = asked.select("name", F.when(F.col("deck_id").isNull(), "not_found").when(F.col("full").isNotNull(), "not_empty").otherwise("deleted").alias("status"))
    gone = told.where("status = 'deleted'").select(F.col("name").alias("gone"))
    left = decks.select("deck_id", "name", F.explode(prefixes("name")).alias("gone")).join(gone, "gone", "left_semi").select("deck_id").distinct()
    return decks.join(left, "deck_id", "left_anti"), told


def delete_note_types(ids: DataFrame, types: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types left, (type_id, status deleted/not_found/error)): only types without notes go."""
    used = notes.select(F.col("note_type").alias("used")).distinct()
    asked = ids.select("type_id").distinct().join(types.select("type_id", "name"), "type_id", "left").join(used, F.col("name") == F.col("used"), "left")
    told = asked.select("type_id", F.when(F.col("name").isNull(), "not_found").when(F.col("used").isNotNull(), "error").otherwise("deleted").alias("status"))
    return types.join(told.where("status = 'deleted'").select("type_id"), "type_id", "left_anti"), told


def positional_replace(old: list[str], new: list[str]) -> None:
    """Raises if a name that stays would move: names are replaced by position, which may rename, append and drop last ones."""
    for i, name in enumerate(new):
        if name in old and old.index(name) != i:
            raise ValueError(f"{name!r} would move from position {old.index(name)} to {i}")


def structure_ops(names: list[str], ops: list[dict]) -> list[str]:
    """Names after add, remove, rename and reposition, all checked before any applies."""
    out = list(names)
    for i, op in enumerate(ops):
        kind, name = op["op"], op["name"]
        fail = lambda what, i=i, kind=kind: ValueError(f"op {i} ({kind}): {what}")
        if kind == "add":
            at = op.get("position", len(out))
            if name in out:
                raise fail(f"{name!r} already exists")
            if not 0 <= at <= len(out):
                raise fail(f"position {at} out of range")
            out.insert(at, name)
            continue
        if name not in out:
            raise fail(f"{name!r} not found")
        if kind == "remove":
            if len(out) == 1:
                raise fail("the last one must stay")
            out.remove(name)
        elif kind == "rename":
            if op["new_name"] != name and op["new_name"] in out:
                raise fail(f"{op['new_name']!r} already exists")
            out[out.index(name)] = op["new_name"]
        elif kind == "reposition":
            if not 0 <= op["position"] < len(out):
                raise fail(f"position {op['position']} out of range")
            out.remove(name)
            out.insert(op["position"], name)
        else:
            raise fail("unknown")
    return out


def _entry(key: str, name: str | None) -> Column:
    """The entry of a name in a list of entries, null if there is none."""
    return F.get(F.filter(key, lambda e: e["name"] == F.lit(name)), F.lit(0))


def restructure(types: DataFrame, type_name: str, key: str, ops: list[dict]) -> DataFrame:
    """The types with a list of entries (``fields`` or ``templates``) changed by operations; entries keep what they hold."""
    row = types.where(F.col("name") == type_name).select(key).first()
    if row is None:
        raise ValueError(f"note type {type_name!r} not found")
    before = [e["name"] for e in sorted(row[key], key=lambda e: e["ord"])]
    after = structure_ops(before, ops)
    origin = {n: n for n in before}
    for op in ops:
        if op["op"] == "rename":
            origin[op["new_name"]] = origin.pop(op["name"])
        elif op["op"] == "add":
            origin[op["name"]] = None
    element = types.schema[key].dataType.elementType
    entries = []
    for i, name in enumerate(after):
        old = _entry(key, origin.get(name))
        entries.append(F.struct(*((F.lit(i) if f.name == "ord" else F.lit(name) if f.name == "name" else F.coalesce(old[f.name], F.lit(None).cast(f.dataType))).cast(f.dataType).alias(f.name) for f in element.fields)))
    return types.withColumn(key, F.when(F.col("name") == type_name, F.array(*entries)).otherwise(F.col(key)))


def rename_fields(notes: DataFrame, type_name: str, before: list[str], ops: list[dict]) -> DataFrame:
    """Notes of a type after structure operations on its fields: values follow their field, new fields are empty."""
    after = structure_ops(before, ops)
    origin = {n: n for n in before}
    for op in ops:
        if op["op"] == "rename":
            origin[op["new_name"]] = origin.pop(op["name"])
        elif op["op"] == "add":
            origin[op["name"]] = None
    value = lambda was: F.coalesce(F.get(F.transform(F.filter("fields", lambda f: f["name"] == was), lambda f: f["value"]), F.lit(0)), F.lit(""))
    fields = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), (value(origin[n]) if origin.get(n) else F.lit("")).alias("value")) for i, n in enumerate(after)))
    return notes.withColumn("fields", F.when(F.col("note_type") == type_name, fields).otherwise(F.col("fields")))


def replace_in_templates(types: DataFrame, search: str, replacement: str, regex: bool = False, match_case: bool = True) -> tuple[DataFrame, DataFrame]:
    """(types, (name, replacements, templates_changed, css_changed)) of a find and replace in templates and style."""
    swap = (lambda v: replace_regex(v, search, replacement, not match_case)) if regex else (lambda v: replace_literal(v, search, replacement, not match_case))
    pattern = ("" if match_case else "(?i)") + (search if regex else "\\Q" + search + "\\E")
    count = lambda v: F.coalesce(F.regexp_count(v, F.lit(pattern)), F.lit(0))
    new = F.transform("templates", lambda t: F.struct(t["ord"].alias("ord"), t["name"].alias("name"), swap(t["front"]).alias("front"), swap(t["back"]).alias("back")))
    done = types.withColumns({"new": new, "new_css": swap("css"), "n": F.aggregate("templates", F.lit(0), lambda s, t: s + count(t["front"]) + count(t["back"])) + count(F.col("css"))})
    told = done.select("name", F.col("n").alias("replacements"), F.size(F.filter(F.arrays_zip(F.col("templates").alias("a"), F.col("new").alias("b")), lambda x: x["a"] != x["b"])).alias("templates_changed"), (F.col("css") != F.col("new_css")).alias("css_changed"))
    return done.withColumns({"templates": F.col("new"), "css": F.col("new_css")}).select(types.columns), told


def empty_notes(notes: DataFrame) -> DataFrame:
    """(note_id) of notes whose fields are all blank."""
    return notes.where(~F.exists("fields", lambda f: ~is_blank(f["value"]))).select("note_id")


def prune(notes: DataFrame, cards: DataFrame, registry: DataFrame, media_refs: DataFrame, files: DataFrame, sections: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """What a clean-up removes, in its order: empty_notes, empty_cards, unused_tags, unused_media; none named: all.

    Each looks at what the ones before it leave. Cards are empty where their note has no text for them (column empty).
    """
    sections = sections or ("empty_notes", "empty_cards", "unused_tags", "unused_media")
    out: dict[str, DataFrame] = {}
    if "empty_notes" in sections:
        out["empty_notes"] = empty_notes(notes)
        notes = notes.join(out["empty_notes"], "note_id", "left_anti")
        cards = cards.join(out["empty_notes"], "note_id", "left_anti")
    if "empty_cards" in sections:
        flags = cards.groupBy("note_id").agg(F.count_if("empty").alias("gone"), F.count("*").alias("n"))
        out["empty_cards"] = cards.where("empty").select("card_id", "note_id")
        notes = notes.join(flags.where("gone = n"), "note_id", "left_anti")
    if "unused_tags" in sections:
        out["unused_tags"] = unused_tags(registry, notes)
    if "unused_media" in sections:
        named = media_refs.join(notes.select("note_id"), "note_id", "left_semi").select(F.explode("names").alias("name")).distinct()
        out["unused_media"] = files.where(~F.col("name").startswith("_")).select("name").join(named, "name", "left_anti")
    return out


def check(media_refs: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status unused/missing, notes): files that no note names, and names without a file, with how many notes."""
    named = media_refs.select("note_id", F.explode("names").alias("name")).groupBy("name").agg(F.countDistinct("note_id").alias("notes"))
    both = named.join(files.select("name", F.lit(True).alias("there")), "name", "full")
    return both.where("notes is null or there is null").select("name", F.when(F.col("notes").isNull(), "unused").otherwise("missing").alias("status"), F.coalesce("notes", F.lit(0)).alias("notes"))
