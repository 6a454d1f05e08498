"""A collection of notes with the actions that clients call; every change writes new versions of the tables it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import schema
from cardloom.operators import filters, mutate, postings, stats, tags
from cardloom.operators.cards import empty_cards
from cardloom.plans import search as plans
from cardloom.sources import notes as sources
from cardloom.sources.files import checkpoint
from cardloom.sources.state import State

TABLES = {"notes": schema.NOTES, "types": schema.NOTE_TYPES, "cards": schema.CARDS, "decks": schema.DECKS, "tags": "tag string"}
#: The stock note types.
STOCK = [
    (1, "Basic", "standard", [(0, "Front"), (1, "Back")], [(0, "Card 1", "{{Front}}", "{{Back}}")], ""),
    (2, "Cloze", "cloze", [(0, "Text"), (1, "Back Extra")], [(0, "Cloze", "{{cloze:Text}}", "{{Back Extra}}")], ""),
]


class Collection:
    """``folder`` holds the tables; ``media`` the media files. Results are DataFrames, or plain values where they are few."""

    def __init__(self, spark: SparkSession, folder: str, media: str | None = None):
        self.spark, self.folder, self.media = spark, folder, media
        self.states = {name: State(spark, f"{folder}/{name}") for name in TABLES}
        for name, ddl in TABLES.items():
            if self.states[name].version() < 0:
                rows = STOCK if name == "types" else [(1, "Default")] if name == "decks" else []
                self.states[name].write(spark.createDataFrame(rows, ddl))

    def table(self, name: str) -> DataFrame:
        return self.states[name].read()

    def _save(self, dry_run: bool = False, **tables: DataFrame) -> None:
        if not dry_run:
            for name, table in tables.items():
                self.states[name].write(table)

    def _ids(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "note_id long")

    def _next(self, name: str, key: str) -> int:
        return (self.table(name).agg(F.max(key)).first()[0] or 0) + 1

    # reads

    def collection_info(self, sections: list[str] | None = None, detail: bool = False) -> dict[str, DataFrame]:
        n, c, d, t = (self.table(x) for x in ("notes", "cards", "decks", "types"))
        make = {
            "summary": lambda: stats.summary(n, c, d, t, self.table("tags")),
            "note_types": lambda: stats.note_type_list(t, detail),
            "decks": lambda: stats.deck_note_counts(c, d),
            "tags": lambda: self.table("tags").orderBy("tag"),
            "stats": lambda: stats.deck_stats(n, c, d),
        }
        return {name: make[name]() for name in stats.sections(sections)}

    def list_notes(self, **filter_by: object) -> tuple[DataFrame, int]:
        return filters.list_notes(self.table("notes"), **filter_by)

    def collection_query(self, query: str, limit: int = 0) -> tuple[DataFrame, int]:
        queues = self.table("cards").groupBy("note_id").agg(F.min("queue").alias("queue"), F.collect_list("card_id").alias("card_ids"))
        return filters.collection_query(self.table("notes").join(queues, "note_id", "left"), query, limit)

    def _segments(self, version: int) -> DataFrame:
        return sources.numbered(sources.field_segments(self.states["notes"].read(version)))

    def postings(self) -> postings.Postings:
        """The stored postings of the present notes, brought there from the notes' version that they were made of: only
        segments whose texts differ are read for terms, and only the buckets of terms that came or went are written."""
        held, now = postings.store(self.spark, f"{self.folder}/postings"), self.states["notes"].version()
        if held.version() < 0:
            postings.build(held, self._segments(now), {"notes": now})
        elif (was := held.note()["notes"]) != now:
            old = self._segments(was).select("seg_id", F.col("text").alias("was"))
            moved = old.join(self._segments(now).select("seg_id", "text"), "seg_id", "full").where("not (was <=> text)")
            postings.update(held, moved.where("was is not null").select("seg_id", F.col("was").alias("text")), moved.where("text is not null").select("seg_id", "text"), {"notes": now})
        return held

    def index(self, embed=None) -> plans.Index:
        """The derived tables of the present notes. ``embed``: an Arrow function from texts to vectors."""
        notes, version = self.table("notes"), self.states["notes"].version()
        segments = self._segments(version)
        if embed is None:
            return plans.Index(segments, postings=self.postings(), version=version)
        from cardloom.functions.text import embed_text

        own = notes.select("note_id", embed_text("fields").alias("text")).where("text <> ''").select(F.lit("text").alias("modality"), "note_id", F.lit(0).alias("item"), embed("text").alias("vec"))
        members = tags.membership(notes)
        return plans.Index(segments, own, members, tags.centroids(members, own, notes.count()), self.postings(), version=version)

    def search_notes(self, queries: list[str] = (), ids: list[int] = (), limit: int = 10, deck: str | None = None, tag_names: list[str] | None = None, exclude: list[int] = (), threshold: float = 0.5, mode: str = "fused", embed=None, index: plans.Index | None = None) -> dict:
        """Groups by source (a query, or ``note #id``): the matches table, a message, and whether the read was stale."""
        meaning, message = plans.gate(list(queries), list(ids), mode)
        before = self.states["notes"].version()
        index = index or self.index(embed if meaning else None)
        scope = filters.scope_of(self.table("notes"), deck, tag_names)
        out = None
        if queries:
            bank = self.spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
            dropped = bank.select("query_id").join(self._ids(list(exclude))) if exclude else None
            vectors = bank.select("query_id", embed("text").alias("vec")) if meaning and embed else None
            out = plans.search(bank, index, limit, vectors, scope, dropped, threshold).join(bank.select("query_id", F.col("text").alias("source_label")), "query_id")
        if ids and index.vectors is not None:
            from cardloom.operators import knn

            near = knn.anchors(self._ids(list(ids)), index.vectors, limit or plans.ALL, threshold).select("query_id", F.col("rank"), "note_id", F.col("score"), F.col("score").alias("semantic"), F.concat(F.lit("note #"), "query_id").alias("source_label"))
            out = near if out is None else out.unionByName(near, allowMissingColumns=True)
        return {"matches": out, "message": message, "complete": bool(meaning and embed) or mode == "lexical", "stale": plans.stale(before, self.states["notes"].version())}

    # notes

    def upsert_notes(self, items: list[dict], duplicates: str = "error", dry_run: bool = False) -> list[dict]:
        rows = [(i, x.get("id"), x.get("note_type"), x.get("deck"), x.get("fields"), x.get("tags")) for i, x in enumerate(items)]
        given = self.spark.createDataFrame(rows, "index long, id long, note_type string, deck string, fields map<string,string>, tags array<string>")
        notes, decks, cards = self.table("notes"), self.table("decks"), self.table("cards")
        after, results = mutate.upsert_notes(given, notes, self.table("types"), decks, duplicates, dry_run, self._next("notes", "note_id"))
        told = [r.asDict() for r in results.orderBy("index").collect()]
        if not dry_run:
            self._save(notes=after)
            notes = self.table("notes")
            known = decks.select("name")
            fresh = notes.select(F.col("deck").alias("name")).distinct().join(known, "name", "left_anti")
            start = self._next("decks", "deck_id")
            names = sorted(r.name for r in fresh.collect())
            decks = decks.unionByName(self.spark.createDataFrame([(start + i, n) for i, n in enumerate(names)], schema.DECKS))
            self._save(decks=decks)
            at = notes.join(self.table("decks").withColumnRenamed("name", "deck"), "deck").select("note_id", F.col("deck_id").alias("here"))
            moved = cards.join(at, "note_id").withColumn("deck_id", F.col("here")).select(cards.columns)
            made = at.join(cards.select("note_id").distinct(), "note_id", "left_anti").select((F.col("note_id") * 1000).alias("card_id"), "note_id", F.lit(0).alias("ord"), F.col("here").alias("deck_id"), F.lit(0).cast("long").alias("original_deck_id"), F.lit("new").alias("queue"))
            self._save(cards=moved.unionByName(made), tags=self.table("tags").union(notes.select(F.explode("tags"))).distinct())
        return told

    def delete_notes(self, ids: list[int]) -> dict[int, str]:
        left, told = mutate.delete_notes(self.table("notes"), self._ids(ids))
        out = {r.note_id: r.status for r in told.collect()}
        self._save(notes=left, cards=self.table("cards").join(self._ids(ids), "note_id", "left_anti"))
        return out

    def update_note_tags(self, ids: list[int], set_tags: list[str] | None = None, add: list[str] = (), remove: list[str] = ()) -> dict:
        notes, asked = self.table("notes"), self._ids(ids)
        missing = [r.note_id for r in asked.join(notes, "note_id", "left_anti").distinct().collect()]
        self._save(notes=mutate.update_tags(notes, asked, set_tags, list(add), list(remove)))
        self._save(tags=self.table("tags").union(self.table("notes").select(F.explode("tags"))).distinct())
        return {"notes_modified": len(set(ids)) - len(missing), "not_found": sorted(missing)}

    def rename_tag(self, old: str, new: str, ids: list[int] | None = None) -> int:
        after, changed = mutate.rename_tag(self.table("notes"), old, new, self._ids(ids) if ids else None)
        n = changed.count()
        self._save(notes=after)
        self._save(tags=self.table("tags").union(self.table("notes").select(F.explode("tags"))).distinct())
        return n

    def find_replace_notes(self, search: str, replacement: str, regex: bool = False, match_case: bool = True, field: str | None = None, dry_run: bool = False, sample: int = 20, **scope: object) -> dict:
        found, _ = filters.list_notes(self.table("notes"), **scope)
        after, changed = mutate.find_replace(self.table("notes"), search, replacement, regex, match_case, field, found.select("note_id"))
        told = {"changed": changed.count(), "sample": [r.asDict(True) for r in changed.orderBy("note_id").limit(sample).collect()], "dry_run": dry_run}
        self._save(dry_run, notes=after)
        return told

    def migrate_note_type(self, ids: list[int], target: str, field_map: dict[str, str], dry_run: bool = False) -> dict:
        after, report = mutate.migrate_note_type(self.table("notes"), self._ids(ids), self.table("types"), target, field_map, dry_run)
        self._save(dry_run, notes=after)
        return report

    # decks and types

    def upsert_decks(self, items: list[dict]) -> list[dict]:
        rows = self.spark.createDataFrame([(i, x.get("id"), x.get("name")) for i, x in enumerate(items)], "index long, id long, name string")
        before = self.table("decks")
        after, results = mutate.upsert_decks(rows, before, self._next("decks", "deck_id"))
        told = [r.asDict() for r in results.orderBy("index").collect()]
        self._save(decks=after)
        moved = before.withColumnRenamed("name", "deck").join(self.table("decks"), "deck_id").select("deck", F.col("name").alias("now"))
        self._save(notes=self.table("notes").join(moved, "deck", "left").withColumn("deck", F.coalesce("now", "deck")).select(self.table("notes").columns))
        return told

    def delete_decks(self, names: list[str]) -> dict[str, str]:
        asked = self.spark.createDataFrame([(n,) for n in names], "name string")
        left, told = mutate.delete_decks(asked, self.table("decks"), self.table("cards"))
        out = {r.name: r.status for r in told.collect()}
        self._save(decks=left)
        return out

    def upsert_note_types(self, items: list[dict]) -> list[dict]:
        """Types by name: new ones are added; of known ones fields and templates are replaced by position."""
        types, out = {r["name"]: r.asDict(True) for r in self.table("types").collect()}, []
        following = max((r["type_id"] for r in types.values()), default=0) + 1
        for i, item in enumerate(items):
            try:
                old = types.get(item["name"])
                fields = [{"ord": j, "name": n} for j, n in enumerate(item["fields"])]
                templates = [{"ord": j, "name": x["name"], "front": x["front"], "back": x["back"]} for j, x in enumerate(item.get("templates", [{"name": "Card 1", "front": "{{" + item["fields"][0] + "}}", "back": ""}]))]
                if old:
                    mutate.positional_replace([f["name"] for f in old["fields"]], item["fields"])
                    mutate.positional_replace([x["name"] for x in old["templates"]], [x["name"] for x in templates])
                types[item["name"]] = {"type_id": old["type_id"] if old else following, "name": item["name"], "kind": item.get("kind", old["kind"] if old else "standard"), "fields": fields, "templates": templates, "css": item.get("css", old["css"] if old else "")}
                following += not old
                out.append({"index": i, "status": "updated" if old else "created", "id": types[item["name"]]["type_id"]})
            except (KeyError, IndexError, ValueError) as error:
                out.append({"index": i, "status": "error", "error": str(error)})
        flat = lambda entries: [tuple(e.values()) for e in entries]
        rows = [(r["type_id"], r["name"], r["kind"], flat(r["fields"]), flat(r["templates"]), r["css"]) for r in types.values()]
        self._save(types=self.spark.createDataFrame(rows, schema.NOTE_TYPES))
        return out

    def update_note_type_fields(self, name: str, ops: list[dict]) -> None:
        types = self.table("types")
        before = [f["name"] for f in sorted(types.where(F.col("name") == name).first()["fields"], key=lambda f: f["ord"])]
        after, notes = mutate.restructure(types, name, "fields", ops), mutate.rename_fields(self.table("notes"), name, before, ops)
        self._save(types=after, notes=notes)

    def update_note_type_templates(self, name: str, ops: list[dict]) -> None:
        self._save(types=mutate.restructure(self.table("types"), name, "templates", ops))

    def update_note_type_field_metadata(self, name: str, metadata: dict[str, dict]) -> None:
        """Font, size and description of fields, kept beside the types."""
        known = {f["name"] for f in self.table("types").where(F.col("name") == name).first()["fields"]}
        if unknown := set(metadata) - known:
            raise ValueError(f"no such fields: {sorted(unknown)}")
        state = State(self.spark, f"{self.folder}/field_metadata")
        ddl = "type string, field string, font string, size int, description string"
        fresh = self.spark.createDataFrame([(name, f, m.get("font"), m.get("size"), m.get("description")) for f, m in metadata.items()], ddl)
        old = state.read() if state.version() >= 0 else self.spark.createDataFrame([], ddl)
        state.write(old.join(fresh.select("type", "field"), ["type", "field"], "left_anti").unionByName(fresh))

    def find_replace_note_types(self, search: str, replacement: str, regex: bool = False, match_case: bool = True, dry_run: bool = False) -> list[dict]:
        after, told = mutate.replace_in_templates(self.table("types"), search, replacement, regex, match_case)
        out = [r.asDict() for r in told.where("replacements > 0").collect()]
        self._save(dry_run, types=after)
        return out

    def delete_note_types(self, ids: list[int]) -> dict[int, str]:
        left, told = mutate.delete_note_types(self.spark.createDataFrame([(i,) for i in ids], "type_id long"), self.table("types"), self.table("notes"))
        out = {r.type_id: r.status for r in told.collect()}
        self._save(types=left)
        return out

    # media, upkeep, packages

    def list_media(self, glob: str | None = None, limit: int = 0) -> tuple[DataFrame, int]:
        return sources.list_media(self.spark, self.media, glob, limit)

    def fetch_media(self, names: list[str]) -> DataFrame:
        return sources.fetch_media(self.spark.createDataFrame([(n,) for n in names], "name string"), self.list_media()[0])

    def store_media(self, items: dict[str, str]) -> DataFrame:
        """Store (name: base64) in the media folder; what was stored, replaced or refused."""
        checked = sources.store_media(self.spark.createDataFrame(list(items.items()), "name string, data string"), self.list_media()[0])
        return checkpoint(sources.write_media(checked, self.media))

    def delete_media(self, names: list[str]) -> DataFrame:
        """The files' verdicts; the files themselves go to the trash folder beside the media."""
        told = sources.delete_media(self.spark.createDataFrame([(n,) for n in names], "name string"), self.list_media()[0])
        jvm = self.spark._jvm
        make = jvm.org.apache.hadoop.fs.Path
        fs = make(self.media).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(make(f"{self.media}.trash"))
        verdicts = told.collect()
        for r in verdicts:
            if r.status == "deleted":
                fs.rename(make(f"{self.media}/{r.name}"), make(f"{self.media}.trash/{r.name}"))
        return self.spark.createDataFrame([tuple(r) for r in verdicts], "name string, status string")

    def collection_check(self) -> DataFrame:
        return mutate.check(sources.media_refs(self.table("notes")), self.list_media()[0])

    def collection_prune(self, *sections: str, dry_run: bool = True) -> dict[str, list]:
        cards = empty_cards(self.table("cards"), self.table("notes"), self.table("types"))
        files = self.list_media()[0] if self.media else self.spark.createDataFrame([], "name string")
        parts = mutate.prune(self.table("notes"), cards, self.table("tags"), sources.media_refs(self.table("notes")), files, sections)
        out = {name: [r[0] for r in part.collect()] for name, part in parts.items()}
        if not dry_run:
            gone = self._ids(out.get("empty_notes", []))
            self._save(notes=self.table("notes").join(gone, "note_id", "left_anti"), cards=self.table("cards").join(gone, "note_id", "left_anti"), tags=self.table("tags").where(~F.col("tag").isin(out.get("unused_tags", []))))
            if out.get("unused_media"):
                self.delete_media(out["unused_media"])
        return out

    def export_package(self, folder: str, deck: str | None = None, ids: list[int] | None = None) -> int:
        return sources.export_package(self.table("notes"), folder, deck, self._ids(ids) if ids is not None else None)

    def import_package(self, folder: str, policy: str = "if_newer") -> dict[str, int]:
        merged, counts = sources.import_package(self.table("notes"), self.spark.read.parquet(folder), policy)
        out = {r.bucket: r.n for r in counts.collect()}
        self._save(notes=merged.select(self.table("notes").columns))
        return out


def list_profiles(registry: dict[str, str]) -> list[tuple[str, str]]:
    """Named collections and their folders, by name."""
    return sorted(registry.items())
