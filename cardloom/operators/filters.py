"""Structured filters over notes, and a small language for them."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import col


def in_deck(deck: str, name: Column | str = "deck") -> Column:
    """The deck itself or one below it; the case doesn't matter."""
    low, own = F.lower(col(name)), deck.lower()
    return (low == own) | low.startswith(own + "::")


def has_tag(tag: str, tags: Column | str = "tags") -> Column:
    """The tag itself or one below it; ``*`` stands for anything; the case doesn't matter."""
    own = tag.lower()
    if "*" in own:
        pattern = "^" + ".*".join(map(re.escape, own.split("*"))) + "(::.*)?$"
        return F.exists(col(tags), lambda t: F.lower(t).rlike(pattern))
    return F.exists(col(tags), lambda t: (F.lower(t) == own) | F.lower(t).startswith(own + "::"))


def cutoff(text: str) -> datetime:
    """ISO 8601; without a zone it is UTC."""
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def list_notes(notes: DataFrame, deck: str | None = None, tags: list[str] | None = None, note_type: str | None = None, ids: list[int] | None = None, modified_since: str | None = None, limit: int = 0, with_fields: bool = True) -> tuple[DataFrame, int]:
    """Notes that pass all filters, by id, and their number before the limit (0: none).

    Ids alone: the first ``limit`` of them, and their number is that of the notes returned. A tag with ``-`` before it must
    be missing. At least one filter is needed.
    """
    if not any((deck, tags, note_type, ids, modified_since)):
        raise ValueError("at least one filter is needed")
    only_ids = ids and not any((deck, tags, note_type, modified_since))
    if ids:
        ids = ids[:limit] if only_ids and limit else ids
        notes = notes.where(F.col("note_id").isin(ids)) if len(ids) <= 500 else notes.join(notes.sparkSession.createDataFrame([(i,) for i in set(ids)], "note_id long"), "note_id", "left_semi")
    if deck:
        notes = notes.where(in_deck(deck))
    for tag in tags or []:
        notes = notes.where(~has_tag(tag[1:]) if tag.startswith("-") else has_tag(tag))
    if note_type:
        notes = notes.where(F.col("note_type") == note_type)
    if modified_since:
        notes = notes.where(F.col("modified") >= F.lit(cutoff(modified_since)))
    total = notes.count()
    out = notes if with_fields else notes.withColumn("fields", F.lit(None).cast(notes.schema["fields"].dataType))
    out = out.orderBy("note_id")
    return (out.limit(limit) if limit and not only_ids else out), total


def resolve_deck(reference: str, decks: DataFrame) -> DataFrame:
    """(name): ``#digits`` is an id or nothing; bare digits an id if there is one, else a name; the rest a name."""
    number = reference[1:] if reference.startswith("#") else reference
    literal = decks.sparkSession.createDataFrame([(reference,)], "name string")
    if not number.isdigit():
        return literal
    found = decks.where(F.col("deck_id") == int(number)).select("name").limit(1)
    return found if reference.startswith("#") or found.count() else literal


def scope_of(notes: DataFrame, deck: str | None = None, tags: list[str] | None = None) -> DataFrame | None:
    """(note_id) of the notes in a deck with all tags, to be shared by all signals of a search; None for no scope."""
    if deck is None and not tags:
        return None
    if deck is not None:
        notes = notes.where(in_deck(deck))
    for tag in tags or []:
        notes = notes.where(~has_tag(tag[1:]) if tag.startswith("-") else has_tag(tag))
    return notes.select("note_id")


class QueryError(ValueError):
    """A query that can't be read."""


_TOKEN = re.compile(r"\s*(?:(\()|(\))|(-)|((?:[A-Za-z_]+:)?\"(?:[^\"\\]|\\.)*\"|[^\s()\"]+))")
_PROP = re.compile(r"^(ivl|due|reps|lapses|ease)(<=|>=|!=|=|<|>)(-?\d+(?:\.\d+)?)$")


def parse_query(text: str, now: Column | None = None) -> Column:
    """A query of terms, ``OR``, ``-`` and brackets as a condition on notes.

    Terms: ``deck: tag: note: nid: cid: is: prop: added: rated: flag:`` and bare text (a substring of any field). ``is:``
    and ``prop:`` read the columns queue, card_ids, flags and of card properties, where notes have them.
    """
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read {text[at:]!r}")
        tokens.append(next((kind, m[i]) for i, kind in ((1, "("), (2, ")"), (3, "-"), (4, "term")) if m[i]))
        at = m.end()
    if not tokens:
        raise QueryError("an empty query")
    now = F.current_timestamp() if now is None else now
    place = 0

    def peek() -> tuple[str, str] | None:
        return tokens[place] if place < len(tokens) else None

    def either() -> Column:
        nonlocal place
        out = every()
        while (t := peek()) and t[0] == "term" and t[1].lower() == "or":
            place += 1
            out = out | every()
        return out

    def every() -> Column:
        nonlocal place
        out = one()
        while (t := peek()) and t[0] != ")" and not (t[0] == "term" and t[1].lower() == "or"):
            if t[0] == "term" and t[1].lower() == "and":
                place += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal place
        t = peek()
        if t is None or t[0] == ")" or t[0] == "term" and t[1].lower() in ("or", "and"):
            raise QueryError(f"a term is missing in {text!r}")
        place += 1
        if t[0] == "-":
            return ~F.coalesce(one(), F.lit(False))
        if t[0] == "(":
            inner = either()
            if (end := peek()) is None or end[0] != ")":
                raise QueryError(f"a bracket isn't closed in {text!r}")
            place += 1
            return inner
        return _term(t[1], now)

    out = either()
    if peek():
        raise QueryError(f"a bracket too many in {text!r}")
    return out


def _term(term: str, now: Column) -> Column:
    m = re.match(r"^([A-Za-z_]+):(.*)$", term, re.S)
    unquote = lambda s: re.sub(r"\\(.)", r"\1", s[1:-1]) if len(s) > 1 and s[0] == s[-1] == '"' else s
    if not m:
        needle = unquote(term).lower()
        return F.exists("fields", lambda f: F.contains(F.lower(f["value"]), F.lit(needle)))
    key, value = m[1].lower(), unquote(m[2])
    if not value:
        raise QueryError(f"{key}: has no value")
    ids = lambda: [int(x) if x.strip().isdigit() else _bad(term) for x in value.split(",")]
    days = lambda: int(value) if value.isdigit() else _bad(term)
    if key == "deck":
        return F.lit(True) if value == "*" else in_deck(value)
    if key == "tag":
        return (F.size("tags") == 0) if value == "none" else has_tag(value)
    if key == "note":
        return F.lower("note_type") == value.lower()
    if key == "nid":
        return F.col("note_id").isin(ids())
    if key == "cid":
        return F.arrays_overlap("card_ids", F.array(*(F.lit(i).cast("long") for i in ids())))
    if key == "is" and value in ("due", "new", "learn", "review", "suspended", "buried"):
        return F.col("queue") == value
    if key == "prop" and (p := _PROP.match(value)):
        number = float(p[3])
        c = F.col(p[1])
        return {"<=": c <= number, ">=": c >= number, "!=": c != number, "=": c == number, "<": c < number, ">": c > number}[p[2]]
    if key in ("added", "rated"):
        return F.col("created" if key == "added" else "reviewed") >= F.date_sub(F.to_date(now), days() - 1).cast("timestamp")
    if key == "flag":
        return F.col("flag") == days()
    return _bad(term)


def _bad(term: str):
    raise QueryError(f"can't read the term {term!r}")


def collection_query(notes: DataFrame, query: str, limit: int = 0) -> tuple[DataFrame, int]:
    """Notes that a query finds, by id, and their number before the limit."""
    found = notes.where(parse_query(query))
    out = found.orderBy("note_id")
    return (out.limit(limit) if limit else out), found.count()
