"""Which cards have nothing to show: card templates compiled to column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import is_blank

_MARK = re.compile(r"\{\{\s*([#^/]?)\s*([^{}]*?)\s*\}\}")


def shown_fields(front: str) -> list[tuple[tuple[tuple[str, bool], ...], str, bool]]:
    """(conditions, field, cloze) for each field that a front shows: the fields that must be there (True) or blank (False)
    for it to be reached, and whether it is shown for its clozes. A section that isn't closed, or is closed by another name,
    is an error; filters (``hint:Field``) show their field."""
    out, open_ = [], []
    for kind, name in _MARK.findall(front or ""):
        if kind in ("#", "^"):
            open_.append((name, kind == "#"))
        elif kind == "/":
            if not open_ or open_[-1][0] != name:
                raise ValueError(f"section {name!r} isn't open here")
            open_.pop()
        elif name:
            filters, _, field = name.rpartition(":")
            out.append((tuple(open_), field.strip(), "cloze" in filters.split(":")))
    if open_:
        raise ValueError(f"section {open_[-1][0]!r} isn't closed")
    return out


def _value(name: str) -> Column:
    return F.coalesce(F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))["value"], F.lit(""))


def shows_something(front: str) -> Column:
    """Whether a front shows any field that isn't blank, or any cloze of the card's number (``ord`` from 0), of columns
    fields and ord. Text that stands in the template itself shows nothing."""
    cases = []
    for conditions, field, cloze in shown_fields(front):
        filled = F.contains(_value(field), F.concat(F.lit("{{c"), (F.col("ord") + 1).cast("string"), F.lit("::"))) if cloze else ~is_blank(_value(field))
        cases.append(reduce(lambda a, b: a & b, [~is_blank(_value(n)) if there else is_blank(_value(n)) for n, there in conditions], filled))
    return reduce(lambda a, b: a | b, cases, F.lit(False))


def empty_cards(cards: DataFrame, notes: DataFrame, types: DataFrame) -> DataFrame:
    """The cards with ``empty``: true where the front of the card's template shows nothing of its note.

    Templates are few and compiled on the driver. A cloze type's one template serves cards of all numbers; cards whose note,
    type or template isn't there aren't empty, as nothing is known of them.
    """
    shows = F.lit(True)
    for row in types.select("name", "kind", "templates").collect():
        for template in row.templates or []:
            own = (F.col("note_type") == row.name) & (F.lit(True) if row.kind == "cloze" else F.col("ord") == template.ord)
            shows = F.when(own, shows_something(template.front)).otherwise(shows)
    known = cards.join(notes.select("note_id", "note_type", "fields"), "note_id", "left")
    return known.withColumn("empty", F.coalesce(~shows, F.lit(False))).select(*cards.columns, "empty")
