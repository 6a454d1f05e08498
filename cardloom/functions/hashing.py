"""Fingerprints of notes and keys of tags."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.text import col


def blake2b8(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


@F.pandas_udf(T.StringType())
def blake2b8_hex(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else blake2b8(t))


@F.pandas_udf(T.LongType())
def tag_key(tag: pd.Series) -> pd.Series:
    return tag.map(lambda t: None if t is None else int(blake2b8(t), 16) & (1 << 63) - 1)


def note_payload(text: Column | str, images: Column | str | None = None, ocr: Column | str | None = None) -> Column:
    """What a note's fingerprint is taken of: its text, then its sorted recognised texts, then its sorted images."""
    out = F.coalesce(col(text), F.lit(""))
    for mark, part in (("\x1e", ocr), ("\x1f", images)):
        if part is not None:
            some = F.size(F.coalesce(col(part), F.array().cast("array<string>"))) > 0
            out = F.when(some, F.concat(out, F.lit(mark), F.array_join(F.array_sort(col(part)), mark))).otherwise(out)
    return out


def image_payload(images: Column | str) -> Column:
    return F.concat(F.lit("\x1fimg\x1f"), F.array_join(F.array_sort(col(images)), "\x1f"))
