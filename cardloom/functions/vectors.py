"""Vector functions as column expressions, and the deterministic synthetic embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.text import col

#: Fixed values of FNV-1a and splitmix64.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1
#: Bytes that are hashed at a time.
HASHED = 1 << 20


def inner_product(a: Column | str, b: Column | str) -> Column:
    """In double precision, terms added in order."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """A zero vector stays as it is."""
    length = F.sqrt(inner_product(v, v))
    return F.when(length > 0, F.transform(col(v), lambda x: x.cast("double") / length)).otherwise(F.transform(col(v), lambda x: x.cast("double")))


def round3(x: Column | str) -> Column:
    """Three decimals, half to even on the binary value."""
    return F.rint(col(x) * 1000) / 1000


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def fnv1a(data: bytes, state: int = FNV_OFFSET) -> int:
    for byte in data:
        state = (state ^ byte) * FNV_PRIME & _MASK
    return state


def _fnv1a_at_once(joined: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The states after texts of one byte and more that lie one after the other.

    A step is (state ^ byte) * prime, and the xor changes the state's low byte alone, by a difference. So with all low bytes
    known, the state is a sum of differences times powers of the prime. As the prime is odd, each bit of the low byte is the one
    before it, xor what the byte and the lower bits give: one running xor per bit.
    """
    prime, ends = np.uint64(FNV_PRIME), np.cumsum(sizes)
    starts = ends - sizes
    met = np.zeros(len(joined), dtype=np.uint8)  # low bytes after the xor
    for bit in range(8):
        own = joined >> bit & 1
        step = own ^ ((met * np.uint8(FNV_PRIME & 0xFF)) >> bit & 1)
        before = np.bitwise_xor.accumulate(step) ^ step
        first = before[starts] ^ (states >> np.uint64(bit) & np.uint64(1)).astype(np.uint8)
        met |= (before ^ np.repeat(first, sizes) ^ own) << bit
    powers = np.multiply.accumulate(np.full(int(sizes.max()), prime))
    left = np.repeat(ends, sizes) - np.arange(len(joined)) - 1
    change = met.astype(np.uint64) - (met ^ joined).astype(np.uint64)
    return states * powers[sizes - 1] + np.add.reduceat(change * powers[left], starts)


def fnv1a_batch(data: list[bytes]) -> list[int]:
    """``fnv1a`` of each, HASHED bytes at a time; a longer text goes on from the state of its last piece."""
    states = np.full(len(data), FNV_OFFSET, dtype=np.uint64)
    group, held = [], 0

    def hashed(group: list[tuple[int, bytes]]) -> None:
        if group:
            at = np.array([i for i, _ in group])
            states[at] = _fnv1a_at_once(np.frombuffer(b"".join(x for _, x in group), dtype=np.uint8), np.array([len(x) for _, x in group]), states[at])

    for i, text in enumerate(data):
        for low in range(0, len(text), HASHED):
            if low or held > HASHED:
                hashed(group)
                group, held = [], 0
            group.append((i, text[low : low + HASHED]))
            held += len(group[-1][1])
    hashed(group)
    return states.tolist()


def synthetic_vectors(seeds: list[int], dims: int) -> np.ndarray:
    """``synthetic_vector`` of each seed, as rows."""
    with np.errstate(over="ignore"):
        z = np.array(seeds, dtype=np.uint64).reshape(-1, 1) + np.arange(1, dims + 1, dtype=np.uint64) * np.uint64(MIX_STEP)
        z = (z ^ z >> np.uint64(30)) * np.uint64(MIX_A)
        z = (z ^ z >> np.uint64(27)) * np.uint64(MIX_B)
    v = ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / (1 << 53) * 2 - 1
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=v.copy(), where=length > 0).astype(np.float32)


def synthetic_vector(text: str, dims: int, seed: int | None = None) -> list[float]:
    """A unit vector that a text's hash seeds."""
    state, out = fnv1a(text.encode()) if seed is None else seed, []
    for _ in range(dims):
        state = (state + MIX_STEP) & _MASK
        z = (state ^ state >> 30) * MIX_A & _MASK
        z = (z ^ z >> 27) * MIX_B & _MASK
        z ^= z >> 31
        out.append((z >> 11) / (1 << 53) * 2 - 1)
    v = np.array(out)
    length = float(np.sqrt((v * v).sum()))
    return (v / length if length else v).astype(np.float32).tolist()


def synthetic_embedder(dims: int = 64):
    """The default engine: an Arrow function from texts to unit vectors. Another engine is any function of this shape."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        held = [t or "" for t in texts]
        return pd.Series(list(synthetic_vectors(fnv1a_batch([t.encode() for t in held]), dims)), index=texts.index, dtype=object)

    return embed
