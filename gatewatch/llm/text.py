"""Words, as every operator here cuts them: maximal runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text without nulls."""
    trimmed = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


# --- inside Python tasks -------------------------------------------------

#: Entries of a task's word cache; it is emptied beyond, so memory is bounded, as longer words are not kept.
CACHE = 400_000
LONGEST = 64


class Cached(dict):
    """word -> value, filled on demand and bounded in entries and bytes."""

    def __init__(self, make: Callable, most: int = CACHE):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(word) > LONGEST:
            return self.make(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.make(word)
        return value


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes; ``bytes.split()`` cuts exactly at GAP."""
    return pc.cast(batch.column(name), pa.large_binary()).to_pylist()


_TABLE = np.random.default_rng(1).integers(0, 1 << 64, (64, 256), np.uint64, endpoint=False)
_IS_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(batch: pa.RecordBatch, name: str, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin (one more than rows).

    Tabulation hashing over bytes and their places in the word, for a whole
    batch at once; lower: A-Z as a-z.  A null text has no words.
    """
    texts = pc.cast(pc.fill_null(batch.column(name), ""), pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    b = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    gap = _IS_GAP[b]
    first = ~gap
    first[1:] &= gap[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[begins] = ~gap[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = np.flatnonzero(~gap)
    at = np.flatnonzero(first[inside])
    place = inside - np.repeat(starts, np.diff(at, append=len(inside)))
    own = b[inside]
    value = _TABLE[place & 63, _LOWER[own] if lower else own]
    far = place >= 64
    if far.any():
        value[far] *= (2 * (place[far] >> 6) + 1).astype(np.uint64)
    return mixed(np.add.reduceat(value, at)), np.searchsorted(starts, ends)


_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that order by hash is order at random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by start; none with fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n] + np.uint64(k)
        for j in range(1, k):
            out = out * _M + hashes[j : j + n]
    return mixed(out)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from arrays."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def batches(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of rows: long texts never pile up as Python objects."""
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
