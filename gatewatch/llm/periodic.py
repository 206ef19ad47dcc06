"""Periodic runs of words: a harmonic grid, and common extensions by prefix hashes.

A run of period q that is long enough repeats its words at distance q over a
stretch that no grid of that width can miss, so q needs n / width points only:
all periods together n log n.  For all pairs of a period and a point at once,
NumPy looks for the longest common extension to both sides by halving over
prefix hashes.  Hashes can only make an extension too long; the words
themselves are compared before a run counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gatewatch.llm.text import batches, raw, word_hashes

LEAST, TIMES = 24, 3
#: Pairs of a period and a grid point that are looked at together.
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The base to the power of 0 to n at least, modulo 2**64."""
    global _powers
    if len(_powers) <= n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * n, _BASE))])
    return _powers


def _longest(equal, most: np.ndarray) -> np.ndarray:
    """The largest length up to most for which equal(length) holds, for all pairs at once; equal() is true up to one and false beyond."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        good = equal(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def extended(h: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows of start, stop, period, sorted: stretches of word hashes that no neighbour extends, for any period they have."""
    n, p = len(h), powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:n])])
    period = np.arange(1, n // times + 1)
    width = np.maximum(least, times * period) - period
    points = (n - period) // width
    ends = np.cumsum(points)
    found, a = [], 0
    while a < len(period):
        done = int(ends[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        q, w = np.repeat(period[a:z], points[a:z]), np.repeat(width[a:z], points[a:z])
        at = (np.arange(len(q)) - np.repeat(ends[a:z] - points[a:z] - done, points[a:z]) + 1) * w - 1
        a = z
        # a stretch of two and more has a neighbour that agrees as well
        met = h[at] == h[at + q]
        at, q, w = at[met], q[met], w[met]
        met = (w < 2) | (h[np.maximum(at - 1, 0)] == h[np.maximum(at - 1, 0) + q]) & (at > 0) | (h[np.minimum(at + 1, n - 1 - q)] == h[np.minimum(at + q + 1, n - 1)]) & (at + q + 1 < n)
        at, q, w = at[met], q[met], w[met]
        if not len(at):
            continue
        to = at + q
        after = _longest(lambda k, at=at, q=q, to=to: (sums[at + k] - sums[at]) * p[q] == sums[to + k] - sums[to], n - to)
        before = _longest(lambda k, at=at, q=q, to=to: (sums[at] - sums[at - k]) * p[q] == sums[to] - sums[to - k], at)
        enough = after + before >= w
        if enough.any():
            found.append(np.unique(np.stack([at - before, to + after, q], axis=1)[enough], axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def runs(words: list[bytes], h: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length, period of every run, by start and period; h: hashes of the words, equal ones of equal words."""
    if len(words) < least:
        return []
    held: dict[tuple[int, int], int] = {}
    for start, stop, q in extended(h, least, times).tolist():
        if held.get((start, stop), q + 1) <= q:
            continue  # a multiple of the smallest period
        if words[start : stop - q] == words[start + q : stop]:
            held[start, stop] = q
            continue
        # different words of one hash: what is left of the stretch, word by word
        since = start
        for i in range(start, stop - q + 1):
            if i == stop - q or words[i] != words[i + q]:
                if i - since >= max(least, times * q) - q:
                    held[since, i + q] = min(q, held.get((since, i + q), q))
                since = i + 1
    return sorted((start, stop - start, q) for (start, stop), q in held.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that come after the first period of a run."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def detect(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period), collapsed (the words left, one space between).

    A run: consecutive words of smallest period q, ``least`` words and ``times``
    q at least, that no neighbouring word extends.  What follows the first q
    words of any run is left out of collapsed.

    docs: doc_id, text; other columns are not looked at.  A null or empty text
    has no runs and an empty rest.  Whole texts of any length are looked at, in
    time n log**2 n and memory of a few numbers a word.  Of runs that share
    words each is given.  Repeated rows each give a row; an empty table none.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            hashes, ends = word_hashes(b, "text")
            every, left = [], []
            for i, text in enumerate(raw(b, "text")):
                words = (text or b"").split()
                found = runs(words, hashes[ends[i] : ends[i + 1]], least, times)
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                left.append(b" ".join(collapsed(words, found)).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(every, _RUNS), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")
