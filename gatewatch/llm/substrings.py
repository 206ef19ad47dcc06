"""Substring deduplication with suffix automata of reference shards.

A word goes if it lies in a run of WINDOW words that also starts in a document
with a smaller id.  Each window picks an anchor, its least gram of ANCHOR
words, so equal windows pick equal anchors.  Per anchor the least document
that has it is the reference.  References are sharded by document; a shard's
suffix automaton is built once in every task that needs it (copied to several
tasks where many documents meet one reference), and the other documents' runs
stream through it: matching statistics of WINDOW words or more are removed.

Sending every automaton to every document would take time by the square of
the corpus; anchors route a document's runs to the shards that can match them.
What a reference does not have may still be shared by later documents in
another context; those windows are settled among themselves by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.tables import free, sized, stash
from gatewatch.llm.text import batches, grams, lists, raw, word_hashes

WINDOW = 50
ANCHOR = 10
#: Words that stream through one copy of a reference's automaton, and how many times its own words these are at least.
STREAM, OWN = 65_536, 4


class SuffixAutomaton:
    """Of word sequences, one after the other; a match never spans two of them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, words: list[int]) -> None:
        self.last = 0
        for w in words:
            self.last = self._step(w)

    def _step(self, w: int) -> int:
        next_, link, length, p = self.next, self.link, self.length, self.last
        if w in next_[p]:  # a sequence before this one went the same way
            q = next_[p][w]
            return q if length[q] == length[p] + 1 else self._split(p, q, w)
        cur = len(next_)
        next_.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and w not in next_[p]:
            next_[p][w] = cur
            p = link[p]
        if p >= 0:
            q = next_[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: int) -> int:
        next_, link, length = self.next, self.link, self.length
        clone = len(next_)
        next_.append(dict(next_[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and next_[p].get(w) == q:
            next_[p][w] = clone
            p = link[p]
        return clone

    def statistics(self, words: list[int]) -> np.ndarray:
        """Length of the longest match that ends at each word."""
        next_, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for w in words:
            while w not in next_[state] and state:
                state = link[state]
                n = length[state]
            if (to := next_[state].get(w)) is not None:
                state, n = to, n + 1
            else:
                n = 0
            out.append(n)
        return np.array(out, np.int64)


def anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and the place of each window's anchor."""
    g = grams(hashes, anchor)
    width = window - anchor + 1
    if len(hashes) < window:
        return g, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    step = 65_536  # windows at once
    least = [view[i : i + step].argmin(1) + np.arange(i, min(i + step, len(view))) for i in range(0, len(view), step)]
    return g, np.concatenate(least)


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """[start, end) of equal values that follow each other."""
    cut = np.flatnonzero(np.diff(flags)) + 1
    return zip([0, *cut.tolist()], [*cut.tolist(), len(flags)], strict=True)


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _summary(window: int, anchor: int) -> Callable:
    names = ["doc_id", "of", "key", "n_words", "sha256", "grams"]

    def run(it):
        for b in batches(it):
            rows, found = [], []
            hashes, ends = word_hashes(b, "text")
            for i, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), raw(b, "text"), strict=True)):
                words = (text or b"").split()
                g, at = anchors(hashes[ends[i] : ends[i + 1]], window, anchor)
                found.append(np.unique(g[np.unique(at)]).view(np.int64))
                rows.append((doc_id, _key(words), len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            ids, keys, n, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column("of"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), lists(found, pa.int64())], names)

    return run


def _segments(window: int, anchor: int) -> Callable:
    """Runs of windows that have the same reference, as word hashes; role 0: the reference's own."""
    names = ["ref", "role", "doc_id", "of", "start", "words"]

    def run(it):
        for b in batches(it, 64):
            rows = []
            shared = b.column("shared")
            every, ends = word_hashes(b, "text")
            for i, (doc_id, of_text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("of").to_pylist(), strict=True)):
                pairs = shared[i].values
                gram = pairs.field("gram").to_numpy(zero_copy_only=False).view(np.uint64)
                ref = pairs.field("ref").to_numpy(zero_copy_only=False)
                order = np.argsort(gram)
                gram, ref = gram[order], ref[order]
                hashes = every[ends[i] : ends[i + 1]]
                g, at = anchors(hashes, window, anchor)
                if not len(at):
                    continue
                own = g[at]
                found = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
                of = np.where(gram[found] == own, ref[found], np.iinfo(np.int64).min)
                for x, y in _runs(of):
                    if of[x] != np.iinfo(np.int64).min:
                        rows.append((int(of[x]), int(of[x] != doc_id), doc_id, of_text, x, hashes[x : y + window - 1].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    return run


def _matched(window: int) -> Callable:
    """Rows come by reference, its own runs first."""
    names = ["doc_id", "of", "start", "stop", "window"]

    def run(it):
        at, automaton = None, SuffixAutomaton()
        for b in batches(it, 256):
            ids, texts, starts, stops, windows = [], [], [], [], []
            for ref, salt, role, doc_id, of, start, words in zip(*(b.column(c).to_pylist() for c in ("ref", "salt", "role", "doc_id", "of", "start", "words")), strict=True):
                if (ref, salt) != at:
                    at, automaton = (ref, salt), SuffixAutomaton()
                hashes = np.frombuffer(words, np.uint64)
                if role == 0:
                    automaton.add(hashes.tolist())
                    continue
                hit = automaton.statistics(hashes.tolist())[window - 1 :] >= window
                for x, y in _runs(hit):
                    if hit[x]:
                        ids.append(doc_id)
                        texts.append(of)
                        starts.append(start + x)
                        stops.append(start + y + window - 1)
                        windows.append(None)
                miss = np.flatnonzero(~hit)
                if len(miss):
                    ids += [doc_id] * len(miss)
                    texts += [of] * len(miss)
                    starts += (start + miss).tolist()
                    stops += (start + miss + window).tolist()
                    windows += grams(hashes, window)[miss].view(np.int64).tolist()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, texts, starts, stops, windows)], names)

    return run


def _removed(it):
    for b in batches(it, 64):
        rows = []
        spans = b.column("spans")
        for i, text in enumerate(raw(b, "text")):
            words = (text or b"").split()
            edge = np.zeros(len(words) + 1, np.int64)
            own = spans[i].values
            start, stop = (own.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            np.add.at(edge, np.minimum(start, len(words)), 1)
            np.add.at(edge, np.minimum(stop, len(words)), -1)
            stays = np.cumsum(edge[:-1]) == 0
            left = [words[j] for j in np.flatnonzero(stays).tolist()]
            rows.append((len(words) - len(left), b" ".join(left).decode(errors="replace")))
        n, kept = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("of"), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "of", "n_removed", "kept"])


def repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept: the text left, where words were removed.

    docs: doc_id, text; other columns are not looked at.  A null text has no
    words.  Texts of any length are read whole; a reference's automaton is of
    the runs that others share with it, some 600 bytes a word.  Equal windows
    count for the least doc_id.  Texts that share a doc_id
    do not remove each other's words, as neither id is smaller; of equal rows
    each gives a row.  A row without doc_id keeps all its words and removes
    none elsewhere.  An empty table gives no rows.
    """
    # of: which of the texts with this doc_id
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("of"))
    summary = stash(docs.mapInArrow(_summary(window, anchor), "doc_id long, of long, key binary, n_words long, sha256 string, grams array<long>"), "summary")
    long = (F.col("n_words") >= window) & F.col("doc_id").isNotNull()
    # written, so that the join can split a large group of copies
    firsts = stash(summary.where(long).groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("key", "first"), "firsts")
    rows = stash(summary.join(sized(firsts), "key", "left").select("doc_id", "of", "n_words", "sha256", "grams", F.coalesce("first", F.when(long, F.col("doc_id"))).alias("first")), "rows")
    free(summary, firsts)
    # whole copies of a smaller document go entirely and are no references: the first copy has the same windows
    marks = rows.where(F.col("doc_id") == F.col("first")).select("doc_id", "of", F.explode("grams").alias("gram"))
    shared = marks.groupBy("gram").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("z")).where("ref < z").select("gram", "ref")
    per_doc = marks.join(shared, "gram").groupBy("doc_id", "of").agg(F.collect_set(F.struct("gram", "ref")).alias("shared"))
    candidates = stash(docs.join(per_doc, ["doc_id", "of"]), "candidates")

    runs = stash(candidates.mapInArrow(_segments(window, anchor), "ref long, role int, doc_id long, of long, start long, words binary"), "runs")
    of_role = lambda role: F.sum(F.when(F.col("role") == role, F.length("words") / 8).otherwise(0))
    # building a copy stays a small part of what it is built for
    wide = runs.groupBy("ref").agg(F.ceil(of_role(1) / F.greatest(F.lit(STREAM), OWN * of_role(0))).cast("int").alias("copies"))
    spread = runs.join(sized(stash(wide.where("copies > 1"), "wide")), "ref", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    salt = F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "of", "start"), F.col("copies")).cast("int")))
    dealt = spread.withColumn("salt", F.explode(salt)).drop("copies").repartition("ref", "salt").sortWithinPartitions("ref", "salt", "role", "doc_id", "of", "start")
    found = stash(dealt.mapInArrow(_matched(window), "doc_id long, of long, start long, stop long, window long"), "matched")

    free(runs)
    rest = found.where("window is not null")
    also = rest.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("z")).where("least < z").select("window", "least")
    spans = found.where("window is null").select("doc_id", "of", "start", "stop").unionByName(rest.join(also, "window").where("doc_id > least").select("doc_id", "of", "start", "stop"))
    # windows that start within a window's length leave no gap between them
    spans = spans.groupBy("doc_id", "of", F.floor(F.col("start") / window)).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("doc_id", "of").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = candidates.select("doc_id", "of", "text").join(spans, ["doc_id", "of"]).mapInArrow(_removed, "doc_id long, of long, n_removed long, kept string")
    cut = cut.dropDuplicates(["doc_id", "of"])

    out = rows.drop("grams").join(cut, ["doc_id", "of"], "left")
    copy = F.col("doc_id") > F.col("first")
    kept = F.when(copy, "").otherwise(F.col("kept"))
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(kept.isNull(), F.col("sha256")).otherwise(F.sha2(kept, 256)).alias("kept_sha256"), kept.alias("kept"),
    )
