"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its hashed word shingles.  Shingles that many sets
hold form the frequent class; all others are rare.  Tokens are ordered rare
class first, by hash within a class.  With similarity t/100 a set of n tokens
misses at most d = (100 - t) * n / 100 tokens of a partner, so a prefix of
d + 1 rare tokens shares a rare token with every partner's prefix.  Where a
set has only r <= d rare tokens, the prefix is extended by frequent tokens and
indexes combinations of two that follow each other: a missing token destroys
two of them at most and a token of the partner's own one, so 2 * (d - r) + 2
combinations leave one in common.  Candidates are then verified exactly.

Exact copies are one class from the start.  A bucket emits links to its least
member only.  Members of different components that still share a bucket are
compared in a last round, so no link is lost: pair by pair in small buckets;
in large ones by their differences from the bucket's least member, block
against block, so that near misses of a large group never become rows.

Two sets share no more tokens than the shorter of their rests from their first
common token on, so a pair is taken up only in buckets whose token stands early
enough in both; of buckets with the same members only the first token's is
looked at, as it is the first that these members share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.graph import components
from gatewatch.llm.tables import free, sized, stash
from gatewatch.llm.text import batches, grams, lists, word_hashes

#: Tokens that are counted together inside a task.
BLOCK = 2_000_000
#: Sets that must hold a token for it to be frequent; the class has LARGEST tokens at most, the commonest.
FREQUENT = 32
LARGEST = 400_000

#: Sets are first compared by their tokens' counts in 2 to this power bins.
BIN_BITS = 9
#: Buckets of more members than this are compared as families.
SMALL = 32
#: Members and bytes of a family's block; two blocks are in one task.
TOGETHER = 1000
TOGETHER_BYTES = 16_000_000


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The set, ascending.  Fewer than k words: the whole sequence as one; none: empty."""
    if 0 < len(hashes) < k:
        return grams(hashes, len(hashes))
    return np.unique(grams(hashes, k))


def _sets(it: Iterator[pa.RecordBatch], k: int):
    for b in batches(it):
        hashes, ends = word_hashes(b, "text", lower=True)
        every = grams(hashes, k)
        for doc_id, x, y in zip(b.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield doc_id, np.unique(every[x : y - k + 1]) if y - x >= k else shingles(hashes[x:y], k)


def _repeated(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tokens, counts = np.unique(np.concatenate(block), return_counts=True)
    return tokens[counts > 1], counts[counts > 1]


def _summary(k: int) -> Callable:
    """Per set its size, fingerprint and counts in bins; per block of sets the tokens that come up more than once."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(it):
        block, held, rows = [], 0, []

        def out(rows, tokens=(), counts=()):
            none = [None] * len(tokens)
            columns = [[*c, *none] for c in (zip(*rows, strict=True) if rows else [()] * 4)]
            columns += [[*[None] * len(rows), *c] for c in (tokens, counts)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n", "key", "bins", "token", "count"])

        for doc_id, own in _sets(it, k):
            rows.append((doc_id, len(own), xxhash.xxh3_128_digest(own.tobytes()), _in_bins(own).tobytes()))
            block.append(own)
            held += len(own)
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
            if held >= BLOCK:
                yield out([], *[x.view(np.int64).tolist() for x in _repeated(block)])
                block, held = [], 0
        yield out(rows)
        if block:
            yield out([], *[x.view(np.int64).tolist() for x in _repeated(block)])

    return run


def signatures(own: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Prefix signatures of an ascending set, and how many of them are single tokens; common: the frequent class, ascending."""
    n = len(own)
    d = (100 - percent) * n // 100
    at = np.searchsorted(common, own)
    frequent = at < len(common)
    frequent[frequent] = common[at[frequent]] == own[frequent]
    rare = own[~frequent][: d + 1]
    if len(rare) == d + 1:
        return rare, d + 1
    many = own[frequent][: 2 * (d - len(rare)) + 3]
    return np.concatenate([rare, grams(many, 2)]), len(rare)


def _signed(k: int, percent: int, common) -> Callable:
    names = ["doc_id", "n", "singles", "sigs"]

    def run(it):
        known = common.value
        rows, out = [], []

        def batch():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, lists(out, pa.int64())], names)

        for doc_id, own in _sets(it, k):
            sigs, singles = signatures(own, known, percent) if len(own) else (own, 0)
            rows.append((doc_id, len(own), singles))
            out.append(sigs.view(np.int64))
            if len(rows) == 2000:
                yield batch()
                rows, out = [], []
        if rows:
            yield batch()

    return run


def _tokens(k: int) -> Callable:
    def run(it):
        for doc_id, own in _sets(it, k):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["doc_id", "n", "tokens"])

    return run


def _in_bins(own: np.ndarray) -> np.ndarray:
    """Tokens of an ascending set by their first bits, counted."""
    counts = np.bincount((own >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=1 << BIN_BITS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32)


def _read_bins(sent: bytes) -> np.ndarray:
    return np.frombuffer(sent, np.uint8 if len(sent) == 1 << BIN_BITS else np.uint32)


def _compared(percent: int, short: bool) -> Callable:
    """Whether two sets can be near enough (from their counts in bins) or are (from whole tokens)."""

    def run(it):
        for b in it:
            keep = []
            for x, y, n_x, n_y in zip(*(b.column(c).to_pylist() for c in ("x", "y", "n_x", "n_y")), strict=True):
                if short:  # a bin shares no more than its lesser count
                    both = int(np.minimum(_read_bins(x), _read_bins(y)).sum(dtype=np.int64))
                else:
                    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * (n_x + n_y - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: a, b and more; sets: doc_id, n, tokens.  The pairs with n_x and x, n_y and y: sizes and tokens of both sets."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_x"), F.col("tokens").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_y"), F.col("tokens").alias("y"))
    return pairs.join(y, "b").join(x, "a")


def _whole(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """A written table of the whole sets that pairs a, b name: doc_id, n, tokens."""
    ids = stash(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    sets = stash(docs.join(sized(ids), "doc_id", "left_semi").mapInArrow(_tokens(k), "doc_id long, n long, tokens binary"), "sets")
    free(ids)
    return sets


def verify(pairs: DataFrame, bins: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs: a, b.  Those whose sets are near enough; counts in bins rule most others out before whole sets move."""
    near = lambda pairs, sets, short: stash(_beside(pairs, sets).mapInArrow(_compared(percent, short), "a long, b long, linked boolean").where("linked").select("a", "b").distinct(), "near")
    may = near(pairs, bins, True)
    sets = _whole(may, docs, k)
    links = near(may, sets, False)
    free(may, sets)
    return links


def _apart(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one of the two sets holds and the other lacks, ascending."""
    for b in it:
        own = [np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).tobytes() for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("part"), b.column("n_y"), pa.array(own, pa.binary())], ["a", "rep", "part", "n", "apart"])


def near_in_family(n: np.ndarray, part: np.ndarray, apart: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places of near sets that join the parts, as few as do so.

    apart: how each set differs from one and the same set.  Two sets differ by
    what these differ by, so they share (n_x - d_x + n_y - d_y) / 2 + c tokens,
    d being the sizes of the differences and c what the differences share.
    """
    d = np.array([len(x) for x in apart], np.int64)
    weight = (100 + percent) * (n - d) - 2 * percent * n
    _, token = np.unique(np.concatenate(apart), return_inverse=True)
    holder = np.repeat(np.arange(len(n)), d)
    order = np.argsort(token, kind="stable")
    holders, begins = holder[order], np.searchsorted(token[order], np.arange(token.max() + 2)) if len(token) else np.zeros(1, np.int64)
    ends = np.concatenate([[0], np.cumsum(d)])
    label, links = part.copy(), []
    for i in range(len(n)):
        own = token[ends[i] : ends[i + 1]]
        lengths = begins[own + 1] - begins[own]
        at = np.repeat(begins[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(holders[at], minlength=len(n))
        for j in np.flatnonzero((weight[i] + weight + 2 * (100 + percent) * both >= 0) & (label != label[i])):
            if label[j] != label[i]:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


def _family(percent: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        n, part, rep = (table.column(c).to_numpy() for c in ("n", "part", "rep"))
        links = near_in_family(n, part, [np.frombuffer(x, np.uint64) for x in table.column("apart").to_pylist()], percent)
        return pa.table({"a": pa.array([int(rep[i]) for i, _ in links], pa.int64()), "b": pa.array([int(rep[j]) for _, j in links], pa.int64())})

    return run


def _possible(percent: int) -> Callable:
    """Members that may be near one of another part, by counts in bins."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        n, part = table.column("n").to_numpy(), table.column("part").to_numpy()
        bins = np.stack([_read_bins(x) for x in table.column("tokens").to_pylist()])
        last = np.searchsorted(n, n * 100 // percent, side="right")
        found = np.zeros(len(n), bool)
        for i in range(len(n)):
            rest = slice(i + 1, last[i])
            both = np.minimum(bins[rest], bins[i]).sum(axis=1, dtype=np.int64)
            hit = (part[rest] != part[i]) & (100 * both >= percent * (n[i] + n[rest] - both))
            found[rest] |= hit
            found[i] |= hit.any()
        return table.select(["a", "rep", "part"]).filter(pa.array(found))

    return run


def _met(members: DataFrame, carried: str) -> DataFrame:
    """Members dealt into blocks of bounded rows and bytes of ``carried``, for every two blocks of one a: groups a, i, j."""
    blocks = members.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / TOGETHER, F.sum(F.length(carried)) / TOGETHER_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "a").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "part", "n", carried)


def families(members: DataFrame, bins: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """members: a, b, part.  Links between near sets b, of different parts, beside the same a: a, b.

    Counts in bins leave the members that may have a partner; these travel as
    their difference from a's set.
    """
    binned = stash(members.withColumnRenamed("b", "rep").join(bins.withColumnRenamed("doc_id", "rep"), "rep"), "binned")
    may = _met(binned, "tokens").groupBy("a", "i", "j").applyInArrow(_possible(percent), "a long, rep long, part long")
    may = stash(may.distinct().withColumnRenamed("rep", "b"), "may")
    sets = _whole(may, docs, k)
    apart = stash(_beside(may, sets).mapInArrow(_apart, "a long, rep long, part long, n long, apart binary"), "apart")
    found = stash(_met(apart, "apart").groupBy("a", "i", "j").applyInArrow(_family(percent), "a long, b long").distinct(), "family-links")
    free(binned, may, sets, apart)
    return found


def _enough(rest: Column, n_x: Column, n_y: Column, percent: int) -> Column:
    """Whether sets of these sizes that share ``rest`` tokens are near."""
    return F.lit(100 + percent) * rest >= F.lit(percent) * (n_x + n_y)


def within(left: DataFrame, percent: int) -> DataFrame:
    """left: sig, rep, part, n, place of buckets of SMALL members at most.  Pairs of different parts that can be near: a, b.

    place: tokens of the set before the bucket's; -1 for combinations, which may stand anywhere.
    """
    lists = left.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("rep", "part", "n", "place"))).alias("m"))
    first = F.col("m")[0]["place"]
    lists = lists.groupBy(F.transform("m", lambda x: x["rep"]).alias("reps"), (first >= 0).alias("single")).agg(F.min_by("m", first).alias("m"))
    rest = lambda x: x["n"] - F.greatest(x["place"], F.lit(0))
    like = lambda x, y: (x["rep"] < y["rep"]) & (x["part"] != y["part"]) & _enough(F.least(rest(x), rest(y)), x["n"], y["n"], percent)
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: like(x, y)), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, copy_of (least doc_id with an equal set), component_id.

    docs: doc_id, text; other columns are not looked at.  Sets without shingles
    (null, empty or blank texts) link with nothing.  Rows that share a doc_id
    are one node, their sets being taken from equal rows; a repeated row gives
    a repeated result row.  A null doc_id is linked with nothing.  A text of
    any length is one set in memory, 8 bytes a word.  An empty table gives no
    rows.  Nothing depends on the order of rows: ties are of equal sets, and of
    these the least doc_id stands for all.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = stash(docs.mapInArrow(_summary(k), "doc_id long, n long, key binary, bins binary, token long, count long"), "summary")
    sets = found.where("n is not null").select("doc_id", "n", "key")
    # pre-aggregated: a large group of copies is one row for each task; written, so that the join can split it
    firsts = stash(sets.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")).where("copies > 1").select("key", "copy_of"), "firsts")
    member = stash(sets.join(sized(firsts), "key", "left").select("doc_id", "n", F.coalesce("copy_of", "doc_id").alias("copy_of")), "members")
    reps = stash(member.where("n > 0 and doc_id = copy_of").select("doc_id", "n").distinct(), "reps")
    bins = found.where("n > 0").select("doc_id", "n", F.col("bins").alias("tokens"))
    free(firsts)

    often = found.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT)
    common = np.sort(np.array([r.token for r in often.orderBy(F.desc("count"), "token").limit(LARGEST).select("token").collect()], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(common)  # 8 bytes * LARGEST at most
    signed = stash(docs.mapInArrow(_signed(k, percent, sent), "doc_id long, n int, singles int, sigs array<long>"), "signed")
    sigs = signed.join(sized(reps.select("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", "singles", F.posexplode("sigs").alias("place", "sig"))
    sigs = sigs.select("sig", "rep", "n", F.when(F.col("place") < F.col("singles"), F.col("place")).otherwise(-1).alias("place"))
    shared = stash(sigs.groupBy("sig").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("sig", "a"), "shared")
    buckets = stash(sigs.join(shared, "sig"), "buckets")
    free(signed, shared)
    tried = buckets.where("rep > a").join(sized(reps.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"))), "a")
    tried = tried.where(_enough(F.least("n_a", F.col("n") - F.greatest("place", F.lit(0))), F.col("n"), F.col("n_a"), percent))
    tried = stash(tried.select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = verify(tried, bins, docs, k, percent)
    label = stash(components(links), "labels")

    # members of different components in one bucket; the least member has been compared with the others
    placed = buckets.where("rep != a").join(label, F.col("rep") == F.col("node"), "left").select("sig", "a", "rep", "n", "place", F.coalesce("component_id", "rep").alias("part"))
    split = stash(placed.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("members")).where("p < q").select("sig", "members"), "split")
    left = stash(placed.join(split, "sig"), "left")
    free(buckets, split)
    rest = stash(within(left.where(F.col("members") <= SMALL), percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = verify(rest, bins, docs, k, percent)
    many = stash(left.where(F.col("members") > SMALL).select("a", F.col("rep").alias("b"), "part").distinct(), "families")
    free(left, rest, tried)
    if not many.isEmpty():
        more = stash(more.unionByName(families(many, bins, docs, k, percent)), "more")
    if not more.isEmpty():
        known = label.where("node != component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
        label = stash(components(known.unionByName(more)), "labels")
    free(many, found, reps)
    out = member.join(label, F.col("copy_of") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "copy_of", F.coalesce("component_id", "copy_of").alias("component_id"))
