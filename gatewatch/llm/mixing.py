"""Mixing sources to target weights by pivotal dependent rounding.

Each document has a fractional number of copies, its source's target over its
source's size.  Within small groups of a source two fractional documents at a
time trade words at random, each in expectation keeping its share, until one of
them is integral; a group leaves one fractional document at most, and a reserve
of a few documents of every size that it has not touched.  Residuals and
reserves meet in a reduction tree until one group per source is left.  There
the largest document trades with all smaller ones at once, then the next, so
that a source's taken words differ from its target by about half of its
smallest document.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.llm.tables import sized, stash
from gatewatch.llm.text import GAP, GAP_CHARS, fresh, whole

#: The mix has 150 % of all words, weights 3, 1, 2 by source in turn; no text more than twice.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Documents that are rounded together, on average.
GROUP = 4096
FAN = 64
#: Documents of each power of two of sizes that a group leaves to the last round.
RESERVE = 16


def size_of(text: str = "text") -> Column:
    """Number of words; null: 0."""
    trimmed = F.btrim(whole(text), F.lit(GAP_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(GAP)) + 1).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources: source, one row each, written.  Adds place, from 0, by code point, null last: sorted in ranges, counted by range."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = stash(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    counts = parts.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("own", own).join(F.broadcast(counts), "part").withColumn("place", F.col("own") + F.col("before")).drop("part", "own", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: source, source_size, perhaps more.  Adds weight and target.

    Weights go by source in code point order, null last, in turn.  The budget
    is filled like water: a source stops at ``most`` times its size, and its
    excess goes to the others by weight.  The level rises from one total over
    all sources to the next until it fills no further source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    known = stash(ranked(stash(sources, "sources")).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).drop("place"), "weights")
    budget = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        left = known.agg(F.sum(F.when(full, F.col("cap"))).alias("filled"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        higher = (budget - (left.filled or 0.0)) / left.weight if left.weight else math.inf
        if higher <= level or left.weight is None:
            break
        level = higher
    level = math.inf if not left.weight else level
    return known.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("cap")


def chance(seed: int, *ids: object) -> float:
    return xxhash.xxh64_intdigest(repr(ids).encode(), seed) / 2.0**64


def pivotal(items: list[tuple[object, int, float]], seed: int) -> tuple[list[int | None], tuple[int, float] | None]:
    """Round fractions of copies; items: (id, size, fraction), in the order to pair them.

    Returns 0 or 1 per item, None for the one left fractional, and that item's
    place and fraction.
    """
    out: list[int | None] = [None] * len(items)
    held: tuple[int, float] | None = None
    for i, (_, size, p) in enumerate(items):
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[i] = int(p > 0.5)
            continue
        if held is None:
            held = i, p
            continue
        j, q = held
        other = items[j][1]
        up = min((1 - q) * other, p * size)  # words that j can win from i
        down = min(q * other, (1 - p) * size)
        if chance(seed, items[j][0], items[i][0]) * (up + down) < down:
            q, p, full_j, moved = q + up / other, p - up / size, True, up == (1 - q) * other
        else:
            q, p, full_j, moved = q - down / other, p + down / size, False, down == q * other
        if moved:  # j is integral now
            out[j] = int(full_j)
            held = i, p
        else:
            out[i] = int(not full_j)
            held = j, q
        if held[1] <= 1e-12 or held[1] >= 1 - 1e-12:
            out[held[0]] = int(held[1] > 0.5)
            held = None
    return out, held


def settled(items: list[tuple[object, int, float]], seed: int) -> list[int]:
    """Round all fractions; items: (id, size, fraction), the largest first.

    Each trades with all that are smaller at once; what they cannot give or
    take any more is rounded to the nearer side.
    """
    size, part = np.array([s for _, s, _ in items], float), np.array([p for _, _, p in items])
    for i in range(len(items)):
        words, rest = size[i + 1 :], part[i + 1 :]
        give, room = float(words @ rest), float(words @ (1 - rest))
        up, down = (1 - part[i]) * size[i], part[i] * size[i]
        ways = (up <= give + 1e-6, down <= room + 1e-6)
        # at random where both ways can be paid for, else the way that leaves less unpaid
        win = chance(seed, items[i][0], "rest") < part[i] if all(ways) else up - give < down - room
        if win:
            rest *= max(0.0, 1 - up / give) if give else 0
        else:
            rest += (1 - rest) * (min(1.0, down / room) if room else 0)
        part[i] = win
    return part.astype(int).tolist()


_ITEM = "source string, id string, row long, size long, part double, bucket long, extra int"


def _round(seed: int, last: bool) -> Callable:
    def run(pdf):
        pdf = pdf.sort_values(["size", "id", "row"], ascending=[False, True, True])
        items = list(zip(zip(pdf["id"], pdf["row"].tolist(), strict=True), pdf["size"].tolist(), pdf["part"].tolist(), strict=True))
        if last:
            return pdf.assign(extra=settled(items, seed))[[x.split()[0] for x in _ITEM.split(", ")]]
        held_back = pdf.groupby(np.log2(pdf["size"]).astype(int)).cumcount() < RESERVE
        at = np.flatnonzero(~held_back.to_numpy())
        out, held = pivotal([items[i] for i in at], seed)
        parts, extra = pdf["part"].to_numpy(copy=True), np.full(len(pdf), -1)
        extra[at] = [-1 if x is None else x for x in out]
        if held:
            parts[at[held[0]]] = held[1]
        return pdf.assign(part=parts, extra=extra)[[x.split()[0] for x in _ITEM.split(", ")]]

    return run


ADDED = ("size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, carry: bool = True) -> DataFrame:
    """docs: doc_id, text, source and any others.  Adds size, source_size, target, copies, taken.

    ``copies`` is a whole number from 0 to ``most`` rounded up; ``taken`` is
    copies * size.  A null text has size 0 and nothing taken, a null source is
    a source of its own, and n equal rows get their n shares in common, whole
    copies first.  Groups depend on doc_id and a source's number of rows alone,
    so reruns agree however the input is split; ties of size go by doc_id and a
    hash of the row.  A text of any length is one row; only its size is looked
    at.  An empty table gives no rows.  Columns of the input named as the added
    ones are replaced, all others are kept; without ``carry`` only doc_id and
    source are.
    """
    kept = [c for c in docs.columns if c not in ADDED] if carry else ["doc_id", "source"]
    size, row, key = fresh(docs.select(*[F.col(f"`{c}`") for c in kept]), "mix_size", "mix_row", "mix_key")
    # written, so the numbers of rows stay
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], size_of().alias(size), F.xxhash64("doc_id", "source", "text").alias(key)).withColumn(row, F.monotonically_increasing_id())
    table = stash(rows, "sized")
    narrow = table.select(F.col(row).alias("at"), "source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col(key).alias("row"), F.col(size).alias("size"))

    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aims = sized(stash(targets(sources, weights, share, most), "targets")).alias("a")
    each = narrow.groupBy("source", "id", "row", "size").agg(F.count("*").alias("n")).alias("r")
    fraction = F.when(F.col("a.source_size") > 0, F.col("a.target") / F.col("a.source_size")).otherwise(0.0)
    each = each.join(aims, F.col("r.source").eqNullSafe(F.col("a.source"))).select("r.*", (fraction * F.col("r.n")).alias("due"), "a.source_size", "a.target", "a.docs")
    bucket = F.pmod(F.xxhash64("id", "row"), F.ceil(F.col("docs") / GROUP))
    each = stash(each.select("source", "id", "row", "size", "n", "source_size", "target", F.floor("due").alias("base"), (F.col("due") - F.floor("due")).alias("part"), bucket.alias("bucket")), "rows")

    items = each.where("size > 0 and part > 0").select("source", "id", "row", "size", "part", "bucket", F.lit(-1).alias("extra"))
    found, buckets = [], (each.agg(F.max("bucket")).first()[0] or 0) + 1
    while True:
        done = stash(items.groupBy("source", "bucket").applyInPandas(_round(seed, False), _ITEM), "rounded")
        found.append(done.where("extra >= 0").select("id", "row", "extra"))
        items = done.where("extra < 0").withColumn("bucket", F.floor(F.col("bucket") / FAN))
        if buckets == 1:
            break
        buckets = -(-buckets // FAN)
    found.append(stash(items.groupBy("source").applyInPandas(_round(seed, True), _ITEM), "rounded").select("id", "row", "extra"))
    counts = each.join(reduce(DataFrame.unionByName, found), ["id", "row"], "left").select("id", "row", "n", "source_size", "target", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("total"))
    place = F.lit(1)
    if not each.where("n > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("id", "row").orderBy("at"))
    share_of = F.floor(F.col("total") / F.col("n"))
    copies = (share_of + (F.col("place") <= F.col("total") - share_of * F.col("n")).cast("int")).cast("int")
    # a row of numbers for each document; texts stay where they are while these are few
    dealt = stash(narrow.withColumn("place", place).join(counts, ["id", "row"]).select("at", "source_size", "target", copies.alias("copies")), "dealt")
    out = table.alias("t").join(sized(dealt).alias("c"), F.col(f"t.{row}") == F.col("c.at"))
    n, taken = F.col(f"t.{size}"), (F.col("c.copies") * F.col(f"t.{size}")).cast("long")
    return out.select(*[F.col(f"t.`{c}`") for c in kept], n.alias("size"), "c.source_size", "c.target", "c.copies", taken.alias("taken"))
