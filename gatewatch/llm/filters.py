"""Filter interaction audit by the subset-zeta transform.

Documents are counted by part and by the set of filters they fail.  The zeta
transform turns these counts into survivors for every subset of filters; what a
step of an order removes is then the difference between two neighbouring
subsets, for labelled documents likewise, so no order reads documents again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.tables import stash
from gatewatch.llm.text import batches, raw

#: The filters in the order of a mask's bits; that for copies is told by ``copies()``.
FILTERS = "ABCDE"
COPY = FILTERS.index("E")
MIN_WORDS, DISTINCT, CAPITALS = 200, 50, 3
_SYMBOL = re.compile(rb"[#$%&*|]").search
_CAPITAL = bytes(range(65, 91))
#: Filters of one audit at most: its rows are all orders of them.
MOST = 8

STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    mask = int(len(words) < MIN_WORDS)
    mask |= (100 * len(set(words)) < DISTINCT * len(words)) << 1
    mask |= (100 * (len(text) - len(text.translate(None, _CAPITAL))) > CAPITALS * n_chars) << 2
    return mask | (_SYMBOL(text) is not None) << 3


def _measured(it):
    for b in batches(it):
        n_chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
        texts = [t or b"" for t in raw(b, "text")]
        masks = pa.array(map(failed, texts, n_chars), pa.int32())
        keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), masks, keys], ["doc_id", "part", "mask", "key"])


def copies(rows: DataFrame) -> DataFrame:
    """rows: doc_id, key and others.  Sets E's bit of mask where a smaller doc_id has the same key.

    The least id of each key meets rows by key and id together, so the copies
    of one text are dealt out, and partial minima shrink them before the shuffle.
    """
    least = rows.groupBy("key").agg(F.min("doc_id").alias("first")).select(F.col("key").alias("key_"), "first")
    met = rows.join(least, (F.col("key") == F.col("key_")) & (F.col("doc_id") == F.col("first")), "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return met.withColumn("mask", F.when(later, F.col("mask").bitwiseOR(F.lit(1 << COPY))).otherwise(F.col("mask"))).drop("key_", "first")


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every row: the filters it fails, and whether its id is labelled of good quality or toxic.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are
    not looked at.  A null text is empty, a null lang the part "".  Of several
    labels of an id one that says so is enough.  Rows that share an id are no
    copies of each other; a row without id is no copy, and none is one of it
    alone; it has no labels.  Texts of any length are read whole.  Repeated rows
    count as often as they come; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    rows = stash(rows.mapInArrow(_measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, key binary"), "measured")
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return copies(rows).select("doc_id", "part", "mask").join(said, "doc_id", "left").select("part", "mask", of("good"), of("toxic"))


def zeta(counts: np.ndarray, filters: int) -> np.ndarray:
    """counts: (..., 2**filters) by set of failed filters.  Survivors by set of applied filters: those that fail none of it."""
    out = counts.copy()
    sets = np.arange(1 << filters)
    for bit in range(filters):
        has = sets >> bit & 1 == 1
        out[..., has] += out[..., ~has]
    return out[..., ::-1]  # what fails within a set survives its complement


def steps(counts: np.ndarray, names: str) -> pd.DataFrame:
    """counts: rows of all, good and toxic by set of failed filters.  All orders with their steps, as STEPS without part."""
    n = len(names)
    alive = zeta(counts, n)
    orders = np.array(list(permutations(range(n))))
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    gone = alive[:, before] - alive[:, after]
    single = 1 << np.arange(n)
    fails = alive[0, 0] - alive[0, single]
    unique = alive[0, (1 << n) - 1 - single] - alive[0, -1]
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, gone[0])
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(names[i] for i in o) for o in orders], n), "step": np.tile(np.arange(1, n + 1), len(orders)), "kept": alive[0, after].ravel(), "removed": gone[0].ravel(),
        "redundant": (fails[orders] - gone[0]).ravel(), "unique_fails": unique[orders].ravel(), "good_lost": gone[1].ravel(), "toxic_lost": gone[2].ravel(), "shapley": shapley[orders].ravel(),
    })


def _every_order(names: str) -> Callable:
    def run(key, pdf):
        counts = np.zeros((3, 1 << len(names)), np.int64)
        counts[:, pdf["mask"]] = pdf[["n", "good", "toxic"]].to_numpy().T
        out = steps(counts, names)
        out.insert(0, "part", key[0])
        return out

    return run


def audit(rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row per part, order of all filters and step, as STEPS says; long counts of the part's rows.

    rows: part, mask (bit i: fails filter i of names), good, toxic.  kept after
    the step, removed by it, redundant: failing its filter but removed earlier,
    unique_fails: failing its filter alone, good_lost and toxic_lost of those
    removed, shapley: what its filter removes, summed over all orders.  Null
    parts are one part, a null flag is no.  Zeros are given; no rows, no parts.
    """
    if not 1 <= len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    yes = lambda name: F.count_if(F.col(name)).alias(name)
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), yes("good"), yes("toxic"))
    return counts.groupBy("part").applyInPandas(_every_order(names), STEPS)


#: The same in SQL over documents and labels, order by order.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
  FROM d JOIN first USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, [x for x in [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END] if x IS NOT NULL] AS fails,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT [p.x, q.x, r.x, s.x, t.x] AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT o, step, o[step] AS own, o[1:step - 1] AS before FROM o, range(1, 6) AS k(step)),
c AS (SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, own,
  coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, own)), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, own)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (list_has_any(fails, before) AND list_contains(fails, own)), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = [own]), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, own)), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, own)), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY part, o, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c
"""
