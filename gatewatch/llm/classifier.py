"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's posterior.

A logistic model on document features is fitted on a bounded sample of
labelled rows.  Its scores are summed by host and by path within a host; each
level's mean is shrunk to the level above by a strength fitted by moments, so
sparse sites stay near their host and sparse hosts near the global mean.  A
document's log odds are then moved by how far its path is from that mean.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.tables import stash
from gatewatch.llm.text import GAP, whole, words

#: Labelled rows that the fit sees at most (the least by hash of doc_id).
SAMPLE = 20_000
#: Strengths of the priors at most, in documents.
STRONGEST = 1000.0
KEEP_FROM = 0.5
FEATURES = ("log_words", "mean_length", "symbol_share", "upper_share", "distinct_share", "bar_share", "dup_line_share")


def features(text: Column) -> dict[str, Column]:
    """Numbers of a text without nulls, from built-in functions."""
    n = F.greatest(F.size("_words"), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    without = lambda what: F.length(text) - F.length(F.regexp_replace(text, what, ""))
    lines = F.split(text, "\n")
    return {
        "log_words": F.log1p(F.size("_words")),
        "mean_length": F.log1p(F.length(F.regexp_replace(text, GAP, "")) / n),
        "symbol_share": F.log1p(without(r"[#*$%&<>!]+") / n),
        "upper_share": without(r"\p{Lu}+") / chars,
        "distinct_share": F.size(F.array_distinct("_words")) / n,
        "bar_share": F.log1p(without(r"[|]+") / n),
        "dup_line_share": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), means and deviations of a ridge logistic model by Newton steps."""
    if not len(labels):
        return np.zeros(len(FEATURES) + 1), np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    mean, std = rows.mean(0), rows.std(0)
    std[std < 1e-9] = 1.0
    x = np.c_[(rows - mean) / std, np.ones(len(rows))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * np.maximum(p * (1 - p), 1e-6) @ x / len(x) + ridge * np.eye(len(w)), x.T @ (p - labels) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, std


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength by moments: spread of group means around the level above, less what chance makes of it."""
    m = groups.where("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.count("*").alias("k")).first()
    if not m.n or m.n <= m.k:
        return STRONGEST
    within = m.within / (m.n - m.k)
    spread = (m.between - m.k * within) / m.n
    return float(min(STRONGEST, within / spread)) if spread > 0 else STRONGEST


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, own_score, host_mean, path_mean, quality, kept.

    docs: doc_id, text and the columns of host and path; labels: doc_id,
    quality (0 or 1, others ignored); other columns are not looked at.  Texts
    of any length are measured whole; nothing depends on the order of rows, and
    of two labels of a document the better counts.  Null texts are empty, null hosts and
    paths are groups of their own, repeated rows count as often as they come.
    Without labels every document scores 0.5.  An empty table gives no rows.
    """
    text = whole("text")
    at = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), text.alias("text"), words(text).alias("_words"))
    at = stash(at.select("doc_id", "host", "path", *[v.cast("double").alias(k) for k, v in features(F.col("text")).items()]), "features")
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = at.join(known, "doc_id").select(*FEATURES, "quality").orderBy(F.xxhash64("doc_id"), *FEATURES).limit(sample).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(-1, len(FEATURES) + 1)
    w, mean, std = fit(data[:, :-1], data[:, -1])
    z = reduce(lambda a, b: a + b, [(F.col(c) - float(mean[i])) / float(std[i]) * float(w[i]) for i, c in enumerate(FEATURES)], F.lit(float(w[-1])))
    scored = at.select("doc_id", "host", "path", (1 / (1 + F.exp(-z))).alias("own_score"))

    sums = [F.count("*").alias("n"), F.sum("own_score").alias("s"), F.sum(F.col("own_score") * F.col("own_score")).alias("s2")]
    paths = stash(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    top = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = top.s / top.n if top.n else 0.5
    k = _strength(hosts, F.lit(overall))
    hosts = hosts.select("host", ((F.col("s") + k * overall) / (F.col("n") + k)).alias("host_mean"))
    level = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "h.host_mean")
    k = _strength(level, F.col("host_mean"))
    level = level.select("host", "path", "host_mean", ((F.col("s") + k * F.col("host_mean")) / (F.col("n") + k)).alias("path_mean"))
    out = scored.alias("d").join(level.alias("p"), F.col("d.host").eqNullSafe(F.col("p.host")) & F.col("d.path").eqNullSafe(F.col("p.path")))
    quality = 1 / (1 + F.exp(-(_logit(F.col("own_score")) + _logit(F.col("path_mean")) - _logit(F.lit(overall)))))
    return out.select("d.doc_id", "own_score", "host_mean", "path_mean", quality.alias("quality"), (quality >= KEEP_FROM).alias("kept"))
