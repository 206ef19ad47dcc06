"""Labels, training and model tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.functions.columns import FEATURES
from gatewatch.operators.scoring import Model, probability
from gatewatch.sources import files
from gatewatch.sources.puts import compact, latest, load_put, put  # noqa: F401

#: Partitions whose gradients the driver adds itself.
FLAT = 32
#: Labels that ordered_fit() takes one after the other at most.
MOST_ORDERED = 10_000
MODEL = "n int, w array<double>, b double, mean array<double>, std array<double>, version long, batch long"


def honeypot_labels(decisions: DataFrame) -> DataFrame:
    """Filled traps label themselves: features, 1, honeypot."""
    return decisions.where("honeypot_filled != 0").select("request_id", *FEATURES, F.lit(1).alias("label"), F.lit("honeypot").alias("label_source"))


def resolve_feedback(feedback: DataFrame, decisions: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, rejected).  feedback: request_id, label and perhaps source; every row counts, unknown ids are rejected.

    parts: tasks that both are dealt to by request_id; by default Spark puts as
    many rows in a task as it takes for a size, which ids of few bytes make millions.
    """
    by_id = lambda df: df.repartition(parts, "request_id") if parts else df
    source = F.coalesce("source", F.lit("operator")) if "source" in feedback.columns else F.lit("operator")
    said = feedback.select("request_id", F.col("label").cast("int").alias("label"), source.alias("label_source"))
    said = by_id(said)
    labels = by_id(decisions.select("request_id", *FEATURES)).join(said, "request_id").select("request_id", *FEATURES, "label", "label_source")
    return labels, said.join(by_id(decisions.select("request_id")), "request_id", "left_anti")


def solve(challenges: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(challenges with solved, unknown tokens).  Solving twice is solving once; it adds no label."""
    solved = outcomes.select("token").distinct()
    done = challenges.join(solved.withColumn("_done", F.lit(True)), "token", "left").withColumn("solved", F.coalesce(F.col("_done"), F.col("solved").cast("boolean"), F.lit(False))).drop("_done")
    return done, solved.join(challenges.select("token"), "token", "left_anti")


def append_labels(labels: DataFrame, path: str) -> None:
    labels.select(F.unix_micros(F.current_timestamp()).alias("ts_us"), "label_source", "label", F.to_json(F.struct(*FEATURES)).alias("features_json")).write.mode("append").parquet(path)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    kept = spark.read.schema("ts_us long, label_source string, label int, features_json string").parquet(path)
    values = F.from_json("features_json", ", ".join(f"{c} double" for c in FEATURES))
    return kept.select("ts_us", values.alias("f"), "label", "label_source").select("ts_us", "f.*", "label", "label_source")


def scaler(rows: DataFrame) -> DataFrame:
    """Population mean and deviation by feature; a constant feature has deviation 1."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.var_pop(c).alias(f"v_{c}") for c in FEATURES])
    std = [F.when(F.col(f"v_{c}") > 1e-12, F.sqrt(f"v_{c}")).otherwise(1.0) for c in FEATURES]
    return stats.select(F.array(*[f"m_{c}" for c in FEATURES]).alias("mean"), F.array(*std).alias("std"))


def fit(rows: DataFrame, epochs: int = 400, lr: float = 0.3, l2: float = 1e-3, method: str = "gd", tol: float = 0.0) -> Model:
    """Logistic regression on FEATURES and label, from zero.

    gd: full-batch descent; rows are computed once, blocks of them are kept in
    memory or on disk, and only sums travel, from more than FLAT partitions
    through sums of them; it ends before its epochs once no part of the gradient
    is over tol.  lbfgs: pyspark.ml, converged.
    """
    if method == "lbfgs":
        top = scaler(rows).first()
        mean, std = np.array(top.mean), np.array(top.std)
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        scaled = rows.select(*[((F.col(c) - float(mean[i])) / float(std[i])).alias(c) for i, c in enumerate(FEATURES)], F.col("label").cast("double").alias("label"))
        found = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scaled))
        return Model(tuple(map(float, found.coefficients)), float(found.intercept), tuple(mean.tolist()), tuple(std.tolist()))

    def blocks(it):
        for b in it:
            if b.num_rows:
                a = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (*FEATURES, "label")], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["block"])

    def read(row):
        return np.frombuffer(row.block, float).reshape(-1, len(FEATURES) + 1)

    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("label").cast("double").alias("label"))
    # a row is a block of rows; partitions for the cores, as each epoch is a job over all of them
    held = numbers.mapInArrow(blocks, "block binary").rdd
    held = held.coalesce(min(held.getNumPartitions(), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    data = held.map(read).persist(StorageLevel.MEMORY_AND_DISK)
    # sums of sums, so that the driver adds a root of them only
    depth = 1 if data.getNumPartitions() <= FLAT else 2

    def summed(of):
        each = data.map(of)
        zero = np.zeros(len(FEATURES) + 1)
        return each.treeAggregate(zero, np.add, np.add, depth) if depth > 1 else each.fold(zero, np.add)

    w = np.zeros(len(FEATURES) + 1)
    first = summed(lambda a: np.r_[a[:, :-1].sum(axis=0), len(a)])
    total = first[-1]
    mean = first[:-1] / max(total, 1)
    spread = summed(lambda a: np.r_[((a[:, :-1] - mean) ** 2).sum(axis=0), 0.0])[:-1] / max(total, 1)
    std = np.where(spread > 1e-12, np.sqrt(spread), 1.0)
    for _ in range(epochs if total else 0):
        # the scaling is in the weights, so that blocks stay as they are
        by, at = w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum()

        def errors(a, by=by, at=at):
            x = a[:, :-1]
            e = 1 / (1 + np.exp(-np.clip(x @ by + at, -35, 35))) - a[:, -1]
            return np.r_[e @ x, e.sum()]

        e = summed(errors) / total
        g = np.r_[(e[:-1] - mean * e[-1]) / std, e[-1]] + l2 * np.r_[w[:-1], 0.0]
        w -= lr * g
        if np.abs(g).max() <= tol:
            break
    data.unpersist()
    return Model(tuple(w[:-1].tolist()), float(w[-1]), tuple(mean.tolist()), tuple(std.tolist()))


def partial_fit(model: Model, labels: DataFrame, lr: float = 0.05) -> Model:
    """One aggregated step over a batch of labels, the scaler being frozen; for one label it is the online step."""
    error = probability(model) - F.col("label")
    steps = labels.agg(*[F.sum(error * (F.col(c) - m) / s).alias(c) for c, m, s in zip(FEATURES, model.mean, model.std, strict=True)], F.sum(error).alias("bias")).first()
    move = lambda v: lr * (v or 0.0)
    return Model(tuple(w - move(steps[c]) for w, c in zip(model.w, FEATURES, strict=True)), model.b - move(steps.bias), model.mean, model.std)


def ordered_fit(model: Model, labels: DataFrame, order: tuple[str, ...] = ("ts_us", "seq"), lr: float = 0.05, most: int = MOST_ORDERED) -> Model:
    """A step for each label, one after the other in their order, each from the model the last one left; the scaler is frozen.

    Such steps can't be taken apart, so they are done in one task, for ``most``
    labels; a larger batch takes the summed step of partial_fit() instead.
    """
    rows = labels.select(*[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("label").cast("double").alias("label"), *order)
    if rows.limit(most + 1).count() > most:
        return partial_fit(model, labels, lr)
    mean, std = np.array(model.mean), np.array(model.std)

    def fold(pdf):
        pdf = pdf.sort_values([*order], kind="stable")
        w, b = np.array(model.w), model.b
        for x, y in zip((pdf[[*FEATURES]].to_numpy() - mean) / std, pdf["label"].to_numpy(), strict=True):
            z = float(x @ w + b)
            error = (0.0 if z <= -35 else 1.0 if z >= 35 else 1 / (1 + np.exp(-z))) - y
            w, b = w - lr * error * x, b - lr * error
        return pd.DataFrame({"w": [w.tolist()], "b": [b]})

    done = rows.groupBy().applyInPandas(fold, "w array<double>, b double").first()
    return Model(tuple(done.w), done.b, model.mean, model.std) if done else model


def retrain(seed: DataFrame, labels: DataFrame, **how) -> tuple[Model, DataFrame]:
    """(model, summary).  Duplicates count; summary: origin, n."""
    both = seed.select(*FEATURES, "label", F.lit("seed").alias("origin")).unionByName(labels.select(*FEATURES, "label", F.lit("collected").alias("origin")))
    return fit(both, **how), both.groupBy("origin").agg(F.count("*").alias("n"))


def publish(spark: SparkSession, seed: DataFrame, labels: DataFrame, path: str, **how) -> tuple[Model, DataFrame]:
    """retrain(), saved as the next free version."""
    model, summary = retrain(seed, labels, **how)
    save_model(spark, model, path)
    return model, summary


def catch_up(spark: SparkSession, seed: DataFrame, path: str, labels: DataFrame | None = None, **how) -> Model:
    """After a restart: the newest saved model, else one fitted on seed; stored labels retrain it.  What is new is saved."""
    if labels is not None and not labels.isEmpty():
        return publish(spark, seed, labels, path, **how)[0]
    if not saved(spark, path):
        save_model(spark, fit(seed, **how), path, 0)
    return load_model(spark, path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(x[6:-5]) for x in files.listed(spark, path) if x.startswith("model-")]


def _name(version: int) -> str:
    return f"model-{version:012d}.json"


def saved(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def newest(spark: SparkSession, path: str) -> int:
    """The largest version, -1 if there is none."""
    return max(_versions(spark, path), default=-1)


def save_model(spark: SparkSession, model: Model, path: str, version: int | None = None, batch: int | None = None) -> int:
    """A new version beside the old ones, the next free one by default; its number.

    A version is one file that is there whole or not at all and is never
    written over: of two writers of a version one gets it, the other the next,
    or FileExistsError if it asked for that one.  batch: that of online_update().
    """
    while True:
        v = newest(spark, path) + 1 if version is None else version
        text = json.dumps({"n": len(model.w), "w": model.w, "b": model.b, "mean": model.mean, "std": model.std, "version": v, "batch": batch})
        if files.put_new(spark, path, _name(v), text):
            return v
        if version is not None:
            raise FileExistsError(f"{path} has a version {version}")


def load_model(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """The newest version, or the one named."""
    r = json.loads(files.read(spark, path, _name(newest(spark, path) if version is None else version)))
    return Model(tuple(r["w"]), r["b"], tuple(r["mean"]), tuple(r["std"]))


def swap_model(spark: SparkSession, path: str, step: Callable[[Model], Model], batch: int | None = None) -> int:
    """The newest model, changed by step and saved as the version right after it; begun anew if another got that first, so no version is lost."""
    while True:
        v = newest(spark, path)
        try:
            return save_model(spark, step(load_model(spark, path, v)), path, v + 1, batch)
        except FileExistsError:
            continue


def predictions(rows: DataFrame, model: Model) -> DataFrame:
    return rows.withColumn("p", probability(model)).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))


def weights_report(spark: SparkSession, model: Model, most: int = 8) -> DataFrame:
    table = spark.createDataFrame([(i, c, w) for i, (c, w) in enumerate(zip(FEATURES, model.w, strict=True))], "place int, feature string, weight double")
    return table.orderBy(F.desc(F.abs("weight")), "place").limit(most).select("feature", F.round("weight", 3).alias("weight"))


def review_picks(sessions: DataFrame) -> DataFrame:
    """sessions: session_id, session_seq, label, action, request_id of the last request.  Sessions to label, with the label.

    Bots that were allowed; humans that were allowed, whose last request id ends evenly, once a bot was missed.
    """
    missed = sessions.where("label = 1 and action = 'ALLOW'")
    first = missed.agg(F.min("session_seq").alias("first_missed"))
    humans = sessions.where("label = 0 and action = 'ALLOW'").where(F.substring("request_id", -1, 1).isin(*"02468")).join(F.broadcast(first), F.col("session_seq") > F.col("first_missed"))
    return missed.select("session_id", F.lit(1).alias("label")).unionByName(humans.select("session_id", F.lit(0).alias("label")))


def review_requests(picks: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests of the sessions that review_picks() chose, with its label.  requests: session_id and any others but label."""
    return requests.join(picks.select("session_id", "label"), "session_id")


def dataset(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled feature table: seq, features, label; labels: seq, label."""
    return decisions.select("seq", *FEATURES).join(labels.select("seq", "label"), "seq")
