"""Streams: scoring with a retained tail, window counts, labels and the online model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gatewatch.functions.columns import FEATURES
from gatewatch.operators import learning
from gatewatch.operators.scoring import check
from gatewatch.operators.windows import with_target
from gatewatch.sources.requests import parse

RETAIN_US = 120_000_000
#: Events later than this behind the newest of what was seen are listed as late: their window may have lost rows.
LATE_US = 60_000_000
REQUEST = ["seq", "ts_us", "ip", "method", "path", "user_agent", "accept", "accept_language", "cookie", "honeypot_value", "asn_type"]
KEPT = ["seq", "ts_us", "request_id", "ip", "route", "target", *FEATURES, "rule_score", "model_proba", "score", "action", "reasons", "challenge_token"]


def _folders(spark: SparkSession, path: str) -> dict[int, object]:
    """The folders n=<number> of a path, as Hadoop paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [p.getPath() for p in files.listStatus(at)] if files.exists(at) else []
    return {int(p.getName().split("=")[1]): p for p in found if p.getName().startswith("n=")}


def score_batch(spark: SparkSession, model_path: str, out: str, reputation: str | None = None, blocklist: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch.  Batch n reads the tail that batch n - 1 left and overwrites its own folders, so a replay gives the same.

    reputation (ip, score) and blocklist (ip): paths of Parquet tables, read anew for
    each batch, as is the newest model.  A late event is scored with what
    history is left, and listed in late; events scored before stay as they are.
    Tails that no replay can need go.
    """

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.select(*REQUEST).persist()
        try:
            now = batch.agg(F.max("ts_us")).first()[0]
            if now is None:
                return
            tails = _folders(spark, f"{out}/tail")
            past = max([k for k in tails if k < n], default=None)
            tail = spark.read.parquet(f"{out}/tail/n={past}").select(*REQUEST) if past is not None else batch.limit(0)
            seen = tail.agg(F.max("ts_us")).first()[0]
            model = learning.load_model(spark, model_path)
            tables = [spark.read.parquet(path) if path else None for path in (reputation, blocklist)]
            late = F.lit(False) if seen is None else F.col("ts_us") < seen - LATE_US
            batch.where(late).write.mode("overwrite").parquet(f"{out}/late/n={n}")
            both = tail.withColumn("fresh", F.lit(False)).unionByName(batch.withColumn("fresh", F.lit(True)))
            scored = check(both, model, *tables, keep=("seq", "ts_us", "ip", "fresh")).where("fresh")
            scored.select(*KEPT).write.mode("overwrite").parquet(f"{out}/decisions/n={n}")
            done = spark.read.parquet(f"{out}/decisions/n={n}")
            learning.honeypot_labels(done).write.mode("overwrite").parquet(f"{out}/labels/n={n}")
            newest = max(now, seen or now)
            tail.unionByName(batch).where(F.col("ts_us") >= newest - RETAIN_US).write.mode("overwrite").parquet(f"{out}/tail/n={n}")
            for k, path in tails.items():
                if k < (n if past is None else past):
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        finally:
            batch.unpersist()

    return run


def stream_check(stream: DataFrame, model_path: str, out: str, checkpoint: str, reputation: str | None = None, blocklist: str | None = None) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(score_batch(stream.sparkSession, model_path, out, reputation, blocklist)).option("checkpointLocation", checkpoint)


def _timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", "60 seconds")


def action_counts(decisions: DataFrame) -> DataFrame:
    return _timed(decisions).groupBy(F.window("ts", "10 seconds"), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def endpoint_pressure(requests: DataFrame) -> DataFrame:
    """Requests and about how many IPs per target in sliding minutes, and whether that is a swarm."""
    counts = _timed(with_target(requests)).groupBy(F.window("ts", "60 seconds", "5 seconds"), "target").agg(F.count("*").alias("n"), F.approx_count_distinct("ip").alias("ips"))
    return counts.select(F.col("window.start").alias("start"), "target", "n", "ips", ((F.col("n") >= 30) & (F.col("ips") >= 10)).alias("swarm"))


def key_rates(requests: DataFrame, key: str = "ip") -> DataFrame:
    return _timed(requests).groupBy(F.window("ts", "5 seconds"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def feedback_join(feedback: DataFrame, decisions: DataFrame, oldest: str = "24 hours", ahead: str = "10 minutes", late: str = "60 seconds") -> DataFrame:
    """Each row of feedback with its decision's features and known; two streams or two tables, no log is read.

    feedback: request_id, label, said_us and perhaps source; decisions:
    request_id, ts_us and FEATURES, a row a request.  A decision counts if it was
    made from ``oldest`` before what is said to ``ahead`` after it.  Streams wait
    that long for a decision, in their own time, and keep decisions as long; what
    is then without one comes with known false and null features.  Rows that are
    more than ``late`` behind their own stream are dropped by Spark.
    """
    source = F.coalesce("source", F.lit("operator")) if "source" in feedback.columns else F.lit("operator")
    said = feedback.select("request_id", F.col("label").cast("int").alias("label"), source.alias("label_source"), F.timestamp_micros("said_us").alias("said_at"))
    made = decisions.select(F.col("request_id").alias("_id"), F.timestamp_micros("ts_us").alias("made_at"), *FEATURES)
    if feedback.isStreaming:
        said, made = said.withWatermark("said_at", late), made.withWatermark("made_at", late)
    met = F.expr(f"request_id = _id AND made_at >= said_at - INTERVAL {oldest} AND made_at <= said_at + INTERVAL {ahead}")
    both = said.join(made, met, "left_outer")
    return both.select("request_id", "label", "label_source", "said_at", F.col("_id").isNotNull().alias("known"), *FEATURES)


def joined_labels(joined: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Rows of a feedback_join() stream as labels and rejected, a folder of each for a batch; a replay writes the same ones."""

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            batch.where("known").select("request_id", *FEATURES, "label", "label_source").write.mode("overwrite").parquet(f"{out}/labels/n={n}")
            batch.where("not known").select("request_id", "label", "label_source").write.mode("overwrite").parquet(f"{out}/rejected/n={n}")
        finally:
            batch.unpersist()

    return joined.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)


def label_stream(feedback: DataFrame, decisions_path: str, out: str, checkpoint: str) -> DataStreamWriter:
    """Feedback against the whole decision log as it stands, appended as labels; feedback_join() reads no log."""

    def run(batch: DataFrame, n: int) -> None:
        labels, rejected = learning.resolve_feedback(batch, batch.sparkSession.read.parquet(decisions_path))
        labels.write.mode("overwrite").parquet(f"{out}/labels/n={n}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/n={n}")

    return feedback.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def online_update(labels: DataFrame, model_path: str, checkpoint: str, lr: float = 0.05, order: tuple[str, ...] = ()) -> DataStreamWriter:
    """One step per micro-batch, written as the next version with the batch's number; a replayed batch is known by that.

    The step is the aggregated one; with order, columns of labels, that of
    ordered_fit().  A version that a retrain publishes meanwhile is stepped from.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = spark.read.schema(learning.MODEL).json(model_path).agg(F.max("batch").alias("batch")).first()
        if (last.batch is None or last.batch < n) and not batch.isEmpty():
            step = (lambda m: learning.ordered_fit(m, batch, order, lr)) if order else (lambda m: learning.partial_fit(m, batch, lr))
            learning.swap_model(spark, model_path, step, n)

    return labels.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def ingest(lines: DataFrame, out: str, checkpoint: str, column: str = "value") -> DataStreamWriter:
    """A stream of JSON lines as requests with seq, and quarantined lines: a folder of each for a batch, from one read.

    A replayed batch writes its own folders again, with the same seq: the
    batch's number, the partition's and the row's in it, so numbers grow from
    batch to batch (up to 1,023 partitions).
    """

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.select(column).persist()
        try:
            good, bad = parse(batch, column)
            good.select((F.lit(n) * F.lit(1 << 43) + F.monotonically_increasing_id()).alias("seq"), "*").write.mode("overwrite").parquet(f"{out}/requests/n={n}")
            bad.write.mode("overwrite").parquet(f"{out}/quarantine/n={n}")
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
