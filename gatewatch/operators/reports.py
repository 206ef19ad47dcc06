"""Counts and reports over the decision log, labels, challenges and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("ALLOW", "CHALLENGE", "BLOCK")


def is_flagged(action: str = "action") -> Column:
    return F.col(action).isin("BLOCK", "CHALLENGE")


def by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def tracked(requests: DataFrame, exact: bool = True) -> DataFrame:
    n = F.count_distinct if exact else F.approx_count_distinct
    return requests.agg(n("ip").alias("tracked_ips"), n("target").alias("tracked_targets"))


def challenges(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("issued"), F.count_if(F.col("solved").cast("boolean")).alias("solved"))


def recent(decisions: DataFrame, most: int = 50) -> DataFrame:
    shown = decisions.orderBy(F.desc("ts_us"), F.desc("seq")).limit(max(0, most))
    return shown.select("seq", "request_id", "ip", "route", "action", F.round("score", 3).alias("score"))


def timeseries(decisions: DataFrame, now_us: int, bucket_s: int = 10, span_s: int = 300) -> DataFrame:
    """t (epoch seconds) and a column per action, for the buckets that have rows."""
    start = now_us - span_s * 1_000_000
    b = F.floor((F.col("ts_us") - start) / (bucket_s * 1_000_000)).cast("long")
    rows = decisions.where((F.col("ts_us") >= start) & (F.col("ts_us") <= now_us)).groupBy(b.alias("b")).pivot("action", list(ACTIONS)).count().na.fill(0)
    return rows.select(F.bround(F.lit(start / 1e6) + F.col("b") * bucket_s).cast("long").alias("t"), *ACTIONS).orderBy("t")


def session_verdicts(scored: DataFrame) -> DataFrame:
    """The action and id of each session's last request."""
    last = F.max_by(F.struct("action", "request_id"), "seq")
    return scored.groupBy("session_id", "archetype", "label").agg(last.alias("v"), F.min("seq").alias("session_seq")).select("session_id", "archetype", "label", "v.action", "v.request_id", "session_seq")


def confusion(verdicts: DataFrame) -> DataFrame:
    bot, hit = F.col("label") == 1, is_flagged()
    t = verdicts.agg(F.count_if(bot & hit).alias("tp"), F.count_if(bot & ~hit).alias("fn"), F.count_if(~bot & ~hit).alias("tn"), F.count_if(~bot & hit).alias("fp"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return t.select("tp", "fn", "tn", "fp", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def archetype_actions(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("archetype").pivot("action", list(ACTIONS)).count().na.fill(0)


def class_shares(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("label").agg(F.avg((F.col("action") == "ALLOW").cast("int")).alias("allowed"), F.avg(is_flagged().cast("int")).alias("flagged"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Flagged verdicts per archetype under two models."""
    count = lambda df, name: df.groupBy("archetype").agg(F.count_if(is_flagged()).alias(name))
    return count(before, "flagged_before").join(count(after, "flagged_after"), "archetype")


def counters(decisions: DataFrame, blocklist: DataFrame) -> DataFrame:
    """One row of totals."""
    totals = decisions.agg(F.count("*").alias("decisions"), *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ACTIONS], F.count_distinct("ip").alias("tracked_ips"), F.count_distinct("target").alias("tracked_targets"), F.count("challenge_token").alias("challenges_issued"))
    return totals.crossJoin(blocklist.agg(F.count("*").alias("blocklist_size")))  # one row each


def dashboard(decisions: DataFrame, blocklist: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """counters(), the number of labels by source, and the top weights: one row.  weights: feature, weight, a few rows."""
    by_source = labels.groupBy("label_source").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_source", "count")))).alias("labels"))
    top = weights.agg(F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("w"), "feature"))).alias("t")).select(F.transform("t", lambda x: x["feature"]).alias("top_features"))
    return counters(decisions, blocklist).crossJoin(by_source).crossJoin(top)  # one row each
