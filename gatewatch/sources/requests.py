"""Request logs: JSON with defaults and quarantine, and a log derived from an events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {"ip": "0.0.0.0", "method": "GET", "path": "/", "user_agent": "", "accept": "", "accept_language": "", "cookie": "", "honeypot_value": "", "asn_type": "residential"}
RAW = ", ".join(f"{c} string" for c in [*DEFAULTS, "ts"]) + ", _bad string"


def parse(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(requests, quarantined lines) of a column of JSON text; works on streams too.

    Missing and null fields take their defaults, ts (epoch seconds, a number or
    numeric text) the time of processing.  An empty body is an empty object.
    What is no JSON object, or has a ts that is no number, is quarantined.
    """
    text = F.when(F.trim(column) == "", "{}").otherwise(F.col(column))
    at = lines.select(F.col(column).alias("line"), F.from_json(text, RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    seconds = F.expr("try_cast(r.ts as double)")
    ok = F.col("r").isNotNull() & F.col("r._bad").isNull() & (F.col("r.ts").isNull() | seconds.isNotNull())
    fields = [F.coalesce(F.col(f"r.{c}"), F.lit(d)).alias(c) for c, d in DEFAULTS.items()]
    now = F.unix_micros(F.current_timestamp())
    good = at.where(ok).select(*fields, F.coalesce(F.round(seconds * 1e6).cast("long"), now).alias("ts_us"))
    return good, at.where(~F.coalesce(ok, F.lit(False))).select("line")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse(spark.read.text(path))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sessions (session_id, archetype, label, events) as one row per request."""
    event = "struct<seq:long," + ",".join(f"{c}:string" for c in DEFAULTS) + ",ts_us:long>"
    nested = spark.read.schema(f"session_id long, archetype string, label int, events array<{event}>").json(path)
    return nested.select("session_id", "archetype", "label", F.explode("events").alias("e")).select("session_id", "archetype", "label", "e.*")


def request_log(spark: SparkSession, sf_dir: str, squeeze: int = 3000) -> DataFrame:
    """One request per event; a month is squeezed so that windows of a minute hold traffic."""
    start = 1704067200000000
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS seq", "user_id AS u", "event_type AS kind", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k")
    return e.selectExpr(
        "seq", f"{start} + (us - {start}) DIV {squeeze} AS ts_us",
        "IF(u % 10 = 4, '73.9.9.9', concat(CASE u % 10 WHEN 0 THEN '185.' WHEN 1 THEN '45.' WHEN 2 THEN '193.' ELSE '73.' END, u DIV 250, '.', u % 250, '.7')) AS ip",
        "IF(kind IN ('signup', 'purchase'), 'POST', 'GET') AS method",
        "CASE kind WHEN 'view' THEN concat('/article/', k) WHEN 'click' THEN concat('/search?q=', k) WHEN 'signup' THEN '/signup' WHEN 'purchase' THEN '/checkout/' ELSE '/login' END AS path",
        "CASE u % 6 WHEN 0 THEN 'python-requests/2.31.0' WHEN 1 THEN '' WHEN 2 THEN 'Scrapy/2.11 (+https://scrapy.org)' ELSE 'Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0' END AS user_agent",
        "IF(u % 6 < 2, '', 'text/html') AS accept", "IF(u % 6 < 3, '  ', 'en-US') AS accept_language",
        "IF(k % 7 = 0, '', concat('session=', u)) AS cookie", "IF(kind = 'signup' AND k % 20 = 0, 'http://spam.example', '') AS honeypot_value",
        "IF(u % 10 IN (0, 1, 3), 'datacenter', 'residential') AS asn_type",
    )
