"""Registered queries against their SQL where rows share their time, and sketches of many IPs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gatewatch.functions.columns import FEATURES
from gatewatch.jobs import queries
from gatewatch.operators import learning, sketch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dense_rule_hits", "policy_decisions", "timed_feedback", "feature_scaler"])
def test_rows_of_one_time(spark, tmp_path, name):
    """Each event is there twice, the second time of another user who asks for the same endpoint."""
    db = duckdb.connect()
    db.execute(f"COPY (SELECT event_id + 1000 * i AS event_id, ts, user_id + 30 * i AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(2) r(i)) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_rolling_ips_of_many(spark):
    """Targets of 20,000 IPs that sketches of 2**12 registers miss by 3 %."""
    many = spark.range(60_000).select(F.element_at(F.array(*[F.lit(x) for x in ("172", "217", "7")]), (F.col("id") % 3 + 1).cast("int")).alias("target"), F.expr("id div 3").alias("i"))
    got = sketch.rolling_ips(many.select("target", F.concat("target", F.lit("."), F.col("i")).alias("ip"), F.lit(10**12).alias("ts_us"))).collect()
    assert len(got) == 3 and all(abs(r.approx_ips - 20_000) <= 400 for r in got)


def test_training_computes_rows_once(spark):
    """The scaling's passes and the epochs read what the first pass kept."""
    seen = spark.sparkContext.accumulator(0)

    def row(i):
        seen.add(1)
        return (*(float((i * (j + 3)) % 7) for j in range(len(FEATURES))), i % 2)

    rows = spark.createDataFrame(spark.sparkContext.range(200, numSlices=3).map(row), ", ".join(f"{c} double" for c in FEATURES) + ", label int")
    model = learning.fit(rows, epochs=3)
    assert seen.value == 200
    top = learning.scaler(rows).first()
    assert model.mean == pytest.approx(top.mean) and model.std == pytest.approx(top.std)
