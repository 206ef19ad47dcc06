"""Streams with state by key, joined streams, versions, compaction, exact online steps."""

import threading
from contextlib import nullcontext

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_requests import SCHEMA, T0, log, result

from gatewatch.functions.columns import FEATURES
from gatewatch.operators import learning
from gatewatch.operators.scoring import STARTING, check
from gatewatch.sources import files, puts
from gatewatch.streaming import keyed, score

LABELLED = ", ".join(f"{c} double" for c in FEATURES) + ", label int"


def run(writer, spark=None):
    with keyed.settings(spark) if spark else nullcontext():
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def written(spark, path):
    return spark.read.parquet(str(path))


def test_state_by_key_equals_batch(spark, tmp_path):
    """In order and over restarts; a slow key keeps its minute while others race far ahead."""
    fast = [{"seq": i, "ts_us": T0 + i * 40_000_000, "ip": f"1.1.1.{i % 2}"} for i in range(24)]
    slow = [{"seq": 100 + i, "ts_us": T0 + i * 9_000_000, "ip": "7.7.7.7", "path": f"/p/{i % 3}", "asn_type": "datacenter"} for i in range(24)]
    df = log(spark, [x for pair in zip(fast, slow, strict=True) for x in pair])
    order = {r.seq: n for n, r in enumerate(df.select("seq").collect())}
    for part in range(4):
        here = [s for s, n in order.items() if n // 12 == part]
        df.where(F.col("seq").isin(here)).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
        # each part is a run of its own, from the checkpoint of the one before
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/p*"))
        out = keyed.check(stream, blocklist=spark.createDataFrame([("1.1.1.1",)], "ip string"))
        run(out.select("seq", "req_10s", "req_60s", "distinct_paths_60s", "iat_mean", "target_req_60s", "target_distinct_ips_60s", "score", "action").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")), spark)
    got, want = result(written(spark, tmp_path / "out")), result(check(df, blocklist=spark.createDataFrame([("1.1.1.1",)], "ip string")))
    assert len(got) == 48
    for i, w in want.items():
        g = got[i].asDict()
        assert g.pop("action") == w.action and list(g.values()) == pytest.approx([w[c] for c in g], abs=1e-9)
    assert got[123].req_60s == 7


def test_state_is_bounded_and_forgets(spark, tmp_path):
    """What leaves a key's two minutes leaves its state; an idle key is forgotten; late and timeless rows are told."""
    rows = [[{"seq": 0, "ts_us": T0}, {"seq": 1, "ts_us": T0 + 1_000_000}], [{"seq": 2, "ts_us": T0 + 130_000_000}, {"seq": 3, "ts_us": None}], [{"seq": 4, "ts_us": T0 + 100_000_000}, {"seq": 5, "ts_us": T0 + 130_000_000}]]
    named = {"n": "n60"}
    for part, some in enumerate(rows):
        log(spark, some).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/p*"))
        run(keyed.by_key(stream, "ip", "path", named, ["seq"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")), spark)
    got = {r.seq: r.n for r in written(spark, tmp_path / "out").collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: None, 4: 1, 5: 3}
    for part in range(2):
        log(spark, [{"seq": part, "ts_us": T0 + part}]).coalesce(1).write.parquet(str(tmp_path / f"in2/p{part}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in2/p*"))
        run(keyed.by_key(stream, "ip", "path", named, ["seq"], idle_s=0).writeStream.format("parquet").option("path", str(tmp_path / "out2")).option("checkpointLocation", str(tmp_path / "cp2")), spark)
    # the timer of the first run has passed by the second's end, not before its rows
    assert {r.seq: r.n for r in written(spark, tmp_path / "out2").collect()}[0] == 1


def test_feedback_meets_decisions_on_streams(spark, tmp_path):
    """Feedback before its decision, after it, twice, too old and never."""
    decisions = check(log(spark, [{"seq": i, "ts_us": T0 + i * 60_000_000} for i in range(4)])).select("request_id", "ts_us", *FEATURES)
    say = lambda rid, label, minutes: (rid, label, T0 + minutes * 60_000_000)
    schema = "request_id string, label int, said_us long"
    parts = [[say("req-1", 1, 0.5), say("req-0", 0, 3), say("req-9", 1, 1)], [say("req-0", 1, 4), say("req-2", 1, 2 + 25 * 60)], [say("req-x", 1, 100 * 60)], [say("req-y", 1, 101 * 60)]]
    late = [decisions.where("ts_us <= 1000000000000"), decisions.where("ts_us > 1000000000000"), decisions.limit(1).withColumn("request_id", F.lit("req-z")).withColumn("ts_us", F.lit(T0 + 100 * 3600_000_000)), decisions.limit(1).withColumn("request_id", F.lit("req-w")).withColumn("ts_us", F.lit(T0 + 101 * 3600_000_000))]
    every = []
    for n, (said, made) in enumerate(zip(parts, late, strict=True)):
        every += [(a, b, int(c)) for a, b, c in said]
        spark.createDataFrame([(a, b, int(c)) for a, b, c in said], schema).coalesce(1).write.parquet(str(tmp_path / f"f/p{n}"))
        made.coalesce(1).write.parquet(str(tmp_path / f"d/p{n}"))
        streams = spark.readStream.schema(schema).parquet(str(tmp_path / "f/p*")), spark.readStream.schema(decisions.schema).parquet(str(tmp_path / "d/p*"))
        run(score.joined_labels(score.feedback_join(*streams), str(tmp_path / "o"), str(tmp_path / "c")))
    labels = sorted((r.request_id, r.label) for r in written(spark, tmp_path / "o/labels").collect())
    assert labels == [("req-0", 0), ("req-0", 1), ("req-1", 1)]
    assert written(spark, tmp_path / "o/labels").where("req_60s >= 1").count() == 3
    rejected = {r.request_id for r in written(spark, tmp_path / "o/rejected").collect()}
    assert {"req-9", "req-2"} <= rejected <= {"req-9", "req-2", "req-x"}
    table = score.feedback_join(spark.createDataFrame(every, schema), decisions)
    assert sorted((r.request_id, r.label) for r in table.where("known").collect()) == labels and table.count() == len(every)


def test_ingest_of_three_batches(spark, tmp_path):
    """Malformed, empty and partial lines; what is replayed is not there twice."""
    parts = [['{"ip":"1.1.1.1","ts":5}', "no json", '{"ts":"soon"}'], ["", '{"path":"/x","ts":"7.5"}'], ["[1]", '{"ip":null,"ts":9}']]
    for n, lines in enumerate(parts):
        (tmp_path / f"in{n}.txt").write_text("\n".join(lines) + "\n")
        run(score.ingest(spark.readStream.text(str(tmp_path / "in*.txt")), str(tmp_path / "o"), str(tmp_path / "c")))
    good, bad = written(spark, tmp_path / "o/requests"), written(spark, tmp_path / "o/quarantine")
    assert sorted(r.ip for r in good.collect()) == ["0.0.0.0", "0.0.0.0", "0.0.0.0", "1.1.1.1"] and good.select("seq").distinct().count() == 4
    assert {r.line for r in bad.collect()} == {"no json", '{"ts":"soon"}', "[1]"}
    before = sorted(map(tuple, good.where("n = 2").select("seq", "ip", "ts_us").collect()))
    (tmp_path / "c/commits/2").unlink()  # as if it had ended before the batch was done
    (tmp_path / "c/commits/.2.crc").unlink(missing_ok=True)
    run(score.ingest(spark.readStream.text(str(tmp_path / "in*.txt")), str(tmp_path / "o"), str(tmp_path / "c")))
    again = written(spark, tmp_path / "o/requests")
    assert again.count() == 4 and sorted(map(tuple, again.where("n = 2").select("seq", "ip", "ts_us").collect())) == before


def test_versions_of_several_writers(spark, tmp_path):
    """Each writer gets versions of its own, a reader never half a model, and no step of an online update is lost."""
    path = str(tmp_path / "m")
    learning.save_model(spark, STARTING, path)
    seen, got, stop = [], [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append(len(learning.load_model(spark, path).w))

    def writer(by):
        for _ in range(5):
            got.append(learning.save_model(spark, STARTING, path) if by == 0 else learning.swap_model(spark, path, lambda m: learning.Model(m.w, m.b + 1, m.mean, m.std)))

    watch, threads = threading.Thread(target=reader), [threading.Thread(target=writer, args=(by,)) for by in (1, 1, 1)]
    for t in [watch, *threads]:
        t.start()
    for t in threads:
        t.join()
    stop.set()
    watch.join()
    assert sorted(got) == list(range(1, 16)) and set(seen) == {15} and learning.newest(spark, path) == 15
    assert learning.load_model(spark, path).b == STARTING.b + 15
    writer(0)
    assert learning.load_model(spark, path) == STARTING and learning.newest(spark, path) == 20
    with pytest.raises(FileExistsError):
        learning.save_model(spark, STARTING, path, 7)
    assert files.put_new(spark, path, "x", "1") and not files.put_new(spark, path, "x", "2") and files.read(spark, path, "x") == "1"
    assert not [x for x in files.listed(spark, path, hidden=True) if x.startswith(".") and not x.endswith(".crc")]


def test_compaction(spark, tmp_path, monkeypatch):
    path, day = str(tmp_path / "d"), 86_400_000_000
    schema = "request_id string, ts_us long, action string"
    put = lambda *rows: learning.put(spark.createDataFrame(rows, schema), path)
    load = lambda: sorted(tuple(r) for r in learning.load_put(spark, path, "request_id").collect())
    put(("a", T0, "ALLOW"), ("b", T0 + day, "ALLOW"), ("c", T0 + 2 * day, "ALLOW"))
    put(("a", T0, "BLOCK"), ("n", None, "ALLOW"))
    now = [("a", T0, "BLOCK"), ("b", T0 + day, "ALLOW"), ("c", T0 + 2 * day, "ALLOW"), ("n", None, "ALLOW")]
    assert load() == now
    assert puts.compact(spark, path, "request_id") == 0 and load() == now and puts.compact(spark, path, "request_id") == -1
    plan = learning.load_put(spark, path, "request_id")._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    # a row that moves to another day leaves one row, and only the two days are written
    put(("a", T0 + day, "ALLOW"), ("d", T0 + day, "ALLOW"))
    now = [("a", T0 + day, "ALLOW"), *now[1:3], ("d", T0 + day, "ALLOW"), now[3]]
    assert load() == now
    before = puts._manifest(spark, path)[1]["days"]

    def crash(*_):
        raise RuntimeError("lost between write and swap")

    with monkeypatch.context() as m:
        m.setattr(puts, "_swap", crash)
        with pytest.raises(RuntimeError, match="swap"):
            puts.compact(spark, path, "request_id")
    assert load() == now and puts._manifest(spark, path)[1]["days"] == before
    assert puts.compact(spark, path, "request_id") == 1 and load() == now
    after = puts._manifest(spark, path)[1]["days"]
    assert {d for d in before if after.get(d) != before[d]} == {str(np.datetime64(T0, "us").astype("datetime64[D]")), str(np.datetime64(T0 + day, "us").astype("datetime64[D]"))}
    put(("c", T0 + 2 * day, "CHALLENGE"))
    with monkeypatch.context() as m:  # another compaction comes first
        m.setattr(puts.files, "put_new", lambda *_: False)
        with pytest.raises(FileExistsError):
            puts.compact(spark, path, "request_id")
    assert puts.compact(spark, path, "request_id") == 2 and ("c", T0 + 2 * day, "CHALLENGE") in load() and len(load()) == 5
    (tmp_path / "d/put/broken").mkdir()  # a writer that was lost
    assert len(load()) == 5


def test_ordered_steps(spark):
    """Equal to a loop over labels in order; one label is the online step; a larger batch takes the summed step."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(500, 15)) * 4, rng.integers(0, 2, 500)
    rows = [(*map(float, a), int(b), int(t), i) for i, (a, b, t) in enumerate(zip(x, y, rng.integers(0, 50, 500), strict=True))]
    labels = spark.createDataFrame(rows, LABELLED + ", ts_us long, seq long").repartition(5)
    w, b = np.array(STARTING.w), STARTING.b
    for r in sorted(rows, key=lambda r: r[-2:]):
        v = (np.array(r[:15]) - STARTING.mean) / STARTING.std
        e = 1 / (1 + np.exp(-(v @ w + b))) - r[15]
        w, b = w - 0.05 * e * v, b - 0.05 * e
    got = learning.ordered_fit(STARTING, labels)
    assert np.allclose(got.w, w, atol=1e-9) and got.b == pytest.approx(b, abs=1e-9)
    one = labels.where("seq = 3")
    assert np.allclose(learning.ordered_fit(STARTING, one).w, learning.partial_fit(STARTING, one).w, atol=1e-12)
    assert learning.ordered_fit(STARTING, labels, most=499) == learning.partial_fit(STARTING, labels)
    assert learning.ordered_fit(STARTING, labels.limit(0)) == STARTING


def test_fit_through_sums_of_gradients(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 15))
    rows = spark.createDataFrame([(*map(float, a), int(a[0] > 0)) for a in x], LABELLED).repartition(9)
    flat = learning.fit(rows, epochs=15)
    monkeypatch.setattr(learning, "FLAT", 4)
    assert np.allclose(learning.fit(rows, epochs=15).w, flat.w, atol=1e-9)
    assert learning.fit(rows, epochs=15, tol=1e9) == learning.fit(rows, epochs=1) != flat
