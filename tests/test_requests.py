import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewatch.functions.columns import FEATURES, clamped, route_of
from gatewatch.jobs import queries
from gatewatch.operators import learning, reports, sketch, windows
from gatewatch.operators.scoring import STARTING, Model, check
from gatewatch.sources import requests
from gatewatch.streaming import score

BROWSER = {"method": "GET", "path": "/article/3", "user_agent": "Mozilla/5.0 Safari/605", "accept": "text/html", "accept_language": "en-US", "cookie": "session=42", "honeypot_value": "", "asn_type": "residential"}
SCHEMA = "seq long, ts_us long, ip string, method string, path string, user_agent string, accept string, accept_language string, cookie string, honeypot_value string, asn_type string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
T0 = 1_000_000_000_000


def log(spark, rows):
    full = [{"seq": i, "ip": "73.5.9.2", "ts_us": T0, **BROWSER, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in full], SCHEMA)


def result(df):
    return {r.seq: r for r in df.collect()}


@pytest.mark.parametrize(("path", "route"), [("/article/5", "/article/{id}"), ("/article/5?x=1", "/article/{id}"), ("/", "/"), ("", "/"), ("//", "/"), ("/login/", "/login"), ("/tag/abc123", "/tag/abc123"), ("/o/deadbeefdead", "/o/{id}"), ("/o/123e4567-e89b-12d3", "/o/{id}"), ("/o/dead-beef", "/o/dead-beef")])
def test_routes(spark, path, route):
    assert spark.createDataFrame([(path,)], "p string").select(route_of(F.col("p"))).first()[0] == route


def test_json(spark):
    lines = ['{"ip":"1.2.3.4","ts":"12.5","other":1}', "", "no json", '{"ts":"soon"}', '{"ip":null,"ts":3}']
    good, bad = requests.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = {(r.ip, r.ts_us) for r in good.collect() if r.ts_us < 10**12}
    assert rows == {("1.2.3.4", 12_500_000), ("0.0.0.0", 3_000_000)}
    assert good.count() == 3 and {r.line for r in bad.collect()} == {"no json", '{"ts":"soon"}'}


def test_windows_against_brute_force(spark):
    random.seed(3)
    rows = [{"ts_us": T0 + random.choice([0, 1, 10, 60, 61, 300, 359]) * 1_000_000 + random.choice([0, 0, 1]), "ip": random.choice(["a", "b"]), "path": random.choice(["/1", "/2", "/3?q"])} for _ in range(150)]
    df = log(spark, rows)
    got = result(windows.features(df, chunk_s=60))
    plain = result(windows.builtin_counts(df, "ip", "path"))
    full = [{"seq": i, **r} for i, r in enumerate(rows)]
    for r in full:
        past = [x for x in full if x["ip"] == r["ip"] and (x["ts_us"], x["seq"]) <= (r["ts_us"], r["seq"])]
        w = sorted((x for x in past if x["ts_us"] >= r["ts_us"] - 60_000_000), key=lambda x: x["ts_us"])
        g = got[r["seq"]]
        assert g.req_60s == len(w) == plain[r["seq"]].n60
        assert g.distinct_paths_60s == len({x["path"] for x in w}) == plain[r["seq"]].different
        assert g.req_10s == sum(x["ts_us"] >= r["ts_us"] - 10_000_000 for x in w)
        gaps = np.diff([x["ts_us"] / 1e6 for x in w])
        assert g.iat_mean == pytest.approx(gaps.mean() if len(gaps) else 30.0, abs=1e-6)
        cv = 1.0 if not len(gaps) else gaps.std() / gaps.mean() if gaps.mean() > 1e-9 else 0.0
        assert g.iat_cv == pytest.approx(cv, abs=1e-4)


def test_hot_key_is_many_groups(spark):
    """A key with the whole of a short log: groups are of its seconds, in plans without Python; a null key is a key."""
    rng = random.Random(4)
    rows = [{"ts_us": T0 + i * 100_000 + rng.choice([0, 0, 7]) + (90_000_000 if i > 1500 else 0), "ip": None if i % 50 == 0 else "a", "path": f"/{rng.randrange(40)}"} for i in range(3000)]
    df = log(spark, rows).cache()
    got = windows.sliding(df, "ip", "path")
    assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "Pandas" not in plan
    every = windows.events(df, "ip", "path").groupBy("k", F.floor(F.col("at") / 1_000_000)).count()
    assert every.agg(F.max("count")).first()[0] <= 100
    here, want = (result(x) for x in (got, windows.builtin_counts(df, "ip", "path")))
    assert len(here) == 3000 and all((here[i].n60, here[i].different) == (want[i].n60, want[i].different) for i in want)


def test_edges_of_the_window(spark):
    got = result(windows.features(log(spark, [{}, {"ts_us": T0 + 60_000_000}, {"ts_us": T0 + 60_000_001}])))
    assert [got[i].req_60s for i in range(3)] == [1, 2, 2]


def test_decisions(spark):
    bare = {"accept": "", "accept_language": "\t", "cookie": "", "user_agent": "python-requests/2.31.0"}
    rows = [{}, {"ip": "185.10.20.30", **bare}, {"ip": "12.1.1.1", "path": "/signup", "honeypot_value": "x"}, {"ip": "9.9.9.9"}]
    rows += [{"ip": "8.8.8.8", "ts_us": T0 + 10**9 + i * 100_000} for i in range(60)]
    rows += [{"ip": f"7.7.7.{i}", "path": "/login", "asn_type": "datacenter", "ts_us": T0 + 2 * 10**9} for i in range(40)]
    got = result(check(log(spark, rows), blocklist=spark.createDataFrame([("9.9.9.9",)], "ip string")))
    assert got[0].action == "ALLOW" and got[0].hits == [] and got[0].rule_score == 0
    assert got[1].action in ("BLOCK", "CHALLENGE") and [h.name for h in got[1].hits][0] == "ua_bot_token" and got[1].rule_score == 1.0
    assert got[2].action == "BLOCK" and got[2].reasons == ["honeypot form field was filled in"]
    assert got[3].hard_reason == "ip is on the blocklist" and got[3].score == 1.0
    assert got[4 + 49].hard_reason is None and got[4 + 50].hits[0].reason == "51 requests in 10s"
    assert {"distributed_attack", "distributed_attack_sensitive"} <= {h.name for h in got[103].hits}
    assert all((r.challenge_token is not None) == (r.action == "CHALLENGE") for r in got.values())


def test_escalation_and_clamp(spark):
    quiet = Model((0.0,) * 15, -40.0, (0.0,) * 15, (1.0,) * 15)
    rows = [{"ip": f"7.7.7.{i}", "path": "/login"} for i in range(40)]
    last = result(check(log(spark, rows), quiet))[39]
    assert last.action == "CHALLENGE" and last.score == 0.45 and last.reasons[-1].startswith("escalated")
    assert spark.range(1).select(clamped(F.lit(3.0)), clamped(F.lit(-1.0))).first() == (1.0, 0.0)


def test_training(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 15)).round(1)
    y = (x[:, 0] + x[:, 3] > 0).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in FEATURES) + ", label int")
    model = learning.fit(rows, epochs=60)
    z, w, b = (x - x.mean(0)) / x.std(0), np.zeros(15), 0.0
    for _ in range(60):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.3 * (z.T @ e / 200 + 1e-3 * w), b - 0.3 * e.mean()
    assert np.allclose(model.w, w, atol=1e-9) and model.b == pytest.approx(b)
    for m in (model, learning.fit(rows, method="lbfgs")):
        assert learning.predictions(rows, m).where("predicted = label").count() > 190
    learning.save_model(spark, STARTING, str(tmp_path / "m"), 0)
    learning.save_model(spark, model, str(tmp_path / "m"), 1)
    assert learning.load_model(spark, str(tmp_path / "m")) == model
    one = rows.limit(1).cache()
    r = one.first()
    v = (np.array(r[:15]) - model.mean) / model.std
    e = 1 / (1 + np.exp(-(v @ model.w + model.b))) - r.label
    assert np.allclose(learning.partial_fit(model, one).w, model.w - 0.05 * e * v)
    assert learning.weights_report(spark, model).first().feature in ("req_10s", "iat_mean")


def test_retrained_accuracy(spark):
    """Against 400 epochs in numpy, and the starting model beside them."""
    sf = "/root/testdata/sf0.001"
    got = queries.retrained_accuracy(spark, sf).first()
    scored = queries.checked(spark, sf)
    users = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), (F.col("user_id") % 10).isin(0, 1, 2, 4).cast("int").alias("label"))
    rows = np.array(scored.select("seq", *FEATURES).join(users, "seq").select(*FEATURES, "label").collect(), float)
    said = np.array(learning.resolve_feedback(queries.feedback(spark, sf), scored)[0].select(*FEATURES, "label").collect(), float)
    both = np.r_[rows, said]
    mean, std = both[:, :-1].mean(0), both[:, :-1].std(0)
    std = np.where(std**2 > 1e-12, std, 1.0)
    z, y, w, b = (both[:, :-1] - mean) / std, both[:, -1], np.zeros(15), 0.0
    for _ in range(400):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.3 * (z.T @ e / len(y) + 1e-3 * w), b - 0.3 * e.mean()
    right = lambda z, w, b: ((z @ np.array(w) + b >= 0) == rows[:, -1]).mean()
    assert got.n == len(rows)
    assert got.accuracy == pytest.approx(right((rows[:, :-1] - mean) / std, w, b), abs=2 / len(rows))
    assert got.accuracy_before == pytest.approx(right((rows[:, :-1] - STARTING.mean) / STARTING.std, STARTING.w, STARTING.b), abs=2 / len(rows))


def test_labels_and_tables(spark, tmp_path):
    scored = check(log(spark, [{}, {"honeypot_value": "x"}]))
    said = spark.createDataFrame([("req-0", 0), ("req-0", 1), ("req-9", 1)], "request_id string, label int")
    labels, rejected = learning.resolve_feedback(said, scored)
    assert labels.count() == 2 and rejected.first().request_id == "req-9"
    own = learning.honeypot_labels(scored)
    assert [(r.request_id, r.label) for r in own.collect()] == [("req-1", 1)]
    learning.append_labels(labels.unionByName(own), str(tmp_path / "l"))
    assert learning.load_labels(spark, str(tmp_path / "l")).where("req_60s >= 1").count() == 3
    put = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, ts int, v string")
    assert {(r.k, r.v) for r in learning.latest(put, "k").collect()} == {("a", "y"), ("b", "z")}
    ch = spark.createDataFrame([("t", False), ("u", False)], "token string, solved boolean")
    done, unknown = learning.solve(ch, spark.createDataFrame([("t",), ("t",), ("v",)], "token string"))
    assert reports.challenges(done).first() == (2, 1) and unknown.first().token == "v"
    ses = spark.createDataFrame([(1, 1, 0, "ALLOW", "req-2"), (2, 2, 1, "ALLOW", "req-3"), (3, 3, 0, "ALLOW", "req-4"), (4, 4, 0, "ALLOW", "req-5")], "session_id int, session_seq int, label int, action string, request_id string")
    assert {(r.session_id, r.label) for r in learning.review_picks(ses).collect()} == {(2, 1), (3, 0)}


def test_sketch(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 3000, "whale").otherwise(F.col("id").cast("string")).alias("k"))
    grid = sketch.build(df, F.col("k"), width=512)
    got = sketch.estimate(grid, df.select(F.col("k").alias("key")), width=512)
    assert got.where("estimate < 1").count() == 0 and sketch.total(grid).first()[0] == 6000
    assert 3000 <= sketch.heavy_hitters(got, 1).first().estimate <= 3120


def test_reports_edges(spark):
    scored = check(log(spark, [{}]))
    assert reports.recent(scored, 0).count() == 0 and reports.recent(scored).count() == 1
    empty = spark.createDataFrame([], "label int, action string")
    assert reports.confusion(empty).first() == (0, 0, 0, 0, 0.0, 0.0)
    assert reports.timeseries(scored, T0).first()[1:] == (1, 0, 0)


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"seq": i, "ts_us": T0 + i * 7_000_000, "ip": f"1.1.1.{i % 3}", "honeypot_value": "x" if i == 5 else ""} for i in range(40)]
    df = log(spark, rows)
    for part in range(4):
        df.where(f"seq div 10 = {part}").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    learning.save_model(spark, STARTING, str(tmp_path / "m"), 0)
    for part in range(4):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / f"in/p[0-{part}]"))
        score.stream_check(stream, str(tmp_path / "m"), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = result(spark.read.parquet(str(tmp_path / "out/decisions")))
    want = result(check(df))
    assert len(got) == 40 and all((got[i].action, got[i].req_60s, round(got[i].score, 9)) == (want[i].action, want[i].req_60s, round(want[i].score, 9)) for i in want)
    assert spark.read.parquet(str(tmp_path / "out/labels")).count() == 1
    before = score.score_batch(spark, str(tmp_path / "m"), str(tmp_path / "out"))
    before(df.where("seq >= 30"), 3)  # a replayed batch
    assert spark.read.parquet(str(tmp_path / "out/decisions")).count() == 40
    before(log(spark, [{"seq": 99, "ts_us": T0}]), 4)
    assert spark.read.parquet(str(tmp_path / "out/late")).first().seq == 99


def test_online_update_after_a_retrain(spark, tmp_path):
    """A version published in between, larger than any batch's number, holds no later batch of labels back."""
    path = str(tmp_path / "m")
    learning.save_model(spark, STARTING, path, 7)
    one = ", ".join(f"{c} double" for c in FEATURES) + ", label int"
    versions = lambda: sorted(((r.version, r.batch) for r in spark.read.schema(learning.MODEL).json(path).collect()), key=lambda v: v[0])
    for n in (0, 1):
        spark.createDataFrame([(*[1.0] * 15, n)], one).write.mode("append").parquet(str(tmp_path / "l"))
        before = learning.load_model(spark, path)
        score.online_update(spark.readStream.schema(one).parquet(str(tmp_path / "l")), path, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert learning.load_model(spark, path) != before
        if n == 0:
            learning.save_model(spark, STARTING, path, 20)
    assert versions() == [(7, None), (8, 0), (20, None), (21, 1)]


def test_window_streams(spark, tmp_path):
    rows = [{"ts_us": T0 + i * 1_000_000, "ip": f"1.1.1.{i % 12}", "path": "/login"} for i in range(200)]
    log(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for i, df in enumerate((score.endpoint_pressure(stream), score.key_rates(stream))):
        df.writeStream.format("memory").outputMode("append").queryName(f"q{i}").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("q0").where("swarm").count() > 0 and spark.table("q1").agg(F.sum("n")).first()[0] > 100


def test_sessions_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"session_id": 1, "archetype": "a", "label": 1, "events": [{"seq": 0, "ip": "x", "ts_us": 5}, {"seq": 1, "ip": "x", "ts_us": 6}]}))
    assert requests.read_sessions(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("most", [None, 5])
def test_window_numbers(most):
    rng = np.random.default_rng(6)
    group = np.sort(rng.integers(0, 5, 400))
    group = np.unique(group, return_inverse=True)[1]
    ts = np.concatenate([np.sort(rng.choice([0, 1, 5, 10, 11, 40, 60, 65, 70, 300], n) * 1_000_000 + rng.integers(0, 2, n)) for n in np.bincount(group)]) + 10**15
    value = rng.integers(0, 6, 400)
    got = windows.window_numbers(ts, group, value, most)
    for i in range(400):
        before = np.flatnonzero((group == group[i]) & (np.arange(400) <= i))
        w = before[ts[before] >= ts[i] - 60_000_000][-(most or 400) :]
        gaps = np.diff(ts[w])
        want = {"n10": (ts[before] >= ts[i] - 10_000_000).sum(), "n60": len(w), "different": len(set(value[w])), "total": gaps.sum(), "square": (gaps * gaps).sum(), "bucketed": (ts[before] // 5_000_000 >= ts[i] // 5_000_000 - 12).sum()}
        assert {k: v[i] for k, v in got.items()} == want


def test_hot_key_streams(spark, monkeypatch):
    """A million rows of one key in a minute, in steps far smaller than its window; null keys and values count as others do."""
    monkeypatch.setattr(windows, "STEP", 20_000)
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * 59 + T0).alias("ts_us"), F.lit("a").alias("k"), F.when(F.col("id") % 1000 > 0, (F.xxhash64("id") % 5000).cast("string")).alias("v"))
    few = spark.range(3).select((F.col("id") + n).alias("seq"), F.lit(T0).alias("ts_us"), F.lit(None).cast("string").alias("k"), F.lit("x").alias("v"))
    kinds = {"n": windows._whole("n60"), "different": windows._whole("different")}
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    got = windows.swept(df.unionByName(few), "k", "v", kinds, ["seq", "v"]).toPandas().sort_values("seq")
    spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    hot, null = got[got.seq < n], got[got.seq >= n]
    assert hot.n.tolist() == list(range(1, n + 1)) and null.n.tolist() == [1, 2, 3] and null.different.tolist() == [1, 1, 1]
    assert hot.different.tolist() == np.cumsum(~hot.v.fillna("").duplicated()).tolist()


def test_busy_keys(spark, monkeypatch):
    """One key with more rows in a minute than a task takes, beside many others: found by itself, equal to the plain way."""
    n = 30_000
    base = dict(zip(NAMES[3:], [BROWSER[c] for c in NAMES[3:]], strict=True))
    hot = F.col("id") < n
    df = spark.range(n + 6000).select(F.col("id").alias("seq"), (T0 + F.when(hot, F.col("id") * 1999).otherwise(F.col("id") * 7919 % 300_000_000)).alias("ts_us"), F.when(hot, "9.9.9.9").otherwise(F.concat(F.lit("1.1."), F.col("id") % 900)).alias("ip"), *[F.lit(v).alias(c) for c, v in base.items() if c != "path"], F.concat(F.lit("/article?"), F.xxhash64("id") % 300).alias("path"))
    df = df.select(*NAMES).cache()
    found = windows.busy_keys(windows.with_target(df), ("ip", "target"), most=8000)
    assert {k: [r.busy for r in v.collect()] for k, v in found.items()} == {"ip": ["9.9.9.9"], "target": ["/article|residential"]}
    assert windows.busy_keys(windows.with_target(df), ("ip",), most=40_000) == {}
    got, want = (windows.features(df, most=m) for m in (8000, 10**9))
    assert "Sliding" not in (plan := got._jdf.queryExecution().toString()) and "Union" in plan and "Union" not in want._jdf.queryExecution().toString()
    numbers = [*windows.BY_IP, *windows.BY_TARGET]
    got, want = (sorted(map(tuple, x.select("seq", *[F.round(c, 6) for c in numbers]).collect())) for x in (got, want))
    assert got == want and len(got) == n + 6000
    # groups that hold all rows of the busy key are of a second
    every = windows.events(df.where("ip = '9.9.9.9'"), "ip", "path").groupBy("k", F.floor(F.col("at") / 1_000_000)).count()
    assert every.agg(F.max("count")).first()[0] < 3000


def test_no_row_is_lost(spark):
    """Rows without a time come back with null numbers; batches, text of several chunks and a null key or value lose nothing."""
    df = log(spark, [{"ts_us": None}, {}, {"ts_us": T0 + 5_000_000}, {"ip": None, "path": None}, {"ts_us": None, "ip": None}])
    got = result(check(df))
    assert {i: r.req_60s for i, r in got.items()} == {0: None, 1: 1, 2: 2, 3: 1, 4: None} and got[0].action == "ALLOW"
    make = {"n": windows._whole("n60"), "different": windows._whole("different")}
    part = lambda a, z: pa.RecordBatch.from_arrays([pa.array(range(a, z)), pa.array(["k"] * (z - a)), pa.array([f"v{i % 3}" if i % 5 else None for i in range(a, z)]), pa.array([T0 + i for i in range(a, z)]), pa.array([0] * (z - a), pa.int64()), pa.array([i % 7 > 0 for i in range(a, z)])], ["seq", "_key", "_value", "_at", "_chunk", "_own"])
    for step in (1, 40, 10**6):
        old, windows.STEP = windows.STEP, step
        out = pa.Table.from_batches(list(windows._sweep(make, ["seq"], None)(part(a, a + 10) for a in range(0, 100, 10))))
        windows.STEP = old
        own = [i for i in range(100) if i % 7]
        assert out.column("seq").to_pylist() == own and out.column("n").to_pylist() == [i + 1 for i in own]
        assert out.column("different").to_pylist() == [len({i % 3 if i % 5 else None for i in range(j + 1)}) for j in own]
    codes = windows._codes(pa.chunked_array([pa.array(["a", None, "b"], pa.large_string()), pa.array(["b", "a", None, "c"], pa.large_string())]))
    assert codes.tolist() == [0, -1, 1, 1, 0, -1, 2]


def test_features_meet_running_sums(spark):
    """Both ways of the windows agree over chunks' borders, and so do the reports of tails and buckets with brute force."""
    rng = random.Random(12)
    rows = [{"ts_us": T0 + rng.randrange(400_000_000), "ip": rng.choice("abc"), "path": f"/{rng.randrange(9)}"} for _ in range(400)]
    df = log(spark, rows).cache()
    streamed, sums = result(windows.features(df)), result(windows.sliding(df, "ip", "path"))
    for i, r in sums.items():
        s = streamed[i]
        assert (s.req_10s, s.req_60s, s.distinct_paths_60s, s.iat_mean, s.iat_cv) == (r.n10, r.n60, r.different, r.iat_mean, r.iat_cv)
    rates, tails = result(windows.bucketed_rate(df, "ip")), result(windows.tail_features(df, "ip", "path", most=4))
    full = [{"seq": i, **r} for i, r in enumerate(rows)]
    for r in full:
        past = sorted((x for x in full if x["ip"] == r["ip"] and (x["ts_us"], x["seq"]) <= (r["ts_us"], r["seq"])), key=lambda x: (x["ts_us"], x["seq"]))
        assert rates[r["seq"]].ip_rate == sum(x["ts_us"] // 5_000_000 >= r["ts_us"] // 5_000_000 - 12 for x in past)
        w = [x for x in past[-4:] if x["ts_us"] >= r["ts_us"] - 60_000_000]
        assert (tails[r["seq"]].ip_n, tails[r["seq"]].ip_different) == (len(w), len({x["path"] for x in w}))


def test_stream_with_tables(spark, tmp_path):
    """Blocked and reputed IPs are told on the stream as in batch; only the tails that a replay needs stay."""
    rows = [{"seq": i, "ts_us": T0 + i * 7_000_000, "ip": f"1.1.1.{i % 4}"} for i in range(30)]
    df = log(spark, rows)
    spark.createDataFrame([("1.1.1.1", 0.9)], "ip string, score double").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("1.1.1.2",)], "ip string").write.parquet(str(tmp_path / "b"))
    learning.save_model(spark, STARTING, str(tmp_path / "m"), 0)
    run = score.score_batch(spark, str(tmp_path / "m"), str(tmp_path / "out"), str(tmp_path / "r"), str(tmp_path / "b"))
    for n in range(3):
        run(df.where(f"seq div 10 = {n}"), n)
    got = result(spark.read.parquet(str(tmp_path / "out/decisions")))
    want = result(check(df, STARTING, spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "b"))))
    assert len(got) == 30 and all((got[i].action, got[i].reasons, got[i].ip_reputation) == (want[i].action, want[i].reasons, want[i].ip_reputation) for i in want)
    assert {r.action for i, r in got.items() if i % 4 == 2} == {"BLOCK"} and got[1].ip_reputation == 0.9
    assert sorted(p.name for p in (tmp_path / "out/tail").iterdir()) == ["n=1", "n=2"]
    run(log(spark, [{"seq": 99, "ts_us": T0 + 5}]), 3)  # late, and scored with what is left
    assert spark.read.parquet(str(tmp_path / "out/decisions")).where("seq = 99").first().req_60s == 1


def test_streamed_counts_and_labels(spark, tmp_path):
    scored = check(log(spark, [{"ts_us": T0 + i * 4_000_000, "ip": "1.1.1.1" if i % 2 else "2.2.2.2"} for i in range(20)]))
    scored.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(scored.schema).parquet(str(tmp_path / "d"))
    score.action_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.start.timestamp(), r.n) for r in spark.table("counts").collect()} == {(r.start.timestamp(), r.n) for r in score.action_counts(scored).collect()} and spark.table("counts").count() == 8
    said = spark.createDataFrame([("req-1", 1), ("req-77", 0)], "request_id string, label int")
    said.write.parquet(str(tmp_path / "f"))
    score.label_stream(spark.readStream.schema(said.schema).parquet(str(tmp_path / "f")), str(tmp_path / "d"), str(tmp_path / "o"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o/labels")).first().request_id == "req-1" and spark.read.parquet(str(tmp_path / "o/rejected")).first().request_id == "req-77"


def test_puts_and_restarts(spark, tmp_path):
    first = spark.createDataFrame([("a", T0, "ALLOW"), ("b", T0 + 10**11, "ALLOW")], "request_id string, ts_us long, action string")
    learning.put(first, str(tmp_path / "d"))
    learning.put(spark.createDataFrame([("a", T0 - 10**11, "BLOCK")], first.schema), str(tmp_path / "d"))
    assert {(r.request_id, r.action) for r in learning.load_put(spark, str(tmp_path / "d"), "request_id").collect()} == {("a", "BLOCK"), ("b", "ALLOW")}
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 15))
    schema = ", ".join(f"{c} double" for c in FEATURES) + ", label int"
    seed, labels = (spark.createDataFrame([(*map(float, a), int(a[0] > 0)) for a in part], schema) for part in (x[:40], x[40:]))
    path = str(tmp_path / "m")
    assert learning.catch_up(spark, seed, path, epochs=5) == learning.fit(seed, epochs=5) == learning.load_model(spark, path)
    assert learning.catch_up(spark, seed, path, labels.limit(0), epochs=9) == learning.fit(seed, epochs=5)  # what is saved stays
    model = learning.catch_up(spark, seed, path, labels, epochs=5)
    assert model == learning.load_model(spark, path) and learning.newest(spark, path) == 1
    assert np.allclose(model.w, learning.fit(seed.unionByName(labels), epochs=5).w)
    assert {tuple(r) for r in learning.publish(spark, seed, labels, path, epochs=1)[1].collect()} == {("seed", 40), ("collected", 20)}


def test_fixed_values():
    from gatewatch.functions import columns

    assert len(columns.BOT_TOKENS) == 18 and {"curl", "python-requests", "go-http-client", "playwright"} < set(columns.BOT_TOKENS)
    assert columns.SENSITIVE == ("/login", "/signup", "/checkout", "/password-reset", "/api/token") and columns.BAD_PREFIXES == ("185.", "45.", "193.")
    assert columns.FEATURES[0] == "req_10s" and columns.FEATURES[4] == "iat_cv" and columns.FEATURES[-1] == "target_distinct_ips_60s" and len(columns.FEATURES) == 15


@pytest.mark.parametrize("step", [1, 7, 10**6])
def test_peers_count_each_other(spark, step):
    """Rows of one time, over batches and chunks, as a RANGE frame of SQL counts them; rows without a time wait for none."""
    rng = random.Random(8)
    rows = [{"ts_us": T0 + rng.choice([0, 1, 9, 10, 60, 61, 119, 120, 180]) * 1_000_000, "ip": rng.choice("ab"), "path": f"/{rng.randrange(4)}"} for _ in range(90)]
    df = log(spark, rows).cache()
    frame = "OVER (PARTITION BY ip ORDER BY ts_us RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
    plain = df.selectExpr("seq", f"count(*) {frame.format(10_000_000)} AS n10", f"count(*) {frame.format(60_000_000)} AS n60", f"size(collect_set(path) {frame.format(60_000_000)}) AS different", f"(ts_us - min(ts_us) {frame.format(60_000_000)}) / 1e6 AS span")
    want = {r.seq: (r.n10, r.n60, r.different, r.span / (r.n60 - 1) if r.n60 > 1 else 30.0) for r in plain.collect()}
    told = lambda r, names: tuple(pytest.approx(r[c]) for c in names)
    named = ("req_10s", "req_60s", "distinct_paths_60s", "iat_mean")
    assert {i: told(r, named) for i, r in result(windows.features(df, peers=True)).items()} == want
    assert {i: told(r, named) for i, r in result(windows.features(df, peers=True, most=5)).items()} == want
    assert {i: told(r, ("n10", "n60", "different", "iat_mean")) for i, r in result(windows.sliding(df, "ip", "path", peers=True)).items()} == want
    one = sorted(({"seq": i, **r} for i, r in enumerate(rows) if r["ip"] == "a"), key=lambda r: (r["ts_us"], r["seq"])) + [{"seq": i, "ts_us": None, "path": "/"} for i in range(90, 96)]
    table = pa.table({"seq": [r["seq"] for r in one], "_key": ["a"] * len(one), "_value": [r["path"] for r in one], "_at": pa.array([r["ts_us"] for r in one], pa.int64()), "_chunk": pa.array([0 if r["ts_us"] else 1 for r in one], pa.int64()), "_own": [True] * len(one)})
    old, windows.STEP = windows.STEP, step
    out = pa.Table.from_batches(list(windows._sweep(windows.kinds_of({"n": "n60", "d": "different"}), ["seq"], None, True)(iter(table.to_batches(max_chunksize=4)))))
    windows.STEP = old
    assert out.column("seq").to_pylist() == [r["seq"] for r in one]
    assert [(n, d) for n, d in zip(out.column("n").to_pylist(), out.column("d").to_pylist(), strict=True)] == [want[r["seq"]][1:3] if r["ts_us"] else (None, None) for r in one]
