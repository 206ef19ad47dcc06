"""Rolling sketches and features in bounded memory, policies, and the bounds that a trained model is held to."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_requests import T0, log, result

from gatewatch.functions.columns import FEATURES
from gatewatch.operators import learning, reports, sketch, windows
from gatewatch.operators.scoring import SOFT, STARTING, Policy, check, decisions
from gatewatch.sources.requests import read_sessions


def test_rolling_sketches(spark):
    rng = random.Random(4)
    rows = [{"ts_us": T0 + rng.choice([rng.randrange(300_000_000), 900_000_000 + rng.randrange(9_000_000)]), "ip": rng.choice([None, *(f"1.1.1.{i}" for i in range(300))]), "path": rng.choice(["/a", "/b"])} for _ in range(1500)] + [{"ts_us": None}]
    df = windows.with_target(log(spark, rows)).cache()
    at = [(r["ip"], r["path"] + "|residential", r["ts_us"] // 5_000_000) for r in rows[:-1]]
    for width in (2048, 32):
        got = {(r.key, r.bucket): (r.minute, r.ten) for r in sketch.rolling_rates(df, "ip", {"minute": 13, "ten": 3}, width=width).collect()}
        assert set(got) == {(ip, b) for ip, _, b in at}
        over = 0
        for (ip, b), found in got.items():
            for most, n in zip((13, 3), found, strict=True):
                within = [x for x, _, y in at if b - most < y <= b]
                true = within.count(ip)
                assert n >= true
                over += n > true + 2.72 / width * len(within)
        # for a key in e ** depth at most
        assert over <= 2 * len(got) / 2.718**4
    got = {(r.target, r.bucket): r.approx_ips for r in sketch.rolling_ips(df).collect()}
    assert set(got) == {(t, b) for _, t, b in at}
    for (target, b), n in got.items():
        true = len({ip for ip, t, y in at if t == target and b - 13 < y <= b and ip})
        assert abs(n - true) <= max(1, true / 20)


def test_grid_does_not_grow_with_the_log(spark):
    """A grid holds so many cells a bucket at most, and the point-in-time one is of the window alone."""
    day = spark.range(40_000).select((T0 + F.col("id") * 2_000_000).alias("ts_us"), F.concat(F.lit("k"), F.col("id") % 5000).alias("ip"))
    got = sketch.windowed(day, "ip", T0 + 79_998_000_000, 60, width=256).where("estimate > 0")
    exact = day.where(F.col("ts_us") >= T0 + 79_935_000_000).select("ip").distinct().count()
    # with all of the log in one grid no cell would be empty
    assert exact <= got.count() <= 3 * exact and got.agg(F.max("estimate")).first()[0] <= 4


def test_features_in_bounded_memory(spark):
    """A flood of one endpoint from many IPs: its rate is told, each key's rows in memory are a tail."""
    rows = spark.range(9000).select(F.col("id").alias("seq"), (T0 + F.col("id") * 1000).alias("ts_us"), F.concat(F.lit("9."), F.col("id") % 6000).alias("ip"), *[F.lit(v).alias(c) for c, v in {"method": "POST", "path": "/login", "user_agent": "Mozilla/5.0", "accept": "text/html", "accept_language": "en", "cookie": "a=1", "honeypot_value": "", "asn_type": "residential"}.items()])
    got = sketch.features(rows, keep=("seq",)).orderBy("seq").collect()
    assert len(got) == 9000 and got[-1].target_req_60s >= 9000 and got[-1].target_distinct_ips_60s == 64
    assert got[8999].req_60s >= 2 and got[10].req_60s >= 1
    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * 5000), pa.array(["v"] * 5000), pa.array(range(5000)), pa.array([0] * 5000), pa.array([True] * 5000)], ["_key", "_value", "_at", "_chunk", "_own"])
    counting = {"n": lambda found: found["n60"].astype(float)}
    out = list(windows._sweep(counting, [], 64)(batch.slice(i, 100) for i in range(0, 5000, 100)))
    assert sum(b.num_rows for b in out) == 5000 and out[-1].column("n")[-1].as_py() == 64
    scored = decisions(sketch.features(rows, keep=("seq", "ts_us")))
    assert scored.where("exists(hits, h -> h.name = 'distributed_attack_sensitive')").count() > 8000


def test_policies(spark):
    rows = [{"ts_us": T0 + i * 100_000, "path": f"/p/{i}"} for i in range(60)] + [{"ip": "2.2.2.2", "path": "/signup"}]
    df = log(spark, rows)
    usual, same = result(check(df)), result(check(df, policy=Policy()))
    assert all(tuple(usual[i]) == tuple(same[i]) for i in usual)
    none = result(check(df, policy=Policy(rules=(), hard=(("never", "false", "x", "'x'"),), escalating=(), rule_share=0.0, model_share=1.0)))
    assert all(r.hits == [] and r.hard_reason is None and r.score == pytest.approx(r.model_proba) for r in none.values())
    policy = Policy(rules=(*SOFT, ("signups", "route = '/signup'", 0.5, "a signup")), escalating=("signups",), challenge_at=0.99, block_at=0.999, saturation=4.0)
    got = result(check(df, policy=policy))
    assert got[60].action == "CHALLENGE" and got[60].score == 0.99 and got[60].rule_score == 0.125 and got[59].action == "BLOCK"
    # rates at the edge of the rule for impossible ones, below, at and above
    assert [usual[i].hard_reason for i in (48, 49, 50)] == [None, None, "impossible request rate"] and usual[50].action == "BLOCK"


# Sessions written down by kind: header values, network, seconds between requests, paths.
BROWSER = {"user_agent": "Mozilla/5.0 (X11) Firefox/125.0", "accept": "text/html", "accept_language": "en-US", "cookie": "session=1", "asn_type": "residential"}
KINDS = {
    "reader": (0, BROWSER, [7, 23, 41, 12, 95, 30], ["/", "/article/{}", "/search?q=a", "/article/{}"]),
    "shopper": (0, BROWSER, [15, 4, 33, 61, 9], ["/", "/product/{}", "/cart", "/checkout"]),
    "signer": (0, {**BROWSER, "cookie": ""}, [11, 48, 26], ["/", "/signup", "/account"]),
    "scraper": (1, {"user_agent": "python-requests/2.31.0", "asn_type": "datacenter"}, [0.5] * 30, ["/article/{}"]),
    "crawler": (1, {**BROWSER, "user_agent": "Examplebot/1.0", "cookie": "", "accept_language": "", "asn_type": "datacenter"}, [1.0] * 40, ["/tag/{}", "/article/{}/x{}"]),
    "bare": (1, {"user_agent": "", "asn_type": "datacenter"}, [2, 2, 2, 2, 2, 2, 2], ["/login"]),
    # a bot that sends what a browser sends, at an even pace
    "mimic": (1, {**BROWSER, "cookie": ""}, [4.0] * 12, ["/article/{}"]),
}


def sessions(spark, path, counts, start_s, seed):
    """JSON sessions of these kinds in a file, each IP its own, and the requests that are read from it."""
    rng, lines, seq = random.Random(seed), [], 0
    for kind, count in counts.items():
        label, headers, gaps, paths = KINDS[kind]
        for n in range(count):
            at, events = start_s + rng.uniform(0, 1500), []
            pace = rng.uniform(0.8, 1.3) if label == 0 else 1.0
            for i, gap in enumerate(gaps):
                at += gap * pace * (rng.uniform(0.4, 1.8) if label == 0 else 1.0)
                events.append({"seq": seed * 10**6 + seq, "ip": f"{'185' if label and kind != 'mimic' else '73'}.{seed}.{len(lines)}.{n}", "ts_us": int(at * 1e6), "method": "GET", "path": paths[i % len(paths)].format(i, i), "honeypot_value": "", **{"accept": "", "accept_language": "", "cookie": "", **headers}})
                seq += 1
            lines.append(json.dumps({"session_id": seed * 1000 + len(lines), "archetype": kind, "label": label, "events": events}))
    path.mkdir(parents=True)
    (path / "sessions.json").write_text("\n".join(lines) + "\n")
    return read_sessions(spark, str(path))


def verdicts(rows, model):
    told = rows.select("seq", "session_id", "archetype", "label")
    return reports.session_verdicts(check(rows, model, keep=("seq",)).join(told, "seq")).cache()


def test_held_out_bounds(spark, tmp_path):
    """A model trained on some sessions is held to others: people pass, bots are flagged, and feedback finds mimics."""
    seed = sessions(spark, tmp_path / "seed", {"reader": 12, "shopper": 8, "signer": 5, "scraper": 8, "crawler": 6, "bare": 5}, 1_000_000, 1)
    first = seed.collect()
    assert len({r.session_id for r in first}) == 44 and {(r.archetype, r.label, r.user_agent) for r in first} >= {("reader", 0, KINDS["reader"][1]["user_agent"]), ("bare", 1, "")}
    assert [r.ts_us for r in first if r.session_id == 1000] == sorted(r.ts_us for r in first if r.session_id == 1000)
    labelled = windows.features(seed, keep=("seq",)).join(seed.select("seq", "label"), "seq").select(*FEATURES, "label").cache()
    model = learning.fit(labelled, epochs=200)
    assert learning.predictions(labelled, model).agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0] > 0.9

    held = sessions(spark, tmp_path / "held", {"reader": 20, "shopper": 14, "signer": 6, "scraper": 15, "crawler": 12}, 5_000_000, 2)
    shares = {r.label: r for r in reports.class_shares(verdicts(held, model)).collect()}
    assert shares[0].allowed > 0.85 and shares[1].flagged > 0.9
    c = reports.confusion(verdicts(held, model)).first()
    assert c.tp + c.fn == 27 and c.tn + c.fp == 40 and c.precision > 0.8 and c.recall > 0.9

    mimics = sessions(spark, tmp_path / "mimics", {"mimic": 30}, 6_000_000, 3)
    later = sessions(spark, tmp_path / "later", {"mimic": 30}, 7_000_000, 4)
    scored = check(mimics, model, keep=("seq",))
    said = scored.select("request_id", F.lit(1).alias("label"), F.lit("review").alias("source"))
    labels, rejected = learning.resolve_feedback(said, scored)
    retrained, summary = learning.retrain(labelled, labels, epochs=200)
    assert rejected.count() == 0 and {r.origin: r.n for r in summary.collect()}["collected"] == mimics.count()
    r = reports.before_after(verdicts(later, model), verdicts(later, retrained)).first()
    assert r.flagged_after > r.flagged_before


def test_a_swarm_is_flagged_and_its_members_alone_are_not(spark):
    """Quiet requests to one sensitive endpoint: each by itself passes, together most are flagged."""
    quiet = dict(BROWSER)
    campaign = [{"ip": f"66.1.{i // 250}.{i % 250}", "path": "/login", "method": "POST", "ts_us": T0 + i * 500_000, **quiet} for i in range(120)]
    alone = [{**r, "ts_us": T0 + i * 100_000_000} for i, r in enumerate(campaign[:20])]
    assert {r.action for r in check(log(spark, alone), STARTING).collect()} == {"ALLOW"}
    assert check(log(spark, campaign), STARTING).where(reports.is_flagged()).count() >= 0.6 * len(campaign)
