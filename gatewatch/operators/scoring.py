"""Rules, model score, blend and decision as one lazy plan of built-in columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.functions.columns import FEATURES, SENSITIVE
from gatewatch.operators.windows import features

# Shares and cuts of the blend.
SATURATION = 8.0
RULE_SHARE, MODEL_SHARE, CHALLENGE_AT, BLOCK_AT = 0.4, 0.6, 0.45, 0.80
ESCALATING = ("distributed_attack_sensitive",)

_SENSITIVE = "route IN (" + ", ".join(f"'{r}'" for r in SENSITIVE) + ")"
_SWARM = "target_distinct_ips_60s >= 10 AND target_req_60s >= 30"
# Rules that decide at once, the first that holds: name, condition, the decision's reason, the hit's reason.
HARD = [
    ("blocklist", "_blocked", "ip is on the blocklist", "'IP on blocklist'"),
    ("honeypot", "honeypot_filled != 0", "honeypot form field was filled in", "'hidden trap field was submitted with a value'"),
    ("velocity_hard", "req_10s > 50", "impossible request rate", "format_string('%d requests in 10s', CAST(req_10s AS BIGINT))"),
]
# Rules that add up: name, condition, weight, reason, in the order they are reported.
SOFT = [
    ("ua_missing", "ua_missing = 1", 2.0, "no User-Agent header"),
    ("ua_bot_token", "ua_bot_token = 1", 3.0, "User-Agent names a script or crawler"),
    ("accept_missing", "accept_missing = 1", 1.0, "no Accept header"),
    ("accept_lang_missing", "accept_lang_missing = 1", 1.0, "no Accept-Language header"),
    ("cookie_missing", "cookie_missing = 1", 1.0, "no session cookie"),
    ("high_velocity", "req_60s > 20", 2.0, "more than 20 requests in 60s"),
    ("path_scan", "distinct_paths_60s > 15", 2.0, "hit more than 15 distinct paths in 60s"),
    ("robotic_timing", "req_60s >= 6 AND iat_cv < 0.15", 3.0, "near-constant gap between requests"),
    ("datacenter_ip", "asn_datacenter = 1", 1.5, "request from a hosting/datacenter network"),
    ("bad_reputation", "ip_reputation > 0.6", 2.5, "IP has poor historical reputation"),
    ("distributed_attack", _SWARM, 3.5, "this endpoint is under coordinated load from many IPs at once"),
    ("distributed_attack_sensitive", f"{_SWARM} AND {_SENSITIVE}", 2.5, "coordinated load on a login/signup-class endpoint"),
    ("sensitive_endpoint_pressure", f"{_SENSITIVE} AND target_req_60s >= 15", 1.5, "elevated traffic to a login/signup-class endpoint"),
]


@dataclass(frozen=True)
class Policy:
    """What an operator may turn: rules (as HARD and SOFT, conditions in SQL), those that escalate, shares and cuts."""

    rules: tuple[tuple[str, str, float, str], ...] = tuple(SOFT)
    hard: tuple[tuple[str, str, str, str], ...] = tuple(HARD)
    escalating: tuple[str, ...] = ESCALATING
    saturation: float = SATURATION
    rule_share: float = RULE_SHARE
    model_share: float = MODEL_SHARE
    challenge_at: float = CHALLENGE_AT
    block_at: float = BLOCK_AT


@dataclass(frozen=True)
class Model:
    """Weights and bias over standardised features."""

    w: tuple[float, ...]
    b: float
    mean: tuple[float, ...]
    std: tuple[float, ...]


#: A plain starting model: round numbers, for use before there are labels.
STARTING = Model(
    w=(0.3, 0.5, 0.3, -0.2, -0.6, 0.4, 0.9, 0.5, 0.5, 0.4, 0.3, 0.7, 0.8, 0.2, 0.2),
    b=0.0,
    mean=(3.0, 10.0, 5.0, 10.0, 0.8, 0.2, 0.3, 0.3, 0.4, 0.2, 0.05, 0.3, 0.4, 100.0, 20.0),
    std=(4.0, 15.0, 6.0, 10.0, 0.4, 0.4, 0.5, 0.5, 0.5, 0.4, 0.2, 0.4, 0.5, 200.0, 30.0),
)


def _hit(name: str, weight: float, reason: str) -> str:
    return f"named_struct('name', '{name}', 'weight', {weight}D, 'reason', {reason})"


def evaluate(df: DataFrame, blocklist: DataFrame | None = None, rules: Sequence[tuple[str, str, float, str]] = SOFT, saturation: float = SATURATION, hard: Sequence[tuple[str, str, str, str]] = HARD) -> DataFrame:
    """Adds hard_reason, hits, rule_score.  blocklist: ip, one row each.  rules, hard: as SOFT and HARD, conditions in SQL."""
    if blocklist is not None:
        df = df.join(blocklist.select("ip", F.lit(True).alias("_blocked")), "ip", "left")
    else:
        df = df.withColumn("_blocked", F.lit(False))
    hard = hard or [("", "false", "", "''")]
    rules = rules or [("", "false", 0.0, "")]
    reason = "CASE " + " ".join(f"WHEN {cond} THEN '{text}'" for _, cond, text, _ in hard) + " END"
    first = "CASE " + " ".join(f"WHEN {cond} THEN array({_hit(name, 1.0, said)})" for name, cond, _, said in hard) + " END"
    quoted = lambda text: "'" + text.replace("'", "\\'") + "'"
    soft = "filter(array(" + ", ".join(f"IF({cond}, {_hit(name, weight, quoted(said))}, NULL)" for name, cond, weight, said in rules) + "), h -> h IS NOT NULL)"
    total = " + ".join(f"IF({cond}, {weight}D, 0D)" for _, cond, weight, _ in rules)
    out = df.selectExpr("*", f"{reason} AS hard_reason", f"coalesce({first}, {soft}) AS hits")
    return out.selectExpr("*", f"IF(hard_reason IS NOT NULL, 1D, least(1D, ({total}) / {saturation}D)) AS rule_score").drop("_blocked")


def probability(model: Model) -> Column:
    z = " + ".join([f"{model.b!r}D", *(f"{w!r}D * ({c} - {m!r}D) / {d!r}D" for c, w, m, d in zip(FEATURES, model.w, model.mean, model.std, strict=True))])
    return F.element_at(F.expr(f"transform(array({z}), z -> CASE WHEN z <= -35 THEN 0D WHEN z >= 35 THEN 1D ELSE 1 / (1 + exp(-z)) END)"), 1)


def decide(df: DataFrame, model: Model = STARTING, policy: Policy | None = None) -> DataFrame:
    """Adds model_proba, score, action, reasons, challenge_token.  df: evaluate()'s columns and request_id."""
    p = policy or Policy()
    df = df.withColumn("model_proba", probability(model))
    escalating = ", ".join(f"'{name}'" for name in p.escalating)
    blend = f"{p.rule_share!r}D * rule_score + {p.model_share!r}D * model_proba"
    rises = f"hard_reason IS NULL AND exists(hits, h -> h.name IN ({escalating})) AND {blend} < {p.challenge_at!r}D" if p.escalating else "false"
    df = df.selectExpr("*", f"{blend} AS _blend", f"{rises} AS _escalated")
    said = "concat(transform(hits, h -> concat(h.name, ': ', h.reason)), array(format_string('model p(bot) = %.2f', model_proba)), IF(_escalated, array('escalated to CHALLENGE by a high-confidence rule'), CAST(array() AS array<string>)))"
    df = df.selectExpr("*", f"CASE WHEN hard_reason IS NOT NULL THEN 1D WHEN _escalated THEN {p.challenge_at!r}D ELSE _blend END AS score", f"IF(hard_reason IS NOT NULL, array(hard_reason), {said}) AS reasons")
    df = df.selectExpr("*", f"CASE WHEN hard_reason IS NOT NULL OR score >= {p.block_at!r}D THEN 'BLOCK' WHEN score >= {p.challenge_at!r}D THEN 'CHALLENGE' ELSE 'ALLOW' END AS action")
    return df.selectExpr("*", "IF(action = 'CHALLENGE', concat('chal-', substring(sha2(request_id, 256), 1, 16)), NULL) AS challenge_token").drop("_blend", "_escalated")


def decisions(featured: DataFrame, model: Model = STARTING, blocklist: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    """Rules, model and decision of rows that have their features.  Request ids come from seq."""
    p = policy or Policy()
    scored = evaluate(featured, blocklist, p.rules, p.saturation, p.hard)
    return decide(scored.withColumn("request_id", F.concat(F.lit("req-"), F.col("seq").cast("string"))), model, p)


def check(df: DataFrame, model: Model = STARTING, reputation: DataFrame | None = None, blocklist: DataFrame | None = None, keep: tuple[str, ...] | None = None, policy: Policy | None = None, peers: bool = False) -> DataFrame:
    """Score a whole request log: features, rules, model, decision.  keep, peers: as in features()."""
    return decisions(features(df, reputation, keep=keep, peers=peers), model, blocklist, policy)


def rounded(df: DataFrame) -> DataFrame:
    """What a client sees: scores to three places."""
    return df.select("request_id", "action", *[F.round(c, 3).alias(c) for c in ("score", "model_proba", "rule_score")], "challenge_token")
