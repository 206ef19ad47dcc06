"""Scalar columns over one request: route, target, header flags, reputation, buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of scripted clients, sensitive routes, prefixes of poor reputation.
BOT_TOKENS = ("bot", "spider", "crawler", "slurp", "curl", "wget", "python-requests", "python-urllib", "aiohttp", "scrapy", "httpclient", "okhttp", "go-http-client", "java/", "headless", "phantomjs", "puppeteer", "playwright")
SENSITIVE = ("/login", "/signup", "/checkout", "/password-reset", "/api/token")
BAD_PREFIXES = ("185.", "45.", "193.")
# The features in the order of a vector.
FEATURES = ("req_10s", "req_60s", "distinct_paths_60s", "iat_mean", "iat_cv", "ua_missing", "ua_bot_token", "accept_missing", "accept_lang_missing", "cookie_missing", "honeypot_filled", "ip_reputation", "asn_datacenter", "target_req_60s", "target_distinct_ips_60s")
BUCKET_US = 5_000_000

#: Anything but white space of any kind.
VISIBLE = r"[^\s\x1c-\x1f\x85\p{Z}]"


#: A whole path segment that is an id.
ID_SEGMENT = r"(^|/)(?:[0-9]+|[0-9a-fA-F]{12,}|[0-9a-fA-F-]{16,})(?=/|$)"


def route_of(path: Column) -> Column:
    """The path without query and trailing slashes, ids as {id}; empty: /."""
    bare = F.rtrim(F.substring_index(path, "?", 1), F.lit("/"))
    return F.when(bare == "", "/").otherwise(F.regexp_replace(bare, ID_SEGMENT, "$1{id}"))


def target_of(route: Column, asn_type: Column) -> Column:
    return F.concat(route, F.lit("|"), asn_type)


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def missing(header: str) -> Column:
    """1.0 where a header is null or blank."""
    return flag(~F.coalesce(F.col(header), F.lit("")).rlike(VISIBLE))


def header_flags() -> dict[str, Column]:
    agent = F.lower(F.coalesce("user_agent", F.lit("")))
    return {
        "ua_missing": missing("user_agent"),
        "ua_bot_token": flag(reduce(lambda a, b: a | b, [agent.contains(t) for t in BOT_TOKENS])),
        "accept_missing": missing("accept"),
        "accept_lang_missing": missing("accept_language"),
        "cookie_missing": missing("cookie"),
        "honeypot_filled": 1.0 - missing("honeypot_value"),
        "asn_datacenter": flag(F.coalesce("asn_type", F.lit("")) == "datacenter"),
    }


def static_reputation(ip: Column) -> Column:
    bad = F.lit(False)
    for prefix in BAD_PREFIXES:
        bad = bad | ip.startswith(prefix)
    return F.when(bad, 0.8).otherwise(0.0)


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def bucket_of(ts_us: Column) -> Column:
    return F.floor(ts_us / BUCKET_US).cast("long")


def vector() -> Column:
    return F.array(*[F.col(c).cast("double") for c in FEATURES])
