"""Approximate counters as tables: count-min grids and HyperLogLog sketches, both mergeable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.functions.columns import bucket_of, header_flags, static_reputation
from gatewatch.operators.windows import swept, kinds_of, with_target

WIDTH, DEPTH = 2048, 4
#: Buckets of a minute and of ten seconds, the one of the request included; rows that a key's bounded tail holds.
MINUTE, TEN_S, TAIL = 13, 3, 64
#: Of rolling_ips(): 2**14 registers, a united sketch errs by 0.8 % (one deviation), so 5 % are six of them; Spark's 2**12 err by 1.6 %.
ROLLING_LG_K = 14


def _cells(df: DataFrame, key: Column, width: int, depth: int) -> DataFrame:
    return df.withColumn("_key", key).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("col", F.pmod(F.xxhash64("_key", "row"), F.lit(width)))


def build(df: DataFrame, key: Column, count: Column | None = None, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """row, col, cnt: at most width * depth rows; partial sums shrink it before the shuffle."""
    return _cells(df.withColumn("_cnt", F.lit(1) if count is None else count), key, width, depth).groupBy("row", "col").agg(F.sum("_cnt").cast("long").alias("cnt"))


def estimate(grid: DataFrame, keys: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """keys: key.  key, estimate: never below the truth.  The grid is broadcast: its size is fixed."""
    asked = _cells(keys.select("key").distinct(), F.col("key"), width, depth)
    found = asked.join(F.broadcast(grid), ["row", "col"], "left")
    return found.groupBy("key").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def total(grid: DataFrame) -> DataFrame:
    """Every add is once in each row of the grid."""
    return grid.where("row = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def windowed(requests: DataFrame, key: str, at_us: int, seconds: int, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """key, estimate: each key's requests in the 5 s buckets from at_us - seconds to at_us, by a grid over key#bucket."""
    past = requests.where(F.col("ts_us") <= at_us).withColumn("bucket", bucket_of(F.col("ts_us")))
    # a grid of the window's buckets alone: its error does not grow with the log
    recent = past.where(F.col("bucket") >= bucket_of(F.lit(at_us - seconds * 1_000_000)))
    grid = build(recent, F.concat_ws("#", key, "bucket"), None, width, depth)
    span = F.sequence(bucket_of(F.lit(at_us - seconds * 1_000_000)), bucket_of(F.lit(at_us)))
    wanted = past.select(F.col(key).alias("of")).distinct().withColumn("b", F.explode(span)).withColumn("key", F.concat_ws("#", "of", "b"))
    return wanted.join(estimate(grid, wanted, width, depth), "key").groupBy(F.col("of").alias("key")).agg(F.sum("estimate").alias("estimate"))


def heavy_hitters(estimates: DataFrame, most: int = 10) -> DataFrame:
    return estimates.orderBy(F.desc("estimate"), "key").limit(most)


def distinct_ips(requests: DataFrame, at_us: int, seconds: int = 60) -> DataFrame:
    """target, approx_ips: a HyperLogLog sketch per bucket, merged over the window."""
    b = requests.withColumn("bucket", bucket_of(F.col("ts_us"))).where(F.col("ts_us") <= at_us)
    per_bucket = b.groupBy("target", "bucket").agg(F.hll_sketch_agg("ip").alias("s"))
    recent = per_bucket.where(F.col("bucket") >= bucket_of(F.lit(at_us - seconds * 1_000_000)))
    return recent.groupBy("target").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("approx_ips"))


def _summed(name: str, buckets: int) -> Column:
    w = Window.partitionBy("row", "col").orderBy("bucket").rangeBetween(1 - buckets, 0)
    return F.sum("cnt").over(w).cast("long").alias(name)


def rolling_rates(requests: DataFrame, key: str, names: dict[str, int] | None = None, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """key, bucket and names: for each bucket that a key has requests in, estimates of its requests in so many buckets up to there.

    A grid for each bucket, of width * depth cells at most however long the log
    is, added up over the window cell by cell: a cell's buckets are a running
    sum, so no grid is read twice.  A request's own cells are in its bucket's
    grid, so a look-up never misses.  An estimate counts its whole bucket; it is
    never less than the truth, and more than it by e / width of all requests in
    the window for one key in e**depth.  Rows without ts_us count nowhere.
    """
    names = names or {"estimate": MINUTE}
    at = requests.where("ts_us is not null").select(F.col(key).alias("key"), bucket_of(F.col("ts_us")).alias("bucket"))
    by_key = at.groupBy("key", "bucket").agg(F.count("*").alias("_n"))
    # each of the key's cells: counted once for the grid, and looked up
    mine = _cells(by_key, F.coalesce(F.col("key").cast("string"), F.lit("\0null")), width, depth).drop("_key")
    grid = mine.groupBy("bucket", "row", "col").agg(F.sum("_n").alias("cnt"))
    grid = grid.select("bucket", "row", "col", *[_summed(name, n) for name, n in names.items()])
    return mine.select("key", "bucket", "row", "col").join(grid, ["bucket", "row", "col"]).groupBy("key", "bucket").agg(*[F.min(name).alias(name) for name in names])


def rolling_ips(requests: DataFrame, buckets: int = MINUTE, lg_k: int = ROLLING_LG_K) -> DataFrame:
    """target, bucket, approx_ips: for each bucket that a target has requests in, its IPs in so many buckets up to there.

    Sketches by target and bucket; those of a stretch of ``buckets`` are united
    from its beginning and from its end, and a window is an end of one stretch
    with a beginning of the next.  So each sketch is united three times, however
    long the window is.  requests: target, ip, ts_us.
    """
    sketches = requests.where("ts_us is not null").groupBy("target", bucket_of(F.col("ts_us")).alias("bucket")).agg(F.hll_sketch_agg("ip", lg_k).alias("s"))
    sketches = sketches.withColumn("stretch", F.floor(F.col("bucket") / buckets))
    own = Window.partitionBy("target", "stretch").rowsBetween(Window.unboundedPreceding, 0)
    both = sketches.select("target", "stretch", "bucket", F.hll_union_agg("s").over(own.orderBy("bucket")).alias("begins"), F.hll_union_agg("s").over(own.orderBy(F.desc("bucket"))).alias("ends"))
    whole = both.groupBy("target", "stretch").agg(F.collect_list(F.struct("bucket", "begins")).alias("begins"), F.array_sort(F.collect_list(F.struct("bucket", "ends"))).alias("ends"))
    before = Window.partitionBy("target").orderBy("stretch")
    ends = F.when(F.lag("stretch").over(before) == F.col("stretch") - 1, F.lag("ends").over(before))
    # two selects: an explode beside a window would come before it
    each = whole.select("target", ends.alias("ends"), "begins").select("target", "ends", F.explode("begins").alias("b"))
    # the longest end that lies within the window
    met = F.filter("ends", lambda e: e["bucket"] > F.col("b.bucket") - buckets)
    end = F.when(F.size(met) > 0, F.element_at(met, 1)["ends"])
    united = F.when(end.isNull(), F.col("b.begins")).otherwise(F.hll_union(F.col("b.begins"), end))
    return each.select("target", F.col("b.bucket").alias("bucket"), F.hll_sketch_estimate(united).alias("approx_ips"))


def features(df: DataFrame, keep: tuple[str, ...] | None = None, width: int = WIDTH, depth: int = DEPTH, most: int = TAIL) -> DataFrame:
    """windows.features() in bounded memory: rates from rolling grids, all else of a window from each key's last ``most`` rows.

    A task holds ``most`` rows of a key, whatever its rate.  df: as there; seq is
    of one row each.  Rows without ts_us have null window numbers.
    """
    kept = [*dict.fromkeys([*(df.columns if keep is None else keep), "ip", "ts_us", "seq", "route", "target", *header_flags()])]
    rows, n = with_target(df).withColumns(header_flags()), df.count()
    out = swept(rows, "ip", "path", kinds_of({"distinct_paths_60s": "different", "iat_mean": "iat_mean", "iat_cv": "iat_cv"}), kept, most=most, rows=n)
    out = swept(out, "target", "ip", kinds_of({"target_distinct_ips_60s": "different"}), [*kept, "distinct_paths_60s", "iat_mean", "iat_cv"], most=most, rows=n)
    out = out.withColumn("_bucket", bucket_of(F.col("ts_us")))
    for key, names in (("ip", {"req_10s": TEN_S, "req_60s": MINUTE}), ("target", {"target_req_60s": MINUTE})):
        rates = rolling_rates(rows, key, names, width, depth).select(F.col("key").alias("_of"), F.col("bucket").alias("_at"), *[F.col(n).cast("double").alias(n) for n in names])
        out = out.join(rates, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_at")), "left").drop("_of", "_at")
    return out.withColumn("ip_reputation", static_reputation(F.col("ip"))).drop("_bucket")
