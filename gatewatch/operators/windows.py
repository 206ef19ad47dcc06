"""Point-in-time window features, exact at any rate.

features() takes two shuffles, one by IP and one by target, each in chunks of
time; a task streams through sorted rows and holds a minute of one key.
Keys whose chunk is too much for a task are found first, and only their rows
go through sliding(), which gives the same from running sums of what enters and
leaves a window, in groups of a key's second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.functions.columns import BUCKET_US, header_flags, route_of, static_reputation, target_of

SECOND = 1_000_000
SPAN = 60 * SECOND
#: What a row's numbers look back at most: a window that begins with a whole bucket.
HALO = SPAN + BUCKET_US
#: Seconds of a chunk of sliding() and of features(); the latter's last minute goes to the next chunk as well.
CHUNK_S = 1
SWEPT_S = 120
#: Rows that a task of features() looks at together at least.
STEP = 65_536
#: Rows of a key in a chunk of time from which the key is busy.
BUSY = 1_000_000
#: Rows that a task of swept() sorts, about, where there are many.
DEALT = 100_000
#: Groups that rows without a time are dealt to.
TIMELESS = 4096
#: What an event changes: rows and values in the window, the gaps between its rows and their squares.
CHANGES = ("d60", "d10", "different", "gap", "square")


def events(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, at, phase, seq, sub and what changes then in the window of the key: d60, d10, different, gap, square.

    A row enters at its time and leaves one microsecond after the window's
    length, before the rows of that time.  A value enters with the first row of
    a stretch without gaps over SPAN and leaves SPAN after the last, so nothing
    looks back over the window: groups are of one key (and value) and second,
    and those that hold all of a key have one row a second.
    """
    k, v = F.col("k"), F.col("v")
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"), "ts_us", "seq", F.floor(F.col("ts_us") / SECOND).cast("long").alias("second"))
    seconds = rows.groupBy("k", "second").agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    by_key = Window.partitionBy("k").orderBy("second")
    seconds = seconds.select(k.alias("k_"), F.col("second").alias("second_"), F.lag("last").over(by_key).alias("before"), F.lead("first").over(by_key).alias("after"))
    near = rows.join(seconds, k.eqNullSafe(F.col("k_")) & (F.col("second") == F.col("second_")))
    own = Window.partitionBy("k", "second").orderBy("ts_us", "seq")
    # a longer gap is never inside a window
    inside = lambda gap: F.when(gap <= SPAN, gap).otherwise(F.lit(0)).cast("long")
    near = near.select("k", "ts_us", "seq", inside(F.col("ts_us") - F.coalesce(F.lag("ts_us").over(own), "before")).alias("gap"), inside(F.coalesce(F.lead("ts_us").over(own), "after") - F.col("ts_us")).alias("next"))
    zero = F.lit(0).cast("long")

    def event(at, phase, sub, **change):
        return F.struct(at.alias("at"), F.lit(phase).alias("phase"), F.lit(sub).alias("sub"), *[(F.lit(x).cast("long") if isinstance(x, int) else x).alias(c) for c in CHANGES for x in [change.get(c, zero)]])

    ts, gap, after = F.col("ts_us"), F.col("gap"), F.col("next")
    of_rows = F.array(
        event(ts, 1, 1, d60=1, d10=1, gap=gap, square=gap * gap),
        event(ts + 10 * SECOND + 1, 0, 0, d10=-1),
        event(ts + SPAN + 1, 0, 0, d60=-1, gap=-after, square=-after * after),
    )
    by_value = Window.partitionBy("k", "v").orderBy("second")
    held = rows.groupBy("k", "v", "second").agg(F.min(F.struct("ts_us", "seq")).alias("first"), F.max("ts_us").alias("last"))
    held = held.select("k", F.col("first.ts_us").alias("first"), F.col("first.seq").alias("seq"), "last", F.lag("last").over(by_value).alias("before"), F.lead("first.ts_us").over(by_value).alias("after"))
    enters = F.when(F.coalesce(F.col("first") - F.col("before") > SPAN, F.lit(True)), event(F.col("first"), 1, 0, different=1))
    leaves = F.when(F.coalesce(F.col("after") - F.col("last") > SPAN, F.lit(True)), event(F.col("last") + SPAN + 1, 0, 0, different=-1))
    of_values = F.filter(F.array(enters, leaves), lambda e: e.isNotNull())
    both = near.select("k", "seq", F.explode(of_rows).alias("e")).unionByName(held.select("k", "seq", F.explode(of_values).alias("e")))
    return both.select("k", "seq", "e.*")


def sliding(df: DataFrame, key: str, value: str, chunk_s: int = CHUNK_S, peers: bool = False) -> DataFrame:
    """Per row (by seq) of its key's last 60 s, itself and earlier arrivals included: n10, n60, different values, gaps.

    Running sums of events(), within chunks of a key and from sums by chunk
    before them; the sums are of what is in the window, so they never grow with the log.
    peers: as in features().
    """
    every = events(df, key, value).withColumn("chunk", F.floor(F.col("at") / (chunk_s * SECOND)).cast("long"))
    earlier = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.groupBy("k", "chunk").agg(*[F.sum(c).alias(c) for c in CHANGES])
    sums = sums.select(F.col("k").alias("k_"), F.col("chunk").alias("chunk_"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_") for c in CHANGES])
    own = Window.partitionBy("k", "chunk")
    if peers:
        own = own.orderBy("at", "phase").rangeBetween(Window.unboundedPreceding, 0)
    else:
        own = own.orderBy("at", "phase", "seq", "sub").rowsBetween(Window.unboundedPreceding, 0)
    at = every.select("k", "chunk", "seq", "phase", "sub", *[F.sum(c).over(own).alias(c) for c in CHANGES]).where("phase = 1 and sub = 1")
    at = at.join(sums, F.col("k").eqNullSafe(F.col("k_")) & (F.col("chunk") == F.col("chunk_")))
    at = at.select("seq", *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in CHANGES])
    n, total, q = (F.col("d60") - 1).cast("double"), F.col("gap").cast("double"), F.col("square").cast("double")
    mean = F.when(n > 0, total / F.greatest(n, F.lit(1.0)) / SECOND).otherwise(30.0)
    cv = F.when(n == 0, 1.0).when(total > 0, F.sqrt(F.greatest(n * q - total * total, F.lit(0.0))) / total).otherwise(0.0)
    return at.select("seq", F.col("d10").alias("n10"), F.col("d60").alias("n60"), "different", mean.alias("iat_mean"), cv.alias("iat_cv"))


def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("route", route_of(F.col("path"))).withColumn("target", target_of(F.col("route"), F.col("asn_type")))


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each different value, -1 for null."""
    coded = values.dictionary_encode().unify_dictionaries()
    return np.concatenate([c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in coded.chunks])


def _narrow(b: pa.RecordBatch) -> pa.Table:
    """What later rows need of a batch; text without the limit of 2 GB."""
    wide = lambda c: c.cast(pa.large_string()) if pa.types.is_string(c.type) else c
    return pa.table([wide(b.column("_key")), b.column("_chunk"), wide(b.column("_value")), b.column("_at")], ["_key", "_chunk", "_value", "_at"])


def _split(rows: list[pa.RecordBatch], n: int) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """The first n rows of batches, and the others."""
    before, after = [], []
    for b in rows:
        m = min(max(n, 0), b.num_rows)
        n -= b.num_rows
        if m:
            before.append(b.slice(0, m))
        if m < b.num_rows:
            after.append(b.slice(m))
    return before, after


def window_numbers(ts: np.ndarray, group: np.ndarray, value: np.ndarray, most: int | None = None, peers: bool = False) -> dict[str, np.ndarray]:
    """Of each row's last minute n10, n60, different, total and square of gaps; rows by group (0, 1, ...) and time.

    most: of the group's last so many rows only.  bucketed: rows since the
    beginning of the bucket that was a minute before this row's.  A value counts
    from its row to its next one or to where the window has left it.  peers: all
    but bucketed are those of the last row of the same time; not with most.
    """
    n = len(ts)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    # groups apart by more than a window
    rel = ts - np.repeat(ts[first], np.diff(first, append=n))
    at = rel + np.cumsum(np.concatenate([[0], rel[first[1:] - 1] + 2 * HALO]))[group]
    since = lambda back: np.searchsorted(at, at - back)
    place = np.arange(n)
    lo, lo10, buckets = since(SPAN), since(10 * SECOND), since(ts % BUCKET_US + SPAN)
    if most:
        lo = np.maximum(lo, place - most + 1)
    order = np.lexsort((place, value, group))
    follows = (value[order][1:] == value[order][:-1]) & (group[order][1:] == group[order][:-1])
    later = np.full(n, n)
    later[order[:-1][follows]] = order[1:][follows]
    edge = np.ones(n + 1, np.int64)
    np.subtract.at(edge, np.minimum(later, np.searchsorted(lo, place, side="right")), 1)
    gap = np.diff(at, prepend=at[:1])
    gap[gap > SPAN] = 0
    square = np.cumsum((gap * gap).astype(np.uint64))  # may wrap; differences are right
    found = {"n10": place - lo10 + 1, "n60": place - lo + 1, "different": np.cumsum(edge[:n]), "total": at - at[lo], "square": (square - square[lo]).astype(np.int64)}
    if peers:
        last = np.searchsorted(at, at, side="right") - 1
        found = {k: v[last] for k, v in found.items()}
    return {**found, "bucketed": place - buckets + 1}


def _sweep(kinds: dict[str, Callable], kept: list[str], most: int | None, peers: bool = False) -> Callable:
    """Rows come by key, chunk and time.

    Of what has passed only key, time and value of the last key's last minute
    stay in memory; with most only so many rows of it, so n10 and bucketed are
    then of those alone.  peers: rows of a key's newest time wait for the others of it.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, waiting, needed = None, [], 0, STEP

        def step(end: bool) -> tuple[list[pa.RecordBatch], pa.Table | None, list[pa.RecordBatch]]:
            t = pa.concat_tables([*([held] if held is not None else []), *map(_narrow, rows)])
            ts, key, chunk = t.column("_at").fill_null(0).to_numpy(), _codes(t.column("_key")), t.column("_chunk").to_numpy()
            group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]))
            out, rest, done = [], [], held.num_rows if held is not None else 0
            ready = rows
            if peers and not end:
                # rows without a time are nobody's peers
                alone = pc.is_null(t.column("_at")).to_numpy()
                cut = int(np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (ts[1:] != ts[:-1]) | alone[1:]]))[-1])
                if cut <= done:
                    return [], held, rows
                ready, rest = _split(rows, cut - done)
                t, ts, group = t.slice(0, cut), ts[:cut], group[:cut]
            found = window_numbers(ts, group, _codes(t.column("_value")), most, peers)
            for b in ready:
                own = {k: v[done : done + b.num_rows] for k, v in found.items()}
                timeless = pc.is_null(b.column("_at")).to_numpy(zero_copy_only=False)
                numbers = [pa.array(make(own), mask=timeless) for make in kinds.values()]
                out.append(pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *numbers], [*kept, *kinds]).filter(b.column("_own")))
                done += b.num_rows
            if done != t.num_rows:
                raise RuntimeError(f"{t.num_rows} rows came and {done} were counted")
            first = int(np.searchsorted(np.where(group == group[-1], ts, np.iinfo(np.int64).min), ts[-1] - HALO))
            if most:
                first = max(first, t.num_rows - most)
            # a copy: a slice would hold all columns of the batches
            return out, t.take(np.arange(first, t.num_rows)), rest

        for b in it:
            if b.num_rows:
                rows.append(b)
                waiting += b.num_rows
            # as many new rows as are held: each row is looked at a few times only
            if waiting >= max(needed, held.num_rows if held is not None else 0):
                out, held, rows = step(False)
                waiting = sum(b.num_rows for b in rows)
                needed = max(STEP, 2 * waiting)
                yield from out
        if rows:
            yield from step(True)[0]

    return run


def _unpacked(kept: list[str], same: dict[str, str]) -> Callable:
    """Batches for _sweep() from those that swept() deals: columns kept from _kept, or from those that are the same."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            carried = b.column("_kept")
            packed = dict(zip([f.name for f in carried.type], carried.flatten(), strict=True))
            columns = {c: b.column(same[c]) if c in same else packed[c] for c in kept}
            columns |= {c: b.column(c) for c in ("_key", "_value", "_at", "_chunk", "_own")}
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return run


def swept(df: DataFrame, key: str, value: str, kinds: dict[str, Callable], kept: list[str], chunk_s: int = SWEPT_S, most: int | None = None, peers: bool = False, rows: int | None = None) -> DataFrame:
    """The columns kept of df, and those of kinds, made from window_numbers() of each row's key.

    One shuffle: rows go by key and chunk of time, those of a chunk's last
    minute to the next chunk as well, there without the columns kept, so a busy
    key is a task for each chunk.  A task streams through its rows in order and
    holds a minute of one key.  A row without ts_us is in no window: it comes
    back with null numbers.  peers: as in features().  rows: those of df; where
    that is more than DEALT for each core, they are dealt to tasks of about so many,
    and else to as many as Spark sees fit.
    """
    # as text: a column of its own each would be a call to the JVM for every part of it
    chunk = lambda at: f"CAST(floor(({at}) / {chunk_s * SECOND}) AS BIGINT)"
    # what is sorted: the columns kept as one, null in the next chunk, without those that are there anyway
    same = {key: "_key", value: "_value", "ts_us": "_at", "seq": "_seq"}
    packed = ", ".join(f"'{c}', `{c}`" for c in kept if c not in same) or "'_none', CAST(NULL AS BOOLEAN)"
    to = f"explode(IF(ts_us IS NULL, array({-(1 << 62)} + pmod(xxhash64(seq), {TIMELESS})), sequence({chunk('ts_us')}, {chunk(f'ts_us + {HALO}')}))) AS _chunk"
    every = df.selectExpr(f"named_struct({packed}) AS _kept", f"`{key}` AS _key", f"`{value}` AS _value", "ts_us AS _at", "seq AS _seq", to)
    own = f"coalesce({chunk('_at')} = _chunk, true)"
    every = every.selectExpr(f"IF({own}, _kept, NULL) AS _kept", "_key", "_value", "_at", "_seq", "_chunk", f"{own} AS _own")
    # with those that go to the next chunk as well; by size alone a task gets millions, as they are packed well
    parts = int((rows or 0) * (1 + HALO / (chunk_s * SECOND)) / DEALT) + 1
    by_number = [parts] if parts > df.sparkSession.sparkContext.defaultParallelism else []
    dealt = every.repartition(*by_number, "_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_at", "_seq")
    if "seq" not in kept:
        dealt = dealt.drop("_seq")
    schema = df.select(*kept).schema
    for name in kinds:
        schema = schema.add(name, "double")
    unpacked, sweep = _unpacked(kept, same), _sweep(kinds, kept, most, peers)
    return dealt.mapInArrow(lambda it: sweep(unpacked(it)), schema)


def row_counts(df: DataFrame, chunk_s: int = SWEPT_S) -> tuple[int, int]:
    """Rows of df, and those of its fullest chunk of time; nothing but ts_us is read."""
    by_chunk = df.groupBy(F.floor(F.col("ts_us") / (chunk_s * SECOND)).alias("_chunk")).count()
    fullest = F.max(F.when(F.col("_chunk").isNotNull(), F.col("count")))
    return tuple(by_chunk.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(fullest, F.lit(0))).first())


def busy_keys(df: DataFrame, keys: tuple[str, ...], chunk_s: int = SWEPT_S, most: int = BUSY, fullest: int | None = None) -> dict[str, DataFrame]:
    """Of each column of keys that has any: its busy keys (column busy), those of more than ``most`` rows in a chunk of time.

    fullest: rows of the fullest chunk, from row_counts() if not given; where that
    is not more, no key is busy.  Else rows are counted by key and chunk, with partial counts before
    the shuffle.  There are fewer busy keys than rows by ``most``, so they are sent
    to the tasks.
    """
    if (row_counts(df, chunk_s)[1] if fullest is None else fullest) <= most:
        return {}
    at = df.where("ts_us is not null").withColumn("_chunk", F.floor(F.col("ts_us") / (chunk_s * SECOND)))
    each = at.select("_chunk", F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.col(k).alias("busy")) for k in keys])).alias("k"))
    found = each.groupBy("_chunk", "k").count().where(F.col("count") > most).select("k.of", "k.busy").distinct().collect()
    return {k: df.sparkSession.createDataFrame([(r.busy,) for r in found if r.of == k], f"busy {df.schema[k].dataType.simpleString()}") for k in {r.of for r in found}}


def _whole(name: str) -> Callable:
    return lambda found: found[name].astype(float)


def _iat_mean(found: dict[str, np.ndarray]) -> np.ndarray:
    n = found["n60"] - 1
    return np.where(n > 0, found["total"] / np.maximum(n, 1) / SECOND, 30.0)


def _iat_cv(found: dict[str, np.ndarray]) -> np.ndarray:
    n, total, q = ((found["n60"] - 1).astype(float), found["total"].astype(float), found["square"].astype(float))
    cv = np.sqrt(np.maximum(n * q - total * total, 0.0)) / np.where(total > 0, total, 1.0)
    return np.where(n == 0, 1.0, np.where(total > 0, cv, 0.0))


#: What sliding() names, from window_numbers().
NUMBERS = {"n10": _whole("n10"), "n60": _whole("n60"), "different": _whole("different"), "iat_mean": _iat_mean, "iat_cv": _iat_cv}
BY_IP = {"req_10s": "n10", "req_60s": "n60", "distinct_paths_60s": "different", "iat_mean": "iat_mean", "iat_cv": "iat_cv"}
BY_TARGET = {"target_req_60s": "n60", "target_distinct_ips_60s": "different"}


def kinds_of(named: dict[str, str]) -> dict[str, Callable]:
    """For swept(): what each name is made of, from NUMBERS."""
    return {name: NUMBERS[of] for name, of in named.items()}


def windowed(df: DataFrame, key: str, value: str, named: dict[str, str], kept: list[str], chunk_s: int = SWEPT_S, busy: DataFrame | None = None, peers: bool = False, rows: int | None = None) -> DataFrame:
    """The columns kept of df and those named, from NUMBERS: swept(), and for busy keys sliding(); seq is of one row each.  rows: as in swept()."""
    kinds = kinds_of(named)
    if busy is None:
        return swept(df, key, value, kinds, kept, chunk_s, peers=peers, rows=rows)
    met = F.col(key).eqNullSafe(F.col("busy")) & F.col("ts_us").isNotNull()
    hot, cold = (df.join(F.broadcast(busy), met, how) for how in ("left_semi", "left_anti"))
    sums = sliding(hot, key, value, peers=peers).select(F.col("seq").alias("_seq"), *[F.col(of).cast("double").alias(name) for name, of in named.items()])
    hot = hot.select(*kept, F.col("seq").alias("_own")).join(sums, F.col("_own") == F.col("_seq")).select(*kept, *named)
    return swept(cold, key, value, kinds, kept, chunk_s, peers=peers, rows=rows).unionByName(hot)


def features(df: DataFrame, reputation: DataFrame | None = None, chunk_s: int = SWEPT_S, keep: tuple[str, ...] | None = None, most: int = BUSY, peers: bool = False) -> DataFrame:
    """The requests with route, target and all features; one code path for training, batch and streams.

    df: seq and the request columns; rows of one time count in the order of seq.
    A row without ts_us has null window numbers and is in no other row's.
    reputation: ip, score, one row an ip; it overrides the prefixes.  keep: the
    columns of df to carry on, all by default.  most: rows of a key in a chunk
    of time that one task takes; busier keys are found by a job beforehand.
    peers: rows of one time count each other, as in a RANGE frame of SQL.
    """
    kept = [*(df.columns if keep is None else keep), "route", "target", *header_flags()]
    carried = [*dict.fromkeys([*kept, "ip", "ts_us", "seq"])]
    rows = with_target(df).withColumns(header_flags())
    n, fullest = row_counts(rows, chunk_s)
    busy = busy_keys(rows, ("ip", "target"), chunk_s, most, fullest)
    rows = windowed(rows, "ip", "path", BY_IP, carried, chunk_s, busy.get("ip"), peers, n)
    out = windowed(rows, "target", "ip", BY_TARGET, [*carried, *BY_IP], chunk_s, busy.get("target"), peers, n)
    known = static_reputation(F.col("ip"))
    if reputation is not None:
        out = out.join(reputation.select("ip", F.col("score").alias("_score")), "ip", "left")
        known = F.coalesce("_score", known)
    return out.withColumn("ip_reputation", known).select(*dict.fromkeys(kept), *BY_IP, *BY_TARGET, "ip_reputation", *(c for c in ("ip",) if c not in kept))


def different_in_reach(df: DataFrame, key: str, value: str, before: int, after: int) -> DataFrame:
    """key, bucket, change: by how many the different values of the key rise there, if each row counts from ``before`` buckets before its own to ``after`` after it.

    Running sums of change by bucket are the numbers.  A row counts from where
    the value's row before it ends, so none is there once for each bucket that it
    reaches: a shuffle by key and value, then sums of a key's buckets.  df: key, value, bucket.
    """
    own = Window.partitionBy(key, value).orderBy("bucket")
    rows = df.where(F.col(value).isNotNull() & F.col("bucket").isNotNull()).select(key, "bucket", F.lag("bucket").over(own).alias("_last"))
    # greatest() leaves out the null of a first row
    begins = F.greatest(F.col("bucket") - before, F.col("_last") + (after + 1))
    changes = F.array(F.struct(begins.alias("bucket"), F.lit(1).alias("change")), F.struct((F.col("bucket") + (after + 1)).alias("bucket"), F.lit(-1).alias("change")))
    fresh = rows.where(F.col("_last").isNull() | (F.col("_last") < F.col("bucket")))
    return fresh.select(key, F.explode(changes).alias("c")).groupBy(key, "c.bucket").agg(F.sum("c.change").alias("change"))


def with_different(found: DataFrame, changes: DataFrame, key: str, name: str) -> DataFrame:
    """found (key, bucket, once each) with the running sums of different_in_reach(), as ``name``."""
    both = found.withColumn("_found", F.lit(True)).join(changes, [key, "bucket"], "full")
    running = F.coalesce(F.sum("change").over(Window.partitionBy(key).orderBy("bucket")), F.lit(0)).cast("long")
    return both.withColumn(name, running).where("_found").drop("_found", "change")


def builtin_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """n60 and different of sliding() from built-in frames: fine for keys with few rows a minute."""
    w = Window.partitionBy(key).orderBy("ts_us").rangeBetween(-SPAN, 0)
    later = F.count("*").over(Window.partitionBy(key, "ts_us")) - F.row_number().over(Window.partitionBy(key, "ts_us").orderBy("seq"))
    seen = F.collect_list(F.struct("ts_us", "seq", value)).over(w)
    before = F.filter(seen, lambda x: (x["ts_us"] < F.col("ts_us")) | (x["seq"] <= F.col("seq")))
    return df.select("seq", (F.count("*").over(w) - later).alias("n60"), F.size(F.array_distinct(F.transform(before, lambda x: x[value]))).cast("long").alias("different"))


def bucketed_rate(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """df with <key>_rate: requests of the key in the 5 s buckets from a minute ago to now, up to this row.  rows: as in swept()."""
    return swept(df, key, key, {f"{key}_rate": _whole("bucketed")}, df.columns, rows=rows)


def tail_features(df: DataFrame, key: str, value: str, most: int = 64, rows: int | None = None) -> DataFrame:
    """df with <key>_n, <key>_different, <key>_iat_mean and <key>_iat_cv of 60 s among the key's last ``most`` rows.  rows: as in swept()."""
    kinds = {"n": _whole("n60"), "different": _whole("different"), "iat_mean": _iat_mean, "iat_cv": _iat_cv}
    return swept(df, key, value, {f"{key}_{name}": make for name, make in kinds.items()}, df.columns, most=most, rows=rows)
