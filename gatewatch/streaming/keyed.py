"""Windows on a stream from state by key: each key keeps its own last two minutes, whatever others do."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from gatewatch.functions.columns import header_flags, static_reputation
from gatewatch.operators.scoring import STARTING, Model, Policy, decisions
from gatewatch.operators.windows import BY_IP, BY_TARGET, NUMBERS, window_numbers, with_target

RETAIN_US = 120_000_000
#: After so long without a row, by the clock, a key is forgotten.
IDLE_S = 3600
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = pa.schema([("ts", pa.int64()), ("value", pa.string())])


class History(StatefulProcessor):
    """A list of blocks of (time, value) for each key; blocks go once the key's newest row is RETAIN_US past all of theirs."""

    def __init__(self, value: str, named: dict[str, str], kept: list[str], retain_us: int, idle_ms: int) -> None:
        self.value, self.named, self.kept, self.retain_us, self.idle_ms = value, named, kept, retain_us, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "newest long, rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        timeless = new["ts_us"].isna().to_numpy()
        new = pd.concat([new[~timeless].sort_values(["ts_us", "seq"], kind="stable"), new[timeless]], ignore_index=True)
        n = int((~timeless).sum())
        ts, value = new["ts_us"][:n].to_numpy(np.int64), new[self.value][:n]
        held = [(newest, bytes(block)) for newest, block in self.past.get()] if self.past.exists() else []
        blocks = [pa.ipc.read_record_batch(pa.py_buffer(block), _ROWS) for _, block in held]
        past = pa.Table.from_batches(blocks, _ROWS)
        every = np.concatenate([past.column("ts").to_numpy(), ts])
        # rows that came before stand before those of their time
        order = np.argsort(every, kind="stable")
        code = pd.factorize(np.concatenate([np.array(past.column("value").to_pylist(), object), value.to_numpy(object)]))[0]
        found = window_numbers(every[order], np.zeros(len(every), np.int64), code[order]) if len(every) else {}
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        own = {k: v[place[len(past) :]] for k, v in found.items()}
        out = new[self.kept].copy()
        for name, of in self.named.items():
            out[name] = np.concatenate([NUMBERS[of](own) if n else np.empty(0), np.full(len(new) - n, np.nan)])
        if n:
            self._keep(held, every.max(), ts, value)
        self._wait(timerValues)
        yield out

    def _keep(self, held: list[tuple[int, bytes]], newest: int, ts: np.ndarray, value: pd.Series) -> None:
        since = newest - self.retain_us
        own = ts >= since
        block = pa.record_batch([pa.array(ts[own]), pa.array(value[own].tolist(), pa.string())], schema=_ROWS)
        added = [(int(ts.max()), block.serialize().to_pybytes())] if own.any() else []
        stay = [(t, b) for t, b in held if t >= since]
        if len(stay) < len(held):
            self.past.put([*stay, *added])
        elif added:
            self.past.appendValue(added[0])

    def _wait(self, timerValues) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.past.clear()
        return iter([])


def by_key(stream: DataFrame, key: str, value: str, named: dict[str, str], kept: list[str], retain_us: int = RETAIN_US, idle_s: float = IDLE_S) -> DataFrame:
    """The columns kept of a stream and those named, from NUMBERS: each row's last minute among its key's rows so far.

    stream: ts_us, seq, key, value and the columns kept.  A row counts those
    that came before it or with it and are not later than it; a late one is told
    from what its key still has.  State: a key's rows of the last retain_us,
    seen from its own newest one, in the RocksDB store; a key without rows for
    idle_s by the clock is forgotten, so that should be longer than the stream
    ever lags.  Rows without ts_us have null numbers.  Start it within settings().
    """
    rows = stream.select(*dict.fromkeys([*kept, key, value, "ts_us", "seq"]))
    schema = StructType([f for c in kept for f in [rows.schema[c]]])
    for name in named:
        schema = schema.add(name, "double")
    history = History(value, named, kept, retain_us, int(idle_s * 1000))
    return rows.groupBy(key).transformWithStateInPandas(history, schema, "Append", "ProcessingTime")


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """What a stream with state by key needs where it is started: the RocksDB store, and no batches without rows.

    Timers by the clock would else ask for such batches without end; so they are
    looked at with the next rows of any key.
    """
    wanted = {STORE: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def features(stream: DataFrame, keep: list[str], retain_us: int = RETAIN_US, idle_s: float = IDLE_S) -> DataFrame:
    """operators.windows.features() of a stream, from state by IP and then by target; start it within settings()."""
    kept = [*dict.fromkeys([*keep, "ip", "ts_us", "seq", "route", "target", *header_flags()])]
    rows = with_target(stream).withColumns(header_flags())
    rows = by_key(rows, "ip", "path", BY_IP, kept, retain_us, idle_s)
    rows = by_key(rows, "target", "ip", BY_TARGET, [*kept, *BY_IP], retain_us, idle_s)
    return rows.withColumn("ip_reputation", static_reputation(F.col("ip")))


def check(stream: DataFrame, model: Model = STARTING, reputation: DataFrame | None = None, blocklist: DataFrame | None = None, keep: tuple[str, ...] = ("seq", "ts_us", "ip"), policy: Policy | None = None, **state) -> DataFrame:
    """operators.scoring.check() of a stream; reputation (ip, score) and blocklist (ip) are tables."""
    rows = features(stream, [*keep], **state)
    if reputation is not None:
        rows = rows.join(reputation.select("ip", F.col("score").alias("_score")), "ip", "left")
        rows = rows.withColumn("ip_reputation", F.coalesce("_score", "ip_reputation")).drop("_score")
    return decisions(rows, model, blocklist, policy)
