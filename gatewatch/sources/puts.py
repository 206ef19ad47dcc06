"""Decisions and challenges, put and put again: the last put of a key counts.

put() appends a folder of its own.  compact() merges what was put into tables by
date, of one row a key, and writes only the dates it touches; a manifest names
the folder of each date, and the put folders that are merged.  The manifest is
the swap: it is a new file, so a crash before it changes nothing that is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gatewatch.sources import files

#: Columns that are added to what is put.
ADDED = ("put_us", "date")


def latest(df: DataFrame, key: str, order: str = "ts") -> DataFrame:
    """Insert-or-replace on read: the last row of each key, of rows that are equally late the one of the greater hash."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    last = F.max_by(F.struct(*columns), F.struct(F.col(order), F.xxhash64(*columns)))
    return df.groupBy(F.col(key).alias("_key")).agg(last.alias("_last")).select("_last.*")


def put(rows: DataFrame, path: str) -> None:
    """Append rows (ts_us and others); what is put later replaces what load_put() gives for its key."""
    dated = rows.withColumn("put_us", F.unix_micros(F.current_timestamp())).withColumn("date", F.to_date(F.timestamp_micros("ts_us")))
    # a folder without the writer's mark of success is not read
    dated.write.parquet(f"{path}/put/{uuid.uuid4().hex}")


def _day():
    """What a day's folder is called; rows without ts_us have one as well."""
    return F.coalesce(F.col("date").cast("string"), F.lit("none"))


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    names = files.listed(spark, f"{path}/manifest")
    if not names:
        return -1, {"days": {}, "merged": [], "replaced": [], "schema": None}
    return int(names[-1].split(".")[0]), json.loads(files.read(spark, f"{path}/manifest", names[-1]))


def _fresh(spark: SparkSession, path: str, merged: list[str]) -> list[str]:
    """Put folders that are whole and not merged yet."""
    whole = lambda x: "_SUCCESS" in files.listed(spark, f"{path}/put/{x}", hidden=True)
    return [x for x in files.listed(spark, f"{path}/put") if x not in merged and whole(x)]


def _folder(path: str, day: str, generation: str) -> str:
    return f"{path}/merged/{generation}/put_day={day}"


def _merged(spark: SparkSession, path: str, manifest: dict, days: set[str] | None = None) -> DataFrame:
    """The compacted rows of all or some days, as they lie there."""
    schema = StructType.fromJson(manifest["schema"])
    folders = [_folder(path, d, g) for d, g in sorted(manifest["days"].items()) if days is None or d in days]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def load_put(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row a key: compacted rows as they are, without those whose keys were put since, and the last of these puts."""
    _, manifest = _manifest(spark, path)
    fresh = _fresh(spark, path, manifest["merged"])
    if not fresh and not manifest["schema"]:
        raise ValueError(f"nothing was put into {path}")
    base = _merged(spark, path, manifest).drop(*ADDED) if manifest["schema"] else None
    if not fresh:
        return base
    news = latest(spark.read.parquet(*(f"{path}/put/{x}" for x in fresh)), key, "put_us").drop(*ADDED)
    if base is None:
        return news
    return _without(base, news, key).unionByName(news, allowMissingColumns=True)


def _without(rows: DataFrame, known: DataFrame, key: str, how: str = "left_anti") -> DataFrame:
    known = known.select(F.col(key).alias("_key"))
    return rows.join(known, F.col(key).eqNullSafe(F.col("_key")), how)


def compact(spark: SparkSession, path: str, key: str) -> int:
    """Merge what was put into the days it touches, those that its keys leave among them; the new manifest's number.

    -1 if there was nothing to merge.  Of two at once the first to finish counts;
    the other's folder is removed and it raises FileExistsError.  Folders that
    the last manifest left behind are deleted by the next compaction, so readers
    of the last manifest keep theirs.
    """
    number, manifest = _manifest(spark, path)
    for x in manifest["merged"]:
        files.remove(spark, f"{path}/put/{x}")
    for day, generation in manifest["replaced"]:
        files.remove(spark, _folder(path, day, generation))
    fresh = _fresh(spark, path, manifest["merged"])
    if not fresh:
        return -1
    news = latest(spark.read.parquet(*(f"{path}/put/{x}" for x in fresh)), key, "put_us").persist()
    generation = uuid.uuid4().hex
    days_of = lambda df: {r[0] for r in df.select(_day()).distinct().collect()}
    try:
        now, rows = days_of(news), news
        touched = set(now)
        if manifest["schema"]:
            # of the days before only keys and dates are read
            touched |= days_of(_without(_merged(spark, path, manifest).select(key, "date"), news, key, "left_semi"))
            stay = _without(_merged(spark, path, manifest, touched), news, key)
            now |= days_of(stay)
            rows = stay.unionByName(news, allowMissingColumns=True)
        rows.withColumn("put_day", _day()).write.partitionBy("put_day").parquet(f"{path}/merged/{generation}")
        _swap(spark, path, number + 1, manifest, touched, dict.fromkeys(now, generation), fresh, rows.schema.json())
    finally:
        news.unpersist()
    return number + 1


def _swap(spark: SparkSession, path: str, number: int, manifest: dict, touched: set[str], wrote: dict[str, str], merged: list[str], schema: str) -> None:
    """The next manifest, which makes what was written count."""
    days = {d: g for d, g in manifest["days"].items() if d not in touched} | wrote
    replaced = [(d, g) for d, g in sorted(manifest["days"].items()) if d in touched]
    text = json.dumps({"days": days, "merged": merged, "replaced": replaced, "schema": json.loads(schema)})
    if not files.put_new(spark, f"{path}/manifest", f"{number:012d}.json", text):
        files.remove(spark, f"{path}/merged/{next(iter(wrote.values()))}")
        raise FileExistsError(f"{path} was compacted meanwhile")
