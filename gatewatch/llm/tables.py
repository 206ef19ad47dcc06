"""Written tables in the shared folder: lineage is cut there, so that a lost executor costs one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
#: With this a job's shuffle files go when the job is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few numbers that are sent to every executor at most; beyond, joins shuffle.
SENT = 1_000_000

#: Of each written table that may still be read: application, Hadoop path, weak reference to what every plan over it holds.
_written: list[tuple[str, object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Where the setting is absent a local master gets a temporary folder; any
    other master raises, because executors do not share local disks.
    """
    at = spark.sparkContext.getConf().get(CHECKPOINT) or spark.conf.get(CHECKPOINT, None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT} to a folder that every executor can reach")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT, at)
    return at


def _delete(spark: SparkSession, where: object) -> None:
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete the tables that no plan in the driver reads any more."""
    app = spark.sparkContext.applicationId
    for entry in list(_written):
        of, where, held = entry
        if of != app:  # that driver has deleted its tables when it ended
            _written.remove(entry)
        elif held.get() is None:
            _written.remove(entry)
            _delete(spark, where)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The table is there as long as a DataFrame that reads it: later calls delete
    those that no plan holds any more, and free() at once.  All go with the JVM.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_dir(spark)}/gatewatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table.written = where
    # a plan is copied as it is optimised, what it reads from is not
    files = table._jdf.queryExecution().analyzed().relation().location()
    _written.append((spark.sparkContext.applicationId, where, jvm.java.lang.ref.WeakReference(files)))
    return table


def free(*tables: DataFrame) -> None:
    """Delete tables of stash() that nothing reads from here on."""
    for table in tables:
        _delete(table.sparkSession, table.written)


def sized(df: DataFrame, most: int = SENT) -> DataFrame:
    """df, marked to be broadcast if it has few enough rows; df is a written table of narrow rows."""
    return F.broadcast(df) if df.count() <= most else df
