"""Small files that come into being whole and once: model versions and manifests.

A file is written under a hidden name first and then gets its own by a step that
fails where the name is taken: a link on local disks, a rename elsewhere, which
HDFS refuses in that case.  Object stores whose rename replaces are no place for
these folders.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str) -> tuple[object, object]:
    """(file system, path), both Hadoop's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, folder: str, hidden: bool = False) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    files, at = located(spark, folder)
    found = [p.getPath().getName() for p in files.listStatus(at)] if files.exists(at) else []
    return sorted(x for x in found if hidden or x[0] not in "._")


def read(spark: SparkSession, folder: str, name: str) -> str:
    files, at = located(spark, f"{folder}/{name}")
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Whether this call made folder/name; false, and nothing changed, if it was there.  Readers see all of it or nothing."""
    files, part = located(spark, f"{folder}/.{uuid.uuid4().hex}")
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files.mkdirs(part.getParent())
    stream = files.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if files.getScheme() != "file":
            return files.rename(part, final)
        to_path = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        spark._jvm.java.nio.file.Files.createLink(to_path(final), to_path(part))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(part, False)


def remove(spark: SparkSession, path: str) -> None:
    files, at = located(spark, path)
    files.delete(at, True)
