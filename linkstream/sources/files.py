"""Small file steps of the driver, through Hadoop's file system, so that they
work wherever Spark's readers do: list a folder, remove one, and publish a
value by an atomic rename.  No data passes through here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in order; nothing, if there is none."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str, key: str) -> list[int]:
    """N of the folders ``key=N``, rising."""
    return sorted(int(n.split("=", 1)[1]) for n in names(spark, path) if n.startswith(f"{key}="))


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def publish(spark: SparkSession, path: str, value: str) -> None:
    """Readers of ``path`` see the value before or this one, never none or half of one."""
    jvm = spark.sparkContext._jvm
    draft, fs = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(value.encode()))
    finally:
        out.close()
    target, _ = _at(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(),
                                                                  spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, target, options)


def published(spark: SparkSession, path: str) -> str | None:
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
