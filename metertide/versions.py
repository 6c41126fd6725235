"""Folders with several versions, of which one small file names the current one.

A version is written beside the others and becomes current only when it is complete, by replacing that
file in one step. Readers take current versions only, so a write that breaks off changes nothing.
"""

import uuid

from pyspark.sql import SparkSession

#: Spark's readers skip files that begin with an underscore.
POINTER = "_CURRENT"


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path in full. The catalog takes others as relative to its own folder."""
    target, files = _path(spark, path)
    return files.makeQualified(target).toString()


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with ``*`` in it."""
    target, files = _path(spark, pattern)
    return sorted(status.getPath().toString() for status in files.globStatus(target) or [])


def modified(spark: SparkSession, path: str) -> int:
    target, files = _path(spark, path)
    return files.getFileStatus(target).getModificationTime()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    target, files = _path(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in one step if there is one already: readers see the old or the new text."""
    jvm = spark.sparkContext._jvm
    fresh, files = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(fresh)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    target = files.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(files.makeQualified(fresh), target, overwrite)


def current_version(spark: SparkSession, folder: str) -> str | None:
    return read_text(spark, f"{folder}/{POINTER}")


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Make a complete version the current one."""
    replace_text(spark, f"{folder}/{POINTER}", version)
