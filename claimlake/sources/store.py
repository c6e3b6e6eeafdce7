"""Small files on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.exists(where))


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.exists(where)) and bool(fs.getFileStatus(where).isFile())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file tables name it, with its scheme."""
    fs, where = _at(spark, path)
    return fs.makeQualified(where).toString()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def modified(spark: SparkSession, path: str) -> float:
    fs, where = _at(spark, path)
    return fs.getFileStatus(where).getModificationTime() / 1000
