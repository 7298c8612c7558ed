"""Small text files in whatever store the session can reach; a file is replaced as a whole."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a folder; 0 if there is none."""
    at, fs = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def signature(spark: SparkSession, files: list[str]) -> str:
    """A digest of the names, sizes and times of files: another one if any was replaced."""
    seen = []
    for name in sorted(files):
        at, fs = _at(spark, name)
        status = fs.getFileStatus(at)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    at, fs = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file and then put it in its place, so no reader sees a part."""
    at, fs = _at(spark, path)
    new = at.suffix(".new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options
    how = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    how[0] = getattr(options, "Rename").OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(at), how)
