"""Partition folders of a path, through Hadoop's file system so any store works."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import SparkSession

DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds anything a reader would see."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return False
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def partition_folders(spark: SparkSession, path: str, column: str = "dt") -> dict[str, str]:
    """Partition value -> folder. Lists names only: one per day, no data is read."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return {}
    found = {}
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(column + "="):
            found[name[len(column) + 1 :]] = status.getPath().toString()
    return found


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    fs, p = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme."""
    fs, p = _path(spark, path)
    return fs.makeQualified(p).toString()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; its folder is made if needed."""
    fs, p = _path(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_new(spark: SparkSession, src: str, dst: str) -> None:
    """Rename to a name that must not be taken."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        jvm.java.net.URI(qualified(spark, dst)), spark._jsc.hadoopConfiguration()
    )
    paths = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.valueOf("NONE")
    context.rename(*paths, options)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that owns a checkpoint; Spark writes it there before the first batch."""
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(text)["id"]


def parse_day(value: str) -> date | None:
    try:
        return date.fromisoformat(value)
    except ValueError:
        return None


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def order_by_name(spark: SparkSession, path: str) -> None:
    """Give the files of a folder modification times in the order of their names, a second apart."""
    fs, p = _path(spark, path)
    found = sorted((s for s in fs.listStatus(p) if s.isFile()), key=lambda s: s.getPath().getName())
    newest = max((s.getModificationTime() for s in found), default=0)
    for i, status in enumerate(found):
        fs.setTimes(status.getPath(), newest - (len(found) - i) * 1000, -1)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, p = _path(spark, src)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(dst)):
        raise OSError(f"cannot move {src} to {dst}")
