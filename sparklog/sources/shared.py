"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="sparklog-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Only a local session without that setting gets a
    temporary folder. The path goes when the session's JVM ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = _local()
    folder = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where, store = _store(spark, folder)
    store.mkdirs(where)
    store.deleteOnExit(where)  # only what is there can be marked
    return f"{folder}/data"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, in any store that Spark reads; None if it isn't there."""
    where, store = _store(spark, path)
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in the place of another, whole or not at all."""
    where, store = _store(spark, path)
    part = _store(spark, f"{path}.part")[0]
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(where, False)
    store.rename(part, where)
