"""What several operators share: staged tables, text helpers, connected components."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def trim() -> None:
    """Give memory that a task has freed back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def memo(owner: str) -> dict:
    """A dictionary of one operator that lives as long as the (reused) Python worker does, or
    until another operator works there: what many memos hold would add up."""
    kept = sys.__dict__.setdefault("_sparklog_memo", {})
    others = [k for k in kept if k != owner]
    for k in others:
        del kept[k]
    if others:
        trim()
    return kept.setdefault(owner, {})


#: Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 16 << 20


def modest_batches(spark: SparkSession) -> None:
    """Limits the bytes of rows that Python workers of this session get at a time: texts may
    be long, and JVM and worker hold several copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") == str(64 << 20):  # else someone has chosen
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local
    session without that setting gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = sys.__dict__.setdefault("_sparklog_shared", None) or tempfile.mkdtemp(prefix="sparklog-")
        sys._sparklog_shared = at
    return at.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in a new folder of the shared one, which goes when the session's JVM ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _fs(spark, folder)
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # only what is there can be marked
    return f"{folder}/data"


#: Shuffle files of a write go when it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost
    executors and gives the optimizer real sizes. Its shuffle files go at once. Removed when
    the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _set(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    p, fs = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """Like staged(), as a table bucketed by a column: what gathers its rows by that column
    needs no shuffle of it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    with _set(spark, _CLEANUP, "true"):
        df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    p, fs = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.table(table)
    out._staged_at, out._table = path, table
    return out


def even_slots(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a table bucketed n-fold by such numbers holds in a bucket each."""
    k = F.col("id").cast("int")
    found = spark.range(max(100, 25 * n)).groupBy(F.pmod(F.hash(k), F.lit(n)).alias("b")).agg(F.min(k).alias("k"))
    got = [r.k for r in found.collect()]
    return sorted(got) + list(range(max(got) + 1, max(got) + 1 + n - len(got)))


def drop_staged(df: DataFrame) -> None:
    """Remove a table made by staged() or bucketed() that nothing will read again."""
    p, fs = _fs(df.sparkSession, df._staged_at)
    if hasattr(df, "_table"):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
    fs.delete(p, True)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def doc_hash(c: Column) -> Column:
    """crc32 of an id's decimal text."""
    return F.crc32(c.cast("string").cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    edges: two columns (a, b) of one orderable type; duplicates, loops and either
    direction are fine. Returns (node, root) for every node that has an edge to another
    node; root is the smallest node of its component. No node's neighbourhood is ever
    gathered: minima are map-side combined, and the joins are plain equi-joins that AQE
    splits when one node holds many edges. Each round is staged in the shared folder.
    """
    a, b = edges.columns
    big, small = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    cur = staged(edges.select(big, small).where("a > b").distinct(), "cc")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).withColumn("m", F.least("k", "m")), "cc")
        large = staged(both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc")
        down = staged(large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")), "cc")
        joined = large.join(down, large.a == down.k)
        nxt = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        nxt = staged(nxt.select("e.a", "e.b").where("a > b").distinct(), "cc")
        for old in (cur, least, large, down):
            drop_staged(old)
        cur, last, seen = nxt, seen, mark(nxt)
        if seen == last:
            break
    ones = cur.groupBy("b").agg(F.lit(1).alias("_n")).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(ones)
