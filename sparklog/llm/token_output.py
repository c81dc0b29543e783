"""Token ids in Simple-8b files.

A file is a Parquet file of segments. A segment holds the ids of whole documents, in ascending
doc_id order (nulls first): the documents' ids and lengths, the Simple-8b words of all their
ids, and the word offset of each block of simple8b.BLOCK ids. Segments are numbered within a
shard, shards in doc_id order; a segment knows how many ids of its shard come before it.
Spark's own writer commits the files, so a lost executor only repeats its tasks.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .bpe import Encoder

#: Ids after which a segment ends (with its document).
SEGMENT_IDS = 500_000
SCHEMA = "shard int, seq int, before long, doc_ids array<long>, lengths array<long>, words binary, offsets binary"


def _segment(shard: int, seq: int, before: int, ids: list, docs: list) -> dict:
    words, offsets = simple8b.encode(np.concatenate(ids))
    return {"shard": shard, "seq": seq, "before": before, "doc_ids": docs, "lengths": [len(x) for x in ids], "words": words.astype("<u8").tobytes(), "offsets": offsets.astype("<u4").tobytes()}


def _encoded(batches, path: str, end: int):
    shard, seq, before = TaskContext.get().partitionId(), 0, 0
    ids, docs, size = [], [], 0
    encoder = Encoder.of(path)
    stop = np.array([end], np.uint32)
    for pdf in batches:
        rows = []
        encoded = encoder.encode(pdf["text"].tolist())
        for doc, known, x in zip(pdf["doc_id"].tolist(), pdf["known"].tolist(), encoded):
            ids.append(np.concatenate([x, stop]))
            docs.append(int(doc) if known else None)
            size += len(x) + 1
            if size >= SEGMENT_IDS:
                rows.append(_segment(shard, seq, before, ids, docs))
                seq, before, ids, docs, size = seq + 1, before + size, [], [], 0
        if rows:
            yield pd.DataFrame(rows)
    if ids:
        yield pd.DataFrame([_segment(shard, seq, before, ids, docs)])


def write(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Writes the ids of all documents (doc_id, text), each followed by the id end.

    Null texts count as empty; rows with one doc_id, null too, stay together, in any order
    among themselves; other columns are not read. An empty table gives files without rows."""
    known = F.col("doc_id").isNotNull()
    src = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    src = src.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), known.alias("known"), "text")
    src.mapInPandas(lambda it: _encoded(it, tokenizer, end), SCHEMA).write.option("compression", "none").parquet(path)


def _decoded(batches):
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            ids = simple8b.decode(np.frombuffer(r.words, "<u8")).astype("<u4")
            size = np.asarray(r.lengths, dtype=np.int64)
            ends = np.cumsum(size)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), size.tolist())]
            yield pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "start": r.at + ends - size, "n_tokens": size, "ids_crc32": crc})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments with at (ids of all documents before the segment). One total a shard goes
    through the driver."""
    seg = spark.read.schema(SCHEMA).parquet(path)
    sizes = seg.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    sizes = sorted((r.shard, r.n) for r in sizes)
    begins = spark.createDataFrame([(s, at) for (s, _), at in zip(sizes, accumulate([0] + [n for _, n in sizes]))] or [(-1, 0)], "shard int, begin long")
    return seg.join(F.broadcast(begins), "shard").withColumn("at", F.col("begin") + F.col("before")).drop("begin")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens and ids_crc32 of each document."""
    return read(spark, path).mapInPandas(_decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")
