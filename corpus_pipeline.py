"""From documents to packed training sequences.

Each stage works on all documents that the stage before kept; run() writes a stage's result to
the folder that driver and executors share and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm import decontaminate, packing, quality, secret_scan, simhash
from sparklog.llm.queries import tokenizer
from sparklog.llm.shared import modest_batches, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, accepts."""
    modest_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates: fingerprints of whole
    texts at most 4 bits apart, or sets of 5-word shingles of similarity 0.8 or more. Of
    repeated rows with one doc_id one stays; rows without a doc_id can't be told apart and
    stay."""
    groups = simhash.similar_groups(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch near a benchmark item."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name="_matches")
    return found.where(F.size("_matches") == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [kind] in the place of each secret; n_chars follows the text."""
    done = secret_scan.redact(secret_scan.scan(docs))
    done = done.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, each document ended by id 1."""
    return packing.sequences(docs, tokenizer(), 1)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: SQL can express neither the classifier nor fingerprints, edit distances and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
