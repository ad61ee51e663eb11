"""A corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. ``run`` writes each stage as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import fresh, materialise, release, scratch
from docgraph.llm.decontaminate import decontaminate
from docgraph.llm.jaccard_join import keep_one
from docgraph.llm.mixing import mix
from docgraph.llm.quality import fit_quality, score_quality
from docgraph.llm.sharding import kd_shards

SHARDS = 24
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = fresh("score", docs.columns)
    scored = score_quality(docs, fit_quality(docs, labels), keep=docs.columns, score_col=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans shared with benchmark items are cut out; documents that are mostly such spans go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes its words, to the nearest whole number, three times at most.

    Documents without words add nothing to a mix and appear once. Rows of one id, source and text share
    what the mix takes of them evenly.
    """
    names = [fresh(c, docs.columns) for c in ("id", "origin", "hash", "copies", "copy")]
    id_, origin, hash_, copies, copy = names
    alike = mix(docs).where("size > 0").groupBy(F.col("doc_id").alias(id_), F.col("source").alias(origin), F.col("text_hash").alias(hash_))
    taken = alike.agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias(copies))
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & docs["source"].eqNullSafe(F.col(origin)) & (F.xxhash64(docs["text"]) == F.col(hash_))
    repeats = F.coalesce(copies, F.lit(1))
    joined = docs.join(taken, same, "left").where(repeats > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), repeats))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return kd_shards(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the learned classifier of the first stage; a test holds the rows of each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept: list[str] = []
    for name, stage in STAGES[:-1]:
        with scratch() as mine:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage wrote on its way, and the stage before it, is read no more
        release(spark, [*mine[:-1], *kept])
        kept = mine[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
