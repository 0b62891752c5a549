"""A corpus from documents: quality, one document of each near-duplicate group, no benchmark leaks, no secrets, target weights.

Each stage takes (spark, docs, sf_dir) and returns rows; all but the last return the columns of docs. run() writes every stage's rows
as Parquet in the shared checkpoint folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import decontaminate, jaccard_join, mixing, quality, secrets
from tracefold.llm.common import materialise, table

#: The stages learn and hash; SQL can't express them, so tests hold them against brute force.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, trained on all labels, predicts as 0."""
    vectors = quality.word_vectors(docs)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), vectors)
    inner = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("text").alias("__text"))
    return quality.score(inner, vectors, model, "__text").where("predicted = 1").select("__doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked at a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard_join.keep_first(docs, n=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold or closely paraphrase a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows the text where it changes."""
    clean = secrets.redact(docs.withColumn("__before", F.length("text")))
    changed = F.length("text") != F.col("__before")
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("__before")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats sources towards equal weights, none more than twice as often as another; adds epoch and mix_key."""
    return mixing.mix(docs, repeat=2.0)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
