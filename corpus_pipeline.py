"""The corpus pipeline: documents in, tokens out, one operator per stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and is
written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, jaccard, mixing, quality, secrets
from tidewatch.llm.common import same, table
from tidewatch.llm.queries import QUALITY_THRESHOLD, rank_file
from tidewatch.workspace import written


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from all labels."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, weights, name="_score")
    return scored.filter(F.col("_score") >= QUALITY_THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share most of their five-word n-grams."""
    return jaccard.one_of_each_class(docs, written(jaccard.similar(docs), "classes"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and ``n_chars`` counted anew."""
    forest = secrets.fit(secrets.findings_by_rule(spark))
    found = secrets.scan(docs, forest, findings="_findings", redacted="_redacted")
    changed = {"text": F.col("_redacted"), "n_chars": F.length("_redacted").cast("long")}
    return found.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).filter("copies > 0").select("doc_id", "source", F.col("size").alias("_size"), "copies")
    plan = written(taken.distinct(), "plan")
    sized = docs.withColumn("_size", mixing.word_count("text"))
    # Both sides grow with the documents: a shuffle at every size, never a broadcast.
    joined = sized.join(plan.hint("merge"), same(sized, plan, ["doc_id", "source", "_size"]))
    repeated = F.explode(F.sequence(F.lit(1), plan["copies"].cast("int")))
    return joined.select(*[sized[c] for c in docs.columns], repeated.alias("_copy")).drop("_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy."""
    return bpe.digests(docs, rank_file(), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", by_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("secret scan", without_secrets),
    ("source mix", mixed),
    ("byte-level BPE", tokens),
]

#: Learnt scores, MinHash and random rounding have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
