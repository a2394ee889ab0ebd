"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import align, bpe, decontaminate, embeddings, extract, hosts, jaccard, mixing, quality, rules, secrets, warc, whitening
from tidewatch.llm.common import table
from tidewatch.llm.sql import ORACLES as ORACLES
from tidewatch.workspace import new_folder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Host and path rules of the URL filter.
URL_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
QUALITY_THRESHOLD = 0.3


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.BASE, "base_failed", "kept", "isolation")


def page_document(url: Column) -> Column:
    """The document that a page shows: the number that its path ends with, else null."""
    number = F.regexp_extract(hosts.path_of(url), r"/([0-9]{1,18})(?:\.[^/]*)?/?$", 1)
    return F.when(number != "", number).cast("long")


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; a page's outcome is the quality label of the document it shows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("good"))
    judged = hosts.judge(pages.withColumn("key", page_document(F.col("url"))), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    return bpe.digests(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


def rank_file() -> bytes:
    with open(RANKS, "rb") as file:
        return file.read()


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page, read back from them."""
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, and the digest of its text without secrets."""
    forest = secrets.fit(secrets.findings_by_rule(spark))
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), forest)
    secret = F.filter("findings", lambda one: one["secret"])
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secret).cast("long").alias("n_secrets"),
        F.transform(secret, lambda one: one["value"]).alias("secrets"), F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    found = jaccard.similar(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extracted(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    weights = quality.fit(docs, table(spark, sf_dir, "labels").filter(fold != 0))
    scored = quality.with_score(docs, weights)
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def _vocabulary(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public tokenizers line up in every document, and which pairs are usual."""
    docs = table(spark, sf_dir, "documents")
    return align.linked(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark, and the items they are from."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_host_reputation": op3_host_reputation,
    "op4_source_mix": op4_source_mix,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc": op6_warc,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_main_text": op9_main_text,
    "op10_quality": op10_quality,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_token_alignment": op12_token_alignment,
    "op13_decontamination": op13_decontamination,
}
