"""A corpus pipeline of five of the training-data operators: documents in, token counts and digests out.

Each stage takes what the one before kept. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, langid, likeness, linededup, simhash
from mosaiq.llm.bpe import bpe_encode
from mosaiq.llm.common import read, written
from mosaiq.llm.components import components

#: A document goes if less than this share of its letters has one language.
LEAST_SHARE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of so many languages that none prevails, go; a missing lang is filled in."""
    model = langid.fit(docs, F.lit(True))
    found = langid.identify(docs, model, docs.columns, spans=False).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs are deleted; documents of which no more than a stub is left go: fewer words than
    a run that counts, and fewer than were deleted. Documents of which nothing is deleted stay as they are."""
    left = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    stub = (F.col("n_removed") > 0) & (left < linededup.MIN_WORDS) & (left < F.col("n_removed"))
    found = linededup.dedup_lines(docs).where(~stub)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints, and of texts that share four fifths of their five-word
    shingles, the row of the smallest doc_id stays; of equal rows, one."""
    row = F.concat(F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~")), F.lit(":"), F.hex(F.xxhash64("text")))
    named = docs.withColumn("__row", row)
    near = written(simhash.near_duplicates(named, by="__row").select("__row", F.xxhash64("component_id").alias("c")))
    alike = written(likeness.sets(named, "__row"))
    root = components(likeness.links(alike))
    group = alike.select("__by", "s").distinct().join(root, F.col("s") == F.col("node"), "left").select(F.col("__by").alias("__row"), F.coalesce("root", "s").alias("g"))
    # components of both kinds of links at once: a fingerprint's component and a group of alike texts share rows
    both = near.join(group, "__row", "left").select("__row", "c", F.xxhash64(F.lit("alike"), "g").alias("g"), F.col("g").isNull().alias("alone"))
    whole = components(both.where("not alone").select(F.col("c").alias("a"), F.col("g").alias("b")).distinct())
    least = both.join(whole, F.col("c") == F.col("node"), "left").select("__row", F.coalesce("root", "c").alias("root"))
    kept = least.groupBy("root").agg(F.min("__row").alias("__row")).select("__row")
    return named.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def decontaminate_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_encode(docs, keep=["doc_id"], emit=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmarks),
    ("bpe_encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
