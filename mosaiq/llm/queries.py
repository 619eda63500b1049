"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, htmltext, langid, linededup, mixture, repair, simhash, toxicity, trie, warc
from .bpe import bpe_encode
from .common import held_out, read
from .prefix import run_digests
from .sketch import edited_likeness


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a crawl log of pages, resolved; header fields as text."""
    out = warc.resolve_revisits(warc.crawl(read(spark, sf_dir, "pages")))
    return out.withColumn("headers", warc.header_text("headers"))


def op2_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op3_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its later repeated runs, with the number of words deleted."""
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language and the spans of every whole text of documents, learned from the part not held out."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = langid.fit(docs, ~held_out())
    return langid.identify(docs, model, ["doc_id", "held_out"]).withColumn("spans", langid.span_text())


def op5_template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text of documents, learned from the part that is not held out."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded; digests of both."""
    return bpe_encode(read(spark, sf_dir, "documents"), keep=["doc_id"], emit=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference pair from every conversation: prompt, completions and their masks' run lengths."""
    out = chat.format_preferences(chat.with_earlier_reply(chat.conversations(read(spark, sf_dir, "conversations"))))
    return out.select("conv_id", "n_prefix", "prompt", "chosen_completion", chat.mask("chosen_segments").alias("chosen_mask"), "rejected_completion", chat.mask("rejected_segments").alias("rejected_mask"))


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, with their edit distances and places."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])


def op10_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, with their likeness and the next document's."""
    return edited_likeness(read(spark, sf_dir, "documents"))


def op11_cost_to_go_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a rule and repaired at least cost: faults, edits and a digest of the repaired turns."""
    found = repair.faults(repair.damaged(read(spark, sf_dir, "conversations")))
    summary = repair.summaries(found)
    turns = repair.rebuilt(found, summary).select("conv_id", repair.turn_text().alias("text"))
    digests = run_digests(turns, "conv_id", "text", "\n").select(F.col("conv_id").alias("__c"), "sha256")
    out = summary.join(digests, F.col("conv_id").eqNullSafe(F.col("__c")), "left")
    return out.select(*summary.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, its source's target and the words that the mix takes of it."""
    out = mixture.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_preorder_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with sums over its subtree and a digest of the ids that end there."""
    convs = trie.grafted(trie.conversations(read(spark, sf_dir, "conversations")))
    ends, nodes = trie.build(convs)
    digests = run_digests(trie.in_order(ends), "node", "ids", ",").select(F.col("node").alias("__n"), "sha256")
    out = nodes.join(digests, F.col("node") == F.col("__n"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": warc.REVISIT_SQL, "op8_preference_format": chat.PREFERENCE_SQL, "op11_cost_to_go_repair": repair.REPAIR_SQL, "op12_mixture_rates": mixture.MIX_SQL, "op13_preorder_trie": trie.TRIE_SQL}
