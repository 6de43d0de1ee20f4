"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import completion, contexts, conversations, leaks, lines, linkgraph, matrices, oracles, phrases, quality, sharding, simhash, suffixes, toxicity
from hazeline.llm.common import documents
from hazeline.llm.tokens import tokenizer_path


def op1_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices with segment lengths and position resets."""
    return matrices.packed_matrices(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def op2_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels of four fifths of the ids."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine)


def op3_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each text when repeats of 20 words or more keep their first place."""
    return suffixes.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))


def op4_url_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, and the link graph's verdict on hosts without one."""
    return linkgraph.judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 from a weighted hash tree."""
    return sharding.place_documents(documents(spark, sf_dir, "doc_id", "text"))


def op6_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and their components at 3 bits or fewer."""
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), 3)


def op7_quality_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the calibrated regression's verdict on every text."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model).drop("text")


def op8_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each text holds, whole or with a tenth of their characters edited."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = leaks.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.col("leaks.item_id").alias("item_ids"),
        F.col("leaks.edits").alias("edits"),
    )


def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 2048 tokens as the search finds."""
    return completion.pack_documents(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that are alike to an earlier line."""
    found = lines.line_report(documents(spark, sf_dir, "doc_id", "text"))
    return found.withColumn("removed_lines", F.array_join("removed_lines", ","))


def op11_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by code length, learned from the lang of two thirds of the ids."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return contexts.identify(docs.select("doc_id", "text"), contexts.train(docs))


def op12_frequent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 to 4 words of each language."""
    return phrases.collocations(documents(spark, sf_dir, "lang", "text"))


def op13_conversation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, after damage."""
    return conversations.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_token_matrices": op1_token_matrices,
    "op2_toxicity_machine": op2_toxicity_machine,
    "op3_suffix_trees": op3_suffix_trees,
    "op4_url_linkgraph": op4_url_linkgraph,
    "op5_hash_tree_shards": op5_hash_tree_shards,
    "op6_simhash_bytes": op6_simhash_bytes,
    "op7_quality_regression": op7_quality_regression,
    "op8_qgram_bands": op8_qgram_bands,
    "op9_bin_completion": op9_bin_completion,
    "op10_line_join": op10_line_join,
    "op11_context_trees": op11_context_trees,
    "op12_frequent_phrases": op12_frequent_phrases,
    "op13_conversation_paths": op13_conversation_paths,
}
ORACLES = {
    "op3_suffix_trees": oracles.repeats_sql(),
    "op4_url_linkgraph": oracles.pages_sql(),
    "op5_hash_tree_shards": oracles.shards_sql(),
    "op10_line_join": oracles.lines_sql(),
    "op12_frequent_phrases": oracles.phrases_sql(),
    "op13_conversation_paths": oracles.conversations_sql(),
}
