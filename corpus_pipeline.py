"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns them
again, of the rows it keeps; the last returns packed pieces. Stages read what the one
before has written, so each can be run again by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import completion, leaks, lines, quality, simhash
from hazeline.llm.common import documents, store
from hazeline.llm.tokens import tokenizer_path

SHINGLE_WORDS = 3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the regression, which is fitted on the documents given."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are alike to an earlier one; n_chars follows the text."""
    kept = lines.drop_lines(docs.select(*COLUMNS))
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return kept.withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component, links being fingerprints of three-word shingles at 3 or fewer differing bits."""
    return simhash.first_of_each(docs.select(*COLUMNS), SHINGLE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = leaks.find_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of up to 2048 tokens."""
    return completion.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Models, fingerprints and tokenizers are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; between them the rows are written to the shared folder."""
    docs = documents(spark, sf_dir, *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
