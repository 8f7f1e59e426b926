"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geneloom.llm import decontamination, line_dedup, near_dedup, quality_rules, sentence_pieces
from geneloom.llm.common import materialise
from geneloom.llm.queries import tokenizer_path

#: Near-duplicate stages take five-word shingles and this similarity, in percent.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Names of columns that the stages add for themselves, chosen so that no table's own columns have them.
VERDICT, LINE_COLUMNS = "quality verdict", ("line count", "lines removed")


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars, where there is one, brought up to date with the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.judge(docs, verdict_col=VERDICT).where(F.col(VERDICT)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any size like an earlier one go, and documents of which no line with a word is left."""
    rows = line_dedup.dedup(docs, SIMILARITY, names=LINE_COLUMNS)
    emptied = (F.size(F.col(LINE_COLUMNS[1])) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return with_text(rows.where(~emptied), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    judged = near_dedup.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
    gone = judged.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, in the same or in edited words, go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, in a column that replaces one of its name."""
    return sentence_pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("sentence_pieces", encode),
]
#: SQL can't express set-similarity joins on whole tables, alignments or the piece search; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
