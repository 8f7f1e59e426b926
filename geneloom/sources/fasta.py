"""FASTA files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta_entries(text: Column) -> Column:
    """array<struct<ord,id,sequence>> of a FASTA file's text; white space in sequences is dropped."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\r?\n>"), 2, F.greatest(F.size(F.split(F.concat(F.lit("\n"), text), r"\r?\n>")) - 1, F.lit(0)))

    def entry(part: Column, i: Column) -> Column:
        head = F.regexp_extract(part, r"^[^\r\n]*", 0)
        body = F.regexp_replace(F.substring(part, F.length(head) + 1, F.length(part)), r"\s+", "")
        return F.struct(i.alias("ord"), F.regexp_extract(head, r"^\S*", 0).alias("id"), body.alias("sequence"))

    return F.transform(parts, entry)


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ord, id, sequence) per entry; ord counts within the file."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.explode(fasta_entries(F.col("value"))).alias("e")).select("path", "e.*")
