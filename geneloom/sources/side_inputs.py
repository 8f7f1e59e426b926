"""Ranges, gene functions and colours."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_range(text: str) -> tuple[str, int, int]:
    """scaffold:start-end. ValueError unless there is one : and one -; TypeError unless the ends are digits."""
    if text.count(":") != 1:
        raise ValueError(f"a range is scaffold:start-end, not {text!r}")
    name, span = text.split(":")
    if span.count("-") != 1:
        raise ValueError(f"a range is scaffold:start-end, not {text!r}")
    start, end = span.split("-")
    if not (re.fullmatch(r"\d+", start) and re.fullmatch(r"\d+", end)):
        raise TypeError(f"start and end of a range are whole numbers, not {span!r}")
    return name, int(start), int(end)


def parse_ranges(texts: Iterable[str]) -> dict[str, tuple[int, int]]:
    """Ranges by scaffold; the last of a scaffold wins."""
    return {name: (start, end) for name, start, end in map(parse_range, texts)}


def two_columns(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """(ord, first, second) of a CSV file without header. White space stays; every line needs exactly two fields."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).where(F.col("line") != "")
    field = F.from_csv("line", "a string, b string, c string", {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"})
    rows = lines.select("ord", "line", field.alias("f"))
    good = F.col("f.a").isNotNull() & F.col("f.b").isNotNull() & F.col("f.c").isNull()
    return rows.select("ord", F.when(good, F.col("f.a")).otherwise(F.raise_error(F.concat(F.lit("two fields are needed: "), F.col("line"))).cast("string")).alias(first), F.col("f.b").alias(second))


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    """(function_ord, function, genes) of a gene,function file: functions and their genes in order of first mention."""
    rows = two_columns(spark, path, "gene", "function")
    grouped = rows.groupBy("function").agg(F.min("ord").alias("function_ord"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "gene"))), lambda x: x["gene"]).alias("genes"))
    return grouped.select("function_ord", "function", "genes")


def read_colours(spark: SparkSession, path: str) -> DataFrame:
    """(function, colour) of a function,colour file; the last of a function wins."""
    return two_columns(spark, path, "function", "colour").groupBy("function").agg(F.max_by("colour", "ord").alias("colour"))
