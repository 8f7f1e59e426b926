"""Incremental comparison: files that arrive in a folder join a session, and only new cluster pairs are aligned."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import Session, parse_files


def watch(spark: SparkSession, folder: str, session: Session, store: str, checkpoint: str, cutoff: float = 0.3, pattern: str = "*.{gbk,gb,gbff}", files_a_batch: int = 100) -> StreamingQuery:
    """A running query over the files of a folder: each batch's clusters are aligned with the stored ones and among themselves.

    The session's tables are written to store after each batch under its number, with a batch already stored skipped, so that
    a batch that is run again after a failure changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        paths = sorted(re.sub(r"^[a-z]+:/+", "/", unquote(r["path"])) for r in batch.select("path").collect())
        known = {r[0] for r in session.clusters.select("source_path").collect()}
        fresh = [p for p in paths if p not in known]
        if fresh:
            session.add_clusters(parse_files(spark, fresh))
            session.align(cutoff)
            session.build_groups()
        session.write_parquet(f"{store}/batch={number}")

    return files.select("path").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores_of_stream(links: DataFrame, time: str = "at", delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Sum of identities per alignment and window of a stream of links with event times; late links beyond `delay` are left out."""
    return links.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), "alignment_id").agg(F.sum("identity").alias("cumulative"), F.count(F.lit(1)).alias("n"))
