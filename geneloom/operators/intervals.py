"""Interval operators: range filter, containment join, islands, circular records."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import shared_dir


def within(df: DataFrame, low: Column | int, high: Column | int, start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose interval lies wholly in [low, high]."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.where((F.col(start) >= lit(low)) & (F.col(end) <= lit(high)))


#: A table of first containers of so many places at most is broadcast, a larger one is dealt.
BROADCAST_PLACES = 300_000


def least_containers(low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each (start, end) the least i with low[i] <= start and high[i] >= end, or -1.

    A merge sort tree over i: whether a block of 2^k neighbours holds one is told by the largest high among its lows up to
    start, and all places go down the tree together. Time is (places + intervals) * log^2, memory in proportion to both.
    NaN counts as the largest number, as in Spark.
    """
    n = len(low)
    if not n:
        return np.full(len(start), -1)
    by_low, by_high = np.argsort(low, kind="stable"), np.argsort(high, kind="stable")
    low_rank, high_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    low_rank[by_low] = high_rank[by_high] = np.arange(n)
    lows, least = np.searchsorted(low[by_low], start, "right"), np.searchsorted(high[by_high], end, "left")

    def holds(block: np.ndarray, k: int) -> np.ndarray:
        base = (np.arange(n) >> k) * n
        order = np.argsort(base + low_rank)
        keys, top = (base + low_rank)[order], np.maximum.accumulate((base + high_rank)[order])
        at = np.searchsorted(keys, block * n + lows, "left") - 1
        return (at >= 0) & (top[at] >= block * n + least)

    depth = int(n - 1).bit_length()
    block = np.zeros(len(start), np.int64)
    found = np.flatnonzero(holds(block, depth))
    block, lows, least = block[found], lows[found], least[found]
    for k in range(depth - 1, -1, -1):
        block = 2 * block + ~holds(2 * block, k)
    out = np.full(len(start), -1)
    out[found] = block
    return out


def written_once(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and its path. Spark removes the run's shuffle files at once, not when the driver next collects garbage; the session keeps its own setting."""
    conf, key, path = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shared_dir(df.sparkSession, name)
    own = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(key) if own is None else conf.set(key, own)
    return df.sparkSession.read.parquet(path).select(*df.columns), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what written_once wrote."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def first_containing(inner: DataFrame, outer: DataFrame, on: list[str], row: list[str], order: str, value: list[str], start: str = "start", end: str = "end", prefix: str = "parent_", bin_width: float = 10_000) -> DataFrame:
    """Each inner row with the values of the first outer row (by `order`, then `value`) that contains it, or nulls.

    An outer row contains an inner one if its start is not above and its end not below the inner row's, also where ends lie
    before starts. `on` are equality keys; `row` names the columns that tell inner rows apart, which the result does not depend
    on: rows of equal `on`, start and end share their answer, so that distinct places meet distinct outer intervals. No pair
    of them is listed: they are dealt by `on` and coordinate bin, and a bin's places are answered together (least_containers).
    A bin's intervals and places are in one worker's memory.
    Bins are bin_width wide, and 32 times as wide at each further level; what touches more than 33 bins is filed at the next
    level, and levels meet in the bins of the wider one. An inner row counts as its start, or as all from end to start where
    the end lies before. An inner row with a null in `on`, start or end has no match. Places, outer intervals and answers are
    written to the shared folder, of which the answers stay; up to BROADCAST_PLACES answers are broadcast, so that inner rows are not shuffled.
    """
    keys, at = [f"_on_{i}" for i in range(len(on))], [*(f"_on_{i}" for i in range(len(on))), "_start", "_end"]
    named = lambda df: [F.col(c).alias(k) for c, k in zip([*on, start, end], at)]
    kinds = inner.select(*named(inner)).union(outer.select(*named(outer))).schema
    typed = [F.col(c).cast(k.dataType).alias(k.name) for c, k in zip([*on, start, end], kinds)]
    whole = reduce(and_, (F.col(k).isNotNull() for k in at))
    bin_of = lambda c: F.floor(F.greatest(F.lit(-(2.0**60)), F.least(F.lit(2.0**60), c / F.lit(float(bin_width)))))

    def filed(df: DataFrame, last: Column, name: str) -> tuple[DataFrame, str, Column]:
        """df, written, with its range of bins and its level; its path; the levels there are."""
        df = df.withColumn("_from", bin_of(F.least("_start", "_end"))).withColumn("_to", bin_of(last))
        df, path = written_once(df.withColumn("_level", F.expr("CAST((length(bin(_to - _from)) - 1) DIV 5 AS INT)")), name)
        return df, path, F.array(*(F.lit(r[0]) for r in df.select("_level").distinct().collect())).cast("array<int>")

    def dealt(df: DataFrame, own: str, levels: Column, other: str) -> DataFrame:
        met = df.withColumnRenamed("_level", own).withColumn(other, F.explode(levels))
        shifted = "shiftright({}, 5 * greatest(_level_in, _level_out))"
        return met.withColumn("_bin", F.explode(F.expr(f"sequence({shifted.format('_from')}, {shifted.format('_to')})"))).drop("_from", "_to")

    places, places_path, place_levels = filed(inner.select(*typed).where(whole).distinct(), F.col("_start"), "places")
    held = outer.select(*typed, F.struct(F.col(order).alias("_order"), *(F.col(v).alias(v) for v in value)).alias("_outer")).where(whole)
    held, held_path, held_levels = filed(held.groupBy(*at).agg(F.min("_outer").alias("_outer")), F.greatest("_start", "_end"), "intervals")
    dealt_by = [*keys, "_level_in", "_level_out", "_bin"]
    ranked = dealt(held, "_level_out", place_levels, "_level_in").withColumn("_place", F.row_number().over(Window.partitionBy(*dealt_by).orderBy("_outer")))

    def meet(places: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("_place")
        low, high, first, last = (t[c].to_numpy() for t in (held, places) for c in ("_start", "_end"))
        found = least_containers(low, high, first, last)
        hit = np.flatnonzero(found >= 0)
        return places.select(at).take(hit).append_column("_outer", held["_outer"].take(found[hit]))

    met = dealt(places, "_level_in", held_levels, "_level_out").groupBy(*dealt_by).cogroup(ranked.groupBy(*dealt_by)).applyInArrow(meet, T.StructType([*places.select(*at).schema, held.schema["_outer"]]))
    first, _ = written_once(met.groupBy(*at).agg(F.min("_outer").alias("_outer")), "containers")
    for path in (places_path, held_path):
        removed(inner.sparkSession, path)
    if first.count() <= BROADCAST_PLACES:
        first = F.broadcast(first)
    same = reduce(and_, (inner[c].cast(k.dataType) == first[k.name] for c, k in zip([*on, start, end], kinds)))
    return inner.join(first, same, "left").select(*inner.columns, *(F.col(f"_outer.{v}").alias(prefix + v) for v in value))


def islands(df: DataFrame, partition: list[str], order: list[str], key: str, name: str = "island") -> DataFrame:
    """Numbers the runs of consecutive rows with equal (or null) keys from 1 on."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def join_abutting(exons: Column) -> Column:
    """Parts in order, neighbours that touch on one strand made one."""
    typed = "array<struct<start:int,end:int,strand:tinyint>>"

    def step(done: Column, e: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        touch = (F.size(done) > 0) & (last["strand"].eqNullSafe(e["strand"])) & ((last["end"] == e["start"]) | (e["end"] == last["start"]))
        one = F.array(F.struct(F.least(last["start"], e["start"]).alias("start"), F.greatest(last["end"], e["end"]).alias("end"), e["strand"].alias("strand")))
        return F.when(touch, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), one)).otherwise(F.concat(done, F.array(e))).cast(typed)

    return F.aggregate(exons.cast(typed), F.array().cast(typed), step)


def spans_origin(exons: Column) -> Column:
    """Whether a feature runs over the origin: its parts, read along the plus strand, go backwards."""
    along = F.when(F.get(exons, F.lit(0))["strand"] == -1, F.reverse(exons)).otherwise(exons)
    return (F.size(along) > 1) & (F.get(along, F.lit(0))["start"] >= F.get(along, F.size(along) - 1)["end"])


def shift_circular(records: DataFrame) -> DataFrame:
    """Circular records of RECORDS with a gene or CDS over the origin start at the first such feature; others stay.

    Positions move modulo the length; a part that ends at the length keeps that end. Parts that touch after the move
    are joined.
    """
    candidates = F.filter("features", lambda f: f["type"].isin("gene", "CDS") & spans_origin(f["exons"]))
    first = F.get(candidates, F.lit(0))["exons"]
    along = F.when(F.get(first, F.lit(0))["strand"] == -1, F.reverse(first)).otherwise(first)
    length = F.coalesce(F.length("sequence"), F.col("length"))
    shift = F.when(F.col("topology") == "circular", F.get(along, F.lit(0))["start"])
    moved = records.withColumn("_shift", shift).withColumn("_length", length)

    def move(e: Column) -> Column:
        start = F.pmod(e["start"] - F.col("_shift"), F.col("_length"))
        return F.struct(start.cast("int").alias("start"), (start + e["end"] - e["start"]).cast("int").alias("end"), e["strand"].alias("strand"))

    def feature(f: Column) -> Column:
        return F.struct(f["feature_ord"].alias("feature_ord"), f["type"].alias("type"), join_abutting(F.transform(f["exons"], move)).alias("exons"), f["qualifiers"].alias("qualifiers"))

    shifted = F.when(F.col("_shift").isNotNull(), F.transform("features", feature)).otherwise(F.col("features"))
    sequence = F.when(F.col("_shift").isNotNull(), F.concat(F.substring("sequence", F.col("_shift") + 1, F.col("_length")), F.substring("sequence", F.lit(1), F.col("_shift")))).otherwise(F.col("sequence"))
    return moved.select(*(shifted.alias(c) if c == "features" else sequence.alias(c) if c == "sequence" else F.col(c) for c in records.columns))
