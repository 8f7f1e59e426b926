"""Synteny of clusters: contiguous pairs, scores, the score matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contiguous_pairs(grouped: DataFrame, partition: list[str], order: list[str], group: str) -> DataFrame:
    """(partition..., left, right): the group numbers of neighbours in a locus; pairs never cross loci."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return grouped.select(*partition, F.col(group).alias("left"), F.lead(group).over(w).alias("right"), (F.row_number().over(w) < F.count(F.lit(1)).over(Window.partitionBy(*partition))).alias("_inner")).where("_inner").drop("_inner")


def shared_pairs(one: DataFrame, two: DataFrame, on: list[str]) -> DataFrame:
    """(on..., contiguity): size of the multiset intersection of the two sides' (left, right) pairs."""
    keys = [*on, "left", "right"]
    a = one.where("left IS NOT NULL AND right IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_one"))
    b = two.where("left IS NOT NULL AND right IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_two"))
    return a.join(b, keys).groupBy(*on).agg(F.sum(F.least("n_one", "n_two")).alias("contiguity"))


def link_sums(links: DataFrame, alignments: DataFrame) -> DataFrame:
    """(alignment_id, cumulative, mean): sum of identities, 0 without links, and their mean, null without."""
    sums = links.groupBy("alignment_id").agg(F.sum("identity").alias("cumulative"), F.avg("identity").alias("mean"))
    return alignments.select("alignment_id").join(sums, "alignment_id", "left").select("alignment_id", F.coalesce("cumulative", F.lit(0.0)).alias("cumulative"), "mean")


def contiguity(links: DataFrame, alignments: DataFrame, genes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(alignment_id, contiguity): neighbouring groups that both clusters of an alignment have, with their numbers of times."""
    from .groups import linked_groups

    groups = linked_groups(links, threshold)
    sides = []
    for side in ("query", "target"):
        own = alignments.select("alignment_id", F.col(f"{side}_cluster_id").alias("cluster_id")).join(genes.select("cluster_id", "locus_id", "gene_ord", "gene_id"), "cluster_id")
        marked = own.join(groups, ["alignment_id", "gene_id"], "left")
        sides.append(contiguous_pairs(marked, ["alignment_id", "locus_id"], ["gene_ord"], "group_no"))
    return shared_pairs(*sides, ["alignment_id"])


def weighted(sums: DataFrame, shared: DataFrame, weight: float) -> DataFrame:
    """sums with score: the cumulative identity and weight times the contiguity, none counting as 0."""
    return sums.join(shared, "alignment_id", "left").withColumn("score", F.col("cumulative") + F.lit(weight) * F.coalesce("contiguity", F.lit(0)))


def synteny(links: DataFrame, alignments: DataFrame, genes: DataFrame | None = None, weight: float = 0.5, mode: str = "effective") -> DataFrame:
    """(alignment_id, query_cluster_id, target_cluster_id, score): the sum of identities and, documented, weight times the contiguity.

    In the effective mode contiguity is always 0.
    """
    scored = alignments.join(link_sums(links, alignments), "alignment_id")
    if mode == "documented":
        scored = weighted(scored, contiguity(links, alignments, genes), weight)
    elif mode == "effective":
        scored = scored.withColumn("score", F.col("cumulative"))
    else:
        raise ValueError("the mode is effective or documented")
    return scored.select("alignment_id", "query_cluster_id", "target_cluster_id", "score")


def score_matrix(clusters: DataFrame, scores: DataFrame, normalise: bool = False, as_distance: bool = False) -> DataFrame:
    """(i, j, value) over all pairs of cluster_ord: symmetric, 0 on the diagonal. A pair without alignment has a null value.

    normalise divides by the largest value where that is above 0; as_distance subtracts from the largest (1 when
    normalised), the diagonal staying 0.
    """
    a = clusters.select(F.col("cluster_ord").alias("i"), F.col("cluster_id").alias("a"))
    b = clusters.select(F.col("cluster_ord").alias("j"), F.col("cluster_id").alias("b"))
    both = scores.select(F.col("query_cluster_id").alias("a"), F.col("target_cluster_id").alias("b"), "score").unionByName(scores.select(F.col("target_cluster_id").alias("a"), F.col("query_cluster_id").alias("b"), "score"))
    grid = a.join(b, F.lit(True)).join(both, ["a", "b"], "left").select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.col("score")).alias("value"))
    top = both.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top"))
    found = grid.join(F.broadcast(top), F.lit(True))  # one row
    value, high = F.col("value"), F.col("top")
    if normalise:
        value, high = F.when(F.col("top") > 0, value / F.col("top")).otherwise(value), F.when(F.col("top") > 0, F.lit(1.0)).otherwise(F.col("top"))
    if as_distance:
        value = F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(high - value)
    return found.select("i", "j", value.alias("value"))
