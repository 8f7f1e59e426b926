"""Finding genes, alignments and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def global_order(genes: DataFrame, loci: DataFrame, clusters: DataFrame) -> DataFrame:
    """genes with `place`, a struct that orders them by cluster, locus and gene."""
    placed = genes.join(loci.select("locus_id", "locus_ord"), "locus_id").join(clusters.select("cluster_id", "cluster_ord"), "cluster_id")
    return placed.withColumn("place", F.struct("cluster_ord", "locus_ord", "gene_ord")).select(*genes.columns, "place")


def genes_by_value(placed: DataFrame, wanted: DataFrame, value: str = "value") -> DataFrame:
    """wanted's columns and gene_id: the first gene with the value among its names' values; misses are dropped."""
    held = placed.select("gene_id", "place", F.explode(F.array_distinct(F.map_values("names"))).alias(value))
    first = held.join(wanted.select(value).distinct(), value).groupBy(value).agg(F.min_by("gene_id", "place").alias("gene_id"))
    return wanted.join(first, value)


def locus_text(name: Column | str = "name", start: Column | str = "start", end: Column | str = "end") -> Column:
    """How a locus is written: its name, and its place from the first to the last base."""
    column = lambda c: c if isinstance(c, Column) else F.col(c)
    return F.concat(column(name), F.lit(":"), column(start).cast("string"), F.lit("-"), column(end).cast("string"))


def gene_by_label(placed: DataFrame, label: str, cluster_id: str | None = None, locus_id: str | None = None) -> DataFrame:
    """The first gene with the label, of one cluster or locus if that is given; one row or none."""
    for column, value in (("cluster_id", cluster_id), ("locus_id", locus_id)):
        if value is not None:
            placed = placed.where(F.col(column) == value)
    return placed.where(F.col("label") == label).orderBy("place").limit(1).drop("place")


def alignment_between(alignments: DataFrame, one: str, two: str) -> DataFrame:
    """The alignment of two clusters, whichever way round."""
    same = (F.col("query_cluster_id") == one) & (F.col("target_cluster_id") == two)
    turned = (F.col("query_cluster_id") == two) & (F.col("target_cluster_id") == one)
    return alignments.where(same | turned)


def members(links: DataFrame) -> DataFrame:
    """(alignment_id, gene_id) of the genes in a link, each once."""
    return links.select("alignment_id", F.explode(F.array("query_gene_id", "target_gene_id")).alias("gene_id")).distinct()


def contains(links: DataFrame, gene_id: str) -> bool:
    return not links.where((F.col("query_gene_id") == gene_id) | (F.col("target_gene_id") == gene_id)).limit(1).isEmpty()


def label_keys(genes: DataFrame) -> DataFrame:
    """(key) of all names that genes have."""
    return genes.select(F.explode(F.map_keys("names")).alias("key")).distinct()


def relabelled(genes: DataFrame, key: str) -> DataFrame:
    """Labels by one kind of name where a gene has it."""
    return genes.withColumn("label", F.coalesce(F.element_at("names", key), "label"))
