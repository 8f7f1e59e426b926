"""From annotated records to clusters, loci and genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as C
from .intervals import first_containing, shift_circular


def start_of(exons: Column) -> Column:
    return F.array_min(F.transform(exons, lambda e: e["start"]))


def end_of(exons: Column) -> Column:
    return F.array_max(F.transform(exons, lambda e: e["end"]))


def strand_of(exons: Column) -> Column:
    strands = F.array_distinct(F.transform(exons, lambda e: e["strand"]))
    return F.when(F.size(strands) == 1, strands[0])


def finish_genes(rows: DataFrame) -> DataFrame:
    """GENES of rows (cluster_id, locus_id, gene_id, gene_ord, start, end, strand, bases, qualifiers); null bases are none.

    The translation is the qualifier's, else that of the extracted bases; of names the first value of a key counts.
    """
    names = C.first_values(F.col("qualifiers"))
    found = rows.withColumn("all", names).withColumn("bases", F.coalesce("bases", F.lit("")))
    kept = F.map_filter("all", lambda k, _: k != "translation")
    return found.select(
        "gene_id", "locus_id", "cluster_id", F.col("gene_ord").cast("int").alias("gene_ord"), C.label(kept, F.col("gene_id")).alias("label"), kept.alias("names"),
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("strand").cast("tinyint").alias("strand"), F.col("bases").alias("sequence"),
        F.coalesce(F.element_at("all", "translation"), C.translate_codons(F.col("bases"))).alias("translation"),
    )


def tables_of_records(records: DataFrame, ranges: dict[str, tuple[int, int]] | None = None, set_origin: bool = True, as_separate_clusters: bool = False) -> dict[str, DataFrame]:
    """clusters, loci and genes of RECORDS rows.

    ranges: record id -> (start, end); features outside go. Sequences are extracted from whole records. A gene is a
    CDS feature; it gets the place of the first gene feature that contains it (a start of 0 there gives the CDS's).
    as_separate_clusters: each record is a cluster, named by file and record id.
    """
    spark = records.sparkSession
    if set_origin:
        records = shift_circular(records)
    wanted = spark.createDataFrame([(k, a, b) for k, (a, b) in (ranges or {}).items()], "record_id string, range_start int, range_end int")
    cluster = C.stable_id(F.lit("cluster"), F.col("source_path"), F.col("cluster_ord"), *([F.col("record_ord")] if as_separate_clusters else []))
    placed = records.join(F.broadcast(wanted), "record_id", "left").withColumn("cluster_id", cluster).withColumn("locus_id", C.stable_id(F.lit("locus"), F.col("source_path"), F.col("cluster_ord"), F.col("record_ord")))
    placed = placed.withColumn("locus_start", F.coalesce("range_start", F.lit(0))).withColumn("locus_end", F.coalesce(F.nullif("range_end", F.lit(0)), F.length("sequence"), "length"))
    order = F.struct("cluster_ord", "record_ord") if as_separate_clusters else F.struct("cluster_ord")
    name = F.concat("cluster_name", "record_id") if as_separate_clusters else F.col("cluster_name")
    found = placed.groupBy("cluster_id").agg(F.min(order).alias("o"), F.min_by(name, "record_ord").alias("name"), F.first("source_path").alias("source_path"))
    loci = placed.select("locus_id", "cluster_id", (F.lit(0) if as_separate_clusters else F.col("record_ord")).cast("int").alias("locus_ord"), F.col("record_name").alias("name"), F.col("locus_start").cast("int").alias("start"), F.col("locus_end").cast("int").alias("end"))
    # Each feature takes its own bases along, so that no copy of the record's sequence is made for it or shuffled.
    own = F.transform(F.filter("features", lambda f: f["type"].isin("CDS", "gene")), lambda f: F.struct(*(f[n].alias(n) for n in ("feature_ord", "type", "exons", "qualifiers")), F.when(f["type"] == "CDS", C.extract(F.col("sequence"), f["exons"])).alias("bases")))
    features = placed.select("cluster_id", "locus_id", "range_start", "range_end", F.explode(own).alias("f")).select("cluster_id", "locus_id", "range_start", "range_end", "f.*")
    features = features.withColumn("start", start_of(F.col("exons"))).withColumn("end", end_of(F.col("exons")))
    features = features.where("range_start IS NULL OR (start >= range_start AND end <= range_end)")
    cds, genes = features.where(F.col("type") == "CDS"), features.where(F.col("type") == "gene")
    met = first_containing(cds, genes, ["locus_id"], ["locus_id", "feature_ord"], "feature_ord", ["start", "end"])
    rows = met.select(
        "cluster_id", "locus_id", C.stable_id(F.lit("gene"), F.col("locus_id"), F.col("feature_ord")).alias("gene_id"), F.col("feature_ord").alias("gene_ord"),
        F.coalesce(F.nullif("parent_start", F.lit(0)), "start").alias("start"), F.coalesce("parent_end", "end").alias("end"), strand_of(F.col("exons")).alias("strand"), "bases", "qualifiers",
    )
    return {"clusters": numbered_clusters(found), "loci": loci, "genes": finish_genes(rows)}


def numbered_clusters(found: DataFrame) -> DataFrame:
    """CLUSTERS of (cluster_id, o, name, source_path): cluster_ord counts by o. There are as many rows as clusters."""
    from pyspark.sql import Window

    return found.select("cluster_id", (F.row_number().over(Window.orderBy("o")) - 1).cast("int").alias("cluster_ord"), "name", "source_path")


def tables_of_gff(loci: DataFrame, genes: DataFrame) -> dict[str, DataFrame]:
    """clusters, loci and genes of what read_gff returns."""
    cluster = C.stable_id(F.lit("cluster"), F.col("source_path"), F.col("cluster_ord"))
    named = loci.withColumn("cluster_id", cluster).withColumn("locus_id", C.stable_id(F.lit("locus"), F.col("source_path"), F.col("cluster_ord"), F.col("locus_ord")))
    found = named.groupBy("cluster_id").agg(F.min(F.struct("cluster_ord")).alias("o"), F.min_by("cluster_name", "locus_ord").alias("name"), F.first("source_path").alias("source_path"))
    rows = genes.join(named.select("cluster_ord", "locus_ord", "cluster_id", "locus_id"), ["cluster_ord", "locus_ord"]).withColumn("gene_id", C.stable_id(F.lit("gene"), F.col("locus_id"), F.col("gene_ord")))
    return {"clusters": numbered_clusters(found), "loci": named.select(*schemas.names(schemas.LOCI)), "genes": finish_genes(rows)}
