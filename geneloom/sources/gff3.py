"""GFF3 and GTF files with their FASTA files as record rows, by DataFrame functions.

Coordinates: rows are 1-based. A locus starts at the region's first base less one. Genes get the 1-based coordinates of
their parent gene row, or where there is none those of their coding parts, 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import extract
from .discovery import escaped_path, find_fasta, plain_path, stem
from .fasta import fasta_entries

#: Parents are looked for through so many levels (CDS, mRNA, gene) before it is asked whether there are more.
LEVELS = 3


def attributes(text: Column) -> Column:
    """map<string,array<string>> of column 9; values are cut at commas and percent escapes decoded. GTF's key "value" form is read too."""
    pairs = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    decode = lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)

    def pair(x: Column) -> Column:
        key = F.regexp_extract(x, r"^[^=\s]+", 0)
        value = F.regexp_replace(F.regexp_replace(x, r"^[^=\s]+\s*=?\s*", ""), r'^"|"$', "")
        return F.struct(key.alias("key"), F.transform(F.split(value, ","), decode).alias("values"))

    entries = F.transform(pairs, pair)
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["values"])))))


def feature_rows(files: DataFrame) -> DataFrame:
    """(cluster_ord, line_ord, seqid, type, start, end, strand, attributes) of (cluster_ord, value) files, up to ##FASTA."""
    body = F.get(F.split("value", r"(?m)^##FASTA.*$"), F.lit(0))
    lines = files.select("cluster_ord", F.posexplode(F.split(body, r"\r?\n")).alias("line_ord", "line")).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    field = F.split("line", "\t")
    rows = lines.where(F.size(field) >= 8)
    return rows.select(
        "cluster_ord", "line_ord", field[0].alias("seqid"), field[2].alias("type"), field[3].cast("int").alias("start"), field[4].cast("int").alias("end"),
        F.when(field[6] == "-", -1).when(field[6] == "+", 1).cast("tinyint").alias("strand"), attributes(F.coalesce(F.get(field, F.lit(8)), F.lit(""))).alias("attributes"),
    )


def regions(files: DataFrame) -> DataFrame:
    """(cluster_ord, seqid, region_start, region_end) of ##sequence-region lines; they must have four tokens."""
    lines = files.select("cluster_ord", F.posexplode(F.split("value", r"\r?\n")).alias("line_ord", "line")).where(F.col("line").startswith("##sequence-region"))
    token = F.split(F.rtrim("line"), " ")
    checked = F.when(F.size(token) == 4, token).otherwise(F.raise_error(F.concat(F.lit("not a sequence-region: "), F.col("line"))).cast("array<string>"))
    rows = lines.select("cluster_ord", "line_ord", checked.alias("t"))
    return rows.groupBy("cluster_ord", F.col("t")[1].alias("seqid")).agg(F.max_by(F.col("t")[2].cast("int"), "line_ord").alias("region_start"), F.max_by(F.col("t")[3].cast("int"), "line_ord").alias("region_end"))


def merged_exons(cds: DataFrame) -> DataFrame:
    """Consecutive coding rows (by start) of one ID as one feature with exons in biological order; interleaved IDs don't merge."""
    order = Window.partitionBy("cluster_ord", "seqid").orderBy("start", "line_ord")
    numbered = cds.withColumn("new", (~F.col("own_id").eqNullSafe(F.lag("own_id").over(order))).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    exon = F.struct("start", "line_ord", "end", "strand", "offset")
    grouped = numbered.groupBy("cluster_ord", "seqid", "island").agg(F.min_by("own_id", "line_ord").alias("own_id"), F.sort_array(F.collect_list(exon)).alias("parts"), F.min_by("attributes", F.struct("start", "line_ord")).alias("attributes"))
    place = lambda p: F.struct((p["start"] - 1 - p["offset"]).cast("int").alias("start"), (p["end"] - p["offset"]).cast("int").alias("end"), p["strand"].alias("strand"))
    exons = F.transform("parts", place)
    return grouped.withColumn("exons", F.when(F.get(F.col("parts"), F.lit(0))["strand"] == -1, F.reverse(exons)).otherwise(exons))


def parent_genes(rows: DataFrame, cds: DataFrame) -> DataFrame:
    """(cluster_ord, own_id, gene_start, gene_end): the first ancestor of type gene, at any depth; in a circle of parents each is met once."""
    own = F.get(F.element_at("attributes", "ID"), F.lit(0))
    links = rows.where(own.isNotNull()).select("cluster_ord", own.alias("node"), "type", "start", "end", "line_ord", F.coalesce(F.element_at("attributes", "Parent"), F.array().cast("array<string>")).alias("parents"))
    steps = cds.select("cluster_ord", "own_id", F.explode(F.coalesce(F.element_at("attributes", "Parent"), F.array().cast("array<string>"))).alias("node"))
    found, seen, level = None, None, 0
    while level < LEVELS or not steps.isEmpty():
        steps = steps.distinct() if seen is None else steps.distinct().join(seen, ["cluster_ord", "own_id", "node"], "left_anti")
        seen = steps if seen is None else seen.unionByName(steps)
        met = steps.join(links, ["cluster_ord", "node"])
        genes = met.where(F.col("type") == "gene").select("cluster_ord", "own_id", F.lit(level).alias("level"), "line_ord", "start", "end")
        found = genes if found is None else found.union(genes)
        steps, level = met.where(F.col("type") != "gene").select("cluster_ord", "own_id", F.explode("parents").alias("node")), level + 1
    first = found.groupBy("cluster_ord", "own_id").agg(F.min_by(F.struct("start", "end"), F.struct("level", "line_ord")).alias("g"))
    return first.select("cluster_ord", "own_id", F.col("g.start").alias("gene_start"), F.col("g.end").alias("gene_end"))


def read_gff(spark: SparkSession, paths: list[str], ordinals: list[int] | None = None, ranges: dict[str, tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(loci, genes) of GFF files: loci(cluster_ord, cluster_name, source_path, locus_ord, record_id, name, start, end), genes(cluster_ord, locus_ord, gene_ord, start, end, strand, exons, bases, qualifiers).

    The region of a record is the user's range, else the file's directive, else the whole record; only a user's range
    cuts the sequence. Coding rows lie wholly in the region; a gene whose parent overflows it is left out. Every coding
    row needs an ID. Without companion FASTA file FileNotFoundError is raised.
    """
    ordinals = list(ordinals or range(len(paths)))
    fastas = [find_fasta(p) for p in paths]
    for p, f in zip(paths, fastas):
        if f is None:
            raise FileNotFoundError(f"no FASTA file belongs to {p}")

    def texts(files: list[str]) -> DataFrame:
        """(cluster_ord, value) of whole files, read in one scan whatever their number."""
        place = spark.createDataFrame([(o, plain_path(p)) for o, p in zip(ordinals, files)], "cluster_ord int, path string")
        uri = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
        found = spark.read.text([escaped_path(p) for p in dict.fromkeys(files)], wholetext=True).select(F.regexp_replace(F.url_decode(uri), "^[a-z]+:/+", "/").alias("path"), "value")
        return found.join(F.broadcast(place), "path").select("cluster_ord", "value")

    gff = texts(paths)
    rows = feature_rows(gff)
    records = texts(fastas).select("cluster_ord", F.explode(fasta_entries(F.col("value"))).alias("e")).select("cluster_ord", F.col("e.ord").alias("locus_ord"), F.col("e.id").alias("seqid"), F.col("e.sequence").alias("sequence"))
    wanted = spark.createDataFrame([(k, a, b) for k, (a, b) in (ranges or {}).items()], "seqid string, range_start int, range_end int")
    placed = records.join(F.broadcast(wanted), "seqid", "left").join(regions(gff), ["cluster_ord", "seqid"], "left")
    placed = placed.select(
        "cluster_ord", "locus_ord", "seqid", (F.coalesce("range_start", "region_start", F.lit(1)) - 1).alias("offset"), F.coalesce("range_end", "region_end", F.length("sequence")).alias("limit"),
        F.when(F.col("range_start").isNotNull(), F.substring("sequence", F.col("range_start"), F.col("range_end") - F.col("range_start") + 1)).otherwise(F.col("sequence")).alias("sequence"),
    )
    own = F.get(F.element_at("attributes", "ID"), F.lit(0))
    checked = F.coalesce(own, F.raise_error(F.lit("a coding row has no ID")).cast("string"))
    cds = rows.where(F.col("type") == "CDS").join(placed.drop("sequence"), ["cluster_ord", "seqid"]).where("start >= offset AND end <= limit").withColumn("own_id", checked)
    based = merged_exons(cds).join(placed, ["cluster_ord", "seqid"]).withColumn("bases", extract(F.col("sequence"), F.col("exons"))).drop("sequence")
    merged = based.join(parent_genes(rows, cds), ["cluster_ord", "own_id"], "left")
    kept = merged.where("gene_start IS NULL OR (gene_start >= offset AND gene_end <= limit)")
    first = F.array_min(F.transform("exons", lambda e: e["start"]))
    last = F.array_max(F.transform("exons", lambda e: e["end"]))
    qualifiers = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), F.get(e["value"], F.lit(0)).alias("value")))
    strands = F.array_distinct(F.transform("exons", lambda e: e["strand"]))
    genes = kept.select(
        "cluster_ord", "locus_ord", F.row_number().over(Window.partitionBy("cluster_ord", "locus_ord").orderBy("island")).alias("gene_ord"),
        F.coalesce("gene_start", first + F.col("offset")).cast("int").alias("start"), F.coalesce("gene_end", last + F.col("offset")).cast("int").alias("end"),
        F.when(F.size(strands) == 1, strands[0]).alias("strand"), "exons", "bases", qualifiers.alias("qualifiers"),
    )
    about = spark.createDataFrame([(o, stem(p), p) for o, p in zip(ordinals, paths)], "cluster_ord int, cluster_name string, source_path string")
    loci = placed.join(F.broadcast(about), "cluster_ord").select("cluster_ord", "cluster_name", "source_path", "locus_ord", F.col("seqid").alias("record_id"), F.col("seqid").alias("name"), F.col("offset").cast("int").alias("start"), F.col("limit").cast("int").alias("end"))
    return loci, genes.withColumn("gene_ord", F.col("gene_ord") - 1)
