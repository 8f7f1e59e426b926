"""Driver queries over the sources and sessions: files are written from the standard tables, read by the library and held against SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import report, schemas
from ..operators import annotation
from ..operators.components import shared_dir
from ..session import Session
from ..sources import fasta, genbank, gff3, side_inputs
from .catalog import query, t

BASES_OF_HEX = ("0123456789abcdef", "ACGTACGTACGTACGT")


def text_file(lines: DataFrame, name: str) -> str:
    """One file of the column `value`, in the order of `place`, in the shared folder; returns its path."""
    spark = lines.sparkSession
    folder = shared_dir(spark, "files")
    lines.coalesce(1).sortWithinPartitions("place").select("value").write.text(f"{folder}/parts")
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(Path(f"{folder}/parts")) if s.getPath().getName().startswith("part-"))
    fs.rename(part, Path(f"{folder}/{name}"))
    return f"{folder}/{name}"


def bases(text: Column, times: Column | int) -> Column:
    return F.repeat(F.translate(F.md5(text.cast("binary")), *BASES_OF_HEX), times if isinstance(times, Column) else F.lit(times))


SQL_BASES = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
SQL_REVERSED = "reverse(translate({}, 'ACGT', 'TGCA'))"


def placed_text(text: Column) -> Column:
    """1,024 bases as a record's sequence lines, each behind its place."""
    return F.concat(*(F.concat(F.lit(f"{60 * i + 1:>9} "), F.substring(text, 60 * i + 1, 60), F.lit("\n")) for i in range(18)))


# GenBank: nations are records of 1,024 bases, suppliers their coding sequences; every third has a gene feature around it.

CODING = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name, 10 + (s_suppkey * 37) % 900 AS a FROM supplier),
    c AS (SELECT k, n, s_name, a, a + 29 AS b, a + 40 AS x, a + 69 AS y, k % 5 = 0 AS two, k % 2 = 0 AS minus FROM s),
    g AS (SELECT k, n, a - 5 AS a, (CASE WHEN two THEN y ELSE b END) + 5 AS b FROM c WHERE k % 3 = 0),
    """
GENBANK_SQL = (
    CODING
    + f"""o AS (SELECT k, row_number() OVER (PARTITION BY n ORDER BY k, kind DESC) - 1 AS feature_ord, kind FROM (SELECT k, n, 'cds' AS kind FROM c UNION ALL SELECT k, n, 'gene' FROM g)),
    m AS (SELECT c.k, min(g.k) AS p FROM c JOIN g ON g.n = c.n AND g.a <= c.a AND g.b >= CASE WHEN c.two THEN c.y ELSE c.b END GROUP BY c.k),
    r AS (SELECT n_nationkey AS n, 'N' || n_nationkey AS locus, repeat({SQL_BASES.format("n_name")}, 32) AS bases FROM nation),
    q AS (SELECT c.*, r.locus, substr(r.bases, c.a, 30) || CASE WHEN two THEN substr(r.bases, c.x, 30) ELSE '' END AS plus FROM c JOIN r USING (n))
    SELECT q.locus, q.s_name AS label, o.feature_ord AS gene_ord, coalesce(g.a, q.a) - 1 AS start, coalesce(g.b, CASE WHEN q.two THEN q.y ELSE q.b END) AS "end",
        CASE WHEN q.minus THEN -1 ELSE 1 END AS strand, CASE WHEN q.minus THEN {SQL_REVERSED.format("q.plus")} ELSE q.plus END AS sequence
    FROM q JOIN o ON o.k = q.k AND o.kind = 'cds' LEFT JOIN m ON m.k = q.k LEFT JOIN g ON g.k = m.p"""
)


def nation_records(spark: SparkSession, d: str) -> DataFrame:
    """RECORDS rows, read from a GenBank file of all nations."""
    k, a = F.col("s_suppkey"), F.col("a")
    two, last = k % 5 == 0, F.when(k % 5 == 0, a + 69).otherwise(a + 29)
    span = lambda x, y: F.concat(x.cast("string"), F.lit(".."), y.cast("string"))
    location = F.when(two, F.concat(F.lit("join("), span(a, a + 29), F.lit(","), span(a + 40, a + 69), F.lit(")"))).otherwise(span(a, a + 29))
    location = F.when(k % 2 == 0, F.concat(F.lit("complement("), location, F.lit(")"))).otherwise(location)
    gene = F.when(k % 3 == 0, F.concat(F.lit("     gene            "), span(a - 5, last + 5), F.lit("\n"))).otherwise("")
    own = F.concat(gene, F.lit("     CDS             "), location, F.lit('\n                     /protein_id="'), F.col("s_name"), F.lit('"\n'))
    suppliers = t(spark, d, "supplier").withColumn("a", 10 + (k * 37) % 900)
    features = suppliers.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), own.alias("own")))), lambda x: x["own"]), "").alias("features"))
    name = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    head = F.concat(F.lit("LOCUS       "), name, F.lit("  1024 bp    DNA     linear   UNK 01-JAN-2020\nACCESSION   "), name, F.lit("\nVERSION     "), name, F.lit(".1\nFEATURES             Location/Qualifiers\n"))
    text = F.concat(head, F.coalesce("features", F.lit("")), F.lit("ORIGIN\n"), placed_text(bases(F.col("n_name"), 32)), F.lit("//"))
    path = text_file(t(spark, d, "nation").join(features, "n_nationkey", "left").select(F.col("n_nationkey").alias("place"), text.alias("value")), "nations.gbk")
    return genbank.read_genbank(spark, [path])


def genes_of(tables: dict[str, DataFrame]) -> DataFrame:
    loci = tables["loci"].select("locus_id", F.col("name").alias("locus"))
    return tables["genes"].join(loci, "locus_id").select("locus", "label", "gene_ord", "start", "end", "strand", "sequence")


@query("genbank_genes", GENBANK_SQL)
def genbank_genes(spark: SparkSession, d: str) -> DataFrame:
    return genes_of(annotation.tables_of_records(nation_records(spark, d)))


@query(
    "genbank_ranges",
    CODING
    + """r AS (SELECT n_nationkey AS n, 100 + n_nationkey AS low, 700 + n_nationkey AS high FROM nation),
    i AS (SELECT c.*, CASE WHEN two THEN y ELSE b END AS e FROM c JOIN r USING (n) WHERE a - 1 >= low AND CASE WHEN two THEN y ELSE b END <= high),
    h AS (SELECT g.* FROM g JOIN r USING (n) WHERE g.a - 1 >= low AND g.b <= high),
    m AS (SELECT i.k, min(h.k) AS p FROM i JOIN h ON h.n = i.n AND h.a <= i.a AND h.b >= i.e GROUP BY i.k)
    SELECT 'N' || i.n AS locus, i.s_name AS label, r.low AS locus_start, r.high AS locus_end, coalesce(h.a, i.a) - 1 AS start, coalesce(h.b, i.e) AS "end"
    FROM i JOIN r USING (n) LEFT JOIN m ON m.k = i.k LEFT JOIN h ON h.k = m.p""",
)
def genbank_ranges(spark: SparkSession, d: str) -> DataFrame:
    keys = [r[0] for r in t(spark, d, "nation").select("n_nationkey").collect()]  # ranges are options of the user's
    ranges = side_inputs.parse_ranges(f"N{k}.1:{100 + k}-{700 + k}" for k in keys)
    tables = annotation.tables_of_records(nation_records(spark, d), ranges)
    loci = tables["loci"].select("locus_id", F.col("name").alias("locus"), F.col("start").alias("locus_start"), F.col("end").alias("locus_end"))
    return tables["genes"].join(loci, "locus_id").select("locus", "label", "locus_start", "locus_end", "start", "end")


@query(
    "record_clusters",
    "SELECT 'nationsN' || n_nationkey || '.1' AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS cluster_ord, 0 AS locus_ord, 0 AS start, 1024 AS \"end\" FROM nation",
)
def record_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each record of the file as a cluster of its own."""
    tables = annotation.tables_of_records(nation_records(spark, d), as_separate_clusters=True)
    return tables["clusters"].join(tables["loci"].drop("name"), "cluster_id").select("name", "cluster_ord", "locus_ord", "start", "end")


# GFF: nations are sequences, suppliers their coding features of two parts, with an mRNA and a gene for three of four.

GFF_SQL = f"""WITH c AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name, 100 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) + 1 AS a, count(*) OVER (PARTITION BY s_nationkey) AS many FROM supplier),
    r AS (SELECT c.*, k % 4 <> 0 AS parented, CASE WHEN n % 2 = 1 THEN 250 ELSE 1000000000 END AS high, repeat({SQL_BASES.format("n_name")}, CAST(4 * many + 4 AS INTEGER)) AS bases FROM c JOIN nation ON n_nationkey = n),
    q AS (SELECT *, a + 79 <= high AS both_parts, substr(bases, a + 10, 30) || CASE WHEN a + 79 <= high THEN substr(bases, a + 50, 30) ELSE '' END AS plus FROM r WHERE a + 39 <= high AND (NOT parented OR a + 89 <= high))
    SELECT 'N' || n AS locus, s_name AS label, row_number() OVER (PARTITION BY n ORDER BY a) - 1 AS gene_ord, CASE WHEN parented THEN a ELSE a + 9 END AS start,
        CASE WHEN parented THEN a + 89 WHEN both_parts THEN a + 79 ELSE a + 39 END AS "end", CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END AS strand,
        CASE WHEN k % 2 = 0 THEN {SQL_REVERSED.format("plus")} ELSE plus END AS sequence FROM q"""


@query("gff_genes", GFF_SQL)
def gff_genes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k, a, nation = F.col("s_suppkey"), F.col("a"), Window.partitionBy("s_nationkey")
    rows = t(spark, d, "supplier").withColumn("a", 100 * (F.row_number().over(nation.orderBy("s_suppkey")) - 1) + 1)
    strand, parented = F.when(k % 2 == 0, "-").otherwise("+"), k % 4 != 0

    def line(kind: str, low: int, high: int, about: Column) -> Column:
        return F.concat_ws("\t", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.lit("."), F.lit(kind), (a + low).cast("string"), (a + high).cast("string"), F.lit("."), strand, F.lit("0"), about)

    name = F.concat(F.lit("ID="), F.col("s_name"))
    gene = F.concat(line("gene", 0, 89, F.concat(F.lit("ID=g"), k.cast("string"))), F.lit("\n"), line("mRNA", 0, 89, F.concat(F.lit("ID=m"), k.cast("string"), F.lit(";Parent=g"), k.cast("string"))), F.lit("\n"))
    about = F.concat(name, F.lit(";protein_id="), F.col("s_name"), F.when(parented, F.concat(F.lit(";Parent=m"), k.cast("string"))).otherwise(""))
    value = F.concat(F.when(parented, gene).otherwise(""), line("CDS", 10, 39, about), F.lit("\n"), line("CDS", 50, 79, about))
    nations = t(spark, d, "nation")
    head = nations.where("n_nationkey % 2 = 1").select(F.lit(0).alias("place"), F.concat(F.lit("##sequence-region N"), F.col("n_nationkey").cast("string"), F.lit(" 1 250")).alias("value"))
    path = text_file(head.unionByName(rows.select((k + 1).alias("place"), value.alias("value"))), "nations.gff3")
    many = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("int").alias("many"))
    entry = F.concat(F.lit(">N"), F.col("n_nationkey").cast("string"), F.lit(" made\n"), bases(F.col("n_name"), 4 * F.coalesce("many", F.lit(0)) + 4))
    made = text_file(nations.join(many, "n_nationkey", "left").select(F.col("n_nationkey").alias("place"), entry.alias("value")), "nations.fa")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs_path(made).getFileSystem(spark._jsc.hadoopConfiguration()).rename(fs_path(made), fs_path(path[: -len(".gff3")] + ".fa"))
    return genes_of(annotation.tables_of_gff(*gff3.read_gff(spark, [path])))


@query("fasta_rows", f"SELECT CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS ord, repeat({SQL_BASES.format('p_name')}, 3) AS sequence FROM part")
def fasta_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of two lines each."""
    made = bases(F.col("p_name"), 3)
    entry = F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_name"), F.lit("\n"), F.substring(made, 1, 60), F.lit("\n"), F.substring(made, 61, 36))
    path = text_file(t(spark, d, "part").select(F.col("p_partkey").alias("place"), entry.alias("value")), "parts.fasta")
    return fasta.read_fasta(spark, [path]).select("id", "ord", "sequence")


# Side inputs.


@query(
    "functions_csv",
    """SELECT p_type AS function, min(n) AS function_ord, string_agg(p_partkey, '|' ORDER BY p_partkey) AS genes FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) GROUP BY p_type""",
)
def functions_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("place"), F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), F.col("p_type"), F.lit('"')).alias("value"))
    return side_inputs.read_functions(spark, text_file(rows, "functions.csv")).select("function", "function_ord", F.array_join("genes", "|").alias("genes"))


@query("colours_csv", "SELECT CAST(user_id AS VARCHAR) AS function, arg_max(event_type, event_id) AS colour FROM events GROUP BY user_id")
def colours_csv(spark: SparkSession, d: str) -> DataFrame:
    """The last line of a function counts."""
    rows = t(spark, d, "events").select(F.col("event_id").alias("place"), F.concat_ws(",", F.col("user_id").cast("string"), "event_type").alias("value"))
    return side_inputs.read_colours(spark, text_file(rows, "colours.csv")).select("function", "colour")


# Sessions.


def nation_session(spark: SparkSession, d: str) -> Session:
    """Regions as clusters of one locus each, nations as genes."""
    region, nation = t(spark, d, "region"), t(spark, d, "nation")
    place = F.col("r_regionkey").cast("string")
    clusters = region.select(place.alias("cluster_id"), F.col("r_regionkey").alias("cluster_ord"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("source_path"))
    loci = region.select(place.alias("locus_id"), place.alias("cluster_id"), F.lit(0).alias("locus_ord"), F.col("r_name").alias("name"), F.lit(0).alias("start"), F.lit(1024).alias("end"))
    owner = F.col("n_regionkey").cast("string")
    genes = nation.select(
        F.col("n_nationkey").cast("string").alias("gene_id"), owner.alias("locus_id"), owner.alias("cluster_id"), F.col("n_nationkey").alias("gene_ord"), F.col("n_name").alias("label"),
        F.create_map(F.lit("protein_id"), "n_name").alias("names"), F.col("n_nationkey").alias("start"), (F.col("n_nationkey") + 30).alias("end"), F.lit(None).cast("tinyint").alias("strand"), F.lit("").alias("sequence"), F.lit(None).cast("string").alias("translation"),
    )
    session = Session(spark)
    session.add_clusters({"clusters": clusters, "loci": loci, "genes": genes})
    return session


@query("session_roundtrip", 'SELECT r_regionkey, r_name, n_nationkey, n_name, n_nationkey AS start, CAST(NULL AS VARCHAR) AS translation FROM region JOIN nation ON n_regionkey = r_regionkey')
def session_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A session's exchange text read back, then its tables written and read; nulls are kept."""
    back = Session.from_dict(spark, json.loads(json.dumps(nation_session(spark, d).to_dict())))
    folder = shared_dir(spark, "session")
    back.write_parquet(folder)
    stored = Session.read_parquet(spark, folder)
    clusters = stored.clusters.select("cluster_id", F.col("name").alias("r_name"))
    return stored.genes.join(clusters, "cluster_id").select(F.col("cluster_id").cast("int").alias("r_regionkey"), "r_name", F.col("gene_id").cast("int").alias("n_nationkey"), F.element_at("names", "protein_id").alias("n_name"), "start", "translation")


@query(
    "append_clusters",
    "SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation UNION ALL SELECT r_name, (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_regionkey) - 1 FROM region",
)
def append_clusters(spark: SparkSession, d: str) -> DataFrame:
    none = {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("loci", "genes")}
    session = Session(spark)
    for table, c in (("nation", "n"), ("region", "r")):
        found = t(spark, d, table).select(F.col(f"{c}_name").alias("cluster_id"), F.col(f"{c}_{table}key").alias("o"), F.col(f"{c}_name").alias("name"), F.lit(None).cast("string").alias("source_path"))
        session.add_clusters({"clusters": annotation.numbered_clusters(found), **none})
    return session.clusters.select("name", F.col("cluster_ord").alias("place"))


@query("file_order", "SELECT n_name, row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS display_ord FROM nation")
def file_order(spark: SparkSession, d: str) -> DataFrame:
    """Clusters get their numbers by the order that is asked for."""
    found = t(spark, d, "nation").select(F.col("n_name").alias("cluster_id"), (-F.col("n_nationkey")).alias("o"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("source_path"))
    return annotation.numbered_clusters(found).select(F.col("name").alias("n_name"), F.col("cluster_ord").alias("display_ord"))


@query(
    "alignment_blocks",
    """WITH r AS (SELECT x.r_regionkey AS i, y.r_regionkey AS j, x.r_name || ' vs ' || y.r_name AS title FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey),
        l AS (SELECT i, j, string_agg(a.n_name || ',' || b.n_name || ',' || printf('%.4f', (a.n_nationkey + b.n_nationkey) / 50.0) || ',' || printf('%.4f', (a.n_nationkey * 7 % 25) / 25.0), chr(10) ORDER BY a.n_nationkey * 100 + b.n_nationkey) AS body
              FROM r JOIN nation a ON a.n_regionkey = i JOIN nation b ON b.n_regionkey = j GROUP BY i, j)
        SELECT i * 100 + j AS alignment_ord, title || chr(10) || repeat('-', length(title)) || chr(10) || 'Query,Target,Identity,Similarity' || coalesce(chr(10) || body, '') AS block FROM r LEFT JOIN l USING (i, j)""",
)
def alignment_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of a report over regions as clusters and nations as genes, each linked to those of later regions."""
    session = nation_session(spark, d)
    cluster = lambda side: session.clusters.select(F.col("cluster_id").alias(f"{side}_cluster_id"), F.col("cluster_ord").alias(f"{side}_ord"))
    pairs = cluster("query").join(cluster("target"), F.col("query_ord") < F.col("target_ord"))
    identity = F.concat_ws("-", "query_cluster_id", "target_cluster_id")
    alignments = pairs.select(identity.alias("alignment_id"), (F.col("query_ord") * 100 + F.col("target_ord")).cast("long").alias("alignment_ord"), "query_cluster_id", "target_cluster_id")
    gene = lambda side: session.genes.select(F.col("cluster_id").alias(f"{side}_cluster_id"), F.col("gene_id").alias(f"{side}_gene_id"), F.col("gene_ord").alias(side))
    met = alignments.join(gene("query"), "query_cluster_id").join(gene("target"), "target_cluster_id")
    links = met.select(
        F.concat_ws("-", "query_gene_id", "target_gene_id").alias("link_id"), "alignment_id", (F.col("query") * 100 + F.col("target")).alias("link_ord"), "query_gene_id", "target_gene_id",
        ((F.col("query") + F.col("target")) / 50.0).alias("identity"), (F.col("query") * 7 % 25 / 25.0).alias("similarity"),
    )
    session.put_alignments(alignments, links)
    return report.format_alignments(session, delimiter=",")
