"""Driver queries: every operator on the standard tables, with equivalent DuckDB SQL where there is one.

Domain mapping: nations and customers stand for clusters, orders for loci, lineitems for genes. (l_orderkey,
l_linenumber) is not unique there, so rows are told apart by all their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import groups, intervals, lookups, ordering, similarity_join, synteny
from ..operators.alignment import AlignConfig, align_pairs
from ..operators.components import connected_components
from .. import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Filters, predicates and projections.


@query(
    "file_feature_filter",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_returnflag = 'R' AND l_linenumber >= 2 AND l_linenumber + l_quantity <= 20""",
)
def file_feature_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") + F.col("l_quantity")).alias("stop"))
    return intervals.within(rows, 2, 20, "l_linenumber", "stop").drop("stop")


@query(
    "label_coalesce",
    """SELECT event_id, coalesce(nullif(coalesce(json_extract_string(props, '$.x'), json_extract_string(props, '$.k')), ''), CAST(event_id AS VARCHAR)) AS label FROM events""",
)
def label_coalesce(spark: SparkSession, d: str) -> DataFrame:
    names = F.from_json("props", "map<string,string>")
    return t(spark, d, "events").select("event_id", C.label(names, F.col("event_id").cast("string"), ("x", "k")).alias("label"))


@query(
    "qualifier_submap",
    """SELECT event_id, CAST(CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_kept, json_extract_string(props, '$.k') AS k FROM events""",
)
def qualifier_submap(spark: SparkSession, d: str) -> DataFrame:
    kept = C.submap(F.from_json("props", "map<string,string>"), ["K", "unknown"])
    return t(spark, d, "events").select("event_id", F.size(kept).cast("long").alias("n_kept"), F.element_at(kept, "k").alias("k"))


@query(
    "circular_shift",
    """SELECT o_orderkey, ((o_orderkey - 7) % 1000 + 1000) % 1000 AS place FROM orders""",
)
def circular_shift(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", C.shifted(F.col("o_orderkey"), 7, 1000).alias("place"))


DNA_SQL = "upper(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'))"


def dna(text) -> "F.Column":
    """Letters a to z as the four bases in turn."""
    return F.upper(F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"))


@query("revcomp", f"SELECT item_id, reverse(translate({DNA_SQL}, 'ACGT', 'TGCA')) AS other_strand FROM benchmark")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select("item_id", C.reverse_complement(dna(F.col("text"))).alias("other_strand"))


@query(
    "extract_exons",
    f"SELECT item_id, reverse(translate(substr(s, 21, 10), 'ACGT', 'TGCA')) || reverse(translate(substr(s, 4, 7), 'ACGT', 'TGCA')) AS bases FROM (SELECT item_id, {DNA_SQL} AS s FROM benchmark)",
)
def extract_exons(spark: SparkSession, d: str) -> DataFrame:
    exon = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(-1).alias("strand"))
    return t(spark, d, "benchmark").select("item_id", C.extract(dna(F.col("text")), F.array(exon(20, 30), exon(3, 10))).alias("bases"))


@query(
    "codon_translate",
    f"""SELECT item_id, array_to_string(list_transform(range(0, length(s) // 3), lambda i: substr('{C.CODE}',
        CAST((strpos('TCAG', substr(s, CAST(3 * i + 1 AS BIGINT), 1)) - 1) * 16 + (strpos('TCAG', substr(s, CAST(3 * i + 2 AS BIGINT), 1)) - 1) * 4 + strpos('TCAG', substr(s, CAST(3 * i + 3 AS BIGINT), 1)) AS BIGINT), 1)), '') AS protein
        FROM (SELECT item_id, {DNA_SQL} AS s FROM benchmark)""",
)
def codon_translate(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select("item_id", C.translate_codons(dna(F.col("text"))).alias("protein"))


NAME_PAIRS = "(SELECT a.n_nationkey AS i, b.n_nationkey AS j, replace(a.n_name, '_', '') AS x, replace(b.n_name, '_', '') AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND length(a.n_name) = length(b.n_name))"
#: Similar letters, for SQL.
CLASS_SQL = "CASE " + " ".join(f"WHEN contains('{s}', {{0}}) THEN {i}" for i, s in enumerate(C.SIMILAR)) + " ELSE -1 END"
POSITIONAL_SQL = f"""SELECT i, j, len(list_filter(p, lambda k: x[k] = y[k])) / length(x) AS identity,
    len(list_filter(p, lambda k: x[k] = y[k] OR ({CLASS_SQL.format("x[k]")}) = ({CLASS_SQL.format("y[k]")}) AND ({CLASS_SQL.format("x[k]")}) >= 0)) / length(x) AS similarity
    FROM (SELECT *, range(1, length(x) + 1) AS p FROM {NAME_PAIRS})"""


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").select("n_nationkey", F.regexp_replace("n_name", "_", "").alias("name"))
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("name").alias("x")), n.select(F.col("n_nationkey").alias("j"), F.col("name").alias("y"))
    return a.join(b, (F.col("i") < F.col("j")) & (F.length("x") == F.length("y")))


@query("positional_identity", POSITIONAL_SQL)
def positional_identity(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("i", "j", C.aligned_identity(F.col("x"), F.col("y")).alias("s")).select("i", "j", "s.*")


@query("identity_filter", f"SELECT * FROM ({POSITIONAL_SQL}) WHERE identity >= 0.8")
def identity_filter(spark: SparkSession, d: str) -> DataFrame:
    return positional_identity(spark, d).where("identity >= 0.8")


# Joins.


@query(
    "interval_containment_first",
    """SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, min(p.p_partkey) AS parent_p_partkey
       FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey % 50 AS g FROM lineitem) l
       LEFT JOIN (SELECT p_partkey, p_partkey % 50 AS g, p_size FROM part) p ON p.g = l.g AND l.l_linenumber >= p.p_size / 10.0 AND l.l_quantity <= p.p_size + 10
       GROUP BY ALL""",
)
def interval_containment_first(spark: SparkSession, d: str) -> DataFrame:
    row = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    inner = t(spark, d, "lineitem").select(*row).distinct().withColumn("g", F.col("l_suppkey") % 50)
    outer = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("g"), (F.col("p_size") / 10.0).alias("l_linenumber"), (F.col("p_size") + 10).alias("l_quantity"))
    return intervals.first_containing(inner, outer, ["g"], row, "p_partkey", ["p_partkey"], "l_linenumber", "l_quantity", bin_width=2).drop("g")


@query("cluster_pairs", "SELECT a.n_nationkey AS query_ord, b.n_nationkey AS target_ord FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def cluster_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity_join.cluster_pairs(nation_clusters(spark, d)).select("query_ord", "target_ord")


def nation_clusters(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").select(F.col("n_name").alias("cluster_id"), F.col("n_nationkey").alias("cluster_ord"), F.col("n_name").alias("name"))


@query(
    "pairs_not_yet_aligned",
    """SELECT a.n_nationkey AS query_ord, b.n_nationkey AS target_ord FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
       WHERE NOT EXISTS (SELECT 1 FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey > y.n_nationkey
                         WHERE least(x.n_name, y.n_name) = least(a.n_name, b.n_name) AND greatest(x.n_name, y.n_name) = greatest(a.n_name, b.n_name))""",
)
def pairs_not_yet_aligned(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    x, y = n.select(F.col("n_name").alias("query_cluster_id"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k")), n.select(F.col("n_name").alias("target_cluster_id"), F.col("n_regionkey").alias("s"), F.col("n_nationkey").alias("m"))
    done = x.join(y, (F.col("r") == F.col("s")) & (F.col("k") > F.col("m")))
    return similarity_join.not_yet_aligned(similarity_join.cluster_pairs(nation_clusters(spark, d)), done).select("query_ord", "target_ord")


@query(
    "gene_cross_pairs",
    """SELECT a.s_suppkey AS query_key, b.s_suppkey AS target_key, row_number() OVER (PARTITION BY a.s_nationkey, b.s_nationkey ORDER BY a.s_suppkey, b.s_suppkey) - 1 AS link_ord
       FROM supplier a JOIN supplier b ON a.s_nationkey < b.s_nationkey""",
)
def gene_cross_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as genes of their nations."""
    nation = F.col("s_nationkey").cast("string")
    genes = t(spark, d, "supplier").select(F.col("s_suppkey").alias("gene_id"), nation.alias("cluster_id"), nation.alias("locus_id"), F.col("s_suppkey").alias("gene_ord"), F.lit("M").alias("translation"))
    clusters = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("cluster_id"), F.col("n_nationkey").alias("cluster_ord"))
    loci = clusters.select(F.col("cluster_id").alias("locus_id"), F.lit(0).alias("locus_ord"))
    met = similarity_join.gene_pairs(genes, loci, similarity_join.cluster_pairs(clusters), bounded=False)
    return met.select(F.col("query_gene_id").alias("query_key"), F.col("target_gene_id").alias("target_key"), similarity_join.link_ord("query_cluster_id", "target_cluster_id").cast("long").alias("link_ord"))


@query(
    "length_bound_prune",
    """SELECT a.item_id AS i, b.item_id AS j FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id AND trim(a.text) <> '' AND trim(b.text) <> ''
       AND least(length(trim(a.text)), length(trim(b.text))) / greatest(length(trim(a.text)), length(trim(b.text))) >= 0.7""",
)
def length_bound_prune(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the one gene of a cluster each."""
    item = F.col("item_id").cast("string")
    genes = t(spark, d, "benchmark").select(F.col("item_id").alias("gene_id"), item.alias("cluster_id"), item.alias("locus_id"), F.lit(0).alias("gene_ord"), F.col("text").alias("translation"))
    clusters = genes.select("cluster_id", F.col("gene_id").alias("cluster_ord"))
    loci = clusters.select(F.col("cluster_id").alias("locus_id"), F.lit(0).alias("locus_ord"))
    met = similarity_join.gene_pairs(genes, loci, similarity_join.cluster_pairs(clusters), cutoff=0.7)
    return met.select(F.col("query_gene_id").alias("i"), F.col("target_gene_id").alias("j"))


@query("global_align")
def global_align(spark: SparkSession, d: str) -> DataFrame:
    """Alignment of the benchmark texts' letters, all pairs that the length bound allows. Tests hold the kernel against a scalar one."""
    b = t(spark, d, "benchmark").select("item_id", F.regexp_replace(F.upper("text"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("s")).where("s <> ''")
    x, y = b.select(F.col("item_id").alias("i"), F.col("s").alias("sequence_a")), b.select(F.col("item_id").alias("j"), F.col("s").alias("sequence_b"))
    n, m = F.length("sequence_a"), F.length("sequence_b")
    pairs = x.join(y, (F.col("i") < F.col("j")) & (F.least(n, m) / F.greatest(n, m) >= 0.3))
    dealt = pairs.repartition(max(8, spark.sparkContext.defaultParallelism), F.xxhash64("i", "j"))
    return align_pairs(dealt, AlignConfig(), cutoff=0.3).select("i", "j", "score", F.round("identity", 9).alias("identity"), F.round("similarity", 9).alias("similarity"), "columns")


EDIT_SQL = """SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(-levenshtein(a.n_name, b.n_name) AS DOUBLE) AS score FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"""


@query("align_edit_score", EDIT_SQL)
def align_edit_score(spark: SparkSession, d: str) -> DataFrame:
    """The kernel with match 0, mismatch -1 and gap -1 is the edit distance turned negative."""
    n = t(spark, d, "nation").select("n_nationkey", F.translate("n_name", "_0123456789", "WACDEFGHIKL").alias("s"))
    x, y = n.select(F.col("n_nationkey").alias("i"), F.col("s").alias("sequence_a")), n.select(F.col("n_nationkey").alias("j"), F.col("s").alias("sequence_b"))
    config = AlignConfig(match_score=0.0, mismatch_score=-1.0, open_gap_score=-1.0, extend_gap_score=-1.0)
    return align_pairs(x.join(y, F.col("i") < F.col("j")).withColumn("sequence_a", F.upper(F.translate("sequence_a", "OU", "MP"))).withColumn("sequence_b", F.upper(F.translate("sequence_b", "OU", "MP"))), config).select("i", "j", "score")


@query(
    "lookup_any_value",
    """SELECT c_custkey, min(e.event_id) AS gene_id FROM customer JOIN (SELECT event_id, unnest([event_type, CAST(user_id AS VARCHAR)]) AS value FROM events) e ON e.value = CAST(c_custkey AS VARCHAR) GROUP BY c_custkey""",
)
def lookup_any_value(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    genes = t(spark, d, "events").select(F.col("event_id").alias("gene_id"), names.alias("names"), F.col("event_id").alias("place"))
    wanted = t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("value"))
    return lookups.genes_by_value(genes, wanted).select("c_custkey", "gene_id")


@query("locus_text", "SELECT n_nationkey, n_name || ':' || CAST(n_regionkey AS VARCHAR) || '-' || CAST(n_nationkey + 100 AS VARCHAR) AS locus FROM nation")
def locus_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").select("n_nationkey", lookups.locus_text("n_name", "n_regionkey", F.col("n_nationkey") + 100).alias("locus"))


@query("gene_by_label", "SELECT min(event_id) AS gene_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) HAVING count(*) > 0")
def gene_by_label(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    genes = e.select(F.col("event_id").alias("gene_id"), F.col("event_type").alias("label"), F.col("event_id").alias("place"))
    first = e.agg(F.min("event_type").alias("m")).first()["m"]
    return lookups.gene_by_label(genes, first).select("gene_id")


@query(
    "alignment_lookup",
    """SELECT o_orderkey FROM orders WHERE least(o_orderstatus, left(o_orderpriority, 1)) = '1' AND greatest(o_orderstatus, left(o_orderpriority, 1)) = 'O'""",
)
def alignment_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("query_cluster_id"), F.substring("o_orderpriority", 1, 1).alias("target_cluster_id"))
    return lookups.alignment_between(rows, "1", "O").select("o_orderkey")


@query("membership", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey OR l_partkey = o_orderkey)")
def membership(spark: SparkSession, d: str) -> DataFrame:
    links = t(spark, d, "lineitem").select(F.lit(0).alias("alignment_id"), F.col("l_orderkey").alias("query_gene_id"), F.col("l_partkey").alias("target_gene_id"))
    return t(spark, d, "orders").join(lookups.members(links), F.col("o_orderkey") == F.col("gene_id"), "left_semi").select("o_orderkey")


@query(
    "upsert_alignment",
    """WITH new AS (SELECT o_orderkey + 5 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 = 0)
       SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new""",
)
def upsert_alignment(spark: SparkSession, d: str) -> DataFrame:
    old = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return similarity_join.upsert(old, old.where("o_orderkey % 7 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 5), ["o_orderkey"])


# Aggregations and graphs.


@query(
    "link_sum_avg",
    "SELECT o_orderkey, round(coalesce(sum(l_discount), 0), 6) AS cumulative, round(avg(l_discount), 6) AS mean FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
)
def link_sum_avg(spark: SparkSession, d: str) -> DataFrame:
    links = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("alignment_id"), F.col("l_discount").alias("identity"))
    alignments = t(spark, d, "orders").select(F.col("o_orderkey").alias("alignment_id"))
    return synteny.link_sums(links, alignments).select(F.col("alignment_id").alias("o_orderkey"), F.round("cumulative", 6).alias("cumulative"), F.round("mean", 6).alias("mean"))


EDGES = "SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem WHERE l_quantity >= 50 AND l_discount = 0.05"


def edges(spark: SparkSession, d: str, rows: str = "l_quantity >= 50 AND l_discount = 0.05") -> DataFrame:
    return t(spark, d, "lineitem").where(rows).select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b")).distinct()


@query(
    "components",
    f"""WITH RECURSIVE e AS ({EDGES}), both_ways AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
        reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
        SELECT x AS node, min(y) AS component FROM reach GROUP BY x""",
)
def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(edges(spark, d))


@query("components_all")
def components_all(spark: SparkSession, d: str) -> DataFrame:
    """The edges of all of lineitem, for which recursive SQL is too slow. Tests hold it against a union-find."""
    return connected_components(edges(spark, d, "true"))


@query(
    "function_groups",
    f"""WITH RECURSIVE e AS ({EDGES}), f AS (SELECT DISTINCT a AS gene, -1 - a % 5 AS fn FROM e),
        both_ways AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e UNION SELECT gene, fn FROM f UNION SELECT fn, gene FROM f),
        reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
        g AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
        SELECT CAST(x AS VARCHAR) AS gene_id, 'F' || CAST((SELECT min(-1 - y.x) FROM g y WHERE y.root = g.root AND y.x < 0) AS VARCHAR) AS label FROM g WHERE x >= 0""",
)
def function_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every function gene has an edge here, so that the documented rule is the closure over edges and functions."""
    return grouped(edges(spark, d))


@query("function_groups_all")
def function_groups_all(spark: SparkSession, d: str) -> DataFrame:
    """The edges of all of lineitem. Tests hold it against a union-find."""
    return grouped(edges(spark, d, "true"))


def grouped(e: DataFrame) -> DataFrame:
    links = e.select(F.col("a").cast("string").alias("query_gene_id"), F.col("b").cast("string").alias("target_gene_id"), F.struct("a", "b").alias("place"))
    functions = e.select((F.col("a") % 5).alias("function_ord"), F.concat(F.lit("F"), (F.col("a") % 5).cast("string")).alias("function"), F.col("a").cast("string").alias("gene_id")).distinct()
    found, members = groups.build_groups(links, functions)
    return members.join(found, "group_id").select("gene_id", "label")


@query("greedy_groups")
def greedy_groups(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    links = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("alignment_id"), F.row_number().over(order).alias("link_ord"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("query_gene_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_gene_id"), (F.col("l_tax") * 10).alias("identity"))
    return groups.greedy_groups(links)


@query(
    "multiset_intersection",
    """WITH p AS (SELECT user_id, event_type AS l, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
            c AS (SELECT user_id, l, r, count(*) AS n FROM p WHERE r IS NOT NULL GROUP BY ALL)
       SELECT a.user_id AS user_id, CAST(sum(least(a.n, b.n)) AS BIGINT) AS contiguity FROM c a JOIN c b ON b.user_id = a.user_id + 1 AND a.l = b.l AND a.r = b.r GROUP BY a.user_id""",
)
def multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    pairs = user_pairs(spark, d)
    return synteny.shared_pairs(pairs, pairs.withColumn("user_id", F.col("user_id") - 1), ["user_id"]).select("user_id", "contiguity")


def user_pairs(spark: SparkSession, d: str) -> DataFrame:
    return synteny.contiguous_pairs(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "synteny_score",
    """WITH p AS (SELECT user_id, event_type AS l, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
            c AS (SELECT user_id, l, r, count(*) AS n FROM p WHERE r IS NOT NULL GROUP BY ALL),
            k AS (SELECT a.user_id, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON b.user_id = a.user_id + 1 AND a.l = b.l AND a.r = b.r GROUP BY a.user_id),
            h AS (SELECT user_id, sum(value) AS s FROM events GROUP BY user_id)
       SELECT h.user_id, round(h.s + 0.5 * coalesce(k.n, 0), 4) AS score FROM h LEFT JOIN k ON k.user_id = h.user_id""",
)
def synteny_score(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    sums = synteny.link_sums(e.select(F.col("user_id").alias("alignment_id"), F.col("value").alias("identity")), e.select(F.col("user_id").alias("alignment_id")).distinct())
    shared = multiset_intersection(spark, d).withColumnRenamed("user_id", "alignment_id")
    return synteny.weighted(sums, shared, 0.5).select(F.col("alignment_id").alias("user_id"), F.round("score", 4).alias("score"))


REGION_SCORES = """SELECT x.n_regionkey AS a, y.n_regionkey AS b, sum(CAST(round(s_acctbal * 100) AS BIGINT)) / 100000.0 AS score
    FROM nation x JOIN nation y ON x.n_regionkey < y.n_regionkey JOIN supplier ON s_nationkey = x.n_nationkey AND s_suppkey % 25 = y.n_nationkey GROUP BY ALL"""


def region_clusters(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "region").select(F.col("r_name").alias("cluster_id"), F.col("r_regionkey").alias("cluster_ord"), F.col("r_name").alias("name"))


def region_scores(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = n.select(F.col("n_nationkey").alias("xk"), F.col("n_regionkey").alias("xr"), F.col("r_name").alias("query_cluster_id"))
    y = n.select(F.col("n_nationkey").alias("yk"), F.col("n_regionkey").alias("yr"), F.col("r_name").alias("target_cluster_id"))
    s = t(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 25).alias("other"), F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"))
    met = s.join(x, F.col("s_nationkey") == F.col("xk")).join(y, F.col("other") == F.col("yk")).where("xr < yr")
    some = met.groupBy("query_cluster_id", "target_cluster_id").agg((F.sum("cents") / 100000.0).alias("score"))
    pairs = similarity_join.cluster_pairs(region_clusters(spark, d)).select("query_cluster_id", "target_cluster_id")
    return pairs.join(some, ["query_cluster_id", "target_cluster_id"], "left").select("query_cluster_id", "target_cluster_id", F.coalesce("score", F.lit(0.0)).alias("score"))


MATRIX_SQL = f"""WITH s AS (SELECT x.r_regionkey AS a, y.r_regionkey AS b, coalesce(z.score, 0.0) AS score FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey
      LEFT JOIN ({REGION_SCORES}) z ON z.a = x.r_regionkey AND z.b = y.r_regionkey),
    top AS (SELECT max(score) AS top FROM s),
    grid AS (SELECT x.r_regionkey AS i, y.r_regionkey AS j, CASE WHEN x.r_regionkey = y.r_regionkey THEN 0.0 ELSE s.score END AS value, top.top
      FROM region x CROSS JOIN region y CROSS JOIN top LEFT JOIN s ON s.a = least(x.r_regionkey, y.r_regionkey) AND s.b = greatest(x.r_regionkey, y.r_regionkey))"""


@query("score_matrix", MATRIX_SQL + " SELECT i, j, round(value, 6) AS value FROM grid")
def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    return synteny.score_matrix(region_clusters(spark, d), region_scores(spark, d)).select("i", "j", F.round("value", 6).alias("value"))


@query("matrix_distance", MATRIX_SQL + " SELECT i, j, round(CASE WHEN i = j THEN 0.0 WHEN top > 0 THEN 1 - value / top ELSE top - value END, 6) AS value FROM grid")
def matrix_distance(spark: SparkSession, d: str) -> DataFrame:
    return synteny.score_matrix(region_clusters(spark, d), region_scores(spark, d), True, True).select("i", "j", F.round("value", 6).alias("value"))


@query("cluster_order")
def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    places = ordering.cluster_order(synteny.score_matrix(region_clusters(spark, d), region_scores(spark, d), True, True), region_clusters(spark, d).count())
    return spark.createDataFrame(list(enumerate(places)), "display_ord int, cluster_ord int")


# Windows and sets.


@query(
    "island_merge",
    """WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            i AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
       SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY user_id, island""",
)
def island_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals.islands(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(
    "contiguous_pairs",
    """SELECT user_id, "left", "right", count(*) AS n FROM (SELECT user_id, event_type AS "left", lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "right" FROM events) WHERE "right" IS NOT NULL GROUP BY ALL""",
)
def contiguous_pairs(spark: SparkSession, d: str) -> DataFrame:
    return user_pairs(spark, d).groupBy("user_id", "left", "right").agg(F.count(F.lit(1)).alias("n"))


@query(
    "best_links",
    """SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 10
       ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem) WHERE n = 1""",
)
def best_links(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    links = rows.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice", F.col("l_orderkey").alias("query_gene_id"), F.col("l_suppkey").alias("target_gene_id"), F.col("l_discount").alias("identity"), order.alias("link_ord"), F.lit(0).alias("link_id"))
    genes = rows.select(F.col("l_suppkey").alias("gene_id"), (F.col("l_suppkey") % 10).alias("cluster_id")).distinct()
    return similarity_join.best_links(links, genes).select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query("distinct_label_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def distinct_label_keys(spark: SparkSession, d: str) -> DataFrame:
    return lookups.label_keys(t(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("names")))


@query("relabel", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), event_type) AS label FROM events")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    genes = t(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("names"), F.col("event_type").alias("label"))
    return lookups.relabelled(genes, "k").select("event_id", "label")


@query("set_difference", "SELECT DISTINCT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(t(spark, d, "lineitem").where("l_quantity > 49 AND l_discount > 0.05").select("l_partkey"))


# Reports and sessions.

REPORT_SQL = """SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_name AS query, b.n_name AS target, printf('%.2f', (a.n_nationkey + b.n_nationkey) / 49.0) AS identity, printf('%.2f', (a.n_nationkey * 7 % 25) / 24.0) AS similarity
    FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"""


def report_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    a, b = n.select(F.col("n_nationkey").alias("alignment_id"), F.col("n_name").alias("query_gene_id")), n.select(F.col("n_nationkey").alias("link_ord"), F.col("n_name").alias("target_gene_id"))
    links = a.join(b, F.col("alignment_id") < F.col("link_ord")).withColumn("identity", (F.col("alignment_id") + F.col("link_ord")) / 49.0).withColumn("similarity", (F.col("alignment_id") * 7 % 25) / 24.0)
    return links, n.select(F.col("n_name").alias("gene_id"), F.col("n_name").alias("label"))


@query("report_rows", REPORT_SQL)
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.link_rows(*report_links(spark, d), 2).withColumnRenamed("alignment_id", "i").withColumnRenamed("link_ord", "j")


@query(
    "report_padded",
    f"""WITH r AS ({REPORT_SQL}), w AS (SELECT i, greatest(5, max(length(query))) AS q, greatest(6, max(length(target))) AS t FROM r GROUP BY i),
        b AS (SELECT i, string_agg(rpad(query, CAST(q AS INTEGER), ' ') || '  ' || rpad(target, CAST(t AS INTEGER), ' ') || '  ' || rpad(identity, 8, ' ') || '  ' || rpad(similarity, 10, ' '), chr(10) ORDER BY j) AS body FROM r JOIN w USING (i) GROUP BY i)
        SELECT i, rpad('Query', CAST(q AS INTEGER), ' ') || '  ' || rpad('Target', CAST(t AS INTEGER), ' ') || '  Identity  Similarity' || chr(10) || body AS body FROM b JOIN w USING (i)""",
)
def report_padded(spark: SparkSession, d: str) -> DataFrame:
    return report.format_links(report.link_rows(*report_links(spark, d), 2), headers=True).withColumnRenamed("alignment_id", "i")


@query("similarity_links")
def similarity_links(spark: SparkSession, d: str) -> DataFrame:
    """The whole gene similarity join: nations' regions as clusters, benchmark texts as genes."""
    b = t(spark, d, "benchmark").select("item_id", F.regexp_replace(F.upper("text"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("translation"))
    genes = b.select(F.col("item_id").cast("string").alias("gene_id"), (F.col("item_id") % 5).cast("string").alias("locus_id"), (F.col("item_id") % 5).cast("string").alias("cluster_id"), F.col("item_id").cast("int").alias("gene_ord"), "translation")
    clusters = genes.select("cluster_id", F.col("cluster_id").cast("int").alias("cluster_ord")).distinct()
    loci = clusters.select(F.col("cluster_id").alias("locus_id"), F.lit(0).alias("locus_ord"))
    return similarity_join.similarity_links(genes, loci, similarity_join.cluster_pairs(clusters)).select("query_gene_id", "target_gene_id", "link_ord", F.round("identity", 9).alias("identity"), F.round("similarity", 9).alias("similarity"))


from . import source_catalog  # noqa: E402,F401 - registers the queries over files and sessions
