"""A session: the tables of one comparison, and what can be done with them."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import columns as C
from .operators import annotation, groups, lookups, ordering, similarity_join, synteny
from .operators.alignment import AlignConfig
from .operators.components import written
from .sources import discovery
from .sources.genbank import read_genbank
from .sources.gff3 import read_gff

LOG = logging.getLogger(__name__)


def parse_files(spark: SparkSession, paths: list[str], ranges: dict[str, tuple[int, int]] | None = None, set_origin: bool = True, as_separate_clusters: bool = False) -> dict[str, DataFrame]:
    """clusters, loci and genes of annotation files, in the order of paths. TypeError for a file of another kind."""
    genbank, gff = [], []
    for i, p in enumerate(paths):
        ending = discovery.suffix(p).lower()
        if ending in discovery.GENBANK_SUFFIXES:
            genbank.append((i, p))
        elif ending in discovery.GFF_SUFFIXES:
            gff.append((i, p))
        else:
            raise TypeError(f"{p} is neither GenBank nor GFF")
    found = []
    if genbank:
        found.append(annotation.tables_of_records(read_genbank(spark, [p for _, p in genbank], [i for i, _ in genbank]), ranges, set_origin, as_separate_clusters))
    if gff:
        found.append(annotation.tables_of_gff(*read_gff(spark, [p for _, p in gff], [i for i, _ in gff], ranges)))
    if not found:
        return {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("clusters", "loci", "genes")}
    out = found[0]
    for more in found[1:]:
        out = {n: out[n].unionByName(more[n]) for n in out}
    # Each reader numbers its own clusters; the files' order is that of paths.
    place = spark.createDataFrame(list(enumerate(paths)), "file_ord int, source_path string").groupBy("source_path").agg(F.min("file_ord").alias("file_ord"))
    out["clusters"] = annotation.numbered_clusters(out["clusters"].join(F.broadcast(place), "source_path").select("cluster_id", F.struct("file_ord", "cluster_ord").alias("o"), "name", "source_path"))
    return out


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.TABLES[name])


@dataclass
class Session:
    """The tables, each a DataFrame with the schema of its name, and the aligner's configuration."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    config: AlignConfig = AlignConfig()

    def __post_init__(self) -> None:
        self.tables = {n: self.tables.get(n, None) if n in self.tables else empty(self.spark, n) for n in schemas.TABLES}

    def __getattr__(self, name: str) -> DataFrame:
        if name in schemas.TABLES:
            return self.tables[name]
        raise AttributeError(name)

    def put(self, **tables: DataFrame) -> "Session":
        """Replaces tables by written copies, so that later steps neither parse nor align again."""
        for name, df in tables.items():
            self.tables[name] = written(df.select(*schemas.names(schemas.TABLES[name])), name)
        return self

    def configure_aligner(self, **changes) -> None:
        self.config = self.config.configured(**changes)

    def add_clusters(self, tables: dict[str, DataFrame]) -> None:
        """Appends clusters behind those there are; a cluster with a known id replaces it and keeps its place."""
        old = {n: self.tables[n] for n in ("clusters", "loci", "genes")}
        first = old["clusters"].agg(F.coalesce(F.max("cluster_ord") + 1, F.lit(0)).alias("n")).first()["n"]
        known = old["clusters"].select("cluster_id", F.col("cluster_ord").alias("known_ord"))
        fresh = tables["clusters"].join(known, "cluster_id", "left").withColumn("cluster_ord", F.coalesce("known_ord", F.col("cluster_ord") + first).cast("int")).drop("known_ord")
        self.put(
            clusters=similarity_join.upsert(old["clusters"], fresh, ["cluster_id"]),
            loci=similarity_join.upsert(old["loci"], tables["loci"], ["locus_id"]),
            genes=similarity_join.upsert(old["genes"], tables["genes"], ["gene_id"]),
        )

    def align(self, cutoff: float = 0.3) -> None:
        """Aligns the cluster pairs that have no alignment yet."""
        pairs = similarity_join.not_yet_aligned(similarity_join.cluster_pairs(self.clusters), self.alignments)
        first = self.alignments.agg(F.coalesce(F.max("alignment_ord") + 1, F.lit(0)).alias("n")).first()["n"]
        alignments = similarity_join.alignments_of(pairs, first)
        links = similarity_join.similarity_links(self.genes, self.loci, pairs, cutoff, self.config)
        self.put(alignments=self.alignments.unionByName(alignments), links=self.links.unionByName(links))

    def put_alignments(self, alignments: DataFrame, links: DataFrame) -> None:
        """Adds alignments; one of a pair of clusters that has one replaces it with its links."""
        pair = [F.least("query_cluster_id", "target_cluster_id"), F.greatest("query_cluster_id", "target_cluster_id")]
        merged = similarity_join.upsert(self.alignments, alignments, pair)
        kept = self.links.join(merged.join(alignments.select("alignment_id"), "alignment_id", "left_anti").select("alignment_id"), "alignment_id", "left_semi")
        self.put(alignments=merged, links=kept.unionByName(links))

    def placed_genes(self) -> DataFrame:
        return lookups.global_order(self.genes, self.loci, self.clusters)

    def placed_links(self) -> DataFrame:
        """links with `place`: alignments in order, then links in order."""
        return self.links.join(self.alignments.select("alignment_id", "alignment_ord"), "alignment_id").withColumn("place", F.struct("alignment_ord", "link_ord"))

    def build_groups(self, functions: DataFrame | None = None, colours: DataFrame | None = None, rule: str = "documented") -> None:
        """Groups of functions (as read_functions gives them) and links; functions also count where there is one cluster."""
        listed = None
        if functions is not None:
            wanted = functions.select("function_ord", "function", F.posexplode_outer("genes").alias("n", "value"))
            met = lookups.genes_by_value(self.placed_genes(), wanted).select("function", "n", "gene_id")
            missed = wanted.join(met.select("function", "n"), ["function", "n"], "left_anti").where("value IS NOT NULL")
            for r in missed.select("value").distinct().limit(20).collect():
                LOG.warning("no gene has the value %s", r["value"])
            listed = functions.select("function_ord", "function").join(met.select("function", "gene_id"), "function", "left")
        found, members = groups.build_groups(self.placed_links(), listed, colours, rule)
        self.put(groups=found, group_members=members)

    def synteny(self, weight: float = 0.5, mode: str = "effective") -> DataFrame:
        return synteny.synteny(self.links, self.alignments, self.genes, weight, mode)

    def matrix(self, normalise: bool = False, as_distance: bool = False, weight: float = 0.5, mode: str = "effective") -> DataFrame:
        return synteny.score_matrix(self.clusters, self.synteny(weight, mode), normalise, as_distance)

    def order(self, method: str = "ward", weight: float = 0.5, mode: str = "effective") -> list[int]:
        n = self.clusters.count()
        if self.alignments.isEmpty():
            return list(range(n))
        return ordering.cluster_order(self.matrix(True, True, weight, mode), n, method)

    # Stored sessions.

    def write_parquet(self, path: str) -> None:
        """The scalable form: a folder with a table each."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str) -> "Session":
        return cls(spark, {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in schemas.TABLES.items()})

    def to_dict(self) -> dict:
        """The exchange form: maps by id. It is one document, so the tables come to the driver."""
        genes = {r["gene_id"]: gene_dict(r) for r in self.placed_genes().orderBy("place").collect()}
        by_locus: dict[str, list[str]] = {}
        for r in self.genes.select("locus_id", "gene_id", "gene_ord").orderBy("locus_id", "gene_ord").collect():
            by_locus.setdefault(r["locus_id"], []).append(r["gene_id"])
        loci = self.loci.orderBy("cluster_id", "locus_ord").collect()
        by_cluster: dict[str, list[str]] = {}
        for x in loci:
            by_cluster.setdefault(x["cluster_id"], []).append(x["locus_id"])
        clusters = self.clusters.orderBy("cluster_ord").collect()
        links = self.placed_links().orderBy("place").collect()
        by_alignment: dict[str, list[str]] = {}
        for x in links:
            by_alignment.setdefault(x["alignment_id"], []).append(x["link_id"])
        members: dict[str, list[str]] = {}
        for r in self.group_members.orderBy("group_id", "gene_id").collect():
            members.setdefault(r["group_id"], []).append(r["gene_id"])
        return {
            "order": [c["cluster_id"] for c in clusters],
            "clusters": {c["cluster_id"]: {"uid": c["cluster_id"], "name": c["name"], "loci": by_cluster.get(c["cluster_id"], [])} for c in clusters},
            "loci": {x["locus_id"]: {"uid": x["locus_id"], "name": x["name"], "start": x["start"], "end": x["end"], "genes": by_locus.get(x["locus_id"], [])} for x in loci},
            "genes": genes,
            "groups": [{"uid": g["group_id"], "label": g["label"], "genes": members.get(g["group_id"], []), "hidden": g["hidden"], "colour": g["colour"]} for g in self.groups.orderBy("group_ord").collect()],
            "alignments": {a["alignment_id"]: {"uid": a["alignment_id"], "query": a["query_cluster_id"], "target": a["target_cluster_id"], "links": by_alignment.get(a["alignment_id"], [])} for a in self.alignments.orderBy("alignment_ord").collect()},
            "links": {x["link_id"]: {"uid": x["link_id"], "query": genes[x["query_gene_id"]], "target": genes[x["target_gene_id"]], "identity": x["identity"], "similarity": x["similarity"]} for x in links},
        }

    @classmethod
    def from_dict(cls, spark: SparkSession, d: dict) -> "Session":
        """A session of the exchange form. Alignments keep their ids; groups may be missing."""
        clusters, loci, genes, alignments, links, found, members = [], [], [], [], [], [], []
        for i, c in enumerate(d["order"]):
            own = d["clusters"][c]
            clusters.append((c, i, own["name"], None))
            for j, x in enumerate(own["loci"]):
                locus = d["loci"][x]
                loci.append((x, c, j, locus["name"], locus["start"], locus["end"]))
                for k, g in enumerate(locus["genes"]):
                    gene = d["genes"][g]
                    genes.append((g, x, c, k, gene["label"], gene["names"], gene["start"], gene["end"], gene["strand"], gene["sequence"], gene["translation"]))
        for i, (uid, a) in enumerate(d["alignments"].items()):
            alignments.append((uid, i, a["query"], a["target"]))
            for j, x in enumerate(a["links"]):
                link = d["links"][x]
                links.append((x, uid, j, link["query"]["uid"], link["target"]["uid"], float(link["identity"]), float(link["similarity"])))
        for i, g in enumerate(d.get("groups", [])):
            found.append((g["uid"], i, g["label"], g["hidden"], g["colour"]))
            members += [(g["uid"], x) for x in g["genes"]]
        rows = {"clusters": clusters, "loci": loci, "genes": genes, "links": links, "alignments": alignments, "groups": found, "group_members": members}
        return cls(spark, {n: spark.createDataFrame(r, schemas.TABLES[n]) for n, r in rows.items()})

    def save(self, path: str, indent: int | None = None) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=indent)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Session":
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(spark, json.load(f))


def gene_dict(r) -> dict:
    return {"uid": r["gene_id"], "label": r["label"], "names": dict(r["names"]), "start": r["start"], "end": r["end"], "strand": r["strand"], "sequence": r["sequence"], "translation": r["translation"]}


def read_session(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an exchange file read by Spark: for files in any store and too large for the driver's parser."""
    gene = "struct<uid:string,label:string,names:map<string,string>,start:int,end:int,strand:tinyint,sequence:string,translation:string>"
    shape = (
        "order array<string>, clusters map<string,struct<uid:string,name:string,loci:array<string>>>, loci map<string,struct<uid:string,name:string,start:int,end:int,genes:array<string>>>, "
        f"genes map<string,{gene}>, groups array<struct<uid:string,label:string,genes:array<string>,hidden:boolean,colour:string>>, "
        f"alignments map<string,struct<uid:string,query:string,target:string,links:array<string>>>, links map<string,struct<uid:string,query:{gene},target:{gene},identity:double,similarity:double>>"
    )
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d")).select("d.*")
    clusters = d.select(F.posexplode("order").alias("cluster_ord", "cluster_id"), "clusters").select("cluster_ord", "cluster_id", F.col("clusters")[F.col("cluster_id")].alias("c"))
    held = clusters.select("cluster_id", F.posexplode("c.loci").alias("locus_ord", "locus_id"))
    loci = d.select(F.explode("loci").alias("locus_id", "x")).join(held, "locus_id")
    placed = loci.select("cluster_id", "locus_id", F.posexplode("x.genes").alias("gene_ord", "gene_id"))
    genes = d.select(F.explode("genes").alias("gene_id", "g")).join(placed, "gene_id").select("gene_id", "locus_id", "cluster_id", "gene_ord", "g.label", "g.names", "g.start", "g.end", "g.strand", "g.sequence", "g.translation")
    alignments = d.select(F.posexplode("alignments").alias("alignment_ord", "alignment_id", "a"))
    listed = alignments.select("alignment_id", F.posexplode("a.links").alias("link_ord", "link_id"))
    links = d.select(F.explode("links").alias("link_id", "x")).join(listed, "link_id").select("link_id", "alignment_id", "link_ord", F.col("x.query.uid").alias("query_gene_id"), F.col("x.target.uid").alias("target_gene_id"), "x.identity", "x.similarity")
    found = d.select(F.posexplode("groups").alias("group_ord", "g"))
    return {
        "clusters": clusters.select("cluster_id", "cluster_ord", F.col("c.name").alias("name"), F.lit(None).cast("string").alias("source_path")),
        "loci": loci.select("locus_id", "cluster_id", "locus_ord", "x.name", "x.start", "x.end"),
        "genes": genes,
        "links": links,
        "alignments": alignments.select("alignment_id", "alignment_ord", F.col("a.query").alias("query_cluster_id"), F.col("a.target").alias("target_cluster_id")),
        "groups": found.select(F.col("g.uid").alias("group_id"), "group_ord", "g.label", "g.hidden", "g.colour"),
        "group_members": found.select(F.col("g.uid").alias("group_id"), F.explode("g.genes").alias("gene_id")),
    }


def align_clusters(spark: SparkSession, tables: dict[str, DataFrame], cutoff: float = 0.3, **aligner_config) -> Session:
    """A session of clusters, loci and genes with all pairs of clusters aligned."""
    session = Session(spark, config=AlignConfig().configured(**aligner_config))
    session.add_clusters(tables)
    session.align(cutoff)
    return session


def from_rows(spark: SparkSession, records: list[dict], name: str | None = None) -> dict[str, DataFrame]:
    """clusters, loci and genes of one cluster of in-memory records (dicts of RECORDS without the cluster's fields). The name is the first record's unless given."""
    if not records:
        raise ValueError("a cluster needs a record")
    own = name or records[0]["record_name"]
    rows = [{"cluster_ord": 0, "cluster_name": own, "source_path": own, "record_ord": i, "topology": "linear", "length": len(r.get("sequence") or ""), **r} for i, r in enumerate(records)]
    frame = spark.createDataFrame([tuple(r.get(c) for c in ("cluster_ord", "cluster_name", "source_path", "record_ord", "record_id", "record_name", "topology", "length", "sequence", "features")) for r in rows], schemas.RECORDS)
    return annotation.tables_of_records(frame)


__all__ = ["C", "Session", "align_clusters", "from_rows", "parse_files", "read_session"]
