"""Table schemas. Spark rows have no order of their own, so every level has an ordinal."""

from __future__ import annotations

EXON = "struct<start:int,end:int,strand:tinyint>"
QUALIFIER = "struct<key:string,value:string>"
FEATURE = f"struct<feature_ord:int,type:string,exons:array<{EXON}>,qualifiers:array<{QUALIFIER}>>"

#: One row per annotated sequence record, as parsers give it. record_ord counts within the file, cluster_ord the files.
RECORDS = f"cluster_ord int, cluster_name string, source_path string, record_ord int, record_id string, record_name string, topology string, length int, sequence string, features array<{FEATURE}>"

CLUSTERS = "cluster_id string, cluster_ord int, name string, source_path string"
LOCI = "locus_id string, cluster_id string, locus_ord int, name string, start int, end int"
GENES = "gene_id string, locus_id string, cluster_id string, gene_ord int, label string, names map<string,string>, start int, end int, strand tinyint, sequence string, translation string"
LINKS = "link_id string, alignment_id string, link_ord int, query_gene_id string, target_gene_id string, identity double, similarity double"
ALIGNMENTS = "alignment_id string, alignment_ord long, query_cluster_id string, target_cluster_id string"
GROUPS = "group_id string, group_ord int, label string, hidden boolean, colour string"
GROUP_MEMBERS = "group_id string, gene_id string"

TABLES = {"clusters": CLUSTERS, "loci": LOCI, "genes": GENES, "links": LINKS, "alignments": ALIGNMENTS, "groups": GROUPS, "group_members": GROUP_MEMBERS}


def names(schema: str) -> list[str]:
    """Column names of a DDL schema without nested structs."""
    return [part.split()[0] for part in schema.replace("map<string,string>", "map").split(", ")]
