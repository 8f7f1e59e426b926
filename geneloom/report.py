"""Text reports and the matrix table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.columns import fixed_decimals

HEADERS = ("Query", "Target", "Identity", "Similarity")


def link_rows(links: DataFrame, genes: DataFrame, decimals: int = 4) -> DataFrame:
    """(alignment_id, link_ord, query, target, identity, similarity): labels and numbers in fixed notation, all text."""
    label = lambda side: genes.select(F.col("gene_id").alias(f"{side}_gene_id"), F.col("label").alias(side))
    rows = links.join(label("query"), "query_gene_id").join(label("target"), "target_gene_id")
    return rows.select("alignment_id", "link_ord", "query", "target", fixed_decimals(F.col("identity"), decimals).alias("identity"), fixed_decimals(F.col("similarity"), decimals).alias("similarity"))


def padded(rows: DataFrame, partition: list[str], names: list[str], headers: tuple[str, ...] | None = None) -> DataFrame:
    """rows with every named column filled up with spaces to the longest value of its partition, headers included."""
    w = Window.partitionBy(*partition)

    def width(i: int, name: str) -> Column:
        longest = F.max(F.length(name)).over(w)
        return F.greatest(longest, F.lit(len(headers[i]))) if headers else longest

    fill = lambda value, n: F.concat(value, F.repeat(F.lit(" "), n - F.length(value)))
    return rows.select(*(c for c in rows.columns if c not in names), *(fill(F.col(n), width(i, n)).alias(n) for i, n in enumerate(names)))


def format_links(rows: DataFrame, headers: bool = False, delimiter: str | None = None) -> DataFrame:
    """(alignment_id, body): the lines of each alignment's links. Without delimiter columns are padded and two spaces apart."""
    names = ["query", "target", "identity", "similarity"]
    if headers:
        head = rows.select("alignment_id").distinct().select("alignment_id", F.lit(-1).alias("link_ord"), *(F.lit(h).alias(n) for h, n in zip(HEADERS, names)))
        rows = head.unionByName(rows)
    if not delimiter:
        rows = padded(rows, ["alignment_id"], names)
    line = F.concat_ws(delimiter or "  ", *names)
    lines = rows.select("alignment_id", F.struct("link_ord", line.alias("line")).alias("x")).groupBy("alignment_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return lines.select("alignment_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("body"))


def format_alignments(session, decimals: int = 4, alignment_headers: bool = True, link_headers: bool = True, delimiter: str | None = None) -> DataFrame:
    """(alignment_ord, block) of every alignment; one without links has its header (and column headers) only."""
    body = format_links(link_rows(session.links, session.genes, decimals), link_headers, delimiter)
    name = lambda side: session.clusters.select(F.col("cluster_id").alias(f"{side}_cluster_id"), F.col("name").alias(side))
    named = session.alignments.join(name("query"), "query_cluster_id").join(name("target"), "target_cluster_id").join(body, "alignment_id", "left")
    empty = (delimiter or "  ").join(HEADERS) if link_headers else ""
    text = F.coalesce("body", F.lit(empty))
    title = F.concat("query", F.lit(" vs "), "target")
    block = F.concat(title, F.lit("\n"), F.repeat(F.lit("-"), F.length(title)), F.lit("\n"), text) if alignment_headers else text
    return named.select("alignment_ord", block.alias("block"))


def format_report(session, decimals: int = 4, alignment_headers: bool = True, link_headers: bool = True, delimiter: str | None = None) -> str:
    """All alignments' blocks in order, a blank line between. ValueError without alignments."""
    blocks = format_alignments(session, decimals, alignment_headers, link_headers, delimiter).orderBy("alignment_ord").collect()
    if not blocks:
        raise ValueError("there are no alignments")
    return "\n\n".join(r["block"] for r in blocks)


def write_blocks(session, path: str, **options) -> None:
    """The report for results too large for the driver: text files whose lines, in file order, are the report's."""
    blocks = format_alignments(session, **options)
    blocks.repartitionByRange("alignment_ord").sortWithinPartitions("alignment_ord").select(F.concat("block", F.lit("\n")).alias("value")).write.text(path)


def format_matrix(session, delimiter: str = ",", normalise: bool = False, as_distance: bool = False, **options) -> str:
    """The score matrix with cluster names around it; there are as many values as pairs of clusters."""
    names = [r["name"] for r in session.clusters.orderBy("cluster_ord").collect()]
    values: dict[int, dict[int, float]] = {}
    for r in session.matrix(normalise, as_distance, **options).collect():
        if r["value"] is None:
            raise KeyError("a pair of clusters has no alignment")
        values.setdefault(r["i"], {})[r["j"]] = r["value"]
    rows = [["", *names]] + [[n, *(str(values[i][j]) for j in range(len(names)))] for i, n in enumerate(names)]
    return "\n".join(delimiter.join(r) for r in rows)


def write_text(text: str, path: str, force: bool = False) -> bool:
    """Writes text unless the file is there and force isn't given."""
    if os.path.exists(path) and not force:
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return True
