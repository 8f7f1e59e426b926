"""Connected components of an edge table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(spark, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one is set if all runs in one process, else RuntimeError."""
    base = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = base.get() if base.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="geneloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the least node that can be reached.

    Labels start at the least neighbour; each round takes the least label among the neighbours' (a partial aggregate,
    so that the sums of a node with very many edges are made before they meet) and then follows labels to their own labels,
    which halves the remaining paths. The joins on a node's key and on a label's are left to adaptive execution to split where they are skewed. Each round is written to the shared folder. Nulls and self-loops: a self-loop makes a
    node, an edge with a null end makes none.
    """
    some = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = written(some.union(some.select("y", "x")).distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        told = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("to")).agg(F.min("label").alias("told"))
        nearer = labels.join(told, labels["node"] == told["to"], "left").select("node", "label", F.least("label", F.coalesce("told", "label")).alias("near"))
        roots = labels.select(F.col("node").alias("at"), F.col("label").alias("root"))
        jumped = nearer.join(roots, nearer["near"] == roots["at"], "left").select("node", F.least("near", F.coalesce("root", "near")).alias("label"), (F.least("near", F.coalesce("root", "near")) < F.col("label")).alias("moved"))
        labels = written(jumped, "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
