"""Connected components: union-find inside partitions, then rounds of contraction between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _unite(batches):
    """Edges of a partition to edges from each node to the smallest node of its local component."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([parent[x] for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every node of the edges (a, b): comp is the smallest node reachable.

    Each round points every node at its smallest neighbour, shortens the paths once and replaces edges
    by edges between the nodes pointed at; it ends when none are left. Nothing is collected; a round's
    tables are staged, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    edges = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").mapInArrow(_unite, "a long, b long"), "edges")
    known = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("up"))
        near = stage(near, "parents")
        top = near.select(F.col("id").alias("up"), F.col("up").alias("top"))
        step = stage(near.join(top, "up").select("id", F.col("top").alias("comp")), "jumps")
        left, right = step.select(F.col("id").alias("a"), F.col("comp").alias("ca")), step.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        edges = edges.join(right, "b").join(left, "a").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b").distinct()
        edges = stage(edges.mapInArrow(_unite, "a long, b long"), "edges")
        if known is None:
            known = step
        else:
            moved = step.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
            known = stage(known.join(moved, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp")), "labels")
    return spark.createDataFrame([], "id long, comp long") if known is None else known
