"""Connected components of an edge table, by hooking to the smallest neighbour and contraction.

Every round each root hooks to its smallest neighbour, parents are shortened by
pointer jumping, and the edges are rewritten to roots; edges inside a component
vanish.  A star of any size shrinks in one round, a path in logarithmically many.
Minima are aggregated map-side, so a hub costs one row per task; hubs in the
joins are split by adaptive skew handling.  Tables go through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.common import materialise


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return materialise(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )


def _shortened(parents: DataFrame) -> DataFrame:
    """Every node's root instead of its parent."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("parent").alias("up"))
        jumped = materialise(
            parents.join(up, parents["parent"] == up["root"], "left")
            .select("node", F.coalesce("up", "parent").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")),
            "parents",
        )
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is a node of its component."""
    edges = _distinct_edges(edges.select("a", "b"))
    labels = None
    while not edges.isEmpty():
        # b is the larger end, so only it can hook; a root without a smaller neighbour stays.
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        stay = edges.select(F.col("a").alias("node"), F.col("a").alias("parent"))
        parents = hooks.unionByName(stay).groupBy("node").agg(F.min("parent").alias("parent"))
        roots = _shortened(materialise(parents, "parents"))
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("root"))
        else:
            up = roots.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
            labels = materialise(
                labels.join(up, labels["root"] == up["__n"], "left").select("node", F.coalesce("__p", "root").alias("root")),
                "labels",
            )
        ra = roots.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        rb = roots.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = _distinct_edges(edges.join(ra, "a").join(rb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
