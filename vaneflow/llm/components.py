"""Connected components of large graphs by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours are tied to its least neighbour; small star: its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.filter("b < a")
    least = side.groupBy("a").agg(F.min("b").alias("_l")).select("a", F.least("a", "_l").alias("m"))
    tied = (both.filter("b > a") if large else side).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        tied = tied.unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node that has an edge (a, b); root is the component's least node.

    Each round halves paths at least; rounds are written to the shared folder, so none is computed again.  Edges from a
    node to itself and nulls are dropped; no edges give no rows.
    """
    edges = edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = keep(edges, name)
    seen = None
    while True:
        edges = keep(_stars(_stars(edges, True), False), name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
