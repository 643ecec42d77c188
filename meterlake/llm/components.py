"""Connected components with DataFrame joins: alternating large and small stars.

Labels are the least node of each component. Every round is written to the shared
folder, so lineage stays short; minima are aggregated before they are shuffled and
stand in a table of their own, so that adaptive execution can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b") if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        found = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return found.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for every node of the edges (columns ``a`` and ``b``).

    Loops and null ends are passed over, so a node with no other edge is not
    returned; no edges give no rows."""
    edges = stored(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), "edges")
    kind = edges.schema["a"].dataType
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        edges = stored(_star(_star(edges, True), False), "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").cast(kind).alias("node"), F.col("b").alias("component")).distinct()
    return stars.union(roots)
