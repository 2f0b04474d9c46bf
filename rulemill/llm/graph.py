"""Connected components of large graphs by alternating star steps on DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex joins its larger neighbours to the least vertex it sees."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex joins itself and its smaller neighbours to the least of them; edges lead from the larger vertex."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every vertex of an edge; component is the least id that can be reached.

    A vertex with many edges only meets sums and joins on its id, which Spark can split; no edge list reaches the
    driver. Edges of a vertex to itself, null ends and repeats change nothing; no edges give no rows. The table is
    written once a round, and the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, seen = materialize(edges, "edges"), None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("id")).distinct()
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(roots.select("id", F.col("id").alias("component"))))
