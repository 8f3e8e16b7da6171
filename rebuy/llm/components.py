"""Connected components of an edge table by alternating large and small stars.

After each round the edges are written to the shared folder, which cuts the lineage; the rounds
end when a round changes nothing, and then every node is tied to the smallest node of its
component. All work is grouping and joins on salted nodes, so components and nodes of any size pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rebuy.session import materialize


SALTS = 16  # tasks over which the edges of one node are spread


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds ``m``, the least ``b`` of each ``a``; edges of a node are never gathered in one task.

    Edges are salted by their other end. A node's least end comes from one row per salt, and
    goes back to the salts that occur, so a node of few edges is not repeated more often than it has edges.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(least.select("a", "m", F.explode("salts").alias("salt")), ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = _with_least(both).filter(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = _with_least(down).select("m", F.explode(F.array("a", "b")).alias("a"))
    return joined.filter(F.col("a") != F.col("m")).select("a", F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) for all nodes of the edges (a, b); ``comp`` is the component's smallest node."""
    current, before = materialize(edges.filter("a != b").distinct(), name), None
    while True:
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        if not state["n"]:
            break
        current = materialize(_small_star(_large_star(current)), name)
    ties = current.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return ties.union(current.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
