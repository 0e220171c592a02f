"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize


def _hooked(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least neighbour of u, itself included."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hooked(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _hooked(down)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        linked.select("u", F.col("m").alias("v"))
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (u, v) of ``edges`` to rows (node, root), root the least node reachable.

    Every round is a table in the shared folder. Nodes without an edge to
    another node have no row. A hub's edges are joined, not gathered, so AQE
    may split them. Raises if ``rounds`` do not suffice; each contracts all
    components at once, so that the number needed is logarithmic.
    """
    current = edges.filter(F.col("u") != F.col("v")).select("u", "v")
    before = None
    for _ in range(rounds):
        star = _small_star(_large_star(current)).filter(F.col("u") != F.col("v")).distinct()
        seen = Observation()
        current = materialize(
            star.observe(
                seen,
                F.count(F.lit(1)).alias("n"),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest"),
            ),
            "components",
        )
        after = (seen.get["n"], seen.get["digest"])
        if after == before or after[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle within {rounds} rounds")
