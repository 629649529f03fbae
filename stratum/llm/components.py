"""Connected components by alternating large-star and small-star steps on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import heavy_join, materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long); root is the least node of its component.

    Edges may repeat, point either way or be loops; those with a null end are left out. A tree row (a, b) has a > b. The
    large star of b hangs a below the least neighbour of b, the small star of a hangs the lesser neighbours of a below the
    least of them. Minima combine before the shuffle. Rows meet the minimum of a node by a join that sets the heaviest
    nodes apart, so the centre of a large star is spread over all tasks. Nothing reaches the driver but a count and a
    checksum.
    """
    spark = edges.sparkSession
    tree = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tree = materialize(spark, tree, "edges")
    state = _state(tree)
    for _ in range(max_rounds):
        if not state[0]:
            break
        large = heavy_join(tree, _least(tree).withColumnRenamed("a", "b"), "b", state[0])
        large = materialize(spark, large.select("a", F.coalesce("m", "b").alias("b")).distinct(), "stars")
        least = _least(large)
        joined = heavy_join(large, least, "a", state[0])
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        tree = materialize(spark, small.distinct(), "edges")
        before, state = state, _state(tree)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return tree.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tree.select(F.col("b").alias("root")).distinct().select(F.col("root").alias("node"), "root"))


def _least(tree: DataFrame) -> DataFrame:
    return tree.groupBy("a").agg(F.min("b").alias("m"))


def _state(tree: DataFrame) -> tuple:
    return tuple(tree.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
