"""What becomes of a peer's updates: comparison of version vectors, conflicts, and the decision per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import expr


def compare_versions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(folder, name, relation) of the rows that both sides have."""
    r = remote.select("folder", "name", F.col("version").alias("remote_version"))
    return local.select("folder", "name", "version").join(r, ["folder", "name"]).select("folder", "name", expr.vv_compare(F.col("version"), F.col("remote_version")).alias("relation"))


def conflict_winners(local: DataFrame, remote: DataFrame, local_device: int = 0) -> DataFrame:
    """For concurrent versions the side that wins and the name under which the loser is kept."""
    r = remote.select("folder", "name", *[F.col(c).alias(f"remote_{c}") for c in ("version", "deleted", "device")])
    both = local.select("folder", "name", "version", "deleted").join(r, ["folder", "name"]).where(expr.vv_compare(F.col("version"), F.col("remote_version")) == "Concurrent")
    winner = expr.conflict_winner(F.col("version"), F.col("deleted"), F.lit(local_device), F.col("remote_version"), F.col("remote_deleted"), F.col("remote_device"))
    side = F.when(winner == "a", "local").otherwise("remote")
    return both.select("folder", "name", side.alias("winner"), F.concat("name", F.lit(".sync-conflict")).alias("loser_name"))


def apply_update_outcome(files: DataFrame, updates: DataFrame, same_blocks) -> DataFrame:
    """Decision for each update: InvalidInput, NeedBlocks, NoAction, Concurrent or Applied.

    Names are checked first, then the block list (where updates have columns blocks and size), then versions. One join on
    (folder, name). same_blocks is a condition over the joined row; its columns may come from either side. A batch that
    names a file twice must be folded in arrival order instead, see stratum.streaming.ingest.
    """
    mine = files.select("folder", "name", F.col("version").alias("local_version"), *[F.col(c).alias(f"local_{c}") for c in files.columns if c in ("blocks", "digest")])
    relation = expr.vv_compare(F.col("local_version"), F.col("version"))
    invalid = expr.name_error(F.col("name")).isNotNull()
    if {"blocks", "size"} <= set(updates.columns):
        invalid = invalid | expr.block_list_error(F.col("size"), F.col("blocks")).isNotNull()
    outcome = (
        F.when(invalid, "InvalidInput")
        .when(F.col("local_version").isNull() | F.col("version").isNull(), "NeedBlocks")
        .when(relation.isin("Greater", "Equal"), "NoAction")
        .when(relation == "Concurrent", "Concurrent")
        .when(relation == "Invalid", "InvalidInput")
        .when(same_blocks, "Applied")
        .otherwise("NeedBlocks")
    )
    return updates.join(mine, ["folder", "name"], "left").select("folder", "name", outcome.alias("outcome"))
