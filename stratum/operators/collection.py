"""Garbage collection as semi and anti joins over what is live, and storage statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import expr


def keep_live(rows: DataFrame, live: DataFrame, on: list[str]) -> DataFrame:
    """Rows of block data, pointers or references whose hash or number is live. The exact form of a Bloom-filtered sweep."""
    return rows.join(live.select(*on).distinct(), on, "left_semi")


def keep_inbox(inbox: DataFrame, current_epoch: int) -> DataFrame:
    return inbox.where(F.col("epoch") >= current_epoch)


def keep_seqs(seqs: DataFrame, floors: DataFrame) -> DataFrame:
    """Entries not below the floor that all peers have reached; folders without a floor keep all."""
    return seqs.join(floors, "folder", "left").where(F.col("floor").isNull() | (F.col("seq") >= F.col("floor"))).drop("floor")


def keep_files(files: DataFrame, floors: DataFrame) -> DataFrame:
    """All but deletions that every peer knows of."""
    return files.join(floors, "folder", "left").where(~F.col("deleted") | F.col("floor").isNull() | (F.col("sequence") >= F.col("floor"))).drop("floor")


def sweep_counts(before_after: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows seen and kept, by class and folder."""
    parts = []
    for name, (before, after) in before_after.items():
        tagged = before.select("folder", F.lit(1).alias("seen"), F.lit(0).alias("kept")).unionByName(after.select("folder", F.lit(0).alias("seen"), F.lit(1).alias("kept")))
        parts.append(tagged.groupBy("folder").agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept")).select("folder", F.lit(name).alias("class"), "seen", "kept"))
    return reduce(DataFrame.unionByName, parts)


def prefix_stats(rows: DataFrame) -> DataFrame:
    """Statistics of (prefix, size, tombstone, dropped): counts, bytes, and rows in 14 buckets of size."""
    bucket = expr.size_bucket(F.when(F.col("tombstone"), 0).otherwise(F.col("size")))
    size = F.when(F.col("tombstone"), 0).otherwise(F.col("size"))
    histogram = [F.count_if(F.col("bucket") == i).alias(f"bucket_{i}") for i in range(14)]
    return rows.withColumns({"bucket": bucket, "bytes": size}).groupBy("prefix").agg(
        F.count("*").alias("seen"), F.count_if("tombstone").alias("tombstones"), F.count_if("dropped").alias("dropped"),
        F.sum("bytes").alias("bytes_total"), F.max("bytes").alias("bytes_max"), *histogram,
    )


def compaction_candidates(segments: DataFrame, meta_l0: int = 4, block_l0: int = 32) -> DataFrame:
    """Segments (folder, segment, l0, runs) worth merging: metadata at 4 new files or more than one run, blocks at 32."""
    ripe = F.when(F.col("segment") == "meta", (F.col("l0") >= meta_l0) | (F.col("runs") > 1)).otherwise(F.col("l0") >= block_l0)
    return segments.where(ripe)


def merge_sources(segments: DataFrame, most: int = 64) -> DataFrame:
    """How many new files of a segment one merge takes: all of metadata's, `most` of blocks' at once."""
    return segments.withColumn("sources", F.when(F.col("segment") == "meta", F.col("l0")).otherwise(F.least(F.col("l0"), F.lit(most))).cast("long"))


def sweep(tables: dict[str, DataFrame], floors: DataFrame, current_epoch: int) -> dict[str, DataFrame]:
    """All record classes without what nothing needs: files, inbox, seqs, block_data, block_ptrs, block_refs.

    Live are the hashes and numbers of blocks that any kept row of files or inbox lists, deletions that are kept included.
    Payloads go by number, pointers and references by hash. A payload without a sound number is corrupt, and an error.
    """
    t = dict(tables)
    t["files"], t["seqs"], t["inbox"] = keep_files(t["files"], floors), keep_seqs(t["seqs"], floors), keep_inbox(t["inbox"], current_epoch)
    listed = [t[k].select("folder", F.explode("blocks").alias("b")).select("folder", "b.hash", "b.blockseq", F.col("b.inline_data").isNull().alias("apart")) for k in ("files", "inbox")]
    live = listed[0].unionByName(listed[1])
    bad = F.col("blockseq").isNull() | (F.col("blockseq") < expr.FIRST_BLOCKSEQ)
    checked = t["block_data"].withColumn("blockseq", F.when(bad, F.raise_error(F.lit("corrupt payload key")).cast("long")).otherwise(F.col("blockseq")))
    t["block_data"] = keep_live(checked, live.where("blockseq is not null"), ["folder", "blockseq"])
    for name in ("block_ptrs", "block_refs"):
        t[name] = keep_live(t[name], live.where("apart"), ["folder", "hash"])
    return t


def decision_counts(tables: dict[str, DataFrame], swept: dict[str, DataFrame]) -> DataFrame:
    """(class, kept, dropped) of a sweep over all folders."""
    parts = []
    for name, before in tables.items():
        n = before.agg(F.count("*").alias("seen")).crossJoin(F.broadcast(swept[name].agg(F.count("*").alias("kept"))))  # one row each
        parts.append(n.select(F.lit(name).alias("class"), "kept", (F.col("seen") - F.col("kept")).alias("dropped")))
    return reduce(DataFrame.unionByName, parts)


def prune_decision(rows: DataFrame) -> DataFrame:
    """What a dead row of (…, run, bottom_run) becomes when runs are merged in place: dropped in the lowest run, which hides
    nothing, a tombstone above it."""
    return rows.withColumn("decision", F.when(F.col("run") == F.col("bottom_run"), "drop").otherwise("tombstone"))


def safe_blocks(hashes: DataFrame, kept_by_sweeps: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Hashes (folder, hash) that every sweep under way (folder, sweep) knows to be live (folder, sweep, hash)."""
    running = sweeps.groupBy("folder").agg(F.count_distinct("sweep").alias("running"))
    known = kept_by_sweeps.groupBy("folder", "hash").agg(F.count_distinct("sweep").alias("known"))
    joined = hashes.join(running, "folder", "left").join(known, ["folder", "hash"], "left")
    return joined.where(F.coalesce("known", F.lit(0)) >= F.coalesce("running", F.lit(0))).select("folder", "hash")


def next_run(runs: DataFrame) -> DataFrame:
    """The number of the next sorted run of each segment (folder, segment, run): one more than the greatest, 0 without any."""
    return runs.groupBy("folder", "segment").agg(F.coalesce(F.max("run") + 1, F.lit(0)).cast("long").alias("next_run"))


def by_rows(stats: DataFrame) -> DataFrame:
    """Statistics with their place, most rows first, then by prefix."""
    return stats.withColumn("place", F.row_number().over(Window.orderBy(F.desc("seen"), "prefix")))  # a row a prefix: few


def column_widths(table: DataFrame) -> DataFrame:
    """(column, width): the longest text of each column, its name included, as a printed table needs."""
    widths = table.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))).cast("long").alias(c) for c in table.columns])
    return widths.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("width")) for c in table.columns])).alias("w")).select("w.*")
