"""Staging, promotion and commit of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import expr
from stratum.operators.numbering import arrival_bucket, hash_bucket, numbered


def inbox_last_write(inbox: DataFrame) -> DataFrame:
    """Of the rows staged for (folder, epoch, name) the one that arrived last."""
    return inbox.groupBy("folder", "epoch", "name").agg(F.max_by("sequence", "arrival").alias("sequence"), F.max("arrival").alias("arrival"))


def promotable(inbox: DataFrame, completions: DataFrame) -> DataFrame:
    """Completions that match a staged row's version, and whether all its blocks can be resolved (`missing` counts those
    that cannot). A completion of another version changes nothing, so it is absent here."""
    want = completions.select("folder", "epoch", "name", F.col("version").alias("expected"))
    joined = inbox.join(want, ["folder", "epoch", "name"]).where(F.col("version").eqNullSafe(F.col("expected")))
    return joined.select("folder", "epoch", "name", "missing", (F.col("missing") == 0).alias("ready"))


def commit_upsert(files: DataFrame, updates: DataFrame) -> DataFrame:
    """Files after a batch of commits, one a name: each takes the next sequence of its folder in order of arrival.

    Unchanged rows keep theirs. The old row of a committed name goes, which is an anti join.
    """
    high = files.groupBy("folder").agg(F.max("sequence").alias("high"))
    placed = numbered(updates.select("folder", "name", "arrival"), "folder", arrival_bucket(F.col("arrival")), ["arrival", "name"])
    fresh = placed.join(high, "folder", "left").select("folder", "name", (F.coalesce("high", F.lit(0)) + F.col("place")).alias("sequence"), F.lit(True).alias("committed"))
    kept = files.join(updates.select("folder", "name"), ["folder", "name"], "left_anti").select("folder", "name", "sequence", F.lit(False).alias("committed"))
    return kept.unionByName(fresh)


def expired_inbox(inbox: DataFrame, current_epoch: int) -> DataFrame:
    return inbox.where(F.col("epoch") < current_epoch).groupBy("folder").agg(F.count("*").alias("dropped"))


def assign_blockseqs(new_hashes: DataFrame, meta: DataFrame) -> DataFrame:
    """(folder, hash, blockseq): numbers for new hashes from the folder's next one on, 1024 at least, in hash order."""
    first = F.greatest(F.coalesce("next_blockseq", F.lit(0)), F.lit(expr.FIRST_BLOCKSEQ))
    placed = numbered(new_hashes.select("folder", "hash").distinct(), "folder", hash_bucket(F.col("hash")), ["hash"])
    return placed.join(meta.select("folder", "next_blockseq"), "folder", "left").select("folder", "hash", (first + F.col("place") - 1).alias("blockseq"))


def reserved_blockseq(assigned: DataFrame, meta: DataFrame) -> DataFrame:
    """The counter to keep: numbers are reserved 256 at a time."""
    used = assigned.groupBy("folder").agg(F.count("*").alias("n"))
    first = F.greatest(F.coalesce("next_blockseq", F.lit(0)), F.lit(expr.FIRST_BLOCKSEQ))
    step = F.lit(expr.BLOCKSEQ_RESERVE)
    return used.join(meta, "folder", "left").select("folder", (first + step * F.ceil(F.col("n") / step)).cast("long").alias("next_blockseq"))


def carry_pointers(new_blocks: DataFrame, old_blocks: DataFrame) -> DataFrame:
    """Pointers of new blocks: their own, else that of the first old block of the file with the same hash that has one."""
    first = old_blocks.where(F.col("blockseq").isNotNull()).groupBy("folder", "name", "hash").agg(F.min_by("blockseq", "block_no").alias("old"))
    return new_blocks.join(first, ["folder", "name", "hash"], "left").select("folder", "name", "block_no", "hash", F.coalesce("blockseq", "old").alias("blockseq"))


def completion_state(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """Blocks a file needs, how many of them are stored, and whether it is complete."""
    have = stored.select("folder", "hash").distinct().withColumn("have", F.lit(1))
    joined = blocks.join(have, ["folder", "hash"], "left")
    return joined.groupBy("folder", "name").agg(F.count("*").alias("needed"), F.count("have").alias("stored"), (F.count("*") == F.count("have")).alias("complete"))


def match_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their responses by id; answers to no request are left out (see unknown_responses)."""
    return requests.join(responses, "id", "left").select("id", "name", F.when(F.col("code").isNull(), "pending").when(F.col("code") == 0, "stored").otherwise("peer error").alias("state"))


def unknown_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return responses.join(requests, "id", "left_anti")


def request_codes(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Code of the answer to a block request: generic for negative ranges, no such file for unknown or deleted ones."""
    live = files.where(~F.col("deleted")).select("folder", "name", F.lit(True).alias("found"))
    code = F.when((F.col("offset") < 0) | (F.col("length") < 0), "GENERIC").when(F.col("found").isNull(), "NO_SUCH_FILE").otherwise("NO_ERROR")
    return requests.join(live, ["folder", "name"], "left").select("id", code.alias("code"))


def in_flight(requests: DataFrame, cap: int = 16) -> DataFrame:
    """Requests (device, arrival, id, …) of a connection with their state: the first `cap` (1 at least) in the order of
    arrival are in flight, the others wait. A connection's open requests are few; each is ranked in its own window."""
    place = F.row_number().over(Window.partitionBy("device").orderBy("arrival", "id"))
    return requests.withColumn("state", F.when(place <= max(1, cap), "in flight").otherwise("deferred"))


def free_ids(wanted: DataFrame, taken: DataFrame, first: int = 1) -> DataFrame:
    """wanted (device, arrival) with ids: the least from `first` on that the device has not in flight, by arrival.

    Of n wanted and m taken ids the least n + m numbers hold n free ones, so candidates are a sequence of that length.
    """
    n = wanted.groupBy("device").agg(F.count("*").alias("n"))
    m = taken.groupBy("device").agg(F.count_distinct("id").alias("m"))
    span = n.join(m, "device", "left").withColumn("top", F.lit(first) + F.col("n") + F.coalesce("m", F.lit(0)) - 1)
    candidates = span.select("device", F.explode(F.sequence(F.lit(first).cast("long"), F.col("top").cast("long"))).alias("id"))
    free = candidates.join(taken.select("device", "id").distinct(), ["device", "id"], "left_anti")
    free = numbered(free, "device", F.shiftright("id", 16), ["id"])
    return numbered(wanted, "device", arrival_bucket(F.col("arrival")), ["arrival"]).join(free, ["device", "place"]).select("device", "arrival", "id")


def current_connections(connections: DataFrame) -> DataFrame:
    """Of the connections (device, connected, id) of each device the latest, which replaces the others."""
    return connections.groupBy("device").agg(F.max_by("id", F.struct("connected", "id")).alias("id"))
