"""Scans of a folder's index and what peers know of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.numbering import numbered


def full_index(files: DataFrame) -> DataFrame:
    """Every row, deleted ones included."""
    return files


def delta_index(files: DataFrame, seqs: DataFrame, since: int) -> DataFrame:
    """Rows whose sequence number follows `since`, by the sequence index; entries whose file is missing are passed over.

    OverflowError if no number can follow.
    """
    if not 0 <= since < 2**63 - 1:
        raise OverflowError(f"no sequence follows {since}")
    return seqs.where(F.col("seq") > since).join(files, ["folder", "name"])


def index_since(files: DataFrame, seqs: DataFrame, since: int, floor: int | None = None) -> DataFrame:
    """The full index for 0 and for what lies below the pruned floor, the delta else."""
    if since == 0 or (floor is not None and since < floor):
        return files.withColumn("seq", F.col("sequence"))
    return delta_index(files, seqs, since)


def effective_entries(files: DataFrame, inbox: DataFrame, epoch: int) -> DataFrame:
    """The staged row of the epoch if there is one, else the committed one."""
    staged = inbox.where(F.col("epoch") == epoch).select("folder", "name", F.col("sequence").alias("staged_sequence"))
    both = files.select("folder", "name", "sequence").join(staged, ["folder", "name"], "full_outer")
    return both.select("folder", "name", F.coalesce("staged_sequence", "sequence").alias("sequence"), F.col("staged_sequence").isNotNull().alias("is_inbox"))


def local_sequence(folders: DataFrame, files: DataFrame) -> DataFrame:
    """The greatest sequence of each folder, 0 for empty ones."""
    last = files.groupBy("folder").agg(F.max("sequence").alias("s"))
    return folders.join(last, "folder", "left").select("folder", F.coalesce("s", F.lit(0)).cast("long").alias("max_sequence"))


def peer_floor(peers: DataFrame) -> DataFrame:
    """What all peers of a folder have; null if one of them has nothing."""
    return peers.groupBy("folder").agg(F.nullif(F.min("max_sequence"), F.lit(0)).alias("floor"))


def index_message(files: DataFrame) -> DataFrame:
    """Header of a full index: rows and last sequence, 0 at least."""
    return files.groupBy("folder").agg(F.count("*").alias("n_files"), F.greatest(F.max("sequence"), F.lit(0)).alias("last_sequence"))


def new_mutual_folders(proposed: DataFrame, mutual: DataFrame, advertised: DataFrame) -> DataFrame:
    """Folders that a peer proposes, that we share, and that have not been advertised yet."""
    return proposed.join(mutual, "folder", "left_semi").join(advertised, "folder", "left_anti").select("folder")


def ensure_folders(proposed: DataFrame, folders: DataFrame) -> DataFrame:
    """Upsert of (folder, label): the label proposed, and whether the folder is new."""
    known = folders.select("folder", F.lit(True).alias("known"))
    return proposed.join(known, "folder", "left").select("folder", "label", F.col("known").isNull().alias("created"))


def remote_state(peers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Progress of wanted (folder, device), 0 if nothing is recorded."""
    return wanted.join(peers, ["folder", "device"], "left").select("folder", "device", F.coalesce("max_sequence", F.lit(0)).cast("long").alias("max_sequence"))


def last_write(states: DataFrame) -> DataFrame:
    """The state that arrived last for each (folder, device), not the greatest."""
    return states.groupBy("folder", "device").agg(F.max_by("max_sequence", "arrival").alias("max_sequence"))


def point_get(table: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Wanted keys with their rows; `found` is false where there is none."""
    return wanted.join(table.withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def folder_state(folders: DataFrame, meta: DataFrame) -> DataFrame:
    """Counters of folders; zero where nothing has been recorded."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return folders.join(meta, "folder", "left").select("folder", zero("max_sequence"), zero("next_blockseq"))


def resolve_folders(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, storage_key, label, error) of wanted folder ids."""
    out = wanted.join(registry, "id", "left")
    return out.select("id", "storage_key", "label", F.when(F.col("storage_key").isNull(), "not found").alias("error"))


def register_folders(registry: DataFrame, proposed: DataFrame) -> DataFrame:
    """(id, label, key, error): the next numbers, by id, for folders that are proposed (id, label) once and not known;
    others are duplicates and get none. registry has the number of each folder as key."""
    once = proposed.groupBy("id").agg(F.min("label").alias("label"), F.count("*").alias("n"))
    known = registry.select("id", F.lit(True).alias("known"))
    judged = once.join(known, "id", "left").withColumn("bad", F.coalesce("known", F.lit(False)) | (F.col("n") > 1))
    high = registry.agg(F.coalesce(F.max("key") + 1, F.lit(0)).alias("high"))
    placed = numbered(judged.where("NOT bad").withColumn("one", F.lit(0)), "one", F.substring("id", 1, 2), ["id"]).crossJoin(F.broadcast(high))  # one row
    fresh = placed.select("id", "label", (F.col("high") + F.col("place") - 1).cast("long").alias("key"), F.lit(None).cast("string").alias("error"))
    return fresh.unionByName(judged.where("bad").select("id", "label", F.lit(None).cast("long").alias("key"), F.lit("duplicate").alias("error")))


def without_folders(table: DataFrame, removed: DataFrame) -> DataFrame:
    """A table of any record class without the rows of removed folders."""
    return table.join(removed.select("folder").distinct(), "folder", "left_anti")


def idle(files: DataFrame, *waiting: DataFrame) -> DataFrame:
    """(folder, name) of files for which no request is pending or deferred."""
    for rows in waiting:
        files = files.join(rows, ["folder", "name"], "left_anti")
    return files.select("folder", "name")


def labels_in_order(listed: DataFrame) -> DataFrame:
    """Labels of (label, position) once each, with the position where each was first seen."""
    return listed.groupBy("label").agg(F.min("position").alias("position"))


def updates_to_send(files: DataFrame, committed: DataFrame) -> DataFrame:
    """Index updates of one file each, for rows that a batch committed: the row's sequence is the last, nothing precedes."""
    return committed.join(files, ["folder", "name"]).select("folder", "name", F.col("sequence").alias("last_sequence"), F.lit(0).cast("long").alias("prev_sequence"))


def allowed(connecting: DataFrame, devices: DataFrame) -> DataFrame:
    """(device, allowed) of devices that ask for a connection."""
    known = devices.select("device").distinct().withColumn("known", F.lit(True))
    return connecting.join(known, "device", "left").select("device", F.coalesce("known", F.lit(False)).alias("allowed"))
