"""One object for the commands of a folder: initialise, list, register, check, compact, checkpoint, browse, read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.device_id import format_device_id
from stratum.operators import blocks as block_ops
from stratum.operators import collection, commit, index, integrity, snapshots
from stratum.sources.storage import check_credentials, check_schedules, format_duration, hadoop_settings, parse_duration, resolve_uri, store_options
from stratum.sources.tables import Manifest, TableStore

DEFAULT_SCHEDULES = {"1h": "24h", "1day": "7days"}
SWEPT = ("files", "inbox", "seqs", "block_data", "block_ptrs", "block_refs")


class Engine:
    """A folder's tables at a storage address."""

    def __init__(self, spark: SparkSession, uri: str, create: bool = True, environment: dict[str, str] | None = None):
        self.spark, self.options = spark, store_options(uri, os.environ if environment is None else environment)
        check_credentials(uri, self.options)
        for name, value in hadoop_settings(self.options).items():
            spark.sparkContext._jsc.hadoopConfiguration().set(name, value)
        self.store = TableStore(spark, resolve_uri(uri, create))
        self.schedules = check_schedules(DEFAULT_SCHEDULES)

    def device_id(self, regenerate: bool = False) -> str:
        return format_device_id(self.store.identity(regenerate))

    def folders(self) -> DataFrame:
        """(folder, label) by folder: those registered, empty ones too, and any that files name."""
        known = self.store.read("folders").select(F.col("id").alias("folder"), "label")
        return known.join(self.store.read("files").select("folder").distinct(), "folder", "full_outer").orderBy("folder")

    def register(self, proposed: DataFrame) -> DataFrame:
        """Add folders (id, label) to the registry; the rows with their keys, or why they were not added."""
        base = self.store.current()
        registry = self.store.read("folders", base)
        made = self.store.scratch(index.register_folders(registry, proposed))
        fresh = made.where("error is null").select("id", "label", F.concat(F.lit("folder_"), F.lpad(F.hex("key"), 8, "0")).alias("storage_key"), "key")
        self.store.commit(base, append={"folders": fresh})
        return made

    def remove(self, folder: str) -> Manifest:
        return self.store.remove_folder(folder)

    def blocks(self, manifest: Manifest | None = None) -> DataFrame:
        """One row a block of every file, as its row has it."""
        files = self.store.read("files", manifest)
        listed = files.select("folder", "name", "deleted", F.col("size").alias("file_size"), F.posexplode("blocks").alias("block_no", "b"))
        return listed.select("folder", "name", "deleted", "file_size", "block_no", "b.hash", "b.offset", "b.size", "b.blockseq", "b.inline_data")

    def check(self, level: str = "full") -> DataFrame:
        """Findings of the integrity rules up to a level; sequences below what all peers have may have been swept."""
        read = self.store.read
        tables = {"files": read("files"), "inbox": read("inbox"), "seqs": read("seqs"), "meta": read("folder_meta"), "blocks": self.blocks(), "ptrs": read("block_ptrs"), "refs": read("block_refs"), "data": read("block_data")}
        return integrity.findings(tables | {"floors": index.peer_floor(read("peers"))}, level)

    def store_blocks(self, incoming: DataFrame, table: str = "files") -> DataFrame:
        """Take in blocks (folder, name, hash, data) that rows of files or inbox list; those that none lists come back."""
        base = self.store.current()
        read = lambda t: self.store.read(t, base)
        out = commit.store(read(table), read("block_refs"), read("block_ptrs"), read("block_data"), read("folder_meta"), incoming)
        self.store.commit(base, replace={table: out["rows"], "block_refs": out["refs"], "block_ptrs": out["ptrs"], "block_data": out["data"], "folder_meta": out["meta"]})
        return out["errors"]

    def promote(self, completions: DataFrame) -> DataFrame:
        """Move staged rows that are complete (folder, epoch, name, version) to files; those that lack blocks come back."""
        base = self.store.current()
        read = lambda t: self.store.read(t, base)
        out = commit.promote(read("inbox"), read("files"), read("seqs"), read("folder_meta"), completions)
        blocked = self.store.scratch(out["blocked"])
        self.store.commit(base, replace={"inbox": out["inbox"], "files": out["files"], "seqs": out["seqs"], "folder_meta": out["meta"]})
        return blocked

    def compact(self, epoch: int = 0) -> DataFrame:
        """Rewrite all tables without what nothing needs, each as one generation of files; rows kept and dropped by class.

        Another writer in between makes the commit fail, so nothing that it wrote can be lost.
        """
        base = self.store.current()
        tables = {t: self.store.read(t, base) for t in SWEPT}
        swept = collection.sweep(tables, index.peer_floor(self.store.read("peers", base)), epoch)
        rest = {t: self.store.read(t, base) for t, paths in base.tables.items() if t not in SWEPT and len(paths) > 1}
        made = self.store.commit(base, replace={t: swept[t] for t in SWEPT} | rest)
        return collection.decision_counts(tables, {t: self.store.read(t, made) for t in SWEPT})

    def set_schedule(self, interval: str, ttl: str | None) -> None:
        """Set a schedule's time to live, or remove it (None)."""
        seconds = parse_duration(interval)
        if ttl is None:
            self.schedules.pop(seconds, None)
        else:
            self.schedules[seconds] = parse_duration(ttl)

    def checkpoint(self, interval: str, now: float | None = None) -> str:
        seconds = parse_duration(interval)
        if seconds < snapshots.LEAST_INTERVAL_S:
            raise ValueError("checkpoints are at least ten minutes apart")
        return self.store.checkpoint(format_duration(seconds), self.schedules.get(seconds, 24 * seconds), now)

    def read_dir(self, checkpoint: str, directory: str = "") -> DataFrame:
        return snapshots.read_dir(self.store.read("files", self.store.at(checkpoint)), directory)

    def read(self, requests: DataFrame, checkpoint: str | None = None) -> DataFrame:
        """Bytes of ranges (folder, name, start, length), now or at a checkpoint; see read_range."""
        manifest = self.store.at(checkpoint) if checkpoint else self.store.current()
        files = self.store.read("files", manifest)
        return block_ops.read_range(files, self.blocks(manifest), self.store.read("block_data", manifest), requests)
