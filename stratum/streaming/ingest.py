"""Continuous intake of peers' updates: each micro-batch is folded into the tables in one pass and published with its cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import expr
from stratum.operators.commit import carried, commit, references
from stratum.sources.schema import LATEST
from stratum.sources.tables import Conflict, TableStore

KEY = ["folder", "name"]


def fold(files: DataFrame, updates: DataFrame, policy: str = "theirs", local_device: int = 0) -> DataFrame:
    """(folder, name, row, changed, staged, copies, invalid) of every name that updates mention, in the order of arrival.

    updates have the columns of files, arrival and device. All updates of a name are one list, folded over the name's row in
    one aggregate: what the row has become and whether it changed, updates that need blocks (staged), rows of losers to keep
    (copies), and the number of invalid ones. An update that is concurrent with the row is resolved by the policy, as
    stratum.operators.commit.resolved() does.
    """
    columns = [c for c in files.columns if c not in KEY]
    lists = updates.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("arrival", "device", F.struct(*columns).alias("row")))).alias("updates"))
    mine = files.select(*KEY, F.struct(*columns).alias("local"))
    kind = files.select(F.struct(*columns).alias("r")).schema["r"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    empty = F.array().cast(f"array<{kind}>")
    start = F.struct(
        F.col("local").alias("row"), F.lit(False).alias("changed"), F.array().cast(f"array<struct<arrival:bigint,row:{kind}>>").alias("staged"),
        empty.alias("copies"), F.lit(0).alias("invalid"), F.lit(0).cast("bigint").alias("arrival"),
    )

    def step(state: Column, u: Column) -> Column:
        own, new = state["row"], u["row"]
        relation = expr.vv_compare(own["version"], new["version"])
        bad = expr.name_error(F.col("name")).isNotNull() | expr.block_list_error(new["size"], new["blocks"]).isNotNull()
        fresh = own.isNull() | own["version"].isNull() | new["version"].isNull()
        outcome = (
            F.when(bad, "invalid").when(fresh, "need").when(relation.isin("Greater", "Equal"), "none").when(relation == "Invalid", "invalid")
            .when(relation == "Concurrent", "conflict").when(expr.blocks_equal(own["blocks"], new["blocks"]), "apply").otherwise("need")
        )
        if policy == "backup":
            local_wins = expr.conflict_winner(own["version"], own["deleted"], F.lit(local_device), new["version"], new["deleted"], u["device"]) == "a"
        else:
            local_wins = F.lit(False)

        def decided(o: Column) -> Column:
            takes = (o == "apply") | ((o == "conflict") & ~local_wins)
            loser = F.when(o == "conflict", F.when(local_wins, _carried(new, own)).otherwise(own)) if policy == "backup" else none
            return F.struct(
                F.when(takes, _carried(new, own)).otherwise(own).alias("row"), (state["changed"] | o.isin("apply", "conflict")).alias("changed"),
                F.when(o == "need", F.concat(state["staged"], F.array(F.struct(u["arrival"].alias("arrival"), new.alias("row"))))).otherwise(state["staged"]).alias("staged"),
                F.when(loser.isNotNull(), F.concat(state["copies"], F.array(loser))).otherwise(state["copies"]).alias("copies"),
                (state["invalid"] + F.when(o == "invalid", 1).otherwise(0)).alias("invalid"), u["arrival"].alias("arrival"),
            )

        return F.get(F.transform(F.array(outcome), decided), F.lit(0))

    def _carried(new: Column, own: Column) -> Column:
        return F.struct(*[carried(new["blocks"], own["blocks"]).alias(c) if c == "blocks" else new[c].alias(c) for c in columns])

    folded = lists.join(mine, KEY, "left").select(*KEY, F.aggregate("updates", start, step).alias("s"))
    return folded.select(*KEY, "s.row", "s.changed", "s.staged", "s.copies", "s.invalid", "s.arrival")


class Intake:
    """A foreachBatch sink that folds update batches into a table store, exactly once.

    The manifest that publishes a batch also records its number, so a batch that is replayed after a failure is passed over.
    It carries all tables the batch changes: files, their sequences and counters, what waits for blocks in the inbox (at the
    epoch of the writer), and the last sequence seen of each device. Changed rows are appended; a table of `generations`
    appended files is written anew, so that a batch costs what it changes and, one in so many, the table.
    """

    def __init__(self, store: TableStore, retries: int = 3, policy: str = "theirs", epoch: int = 0, generations: int = 16):
        self.store, self.retries, self.policy, self.epoch, self.generations = store, retries, policy, epoch, generations

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for attempt in range(self.retries):
                base = self.store.current()
                if base.cursors.get("intake", -1) >= number:
                    return
                try:
                    self._publish(base, batch, number)
                    return
                except Conflict:
                    if attempt + 1 == self.retries:
                        raise
        finally:
            batch.unpersist()

    def _publish(self, base, batch: DataFrame, number: int) -> None:
        read = lambda t: self.store.read(t, base)
        files = read("files")
        folded = self.store.scratch(fold(files, batch, self.policy))  # read three times below
        winners = folded.where("changed").select(*KEY, "arrival", F.lit(1).alias("part"), "row.*")
        copies = folded.select("folder", F.concat("name", F.lit(".sync-conflict")).alias("name"), "arrival", F.lit(0).alias("part"), F.explode("copies").alias("row"))
        last = copies.groupBy("folder", "name").agg(F.max_by("row", "arrival").alias("row"), F.max("arrival").alias("arrival"))
        rows = winners.unionByName(last.select(*KEY, "arrival", F.lit(0).alias("part"), "row.*"))
        staged = folded.select(*KEY, F.explode("staged").alias("u")).select("folder", F.lit(self.epoch).cast("long").alias("epoch"), "u.arrival", "name", "u.row.*")
        staged = staged.select(*read("inbox").columns)
        waiting = staged.groupBy("folder", "epoch", "name").agg(F.max_by(F.struct(*staged.columns), "arrival").alias("r")).select("r.*")
        seen = batch.where(F.col("device").isNotNull()).groupBy("folder", "device").agg(F.max("sequence").alias("seen"))
        peers = read("peers").join(seen, ["folder", "device"], "full_outer").select("folder", "device", F.greatest(F.coalesce("max_sequence", F.lit(0)), F.coalesce("seen", F.lit(0))).alias("max_sequence"))
        known = read("folder_meta").join(files.groupBy("folder").agg(F.max("sequence").alias("high")), "folder", "full_outer")
        meta = known.select("folder", F.greatest(F.coalesce("max_sequence", F.lit(0)), F.coalesce("high", F.lit(0))).alias("max_sequence"), "next_blockseq")
        out = commit(files, read("seqs"), meta, rows, ["part"])
        more = {"files": out["new_files"], "seqs": out["new_seqs"], "inbox": waiting, "block_refs": references(last.select(*KEY, "row.*"))}
        full = {t for t in more if len(base.tables.get(t, [])) >= self.generations}
        anew = {"files": out["files"], "seqs": out["seqs"]} | {t: _latest(read(t).unionByName(more[t]), t) for t in ("inbox", "block_refs")}
        changes = {t: anew[t] for t in full} | {"folder_meta": out["meta"], "peers": peers}
        self.store.commit(base, replace=changes, append={t: df for t, df in more.items() if t not in full}, cursors={"intake": number})


def _latest(rows: DataFrame, table: str) -> DataFrame:
    key, latest = LATEST[table]
    return rows.distinct() if latest is None else rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), latest).alias("r")).select("r.*")


def source(spark, path: str, schema: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """A stream of updates from files; max_files and max_bytes bound what a micro-batch takes, as a peer's pace would."""
    reader = spark.readStream.schema(schema)
    for name, value in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        reader = reader.option(name, value) if value is not None else reader
    return reader.parquet(path)


def start(source: DataFrame, store: TableStore, checkpoint: str, once: bool = False, policy: str = "theirs", generations: int = 16):
    """Run the intake over a streaming DataFrame of updates (the columns of files, arrival and device)."""
    writer = source.writeStream.foreachBatch(Intake(store, policy=policy, generations=generations)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def completion(blocks: DataFrame) -> DataFrame:
    """Stateful completion over a stream of (folder, name, version, hash, needed): rows of files whose blocks are all there.

    State is the set of hashes seen of the latest version of a file; another version starts anew.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        import pandas as pd

        version, seen, needed = state.get if state.exists else ("", [], 0)
        hashes = set(seen)
        for frame in frames:
            for row in frame.itertuples():
                if row.version != version:
                    version, hashes = row.version, set()
                hashes.add(row.hash)
                needed = int(row.needed)
        if len(hashes) >= needed:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"folder": [key[0]], "name": [key[1]], "version": [version], "blocks": [len(hashes)]})
        else:
            state.update((version, sorted(hashes), needed))

    return blocks.groupBy("folder", "name").applyInPandasWithState(
        step, "folder string, name string, version string, blocks long", "version string, seen array<string>, needed long", "append", GroupStateTimeout.NoTimeout
    )
