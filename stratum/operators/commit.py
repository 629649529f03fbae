"""The write half: what commits, promotions, stored blocks and resolved conflicts make of the tables.

File rows carry blocks as array<struct<hash, offset, size, blockseq, inline_data>>. Each function returns the tables it
changes, whole; a store publishes them together, or none (see stratum.sources.tables).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import expr
from stratum.operators.blocks import canonical_blocks
from stratum.operators.numbering import arrival_bucket, hash_bucket, numbered

KEY = ["folder", "name"]


def carried(blocks: Column, old: Column) -> Column:
    """Blocks, those without data and number with what the first of the old blocks with their hash has that has any."""
    known = F.filter(old, lambda o: o["blockseq"].isNotNull() | o["inline_data"].isNotNull())

    def fill(b: Column) -> Column:
        bare = b["blockseq"].isNull() & b["inline_data"].isNull()
        found = F.get(F.filter(known, lambda o: o["hash"] == b["hash"]), F.lit(0))
        kept = lambda c: F.when(bare, found[c]).otherwise(b[c]).alias(c)
        return F.struct(b["hash"].alias("hash"), b["offset"].alias("offset"), b["size"].alias("size"), kept("blockseq"), kept("inline_data"))

    return F.when(old.isNull(), blocks).otherwise(F.transform(blocks, fill))


def carry(rows: DataFrame, old: DataFrame) -> DataFrame:
    """Rows with what the blocks of the committed rows of their names hand down."""
    joined = rows.join(old.select(*KEY, F.col("blocks").alias("__old")), KEY, "left")
    return joined.select(*[carried(F.col("blocks"), F.col("__old")).alias(c) if c == "blocks" else F.col(c) for c in rows.columns])


def references(rows: DataFrame) -> DataFrame:
    """(folder, hash, name) of the blocks of rows that have a number: what a row under a new name adds to the references."""
    listed = rows.select(*KEY, F.explode("blocks").alias("b")).where("b.blockseq is not null")
    return listed.select("folder", "b.hash", "name").distinct()


def commit(files: DataFrame, seqs: DataFrame, meta: DataFrame, staged: DataFrame, order: list[str] | None = None) -> dict[str, DataFrame]:
    """files, seqs and meta after the staged rows, one a name, are committed in the order of arrival (and `order`); new_files
    and new_seqs are what a store that keeps the latest row of a name has to add to its own.

    Each takes the next sequence of its folder and carries pointers from the row it replaces, whose sequence entry goes;
    the folder's counter rises to its last sequence. Rows that stay keep all they have.
    """
    placed = numbered(carry(staged, files), "folder", arrival_bucket(F.col("arrival")), ["arrival", *(order or []), "name"])
    base = meta.select("folder", F.coalesce("max_sequence", F.lit(0)).alias("__high"))
    fresh = placed.join(base, "folder", "left").withColumn("sequence", F.coalesce("__high", F.lit(0)) + F.col("place")).select(*files.columns)
    names = staged.select(*KEY)
    entries = fresh.select("folder", F.col("sequence").alias("seq"), "name")
    used = placed.groupBy("folder").agg(F.count("*").alias("__n"))
    high = (F.coalesce("max_sequence", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long")
    counters = meta.join(used, "folder", "full_outer").select(*[high.alias(c) if c == "max_sequence" else F.col(c) for c in meta.columns])
    after = {"files": files.join(names, KEY, "left_anti").unionByName(fresh), "seqs": seqs.join(names, KEY, "left_anti").unionByName(entries), "meta": counters}
    return after | {"new_files": fresh, "new_seqs": entries}


def promote(inbox: DataFrame, files: DataFrame, seqs: DataFrame, meta: DataFrame, completions: DataFrame) -> dict[str, DataFrame]:
    """inbox, files, seqs and meta after completions (folder, epoch, name, version), and `blocked`.

    A completion counts if a row is staged under its key with its version. If all blocks of that row, with what the
    committed row hands down, can be resolved, it leaves the inbox and is committed; else it stays and is listed in blocked
    with the number of missing blocks.
    """
    want = completions.select("folder", "epoch", "name", F.col("version").alias("__version"))
    met = inbox.join(want, ["folder", "epoch", "name"]).where(F.col("version").eqNullSafe(F.col("__version"))).drop("__version")
    carried = carry(met, files)
    missing = F.size(F.filter("blocks", lambda b: b["blockseq"].isNull() & b["inline_data"].isNull()))
    judged = carried.withColumn("missing", F.when(F.col("deleted"), 0).otherwise(missing))
    ready = judged.where("missing = 0").drop("missing")
    out = commit(files, seqs, meta, ready)
    out["inbox"] = inbox.join(ready.select("folder", "epoch", "name"), ["folder", "epoch", "name"], "left_anti")
    out["blocked"] = judged.where("missing > 0").select("folder", "epoch", "name", "missing")
    return out


def store(rows: DataFrame, refs: DataFrame, ptrs: DataFrame, data: DataFrame, meta: DataFrame, incoming: DataFrame, below: int = expr.INLINE_BELOW) -> dict[str, DataFrame]:
    """files (or inbox) rows, refs, ptrs, data and meta after blocks (folder, name, hash, data) have come in, and `errors`.

    Data shorter than `below` goes into the row, at every block of its hash. Other data takes the number of the folder's
    first user of the hash if that is stored, else a new one in the order of hashes; its directory gets a pointer and its
    name a reference. Blocks whose hash the row does not list, or whose row is missing, are errors (not found).
    """
    listed = rows.select(*KEY, F.explode("blocks").alias("b")).select(*KEY, F.col("b.hash").alias("hash")).distinct()
    got = incoming.groupBy(*KEY, "hash").agg(F.min(F.col("data").cast("binary")).alias("data"))
    errors = got.join(listed, [*KEY, "hash"], "left_anti").select(*KEY, "hash", F.lit("not found").alias("error"))
    got = got.join(listed, [*KEY, "hash"], "left_semi")
    inline = expr.is_inline(F.octet_length("data"), below)
    large = got.where(~inline).select(*KEY, "hash", expr.dirname(F.col("name")).alias("dir"), "data")
    known = canonical_blocks(refs, ptrs, data).select("folder", "hash", F.col("blockseq").alias("__known"))
    payloads = large.groupBy("folder", "hash").agg(F.min("data").alias("data")).join(known, ["folder", "hash"], "left")
    new = numbered(payloads.where("__known is null").drop("__known"), "folder", hash_bucket(F.col("hash")), ["hash"])
    counter = meta.select("folder", F.greatest(F.coalesce("next_blockseq", F.lit(0)), F.lit(expr.FIRST_BLOCKSEQ)).alias("__next"))
    first = F.coalesce("__next", F.lit(expr.FIRST_BLOCKSEQ))
    new = new.join(counter, "folder", "left").select("folder", "hash", (first + F.col("place") - 1).cast("long").alias("blockseq"), "data")
    numbers = payloads.where("__known is not null").select("folder", "hash", F.col("__known").alias("blockseq")).unionByName(new.select("folder", "hash", "blockseq"))
    placed = large.select(*KEY, "hash", "dir").join(numbers, ["folder", "hash"])
    more = placed.select("folder", "dir", "hash", "blockseq").distinct().join(ptrs, ["folder", "dir", "hash"], "left_anti")
    users = placed.select("folder", "hash", "name").join(refs, ["folder", "hash", "name"], "left_anti")

    each = got.where(inline).select(*KEY, "hash", F.lit(None).cast("long").alias("blockseq"), F.col("data").alias("inline_data"))
    each = each.unionByName(placed.select(*KEY, "hash", "blockseq", F.lit(None).cast("binary").alias("inline_data")))
    lists = each.groupBy(*KEY).agg(F.collect_list(F.struct("hash", "blockseq", "inline_data")).alias("__new"))

    def fill(b: Column) -> Column:
        n = F.get(F.filter("__new", lambda x: x["hash"] == b["hash"]), F.lit(0))
        kept = lambda c: F.when(n.isNull(), b[c]).otherwise(n[c]).alias(c)
        return F.struct(b["hash"].alias("hash"), b["offset"].alias("offset"), b["size"].alias("size"), kept("blockseq"), kept("inline_data"))

    joined = rows.join(lists, KEY, "left")
    filled = F.when(F.col("__new").isNull(), F.col("blocks")).otherwise(F.transform("blocks", fill))
    step = F.lit(expr.BLOCKSEQ_RESERVE)
    used = new.groupBy("folder").agg(F.count("*").alias("__n")).join(counter, "folder", "left")
    used = used.select("folder", (first + step * F.ceil(F.col("__n") / step)).cast("long").alias("__high"))
    counters = meta.join(used, "folder", "full_outer").select(*[F.coalesce("__high", c).alias(c) if c == "next_blockseq" else F.col(c) for c in meta.columns])
    return {
        "rows": joined.select(*[filled.alias(c) if c == "blocks" else F.col(c) for c in rows.columns]),
        "refs": refs.select("folder", "hash", "name").unionByName(users), "ptrs": ptrs.select("folder", "dir", "hash", "blockseq").unionByName(more),
        "data": data.select("folder", "blockseq", F.col("data").cast("binary").alias("data")).unionByName(new.select("folder", "blockseq", "data")), "meta": counters, "errors": errors,
    }


def resolved(local: DataFrame, remote: DataFrame, policy: str = "theirs", local_device: int = 0) -> DataFrame:
    """What to commit of updates whose versions are concurrent with the local row's: remote rows with a column part.

    theirs: the remote row always wins, the local one is dropped. backup: the larger total of counters wins, then what is
    not deleted, then the larger device, then the remote; the loser is committed first (part 0), as name.sync-conflict,
    then the winner (part 1). Both keep their own versions; the copy inherits what the local row has for its blocks.
    """
    columns = remote.columns
    mine = local.select(*KEY, F.struct(*[c for c in local.columns if c not in KEY]).alias("__l"))
    both = remote.join(mine, KEY).where(expr.vv_compare(F.col("__l.version"), F.col("version")) == "Concurrent")
    if policy == "theirs":
        winner = F.lit("b")
    elif policy == "backup":
        winner = expr.conflict_winner(F.col("__l.version"), F.col("__l.deleted"), F.lit(local_device), F.col("version"), F.col("deleted"), F.col("device"))
    else:
        raise ValueError(f"unknown policy: {policy}")
    both = both.withColumn("__winner", winner)
    fields = set(local.columns)

    def side(wins: bool) -> list[Column]:
        """The columns of the winner or of the loser; what only updates have stays the update's."""
        ours = F.col("__winner") == ("a" if wins else "b")
        return [F.when(ours, F.col(f"__l.{c}")).otherwise(F.col(c)).alias(c) if c in fields and c not in KEY else F.col(c) for c in columns]

    out = both.select(*side(True), F.lit(1).alias("part"))
    if policy == "theirs":
        return out
    lost = both.select(*side(False), F.col("__l.blocks").alias("__old"), F.lit(0).alias("part")) if "blocks" in fields else both.select(*side(False), F.lit(0).alias("part"))
    losers = lost.select(*[carried(F.col("blocks"), F.col("__old")).alias(c) if c == "blocks" else F.col(c) for c in columns], "part")
    return losers.withColumn("name", F.concat("name", F.lit(".sync-conflict"))).unionByName(out)
