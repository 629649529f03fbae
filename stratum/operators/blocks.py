"""Blocks: storage plans, deduplication inside a folder, resolution, and what is live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import expr


def canonical_blocks(refs: DataFrame, ptrs: DataFrame, data: DataFrame) -> DataFrame:
    """For each hash of a folder the first user, in key order, whose directory has a pointer to a stored payload."""
    users = refs.select("folder", "hash", "name", expr.dirname(F.col("name")).alias("dir"))
    alive = ptrs.join(data.select("folder", "blockseq"), ["folder", "blockseq"], "left_semi")
    usable = users.join(alive, ["folder", "dir", "hash"])
    first = usable.groupBy("folder", "hash").agg(F.min_by(F.struct("name", "blockseq"), expr.name_key(F.col("name"))).alias("r"))
    return first.select("folder", "hash", "r.name", "r.blockseq")


def store_plan(needed: DataFrame, canonical: DataFrame, ptrs: DataFrame, below: int = expr.INLINE_BELOW) -> DataFrame:
    """What storing each needed block takes: inline, reuse (pointer in this directory), link (pointer elsewhere) or new."""
    found = canonical.select("folder", "hash", F.lit(True).alias("known"))
    here = ptrs.select("folder", "dir", "hash", F.lit(True).alias("here")).distinct()
    wanted = needed.withColumn("dir", expr.dirname(F.col("name")))
    joined = wanted.join(found, ["folder", "hash"], "left").join(here, ["folder", "dir", "hash"], "left")
    action = F.when(expr.is_inline(F.col("size"), below), "inline").when(F.col("known") & F.col("here"), "reuse").when(F.col("known"), "link").otherwise("new")
    return joined.select("folder", "name", "block_no", action.alias("action"))


def reusable_blocks(needed: DataFrame, canonical: DataFrame, below: int = expr.INLINE_BELOW) -> DataFrame:
    """Needed hashes that need no request."""
    large = needed.where(~expr.is_inline(F.col("size"), below)).select("folder", "hash").distinct()
    return large.join(canonical.select("folder", "hash"), ["folder", "hash"], "left_semi")


def blocks_to_fetch(needed: DataFrame, canonical: DataFrame, below: int = expr.INLINE_BELOW) -> DataFrame:
    """Needed hashes to ask a peer for: inline ones and those not stored."""
    known = canonical.select("folder", "hash", F.lit(True).alias("known"))
    joined = needed.select("folder", "hash", "size").distinct().join(known, ["folder", "hash"], "left")
    return joined.where(F.col("known").isNull() | expr.is_inline(F.col("size"), below)).select("folder", "hash")


def digests(data: DataFrame) -> DataFrame:
    """(folder, blockseq, stored_size, stored_hash): payloads reduced to numbers before any join."""
    return data.select("folder", "blockseq", F.octet_length("data").alias("stored_size"), F.sha2(F.col("data").cast("binary"), 256).alias("stored_hash"))


def resolve_blocks(blocks: DataFrame, data: DataFrame) -> DataFrame:
    """(folder, name, block_no, hash, size, deleted, is_inline, source, stored_size, stored_hash), the way readers resolve:
    the row's inline data first, then the payload of the row's number; invalid if that is too low, dangling without payload."""
    inline = F.col("inline_data").isNotNull()
    lean = blocks.select(
        "folder", "name", "block_no", "hash", "size", "deleted", "blockseq", inline.alias("is_inline"),
        F.octet_length("inline_data").alias("inline_size"), F.sha2(F.col("inline_data").cast("binary"), 256).alias("inline_hash"),
    )
    own = lean.join(digests(data), ["folder", "blockseq"], "left")
    low = F.col("blockseq") < expr.FIRST_BLOCKSEQ
    source = F.when(F.col("is_inline"), "inline").when(low, "invalid").when(F.col("stored_size").isNotNull(), "stored").otherwise("dangling")
    return own.withColumn("source", source).select(
        "folder", "name", "block_no", "hash", "size", "deleted", "is_inline", "source",
        F.when(F.col("is_inline"), F.col("inline_size")).when(~low, F.col("stored_size")).alias("stored_size"),
        F.when(F.col("is_inline"), F.col("inline_hash")).when(~low, F.col("stored_hash")).alias("stored_hash"),
    )


def read_block(blocks: DataFrame, data: DataFrame, wanted: DataFrame) -> DataFrame:
    """(folder, name, hash, bytes, error) for wanted (folder, name, hash): of the file's blocks of that hash the first that
    can be resolved; error says which of the rules hash length and not found applies."""
    found = blocks.join(wanted.select("folder", "name", "hash").distinct(), ["folder", "name", "hash"])
    held = _with_bytes(found, data).where(F.col("bytes").isNotNull())
    first = held.groupBy("folder", "name", "hash").agg(F.min_by("bytes", "block_no").alias("bytes"))
    error = F.when(F.length("hash") != expr.HASH_HEX, "hash length").when(F.col("bytes").isNull(), "not found")
    out = wanted.select("folder", "name", "hash").join(first, ["folder", "name", "hash"], "left")
    return out.select("folder", "name", "hash", F.when(error.isNull(), F.col("bytes")).alias("bytes"), error.alias("error"))


def _with_bytes(blocks: DataFrame, data: DataFrame) -> DataFrame:
    """Blocks with what they resolve to: inline data, else the payload of a valid number, else null."""
    own = blocks.join(data.select("folder", "blockseq", F.col("data").cast("binary").alias("payload")), ["folder", "blockseq"], "left")
    stored = F.when(F.col("blockseq") >= expr.FIRST_BLOCKSEQ, F.col("payload"))
    return own.withColumn("bytes", F.coalesce(F.col("inline_data").cast("binary"), stored)).drop("payload")


def has_block(wanted: DataFrame, refs: DataFrame, known: list[DataFrame] | None = None) -> DataFrame:
    """Wanted (folder, hash) that some file refers to and that every sweep under way knows to be live.

    known: for each sweep under way the (folder, hash) it keeps, blocks written since it began included.
    """
    out = wanted.join(refs, ["folder", "hash"], "left_semi")
    for live in known or []:
        out = out.join(live, ["folder", "hash"], "left_semi")
    return out


def has_inline_block(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Wanted (folder, name, hash) that the file's own row holds inline."""
    return wanted.join(blocks.where(F.col("inline_data").isNotNull()), ["folder", "name", "hash"], "left_semi")


def live_blocks(blocks: DataFrame, ptrs: DataFrame) -> DataFrame:
    """Distinct (folder, hash, blockseq) that any file, deleted ones included, uses."""
    return blocks.select("folder", "hash").distinct().join(ptrs.select("folder", "hash", "blockseq").distinct(), ["folder", "hash"])


def dedup_ratio(blocks: DataFrame) -> DataFrame:
    """Bytes as files count them and as they are stored, by folder: identical blocks of a folder are one."""
    per = blocks.groupBy("folder", "hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return per.groupBy("folder").agg(F.sum("n").alias("blocks"), F.count("*").alias("distinct_blocks"), F.sum(F.col("n") * F.col("size")).alias("logical_bytes"), F.sum("size").cast("long").alias("stored_bytes"))


def range_plan(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Blocks that byte ranges (folder, name, start, length) touch, with the bytes to skip and to take of each.

    An equi join on the file with the overlap as a residual, never a nested loop. Ranges are clamped to the file.
    """
    end = F.least(F.col("start") + F.col("length"), F.col("file_size"))
    hit = blocks.where(~F.col("deleted")).join(requests, ["folder", "name"]).where((F.col("offset") < end) & (F.col("offset") + F.col("size") > F.col("start")))
    skip = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    return hit.select("folder", "name", "block_no", "hash", skip.cast("long").alias("skip"), (F.least(end - F.col("offset"), F.col("size").cast("long")) - skip).cast("long").alias("take"))


def read_range(files: DataFrame, blocks: DataFrame, data: DataFrame, requests: DataFrame) -> DataFrame:
    """(folder, name, start, length, bytes, error) of byte ranges, clamped to the file; one row a request.

    error: not found (no such file, or deleted), or short block (one that cannot be resolved or is shorter than declared);
    bytes are null then. Payloads meet only blocks that a range touches.
    """
    asked = requests.select("folder", "name", "start", "length").distinct()
    live = files.where(~F.col("deleted")).select("folder", "name", F.lit(True).alias("there"))
    end = F.least(F.col("start") + F.col("length"), F.col("file_size"))
    hit = blocks.where(~F.col("deleted")).join(asked, ["folder", "name"]).where((F.col("offset") < end) & (F.col("offset") + F.col("size") > F.col("start")))
    skip = F.greatest(F.col("start") - F.col("offset"), F.lit(0)).cast("int")
    take = (F.least(end - F.col("offset"), F.col("size").cast("long")) - skip).cast("int")
    held = _with_bytes(hit, data)
    short = F.coalesce(F.octet_length("bytes") < F.col("size"), F.lit(True))
    piece = F.struct("block_no", F.substring(F.col("bytes"), skip + 1, take).alias("piece"))
    joined = F.aggregate(F.array_sort(F.collect_list(piece)), F.lit(b""), lambda a, p: F.concat(a, p["piece"]))
    read = held.withColumn("short", short).groupBy("folder", "name", "start", "length").agg(joined.alias("bytes"), F.bool_or("short").alias("short"))
    out = asked.join(live, ["folder", "name"], "left").join(read, ["folder", "name", "start", "length"], "left")
    error = F.when(F.col("there").isNull(), "not found").when(F.col("short"), "short block")
    return out.select("folder", "name", "start", "length", F.when(error.isNull(), F.coalesce("bytes", F.lit(b""))).alias("bytes"), error.alias("error"))
