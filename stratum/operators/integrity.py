"""Referential integrity in three levels, every rule a set operation; findings are (folder, rule, level, subject)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import expr
from stratum.operators.blocks import digests, resolve_blocks

LEVELS = {"quick": 0, "structural": 1, "full": 2}


def inbox_without_file(inbox: DataFrame) -> DataFrame:
    return inbox.where(F.col("sequence").isNull()).select("folder", F.col("name").alias("subject"))


def dangling_seqs(seqs: DataFrame, files: DataFrame) -> DataFrame:
    """Sequence entries whose file is missing."""
    return seqs.join(files, ["folder", "name"], "left_anti").select("folder", F.col("seq").cast("string").alias("subject"))


def mismatched_seqs(seqs: DataFrame, files: DataFrame) -> DataFrame:
    """Sequence entries whose file has another number."""
    joined = seqs.join(files.select("folder", "name", "sequence"), ["folder", "name"])
    return joined.where(F.col("seq") != F.col("sequence")).select("folder", F.col("seq").cast("string").alias("subject"))


def missing_seqs(files: DataFrame, seqs: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Files without an entry of their number; those below the pruned floor of their folder may lack one."""
    own = files.select("folder", "name", "sequence")
    if floors is not None:
        own = own.join(floors.select("folder", "floor"), "folder", "left").where(F.col("floor").isNull() | (F.col("sequence") >= F.col("floor")))
    entries = seqs.select("folder", "name", F.col("seq").alias("sequence"))
    return own.join(entries, ["folder", "name", "sequence"], "left_anti").select("folder", F.col("name").alias("subject"))


def negative_sequences(files: DataFrame) -> DataFrame:
    return files.where(F.col("sequence") < 0).select("folder", F.col("name").alias("subject"))


def low_counters(meta: DataFrame, used: DataFrame, column: str) -> DataFrame:
    """Folders whose stored counter is below a sequence in use, or negative; without a record the counter is 0."""
    high = used.groupBy("folder").agg(F.max(column).alias("high"))
    joined = meta.select("folder", "max_sequence").join(high, "folder", "full_outer")
    counter, reached = F.coalesce("max_sequence", F.lit(0)), F.coalesce("high", F.lit(0))
    return joined.where((counter < reached) | (counter < 0)).select("folder", reached.cast("string").alias("subject"))


def _live(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.col("deleted"))


def _block(name: str = "name"):
    return F.concat_ws("#", name, F.col("block_no").cast("string")).alias("subject")


def bad_hashes(blocks: DataFrame) -> DataFrame:
    return _live(blocks).where(F.length("hash") != expr.HASH_HEX).select("folder", _block())


def _checked(resolved: DataFrame) -> DataFrame:
    """Live blocks whose hash is one: the others are judged no further."""
    return _live(resolved).where(F.length("hash") == expr.HASH_HEX)


def unresolvable(resolved: DataFrame) -> DataFrame:
    return _checked(resolved).where(F.col("source").isin("dangling", "invalid")).select("folder", _block())


def wrong_sizes(resolved: DataFrame) -> DataFrame:
    return _checked(resolved).where(F.col("stored_size") != F.col("size")).select("folder", _block())


def wrong_checksums(resolved: DataFrame) -> DataFrame:
    return _checked(resolved).where(F.col("stored_hash") != F.col("hash")).select("folder", _block())


def block_findings(resolved: DataFrame) -> DataFrame:
    """(folder, rule, level, subject) of all rules over single blocks, in one pass over them."""
    sound = F.length("hash") == expr.HASH_HEX
    found = _rules(
        ("hash length", "structural", ~sound), ("unresolvable block", "structural", sound & F.col("source").isin("dangling", "invalid")),
        ("size mismatch", "full", sound & (F.col("stored_size") != F.col("size"))), ("checksum", "full", sound & (F.col("stored_hash") != F.col("hash"))),
    )
    return _live(resolved).select("folder", F.explode(found).alias("r"), _block()).select("folder", "r.rule", "r.level", "subject")


def pointer_findings(ptrs: DataFrame, data: DataFrame) -> DataFrame:
    """(folder, rule, level, subject) of all rules over single pointers and their payloads, in one pass."""
    joined = ptrs.join(digests(data), ["folder", "blockseq"], "left")
    found = _rules(
        ("block number", "structural", F.col("blockseq") < expr.FIRST_BLOCKSEQ), ("missing payload", "structural", F.col("stored_hash").isNull()),
        ("payload checksum", "full", F.col("stored_hash") != F.col("hash")),
    )
    subject = F.concat_ws("/", "dir", "hash").alias("subject")
    return joined.select("folder", F.explode(found).alias("r"), subject).select("folder", "r.rule", "r.level", "subject")


def _rules(*rules: tuple[str, str, Column]) -> Column:
    """The (rule, level) structs of a row whose condition holds."""
    made = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))) for rule, level, c in rules])
    return F.filter(made, lambda x: x.isNotNull())


def missing_refs(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """Blocks that are not inline and whose file is not among the users of their hash."""
    own = _checked(blocks).where(F.col("inline_data").isNull()).select("folder", "hash", "name", "block_no")
    return own.join(refs, ["folder", "hash", "name"], "left_anti").select("folder", _block())


def low_blockseqs(ptrs: DataFrame) -> DataFrame:
    return ptrs.where(F.col("blockseq") < expr.FIRST_BLOCKSEQ).select("folder", F.concat_ws("/", "dir", "hash").alias("subject"))


def missing_payloads(ptrs: DataFrame, data: DataFrame) -> DataFrame:
    return ptrs.join(data, ["folder", "blockseq"], "left_anti").select("folder", F.concat_ws("/", "dir", "hash").alias("subject"))


def wrong_payloads(ptrs: DataFrame, data: DataFrame) -> DataFrame:
    lean = data.select("folder", "blockseq", F.sha2(F.col("data").cast("binary"), 256).alias("stored_hash"))
    return ptrs.join(lean, ["folder", "blockseq"]).where(F.col("stored_hash") != F.col("hash")).select("folder", F.concat_ws("/", "dir", "hash").alias("subject"))


def missing_pointers(blocks: DataFrame, ptrs: DataFrame) -> DataFrame:
    """Blocks that the files of a directory use and that it has no pointer to; inline ones need none."""
    own = _checked(blocks).where(F.col("inline_data").isNull())
    expected = own.select("folder", expr.dirname(F.col("name")).alias("dir"), "hash").distinct()
    return expected.join(ptrs, ["folder", "dir", "hash"], "left_anti").select("folder", F.concat_ws("/", "dir", "hash").alias("subject"))


def malformed(table: DataFrame, rule: str, subject: str, *conditions: Column) -> DataFrame:
    """Rows of a record class that no writer makes: any condition holds, or is null."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(True)) for c in conditions])
    return table.where(bad).select("folder", F.lit(rule).alias("rule"), F.coalesce(F.col(subject).cast("string"), F.lit("")).alias("subject"))


def malformed_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """What typed tables can still hold of undecodable records: nulls where a record must have a value, bad names and keys,
    numbers out of range, keys that repeat. Tables: files, inbox, seqs, meta, peers, ptrs, data."""
    t, parts = tables, []

    def c(name: str) -> Column:
        return F.col(name)

    if "inbox" in t:
        parts.append(malformed(t["inbox"], "inbox key", "name", c("epoch").isNull() | (c("epoch") < 0), c("name").isNull(), expr.name_error(c("name")).isNotNull()))
    if "meta" in t:
        parts.append(malformed(t["meta"], "folder record", "max_sequence", c("max_sequence").isNull() | (c("max_sequence") < 0)))
        parts.append(_repeated(t["meta"], "folder record repeats", "folder"))
    if "peers" in t:
        parts.append(malformed(t["peers"], "peer record", "device", c("device").isNull(), c("max_sequence").isNull() | (c("max_sequence") < 0)))
        parts.append(_repeated(t["peers"], "peer record repeats", "device"))
    if "seqs" in t:
        parts.append(malformed(t["seqs"], "sequence key", "seq", c("seq").isNull() | (c("seq") < 0), c("name").isNull(), expr.name_error(c("name")).isNotNull()))
        parts.append(_repeated(t["seqs"], "sequence key repeats", "seq"))
    if "files" in t:
        parts.append(malformed(t["files"], "file record", "name", c("name").isNull(), expr.name_error(c("name")).isNotNull(), c("version").isNull(), c("size").isNull() | (c("size") < 0), c("deleted").isNull()))
        parts.append(_repeated(t["files"], "file record repeats", "name"))
    if "ptrs" in t:
        parts.append(malformed(t["ptrs"], "pointer key", "hash", c("dir").isNull(), ~F.coalesce(c("hash").rlike(expr.HASH_PATTERN), F.lit(False)), c("blockseq").isNull()))
    if "data" in t:
        parts.append(malformed(t["data"], "payload key", "blockseq", c("blockseq").isNull() | (c("blockseq") < expr.FIRST_BLOCKSEQ)))
        parts.append(_repeated(t["data"], "payload key repeats", "blockseq"))
    return reduce(DataFrame.unionByName, parts)


def _repeated(table: DataFrame, rule: str, key: str) -> DataFrame:
    keys = list(dict.fromkeys(["folder", key]))
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select("folder", F.lit(rule).alias("rule"), F.col(key).cast("string").alias("subject"))


def findings(tables: dict[str, DataFrame], level: str = "full") -> DataFrame:
    """All findings up to a level. Tables: files, inbox, seqs, meta, blocks, ptrs, refs, data; floors (the pruned floor of each
    folder) if sequences have been swept.

    Payloads are read and hashed once, before the shuffle that blocks and pointers share; a block's rules are one pass.
    """
    t = tables
    rules = [
        ("inbox", "quick", inbox_without_file(t["inbox"])),
        ("dangling sequence", "structural", dangling_seqs(t["seqs"], t["files"])),
        ("sequence mismatch", "structural", mismatched_seqs(t["seqs"], t["files"])),
        ("counter too low", "structural", low_counters(t["meta"], t["seqs"], "seq")),
        ("missing reference", "structural", missing_refs(t["blocks"], t["refs"])),
        ("missing pointer", "structural", missing_pointers(t["blocks"], t["ptrs"])),
        ("missing sequence", "full", missing_seqs(t["files"], t["seqs"], t.get("floors"))),
        ("negative sequence", "full", negative_sequences(t["files"])),
        ("counter below a file", "full", low_counters(t["meta"], t["files"], "sequence")),
    ]
    chosen = [df.select("folder", F.lit(rule).alias("rule"), F.lit(lv).alias("level"), "subject") for rule, lv, df in rules if LEVELS[lv] <= LEVELS[level]]
    if LEVELS[level]:
        passes = block_findings(resolve_blocks(t["blocks"], t["data"])).unionByName(pointer_findings(t["ptrs"], t["data"]))
        malformed_ = malformed_rows({k: t[k] for k in ("files", "seqs", "meta", "ptrs", "data")}).withColumn("level", F.lit("structural"))
        chosen.append(passes.unionByName(malformed_.select("folder", "rule", "level", "subject")).where(F.col("level").isin([k for k, v in LEVELS.items() if v <= LEVELS[level]])))
    return reduce(DataFrame.unionByName, chosen)


def passed(found: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, errors, ok) for every folder."""
    n = found.groupBy("folder").agg(F.count("*").alias("n"))
    errors = F.coalesce("n", F.lit(0)).cast("long")
    return folders.select("folder").distinct().join(n, "folder", "left").select("folder", errors.alias("errors"), (errors == 0).alias("ok"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("folder", "rule").agg(F.count("*").alias("n"))


#: Failures from the mildest to the gravest: what a connection's end is put down to when several workers failed.
GRAVITY = ("closed", "transient", "peer", "fatal")


def gravest(failures: DataFrame) -> DataFrame:
    """Of the failures (folder, error) of each folder the gravest."""
    rank = F.array_position(F.array(*map(F.lit, GRAVITY)), F.col("error"))
    return failures.groupBy("folder").agg(F.max_by("error", rank).alias("error"))
