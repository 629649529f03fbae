"""The data model of the engine, derived deterministically from the tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import expr
from stratum.operators.numbering import hash_bucket, numbered

#: Here blocks below 512 bytes are inline, so that both ways of keeping blocks occur.
INLINE, CHUNK, EPOCH = 512, 1024, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counters(*values: Column) -> Column:
    return F.array(*[F.struct(F.lit(i + 1).cast("decimal(20,0)").alias("id"), v.cast("decimal(20,0)").alias("value")) for i, v in enumerate(values)])


def file_name(doc: Column) -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/d"), (doc % 7).cast("string"), F.lit("/doc"), doc.cast("string"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One row a document; the text itself only if asked for."""
    doc = F.col("doc_id")
    out = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("folder"), file_name(doc).alias("name"), "doc_id", (doc + 1).alias("sequence"), (doc % 17 == 0).alias("deleted"),
        F.octet_length("text").cast("long").alias("size"), (doc + 1_700_000_000).alias("modified_s"), (doc * 37 % 1000 - 3).cast("int").alias("modified_ns"),
        counters(1 + doc % 5, doc % 3, F.lit(0)).alias("version"), (doc % 6).cast("int").alias("type_code"), "text",
    )
    return out if text else out.drop("text")


def blocks(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    """One row a block of 1024 characters, with its offset in bytes. Texts are cut and the offsets summed up within their rows,
    in time that grows with the text, so blocks need no shuffle and no row carries more than its piece."""
    source = files(spark, sf_dir, text=True)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<chunk:string,offset:bigint>>").alias("list"))

    def add(state: Column, chunk: Column) -> Column:
        entry = F.struct(chunk.alias("chunk"), state["at"].alias("offset"))
        return F.struct((state["at"] + F.octet_length(chunk)).alias("at"), F.concat(state["list"], F.array(entry)).alias("list"))

    listed = F.aggregate(pieces, start, add)["list"]
    out = source.select("folder", "name", "doc_id", "deleted", F.col("size").alias("file_size"), F.posexplode(listed).alias("block_no", "b"))
    chunk = F.col("b.chunk")
    out = out.select("folder", "name", "doc_id", "deleted", "file_size", "block_no", chunk.alias("chunk"), F.sha2(chunk, 256).alias("hash"), F.octet_length(chunk).cast("int").alias("size"), "b.offset")
    return out if payload else out.drop("chunk")


def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as file rows have them: small ones with their data, others with their number.

    Faults by hash: b1 wrong inline data, b2 neither data nor number, d7 a number without payload, d8 one too low.
    """
    starts = lambda h: F.startswith("hash", F.lit(h))
    all_ = blocks(spark, sf_dir, payload=True).join(block_numbers(spark, sf_dir), ["folder", "hash"], "left")
    inline = F.when(expr.is_inline(F.col("size"), INLINE) & ~starts("b2"), F.concat("chunk", F.when(starts("b1"), "!").otherwise("")).cast("binary"))
    number = F.when(starts("d8"), F.lit(7)).when(starts("d7"), F.col("blockseq") + 10_000_000).otherwise(F.col("blockseq"))
    stored = F.when(~expr.is_inline(F.col("size"), INLINE), number).cast("long")
    return all_.withColumns({"inline_data": inline, "blockseq": stored}).drop("chunk")


def file_rows(spark: SparkSession, sf_dir: str, bare: bool = False) -> DataFrame:
    """Files with their blocks as a list; bare ones have neither data nor numbers, as a peer announces them."""
    entry = F.struct("block_no", "hash", "offset", "size", "blockseq", "inline_data")
    lists = file_blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("listed"))

    def plain(b: Column) -> Column:
        seq, inline = (F.lit(None).cast("long"), F.lit(None).cast("binary")) if bare else (b["blockseq"], b["inline_data"])
        return F.struct(b["hash"].alias("hash"), b["offset"].alias("offset"), b["size"].alias("size"), seq.alias("blockseq"), inline.alias("inline_data"))

    none = F.expr("from_json('[]', 'array<struct<hash:string,offset:bigint,size:int,blockseq:bigint,inline_data:binary>>')")
    return files(spark, sf_dir).join(lists, "doc_id", "left").withColumn("blocks", F.coalesce(F.transform("listed", plain), none)).drop("listed")


def block_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blocks) in list order; documents without a block are absent."""
    entry = F.struct("block_no", "hash", "offset", "size")
    lists = blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("blocks"))
    return lists.select("doc_id", F.transform("blocks", lambda b: F.struct(b["hash"].alias("hash"), b["offset"].alias("offset"), b["size"].alias("size"))).alias("blocks"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a peer announces: even documents, some under new names, a third with other contents."""
    doc = F.col("doc_id")
    return files(spark, sf_dir).where(doc % 2 == 0).select(
        "folder", F.when(doc % 11 == 0, F.concat("name", F.lit(".new"))).otherwise(F.col("name")).alias("name"), "doc_id", "size", "deleted", "sequence",
        counters(1 + doc * 3 % 5, doc * 7 % 3, F.when(doc % 4 == 0, 1).otherwise(0)).alias("version"), (doc % 3 == 0).alias("changed"), (doc % 12).alias("device"),
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    out = table(spark, sf_dir, "events").groupBy(_event_folder(), (user % 12).alias("device")).agg(F.max("event_id").alias("max_sequence"))
    return out.withColumn("max_sequence", F.when(F.col("device") == 6, 0).otherwise(F.col("max_sequence")).cast("long"))


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return files(spark, sf_dir).where(doc % 13 == 0).withColumns({"epoch": (1 + doc % 3).cast("long"), "arrival": doc * 7919 % 1009, "missing": doc % 2})


def seqs(spark: SparkSession, sf_dir: str, clean: bool = False) -> DataFrame:
    """Sequence to name; unless clean, some rows are missing, dangle or carry another number."""
    doc, source = F.col("doc_id"), files(spark, sf_dir)
    if clean:
        return source.select("folder", F.col("sequence").alias("seq"), "name")
    name = F.when(doc % 89 == 0, F.concat("name", F.lit(".gone"))).otherwise(F.col("name"))
    seq = F.col("sequence") + F.when(doc % 83 == 0, 1_000_000).otherwise(0)
    return source.where(doc % 97 != 0).select("folder", seq.cast("long").alias("seq"), name.alias("name"))


def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks too large to be inline, of all files."""
    return blocks(spark, sf_dir).where(~expr.is_inline(F.col("size"), INLINE))


def block_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, hash, blockseq): distinct blocks in the order of their hashes."""
    distinct = stored_blocks(spark, sf_dir).select("folder", "hash").distinct()
    placed = numbered(distinct, "folder", hash_bucket(F.col("hash")), ["hash"])
    return placed.select("folder", "hash", (F.col("place") + expr.FIRST_BLOCKSEQ - 1).alias("blockseq"))


def block_ptrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = stored_blocks(spark, sf_dir).select("folder", expr.dirname(F.col("name")).alias("dir"), "hash").distinct()
    return used.join(block_numbers(spark, sf_dir), ["folder", "hash"]).select("folder", "dir", "hash", "blockseq")


def block_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names use a hash; rows of hashes that begin 00 are lost."""
    return stored_blocks(spark, sf_dir).where(~F.startswith("hash", F.lit("00"))).select("folder", "hash", "name").distinct()


def block_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads; those of hashes that begin ff are lost, those of ab have a byte too many."""
    chunks = blocks(spark, sf_dir, payload=True).where(~expr.is_inline(F.col("size"), INLINE)).where(~F.startswith("hash", F.lit("ff")))
    data = F.concat("chunk", F.when(F.startswith("hash", F.lit("ab")), "x").otherwise(""))
    once = chunks.groupBy("folder", "hash").agg(F.min(data).alias("data"))
    return once.join(block_numbers(spark, sf_dir), ["folder", "hash"]).select("folder", "blockseq", "hash", "data")


def folder_of_user() -> Column:
    return F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("user_id") % 4 + 1).cast("int"))


def _event_folder() -> Column:
    return folder_of_user().alias("folder")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly ones kept for a day and daily ones kept for a week, from the events of each folder."""
    events = table(spark, sf_dir, "events")
    parts = []
    for name, unit, hours in (("1h", "hour", 24), ("1day", "day", 168)):
        last = events.groupBy(_event_folder(), F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("slot")).agg(F.max("ts").cast("timestamp").alias("create_time"))
        parts.append(last.select("folder", F.lit(name).alias("name"), "create_time", (F.col("create_time") + F.make_dt_interval(hours=F.lit(hours))).alias("expire_time")))
    return parts[0].unionByName(parts[1])


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("now"))


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on the lock of a folder and hour, one an event; epochs follow the events."""
    event, user = F.col("event_id"), F.col("user_id")
    late = F.make_dt_interval(hours=F.when(event % 11 == 0, 2).otherwise(0))
    lock = F.concat(folder_of_user(), F.lit("@"), F.date_format("ts", "yyyy-MM-dd HH")).alias("lock")
    return table(spark, sf_dir, "events").select(
        lock, event.alias("epoch"), F.concat(F.lit("h"), (user % 5).cast("string")).alias("holder"), (user % 3).alias("priority"),
        (60 * (1 + event % 5)).alias("duration_s"), (F.col("ts").cast("timestamp") + late).alias("last_modified"),
    )
