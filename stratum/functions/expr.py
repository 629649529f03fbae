"""Names, keys, sizes, versions and validation as JVM column expressions; all of them stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks below this size live inside the file row; block numbers below FIRST_BLOCKSEQ are never given out.
INLINE_BELOW = 4096
FIRST_BLOCKSEQ = 1024
BLOCKSEQ_RESERVE = 256
MAX_BLOCK = 16 << 20
HASH_HEX = 64
# fixed values: kinds of errors
TRANSIENT = ("transient_io", "network_error")
FATAL = ("corruption", "internal", "unsupported_version")
PEER_FAULT = ("peer_bad_hello", "peer_bad_message", "peer_error")
HASH_PATTERN = "^[0-9a-f]{64}$"


def dirname(name: Column) -> Column:
    """What precedes the last slash; the root is empty."""
    return F.regexp_extract(name, "(?s)^(.*)/[^/]*$", 1)


def basename(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def join_name(directory: Column, base: Column) -> Column:
    return F.when(directory == "", base).otherwise(F.concat(directory, F.lit("/"), base))


def name_key(name: Column) -> Column:
    """Directory, two slashes, base name: the byte order in which rows of a folder are kept."""
    return F.concat(dirname(name), F.lit("//"), basename(name))


def file_key(name: Column) -> Column:
    return F.concat(F.lit("mn"), name_key(name))


def parse_file_key(key: Column) -> Column:
    """The name of a file key (split at the last double slash); null for other keys."""
    directory, base = (F.regexp_extract(key, "(?s)^mn(.*)//(.*)$", i) for i in (1, 2))
    return F.when(key.rlike("(?s)^mn.*//"), join_name(directory, base))


def seq_key(seq: Column) -> Column:
    """Sixteen hex digits, in the order of the numbers; null for negative ones, which are an error."""
    return F.when(seq >= 0, F.concat(F.lit("ms"), F.lpad(F.hex(seq), 16, "0")))


def parse_seq_key(key: Column) -> Column:
    return F.when(key.rlike("^ms[0-7][0-9A-F]{15}$"), F.conv(F.substring(key, 3, 16), 16, 10).cast("long"))


def is_inline(size: Column, below: int = INLINE_BELOW) -> Column:
    return (size >= 0) & (size < below)


def name_error(name: Column) -> Column:
    """The first rule that a file name breaks, or null."""
    parts = F.split(name, "/")
    first_bad = F.get(F.filter(parts, lambda p: (p == "") | (p == "..")), F.lit(0))
    return (
        F.when(name == "", "empty")
        .when(F.startswith(name, F.lit("/")), "absolute")
        .when(F.contains(name, F.lit("\0")), "null byte")
        .when(first_bad == "", "empty component")
        .when(first_bad == "..", "traversal")
    )


def block_list_error(size: Column, blocks: Column) -> Column:
    """The first rule that a file's block list breaks, in list order, or null.

    blocks: array of structs with hash (hex), offset and size. The list must cover the file without gaps; an empty one may
    belong to any size that is not negative.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("error"))

    def step(state: Column, block: Column) -> Column:
        found = (
            F.when(state["error"].isNotNull(), state["error"])
            .when(block["size"] <= 0, "block size")
            .when(block["size"] > MAX_BLOCK, "block too large")
            .when(F.length(block["hash"]) != HASH_HEX, "hash length")
            .when(block["offset"] != state["at"], "gap")
        )
        return F.struct((state["at"] + F.coalesce(block["size"], F.lit(0))).cast("long").alias("at"), found.alias("error"))

    def finish(state: Column) -> Column:
        return F.coalesce(state["error"], F.when((F.size(blocks) > 0) & (state["at"] != size), "coverage"))

    return F.when(size < 0, "negative size").otherwise(F.aggregate(blocks, start, step, finish))


def blocks_equal(a: Column, b: Column) -> Column:
    """Same hashes and sizes in the same order; offsets don't count."""
    slim = lambda c: F.transform(c, lambda x: F.struct(x["hash"], x["size"]))
    return slim(a) == slim(b)


def wire_type(code: Column) -> Column:
    """Wire enumeration to stored type: the symlink kinds become one, what is unknown counts as a file."""
    return F.when(code == 1, "DIRECTORY").when(code.isin(2, 3, 4), "SYMLINK").otherwise("FILE")


def size_bucket(size: Column) -> Column:
    """Histogram bucket of a length: powers of four from 16 bytes to 64 MiB, 14 buckets."""
    inner = (F.floor((F.floor(F.log2(size.cast("double"))) - 4) / 2) + 1).cast("int")
    return F.when(size < 16, 0).when(size >= 1 << 27, 13).otherwise(F.least(inner, F.lit(12)))


def base32_epoch(value: Column) -> Column:
    """Eight base-32 digits without I, L, O and U; null beyond 40 bits. Text order is number order."""
    text = F.translate(F.lpad(F.conv(value.cast("string"), 10, 32), 8, "0"), "IJKLMNOPQRSTUV", "JKMNPQRSTVWXYZ")
    return F.when((value >= 0) & (value < 1 << 40), text)


def parse_base32_epoch(text: Column) -> Column:
    """The number of eight such digits, with or without '.json' behind; null for anything else."""
    bare = F.regexp_replace(text, r"\.json$", "")
    number = F.conv(F.translate(bare, "JKMNPQRSTVWXYZ", "IJKLMNOPQRSTUV"), 32, 10).cast("long")
    return F.when(bare.rlike("^[0-9A-HJKMNP-TV-Z]{8}$"), number)


def folder_storage_key(key: Column) -> Column:
    return F.concat(F.lit("folder_"), base32_epoch(key))


def snapshot_dir(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH-mm")


def relative_under(directory: str, name: Column) -> Column:
    """The part of a name below a directory; null outside it."""
    if not directory:
        return name
    return F.when(F.startswith(name, F.lit(directory + "/")), F.substring(name, len(directory) + 2, 1 << 30))


def modified_nanos(ns: Column) -> Column:
    return F.greatest(ns, F.lit(0))


def expiry(modified: Column, duration_s: Column) -> Column:
    """Microseconds of a time of expiry; the greatest long where the sum is beyond it."""
    top = F.lit(2**63 - 1)
    wide = modified.cast("decimal(38,0)") + duration_s.cast("decimal(38,0)") * 1_000_000
    return F.when(wide > top, top).otherwise(wide.cast("long"))


def modified_time(seconds: Column, ns: Column) -> Column:
    """Microseconds since the epoch of a file's time, negative nanoseconds counting as 0; null beyond what a timestamp holds."""
    wide = seconds.cast("decimal(38,0)") * 1_000_000 + F.floor(F.greatest(ns, F.lit(0)) / 1000)
    return F.when(F.abs(wide) <= 2**63 - 1, wide.cast("long"))


def error_class(error: Column) -> Column:
    """What an error means for a connection: transient (tried again), fatal (the process ends), peer (its fault) or other."""
    return F.when(error.isin(*TRANSIENT), "transient").when(error.isin(*FATAL), "fatal").when(error.isin(*PEER_FAULT), "peer").otherwise("other")


def protocol_error(error: Column) -> Column:
    """The protocol's error for one of the storage: what is missing counts as corrupt, bad input as a bad message."""
    return F.when(error == "not_found", "corruption").when(error == "invalid_input", "peer_bad_message").otherwise(error)


def answer_code(error: Column) -> Column:
    """The code with which a request is answered after a storage error; null is none."""
    return F.when(error.isNull(), "NO_ERROR").when(error == "not_found", "NO_SUCH_FILE").otherwise("GENERIC")


def seek(position: Column, size: Column, whence: Column, offset: Column) -> Column:
    """Where a file handle stands after a seek from start, end or current; null for a place before the start."""
    target = F.when(whence == "start", offset).when(whence == "end", size + offset).otherwise(position + offset)
    return F.when(target >= 0, target)


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "on", "yes", "y")


def backoff_seconds(attempt: Column, base: float = 1.0, cap: float = 60.0, most: int = 10) -> Column:
    """Delay before a retry of a transient failure: doubling, capped; null once there have been `most`."""
    return F.when(attempt < most, F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap)))


# --- version vectors: arrays of (id, value) ---


def vv_total(version: Column) -> Column:
    return F.aggregate(version, F.lit(0).cast("decimal(38,0)"), lambda n, c: (n + c["value"]).cast("decimal(38,0)"))


def vv_has_duplicates(version: Column) -> Column:
    ids = F.transform(version, lambda c: c["id"])
    return F.size(ids) != F.size(F.array_distinct(ids))


def vv_compare(a: Column, b: Column) -> Column:
    """Equal, Greater, Less or Concurrent; a counter that is absent is 0. 'Invalid' if an id repeats on either side."""
    zero = F.lit(0).cast("decimal(20,0)")

    def value(version: Column, counter: Column) -> Column:
        return F.coalesce(F.get(F.filter(version, lambda c: c["id"] == counter), F.lit(0))["value"], zero)

    ids = F.array_union(F.transform(a, lambda c: c["id"]), F.transform(b, lambda c: c["id"]))
    above = F.exists(ids, lambda i: value(a, i) > value(b, i))
    below = F.exists(ids, lambda i: value(a, i) < value(b, i))
    return (
        F.when(vv_has_duplicates(a) | vv_has_duplicates(b), "Invalid")
        .when(above & below, "Concurrent")
        .when(above, "Greater")
        .when(below, "Less")
        .otherwise("Equal")
    )


def conflict_winner(a: Column, a_deleted: Column, a_device: Column, b: Column, b_deleted: Column, b_device: Column) -> Column:
    """'a' or 'b': the larger total wins, then the one that is not deleted, then the larger device id; ties go to b."""
    total_a, total_b = vv_total(a), vv_total(b)
    return (
        F.when(total_a > total_b, "a")
        .when(total_a < total_b, "b")
        .when(~a_deleted & b_deleted, "a")
        .when(a_deleted & ~b_deleted, "b")
        .when(a_device > b_device, "a")
        .otherwise("b")
    )
