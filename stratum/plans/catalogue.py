"""Every query of the library by name, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import device_id as device_ids
from stratum.functions import expr
from stratum.operators import blocks as block_ops
from stratum.operators import collection, commit, index, intake, integrity, leases, snapshots, versions
from stratum.plans.oracle import with_fixtures
from stratum.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SINCE, DIRECTORY = 500, "src1/en"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL over the fixtures if SQL can express it."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = with_fixtures(sql)
        return function

    return add


# --- index ---


@query("SELECT folder, name, sequence, deleted, size FROM files")
def full_index(spark, d):
    return index.full_index(fx.files(spark, d)).select("folder", "name", "sequence", "deleted", "size")


@query("SELECT s.folder, s.seq, f.name, f.size FROM seqs s JOIN files f ON s.folder = f.folder AND s.name = f.name WHERE s.seq > 500")
def delta_index(spark, d):
    return index.delta_index(fx.files(spark, d), fx.seqs(spark, d), SINCE).select("folder", "seq", "name", "size")


@query("SELECT folder, name, sequence, size, deleted FROM files WHERE folder = 'en' AND name LIKE 'src1/en/d0/%'")
def file_lookup(spark, d):
    return fx.files(spark, d).where((F.col("folder") == "en") & F.startswith("name", F.lit("src1/en/d0/"))).select("folder", "name", "sequence", "size", "deleted")


@query("""SELECT f.folder, f.name, coalesce(i.sequence, f.sequence) AS sequence, i.name IS NOT NULL AS is_inbox
    FROM files f LEFT JOIN (SELECT * FROM inbox WHERE epoch = 3) i ON f.folder = i.folder AND f.name = i.name""")
def effective_entry(spark, d):
    return index.effective_entries(fx.files(spark, d), fx.inbox(spark, d), fx.EPOCH)


@query("SELECT folder, max(sequence) AS max_sequence FROM files GROUP BY folder UNION ALL SELECT 'empty', 0")
def local_sequence(spark, d):
    files = fx.files(spark, d)
    folders = files.select("folder").distinct().unionByName(spark.createDataFrame([("empty",)], "folder string"))
    return index.local_sequence(folders, files)


@query("SELECT DISTINCT folder, 'Folder ' || folder AS label FROM files")
def list_folders(spark, d):
    return fx.files(spark, d).select("folder").distinct().select("folder", F.concat(F.lit("Folder "), "folder").alias("label")).orderBy("folder")


@query("SELECT folder, floor FROM floors")
def peer_floor(spark, d):
    return index.peer_floor(fx.peers(spark, d))


@query("SELECT folder, count(*) AS n_files, greatest(max(sequence), 0) AS last_sequence FROM files GROUP BY folder")
def index_message(spark, d):
    return index.index_message(fx.files(spark, d))


@query("SELECT DISTINCT folder FROM files WHERE folder IN (SELECT folder FROM peers) AND folder <> 'en'")
def new_mutual_folders(spark, d):
    shared = fx.files(spark, d).select("folder").distinct()
    return index.new_mutual_folders(shared, fx.peers(spark, d), spark.createDataFrame([("en",)], "folder string"))


@query("SELECT DISTINCT lang AS folder, 'L-' || lang AS label, lang NOT IN ('en', 'de') AS created FROM documents")
def ensure_folders(spark, d):
    proposed = fx.files(spark, d).select("folder", F.concat(F.lit("L-"), "folder").alias("label")).distinct()
    return index.ensure_folders(proposed, spark.createDataFrame([("en",), ("de",)], "folder string"))


@query("SELECT f.folder, 3 AS device, coalesce(p.max_sequence, 0) AS max_sequence FROM (SELECT DISTINCT folder FROM files) f LEFT JOIN peers p ON f.folder = p.folder AND p.device = 3")
def remote_state(spark, d):
    return index.remote_state(fx.peers(spark, d), fx.files(spark, d).select("folder", F.lit(3).alias("device")).distinct())


@query("""SELECT folder, device, max_sequence FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS folder, user_id % 12 AS device,
    event_id * 31 % 1000 AS max_sequence, row_number() OVER (PARTITION BY user_id % 4, user_id % 12 ORDER BY event_id DESC) AS place FROM events) WHERE place = 1""")
def remote_state_last_write(spark, d):
    states = fx.table(spark, d, "events").select(fx._event_folder(), (F.col("user_id") % 12).alias("device"), (F.col("event_id") * 31 % 1000).alias("max_sequence"), F.col("event_id").alias("arrival"))
    return index.last_write(states)


# --- names and keys ---


@query("SELECT name, regexp_extract(name, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(name, '([^/]*)$', 1) AS base FROM files")
def split_name(spark, d):
    name = F.col("name")
    return fx.files(spark, d).select("name", expr.dirname(name).alias("dir"), expr.basename(name).alias("base"))


@query("SELECT name, 'mn' || regexp_extract(name, '^(.*)/[^/]*$', 1) || '//' || regexp_extract(name, '([^/]*)$', 1) AS key, name AS parsed FROM files")
def file_keys(spark, d):
    keyed = fx.files(spark, d).select("name", expr.file_key(F.col("name")).alias("key"))
    return keyed.withColumn("parsed", expr.parse_file_key(F.col("key")))


@query("SELECT sequence, 'ms' || lpad(upper(printf('%x', sequence)), 16, '0') AS key, sequence AS parsed FROM files")
def seq_keys(spark, d):
    keyed = fx.files(spark, d).select("sequence", expr.seq_key(F.col("sequence")).alias("key"))
    return keyed.withColumn("parsed", expr.parse_seq_key(F.col("key")))


_BAD = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/' || name WHEN 2 THEN replace(name, '/d', '//d') WHEN 3 THEN '../' || name WHEN 4 THEN name || '/' ELSE name END"


@query(f"""SELECT doc_id, CASE WHEN n = '' THEN 'empty' WHEN n LIKE '/%' THEN 'absolute' WHEN n LIKE '../%' THEN 'traversal'
    WHEN n LIKE '%//%' OR n LIKE '%/' THEN 'empty component' END AS error FROM (SELECT doc_id, {_BAD} AS n FROM files)""")
def validate_names(spark, d):
    return fx.files(spark, d).withColumn("n", F.expr(_BAD)).select("doc_id", expr.name_error(F.col("n")).alias("error"))


@query("SELECT doc_id, CASE WHEN type_code = 1 THEN 'DIRECTORY' WHEN type_code IN (2, 3, 4) THEN 'SYMLINK' ELSE 'FILE' END AS type FROM files")
def type_mapping(spark, d):
    return fx.files(spark, d).select("doc_id", expr.wire_type(F.col("type_code")).alias("type"))


@query("SELECT folder, count(*) AS blocks, sum(CASE WHEN size < 512 THEN 1 ELSE 0 END)::BIGINT AS inline_blocks FROM blocks GROUP BY folder")
def inline_split(spark, d):
    return fx.blocks(spark, d).groupBy("folder").agg(F.count("*").alias("blocks"), F.count_if(expr.is_inline(F.col("size"), fx.INLINE)).alias("inline_blocks"))


@query("SELECT doc_id, modified_s, greatest(modified_ns, 0) AS ns FROM files")
def modified_times(spark, d):
    return fx.files(spark, d).select("doc_id", "modified_s", expr.modified_nanos(F.col("modified_ns")).alias("ns"))


_DIGITS = " || ".join(f"substring('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(v // {32**i} % 32 AS INTEGER) + 1, 1)" for i in range(7, -1, -1))


@query(f"SELECT event_id, {_DIGITS} AS text, v AS back FROM (SELECT event_id, event_id * 104729 AS v FROM events)")
def base32_encode(spark, d):
    coded = fx.table(spark, d, "events").select("event_id", expr.base32_epoch(F.col("event_id") * 104729).alias("text"))
    return coded.withColumn("back", expr.parse_base32_epoch(F.concat("text", F.lit(".json"))))


_SIGNS = " || ".join(f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substring(h, {5 * (i // 4) + 1}, 5))::BIGINT // {32 ** (3 - i % 4)}) % 32 AS INTEGER) + 1, 1)" for i in range(52))
_CHECK = "(32 - (" + " + ".join(f"((strpos(a, substring(g, {i + 1}, 1)) - 1) * {1 + i % 2}) // 32 + ((strpos(a, substring(g, {i + 1}, 1)) - 1) * {1 + i % 2}) % 32" for i in range(13)) + ") % 32) % 32"


@query(f"""SELECT event_id, array_to_string([substring(t, 7 * i + 1, 7) FOR i IN range(8)], '-') AS text, raw AS parsed FROM (SELECT event_id, raw, string_agg(g || substring(a, CAST({_CHECK} AS INTEGER) + 1, 1), '' ORDER BY k) AS t
    FROM (SELECT event_id, raw, k, substring(b, 13 * CAST(k AS INTEGER) + 1, 13) AS g, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM (SELECT event_id, raw, {_SIGNS} AS b FROM
    (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS raw, sha256(CAST(event_id AS VARCHAR)) || '0' AS h FROM events)), range(4) AS r(k)) GROUP BY event_id, raw)""")
def device_id_text(spark, d):
    made = fx.table(spark, d, "events").select("event_id", device_ids.device_id_text(F.unhex(F.sha2(F.col("event_id").cast("string"), 256))).alias("text"))
    return made.withColumn("parsed", F.lower(F.hex(device_ids.device_id_bytes(F.lower("text"))["raw"])))


@query("SELECT attempt, CASE WHEN attempt < 10 THEN least(pow(2, attempt), 60.0) END AS delay FROM range(12) AS t(attempt)")
def backoff_schedule(spark, d):
    return spark.range(12).select(F.col("id").alias("attempt"), expr.backoff_seconds(F.col("id")).alias("delay"))


@query("SELECT size, CAST(CASE WHEN size < 16 THEN 0 WHEN size >= 134217728 THEN 13 ELSE least(floor((floor(log2(size)) - 4) / 2) + 1, 12) END AS INTEGER) AS bucket FROM (SELECT DISTINCT size FROM files)")
def size_buckets(spark, d):
    return fx.files(spark, d).select("size").distinct().select("size", expr.size_bucket(F.col("size")).alias("bucket"))


# --- versions ---


@query("SELECT folder, name, relation FROM pairs")
def vv_compare(spark, d):
    return versions.compare_versions(fx.files(spark, d), fx.updates(spark, d))


@query("SELECT doc_id, CAST(l1 + l2 + l3 AS BIGINT) AS total FROM files")
def vv_total(spark, d):
    return fx.files(spark, d).select("doc_id", expr.vv_total(F.col("version")).cast("long").alias("total"))


@query("SELECT doc_id, doc_id % 4 = 0 AS duplicates FROM files")
def vv_duplicates(spark, d):
    again = F.when(F.col("doc_id") % 4 == 0, F.concat("version", F.slice("version", 1, 1))).otherwise(F.col("version"))
    return fx.files(spark, d).select("doc_id", expr.vv_has_duplicates(again).alias("duplicates"))


@query("""SELECT folder, name, CASE WHEN lt > rt THEN 'local' WHEN lt < rt THEN 'remote' WHEN NOT deleted AND rdeleted THEN 'local' WHEN deleted AND NOT rdeleted THEN 'remote'
    WHEN 0 > device THEN 'local' ELSE 'remote' END AS winner, name || '.sync-conflict' AS loser_name FROM pairs WHERE relation = 'Concurrent'""")
def conflict_winner(spark, d):
    return versions.conflict_winners(fx.files(spark, d), fx.updates(spark, d))


@query("""SELECT c.folder, c.copy_name, b.block_no, n.blockseq FROM (SELECT folder, name, name || '.sync-conflict' AS copy_name FROM pairs WHERE relation = 'Concurrent') c
    JOIN stored b ON c.folder = b.folder AND c.name = b.name JOIN numbers n ON b.folder = n.folder AND b.hash = n.hash""")
def conflict_copy(spark, d):
    losers = versions.conflict_winners(fx.files(spark, d), fx.updates(spark, d))
    old = fx.stored_blocks(spark, d).join(fx.block_numbers(spark, d), ["folder", "hash"])
    new = fx.stored_blocks(spark, d).select("folder", "name", "block_no", "hash", F.lit(None).cast("long").alias("blockseq"))
    carried = intake.carry_pointers(new, old)
    return losers.join(carried, ["folder", "name"]).select("folder", F.col("loser_name").alias("copy_name"), "block_no", "blockseq")


@query("""SELECT u.folder, u.name, CASE WHEN p.name IS NULL THEN 'NeedBlocks' WHEN relation IN ('Greater', 'Equal') THEN 'NoAction' WHEN relation = 'Concurrent' THEN 'Concurrent'
    WHEN NOT u.changed THEN 'Applied' ELSE 'NeedBlocks' END AS outcome FROM updates u LEFT JOIN pairs p ON u.folder = p.folder AND u.name = p.name""")
def apply_update_outcome(spark, d):
    return versions.apply_update_outcome(fx.files(spark, d), fx.updates(spark, d), ~F.col("changed"))


@query("SELECT a.doc_id, length(a.text) = length(b.text) AND a.text = b.text AS equal FROM files a JOIN files b ON a.doc_id = b.doc_id + 1")
def blocks_equal(spark, d):
    lists = fx.block_lists(spark, d)
    after = lists.select((F.col("doc_id") + 1).alias("doc_id"), F.col("blocks").alias("other"))
    return lists.join(after, "doc_id").select("doc_id", expr.blocks_equal(F.col("blocks"), F.col("other")).alias("equal"))


@query("""SELECT doc_id, CASE WHEN kind = 1 THEN 'negative size' WHEN kind = 2 THEN 'coverage' WHEN kind = 3 AND n > 1 THEN 'gap' WHEN kind = 4 THEN 'hash length'
    WHEN kind = 5 THEN 'block size' WHEN kind = 6 THEN 'block too large' END AS error FROM (SELECT doc_id, doc_id % 8 AS kind, count(*) AS n FROM blocks GROUP BY doc_id)""")
def validate_blocks(spark, d):
    kind = F.col("doc_id") % 8
    joined = fx.block_lists(spark, d).join(fx.files(spark, d).select("doc_id", "size"), "doc_id")
    size = F.when(kind == 1, -1).when(kind == 2, F.col("size") + 1).otherwise(F.col("size"))
    spoilt = F.transform("blocks", lambda b: F.struct(
        F.when(kind == 4, F.substring(b["hash"], 1, 40)).otherwise(b["hash"]).alias("hash"), b["offset"].alias("offset"),
        F.when(kind == 5, 0).when(kind == 6, expr.MAX_BLOCK + 1).otherwise(b["size"]).alias("size"),
    ))
    listed = F.when(kind == 3, F.reverse("blocks")).otherwise(spoilt)
    return joined.select("doc_id", expr.block_list_error(size, listed).alias("error"))


# --- intake ---


@query("SELECT folder, epoch, name, max_by(sequence, arrival) AS sequence, max(arrival) AS arrival FROM (SELECT folder, epoch, name, sequence, arrival FROM inbox UNION ALL SELECT folder, epoch, name, sequence + 7, arrival + 1 FROM inbox WHERE doc_id % 2 = 0) GROUP BY folder, epoch, name")
def inbox_lww(spark, d):
    staged = fx.inbox(spark, d).select("folder", "epoch", "name", "sequence", "arrival", "doc_id")
    again = staged.where("doc_id % 2 = 0").withColumns({"sequence": F.col("sequence") + 7, "arrival": F.col("arrival") + 1})
    return intake.inbox_last_write(staged.unionByName(again))


def _completions(spark, d):
    """What peers report complete: a third with an outdated version."""
    other = fx.counters(F.lit(99), F.lit(0), F.lit(0))
    return intake.promotable(fx.inbox(spark, d), fx.inbox(spark, d).withColumn("version", F.when(F.col("doc_id") % 3 == 1, other).otherwise(F.col("version"))))


@query("SELECT folder, epoch, name FROM inbox WHERE doc_id % 3 <> 1 AND missing = 0")
def promote_ready(spark, d):
    return _completions(spark, d).where("ready").select("folder", "epoch", "name")


@query("SELECT folder, epoch, name, missing FROM inbox WHERE doc_id % 3 <> 1 AND missing > 0")
def promote_blocked(spark, d):
    return _completions(spark, d).where("NOT ready").select("folder", "epoch", "name", "missing")


@query("""SELECT folder, name, sequence, false AS committed FROM files f WHERE NOT EXISTS (SELECT 1 FROM inbox i WHERE i.folder = f.folder AND i.name = f.name)
    UNION ALL SELECT i.folder, i.name, m.high + row_number() OVER (PARTITION BY i.folder ORDER BY i.arrival, i.name), true
    FROM inbox i JOIN (SELECT folder, max(sequence) AS high FROM files GROUP BY folder) m ON i.folder = m.folder""")
def commit_upsert(spark, d):
    return intake.commit_upsert(fx.files(spark, d), fx.inbox(spark, d))


@query("SELECT folder, count(*) AS dropped FROM inbox WHERE epoch < 3 GROUP BY folder")
def inbox_gc(spark, d):
    return intake.expired_inbox(fx.inbox(spark, d), fx.EPOCH)


@query("""SELECT folder, hash, CASE WHEN folder = 'en' THEN 5000 ELSE 1024 END + row_number() OVER (PARTITION BY folder ORDER BY hash) - 1 AS blockseq
    FROM (SELECT DISTINCT folder, hash FROM stored)""")
def blockseq_assign(spark, d):
    meta = spark.createDataFrame([("en", 5000), ("de", 3)], "folder string, next_blockseq long")
    return intake.assign_blockseqs(fx.stored_blocks(spark, d), meta)


@query("""SELECT folder, CAST(CASE WHEN folder = 'en' THEN 5000 ELSE 1024 END + 256 * ceil(count(*) / 256.0) AS BIGINT) AS next_blockseq
    FROM (SELECT DISTINCT folder, hash FROM stored) GROUP BY folder""")
def blockseq_reserve(spark, d):
    meta = spark.createDataFrame([("en", 5000), ("de", 3)], "folder string, next_blockseq long")
    return intake.reserved_blockseq(intake.assign_blockseqs(fx.stored_blocks(spark, d), meta), meta)


@query("""SELECT b.folder, b.name, b.block_no, b.hash, CASE WHEN b.doc_id % 2 = 0 AND o.old IS NOT NULL THEN o.old WHEN b.doc_id % 2 = 1 THEN CAST(7 AS BIGINT) END AS blockseq FROM stored b
    LEFT JOIN (SELECT folder, name, hash, min(2000 + block_no) AS old FROM stored WHERE block_no % 3 <> 1 GROUP BY folder, name, hash) o
    ON b.folder = o.folder AND b.name = o.name AND b.hash = o.hash""")
def carry_pointers(spark, d):
    stored = fx.stored_blocks(spark, d)
    old = stored.withColumn("blockseq", F.when(F.col("block_no") % 3 != 1, F.lit(2000).cast("long") + F.col("block_no")))
    new = stored.withColumn("blockseq", F.when(F.col("doc_id") % 2 == 1, F.lit(7).cast("long")))
    return intake.carry_pointers(new, old)


@query("""SELECT b.folder, b.name, count(*) AS needed, count(p.hash) AS stored, count(*) = count(p.hash) AS complete FROM stored b
    LEFT JOIN payloads p ON b.folder = p.folder AND b.hash = p.hash GROUP BY b.folder, b.name""")
def completion_state(spark, d):
    return intake.completion_state(fx.stored_blocks(spark, d), fx.block_data(spark, d))


@query("SELECT doc_id AS id, name, CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 5 = 0 THEN 'peer error' ELSE 'stored' END AS state FROM files")
def match_responses(spark, d):
    requests = fx.files(spark, d).select(F.col("doc_id").alias("id"), "name")
    answers = requests.where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, 2).otherwise(0).alias("code"))
    return intake.match_responses(requests, answers)


@query("SELECT doc_id + 1000000 AS id FROM files WHERE doc_id % 4 = 0")
def unknown_responses(spark, d):
    requests = fx.files(spark, d).select(F.col("doc_id").alias("id"), "name")
    answers = requests.select((F.col("id") + F.when(F.col("id") % 4 == 0, 1_000_000).otherwise(0)).alias("id"))
    return intake.unknown_responses(requests, answers)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 OR doc_id % 10 = 7 THEN 'GENERIC' WHEN doc_id % 9 = 0 OR deleted THEN 'NO_SUCH_FILE' ELSE 'NO_ERROR' END AS code FROM files""")
def request_codes(spark, d):
    doc = F.col("doc_id")
    asked = fx.files(spark, d).select(
        doc.alias("id"), "folder", F.when(doc % 9 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"),
        F.when(doc % 10 == 3, -1).otherwise(0).alias("offset"), F.when(doc % 10 == 7, -1).otherwise(100).alias("length"),
    )
    return intake.request_codes(asked, fx.files(spark, d))


# --- blocks ---


def _needed(spark, d):
    """All blocks, those of a fifth of the documents changed."""
    return fx.blocks(spark, d).withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("hash", F.lit("!")), 256)).otherwise(F.col("hash")))


_NEEDED = "(SELECT folder, name, block_no, size, CASE WHEN doc_id % 5 = 0 THEN sha256(hash || '!') ELSE hash END AS hash, regexp_extract(name, '^(.*)/[^/]*$', 1) AS dir FROM blocks)"


def _canonical(spark, d):
    return block_ops.canonical_blocks(fx.block_refs(spark, d), fx.block_ptrs(spark, d), fx.block_data(spark, d))


@query(f"""SELECT n.folder, n.name, n.block_no, CASE WHEN n.size < 512 THEN 'inline' WHEN c.hash IS NOT NULL AND p.hash IS NOT NULL THEN 'reuse' WHEN c.hash IS NOT NULL THEN 'link' ELSE 'new' END AS action
    FROM {_NEEDED} n LEFT JOIN canonical c ON n.folder = c.folder AND n.hash = c.hash LEFT JOIN ptrs p ON n.folder = p.folder AND n.dir = p.dir AND n.hash = p.hash""")
def store_blocks_plan(spark, d):
    return block_ops.store_plan(_needed(spark, d), _canonical(spark, d), fx.block_ptrs(spark, d), fx.INLINE)


@query(f"SELECT DISTINCT n.folder, n.hash FROM {_NEEDED} n JOIN canonical c ON n.folder = c.folder AND n.hash = c.hash WHERE n.size >= 512")
def reusable_blocks(spark, d):
    return block_ops.reusable_blocks(_needed(spark, d), _canonical(spark, d), fx.INLINE)


@query(f"SELECT DISTINCT n.folder, n.hash FROM {_NEEDED} n LEFT JOIN canonical c ON n.folder = c.folder AND n.hash = c.hash WHERE n.size < 512 OR c.hash IS NULL")
def blocks_to_fetch(spark, d):
    return block_ops.blocks_to_fetch(_needed(spark, d), _canonical(spark, d), fx.INLINE)


@query("SELECT folder, hash, name, blockseq FROM canonical")
def canonical_block(spark, d):
    return _canonical(spark, d)


@query("SELECT folder, name, block_no, source, CAST(stored_size AS BIGINT) AS stored_size, stored_hash FROM resolved")
def resolve_blocks(spark, d):
    out = block_ops.resolve_blocks(fx.file_blocks(spark, d), fx.block_data(spark, d))
    return out.select("folder", "name", "block_no", "source", F.col("stored_size").cast("long").alias("stored_size"), "stored_hash")


@query("""SELECT folder, name, hash, CASE WHEN error IS NULL THEN content END AS content, error FROM (SELECT w.folder, w.name, w.hash, min(b.content) AS content,
    CASE WHEN length(w.hash) <> 64 THEN 'hash length' WHEN min(b.content) IS NULL THEN 'not found' END AS error
    FROM (SELECT DISTINCT folder, name, CASE WHEN doc_id % 9 = 0 THEN substring(hash, 1, 9) ELSE hash END AS hash FROM blocks) w
    LEFT JOIN (SELECT r.folder, r.name, r.hash, coalesce(r.inline_data, CASE WHEN r.blockseq >= 1024 THEN p.data END) AS content FROM fileblocks r
    LEFT JOIN payloads p ON r.folder = p.folder AND r.blockseq = p.blockseq) b ON w.folder = b.folder AND w.name = b.name AND w.hash = b.hash GROUP BY w.folder, w.name, w.hash)""")
def read_block(spark, d):
    cut = F.when(F.col("doc_id") % 9 == 0, F.substring("hash", 1, 9)).otherwise(F.col("hash")).alias("hash")
    wanted = fx.blocks(spark, d).select("folder", "name", cut).distinct()
    out = block_ops.read_block(fx.file_blocks(spark, d), fx.block_data(spark, d), wanted)
    return out.select("folder", "name", "hash", F.decode("bytes", "UTF-8").alias("content"), "error")


@query("SELECT DISTINCT folder, name, hash FROM fileblocks WHERE inline_data IS NOT NULL")
def has_inline_block(spark, d):
    stored = fx.file_blocks(spark, d)
    return block_ops.has_inline_block(stored.select("folder", "name", "hash").distinct(), stored)


@query("""SELECT f.folder, f.name, CAST(700 AS BIGINT) AS start, CAST(1000 AS BIGINT) AS length, CASE WHEN NOT f.deleted AND NOT coalesce(r.short, false) THEN sha256(encode(f.text)[701:1700]) END AS sha,
    CASE WHEN f.deleted THEN 'not found' WHEN r.short THEN 'short block' END AS error FROM files f LEFT JOIN (SELECT b.folder, b.name, bool_or(r.stored_size IS NULL OR r.stored_size < r.size) AS short
    FROM fileblocks b JOIN resolved r ON b.folder = r.folder AND b.name = r.name AND b.block_no = r.block_no WHERE b.start < least(1700, b.file_size) AND b.start + b.size > 700 GROUP BY b.folder, b.name) r
    ON f.folder = r.folder AND f.name = r.name""")
def read_ranges(spark, d):
    asked = fx.files(spark, d).select("folder", "name", F.lit(700).cast("long").alias("start"), F.lit(1000).cast("long").alias("length"))
    out = block_ops.read_range(fx.files(spark, d), fx.file_blocks(spark, d), fx.block_data(spark, d), asked)
    return out.select("folder", "name", "start", "length", F.sha2("bytes", 256).alias("sha"), "error")


@query(f"SELECT DISTINCT n.folder, n.hash FROM {_NEEDED} n JOIN refs r ON n.folder = r.folder AND n.hash = r.hash")
def has_block(spark, d):
    return block_ops.has_block(_needed(spark, d).select("folder", "hash").distinct(), fx.block_refs(spark, d))


def _live(spark, d):
    """Live blocks once every other deleted file has lost its row."""
    return block_ops.live_blocks(fx.blocks(spark, d).where("NOT (deleted AND doc_id % 2 = 0)"), fx.block_ptrs(spark, d))


@query("SELECT folder, hash, blockseq FROM live")
def live_blocks(spark, d):
    return _live(spark, d)


@query("""SELECT folder, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS distinct_blocks, CAST(sum(n * size) AS BIGINT) AS logical_bytes, CAST(sum(size) AS BIGINT) AS stored_bytes
    FROM (SELECT folder, hash, count(*) AS n, max(size) AS size FROM blocks GROUP BY folder, hash) GROUP BY folder""")
def dedup_ratio(spark, d):
    return block_ops.dedup_ratio(fx.blocks(spark, d))


@query("""SELECT folder, name, block_no, hash, CAST(greatest(700 - start, 0) AS BIGINT) AS skip,
    CAST(least(least(1700, file_size) - start, size) - greatest(700 - start, 0) AS BIGINT) AS take FROM blocks WHERE NOT deleted AND start < least(1700, file_size) AND start + size > 700""")
def range_read_plan(spark, d):
    asked = fx.files(spark, d).select("folder", "name", F.lit(700).cast("long").alias("start"), F.lit(1000).cast("long").alias("length"))
    return block_ops.range_plan(fx.blocks(spark, d), asked)


# --- integrity ---


def _tables(spark, d):
    files = fx.files(spark, d)
    meta = files.where("folder <> 'fr'").groupBy("folder").agg(F.max("sequence").alias("max_sequence"))
    broken = fx.inbox(spark, d).withColumn("sequence", F.when(F.col("doc_id") % 4 != 0, F.col("sequence")))
    ptrs = fx.block_ptrs(spark, d)
    low = ptrs.withColumn("blockseq", F.when(F.startswith("hash", F.lit("cd")), 5).otherwise(F.col("blockseq")).cast("long"))
    return {"files": files, "inbox": broken, "seqs": fx.seqs(spark, d), "meta": meta, "blocks": fx.file_blocks(spark, d), "ptrs": ptrs, "low": low, "refs": fx.block_refs(spark, d), "data": fx.block_data(spark, d)}


def _resolved(t):
    return block_ops.resolve_blocks(t["blocks"], t["data"])


@query("SELECT folder, name AS subject FROM inbox WHERE doc_id % 4 = 0")
def fsck_inbox(spark, d):
    return integrity.inbox_without_file(_tables(spark, d)["inbox"])


@query("SELECT folder, CAST(seq AS VARCHAR) AS subject FROM seqs s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.folder = s.folder AND f.name = s.name)")
def fsck_dangling_seq(spark, d):
    t = _tables(spark, d)
    return integrity.dangling_seqs(t["seqs"], t["files"])


@query("SELECT s.folder, CAST(s.seq AS VARCHAR) AS subject FROM seqs s JOIN files f ON f.folder = s.folder AND f.name = s.name WHERE s.seq <> f.sequence")
def fsck_seq_mismatch(spark, d):
    t = _tables(spark, d)
    return integrity.mismatched_seqs(t["seqs"], t["files"])


@query("SELECT folder, name AS subject FROM files f WHERE NOT EXISTS (SELECT 1 FROM seqs s WHERE f.folder = s.folder AND f.name = s.name AND f.sequence = s.seq)")
def fsck_missing_seq(spark, d):
    t = _tables(spark, d)
    return integrity.missing_seqs(t["files"], t["seqs"])


@query("""SELECT s.folder, CAST(s.high AS VARCHAR) AS subject FROM (SELECT folder, max(seq) AS high FROM seqs GROUP BY folder) s
    LEFT JOIN meta m ON m.folder = s.folder WHERE s.high > coalesce(m.max_sequence, 0)""")
def fsck_max_sequence(spark, d):
    t = _tables(spark, d)
    return integrity.low_counters(t["meta"], t["seqs"], "seq")


@query("""SELECT s.folder, CAST(s.high AS VARCHAR) AS subject FROM (SELECT folder, max(sequence) AS high FROM files GROUP BY folder) s
    LEFT JOIN (SELECT folder, CASE WHEN folder = 'de' THEN max_sequence - 1 ELSE max_sequence END AS max_sequence FROM meta) m ON m.folder = s.folder WHERE s.high > coalesce(m.max_sequence, 0)""")
def fsck_max_file_sequence(spark, d):
    t = _tables(spark, d)
    meta = t["meta"].withColumn("max_sequence", F.col("max_sequence") - F.when(F.col("folder") == "de", 1).otherwise(0))
    return integrity.low_counters(meta, t["files"], "sequence")


@query("SELECT folder, name AS subject FROM files WHERE doc_id % 23 = 0")
def fsck_negative_sequence(spark, d):
    sequence = F.when(F.col("doc_id") % 23 == 0, -F.col("sequence")).otherwise(F.col("sequence"))
    return integrity.negative_sequences(fx.files(spark, d).withColumn("sequence", sequence))


@query("""SELECT f.folder, f.name AS subject FROM files f LEFT JOIN floors l ON f.folder = l.folder WHERE (l.floor IS NULL OR f.sequence >= l.floor // 20)
    AND NOT EXISTS (SELECT 1 FROM (SELECT s.* FROM seqs s LEFT JOIN floors l ON s.folder = l.folder WHERE l.floor IS NULL OR s.seq >= l.floor // 20) s WHERE f.folder = s.folder AND f.name = s.name AND f.sequence = s.seq)""")
def fsck_missing_seq_swept(spark, d):
    """After a sweep, files below the floor may lack their entry."""
    t, floors = _tables(spark, d), _floors(spark, d)
    return integrity.missing_seqs(t["files"], collection.keep_seqs(t["seqs"], floors), floors)


@query("""SELECT folder, 'file record' AS rule, CASE WHEN doc_id % 31 = 1 THEN '/' || name WHEN doc_id % 31 = 2 THEN '' ELSE name END AS subject FROM files WHERE doc_id % 31 IN (1, 2, 3, 4, 5)
    UNION ALL SELECT folder, 'file record repeats', name FROM files WHERE doc_id % 31 = 6
    UNION ALL SELECT folder, 'file record repeats', '' FROM files WHERE doc_id % 31 = 2 GROUP BY folder HAVING count(*) > 1
    UNION ALL SELECT folder, 'sequence key', CAST(CASE WHEN doc_id % 37 = 1 THEN -sequence ELSE sequence END AS VARCHAR) FROM files WHERE doc_id % 37 IN (1, 2)
    UNION ALL SELECT folder, 'sequence key repeats', CAST(sequence AS VARCHAR) FROM files WHERE doc_id % 37 = 3
    UNION ALL SELECT folder, 'inbox key', CASE WHEN doc_id % 4 = 1 THEN name || '/..' ELSE name END FROM inbox WHERE doc_id % 4 IN (0, 1)
    UNION ALL SELECT folder, 'folder record', '-1' FROM meta WHERE folder = 'de' UNION ALL SELECT folder, 'folder record repeats', folder FROM meta WHERE folder = 'en'
    UNION ALL SELECT folder, 'peer record', CAST(device AS VARCHAR) FROM peers WHERE device = 5 UNION ALL SELECT folder, 'peer record repeats', CAST(device AS VARCHAR) FROM peers WHERE device = 7
    UNION ALL SELECT folder, 'pointer key', substring(hash, 1, 40) FROM ptrs WHERE hash LIKE 'e0%'
    UNION ALL SELECT folder, 'payload key', CAST(blockseq - 1000000 AS VARCHAR) FROM payloads WHERE hash LIKE 'e1%' UNION ALL SELECT folder, 'payload key repeats', CAST(blockseq AS VARCHAR) FROM payloads WHERE hash LIKE 'e2%'""")
def fsck_malformed(spark, d):
    """Records that no writer makes, of every class."""
    t, doc = _tables(spark, d), F.col("doc_id")

    def twice(df, condition):
        return df.unionByName(df.where(condition))

    n = doc % 31
    files = t["files"].withColumns({
        "name": F.when(n == 1, F.concat(F.lit("/"), "name")).when(n == 2, "").otherwise(F.col("name")),
        "size": F.when(n == 3, -1).otherwise(F.col("size")), "version": F.when(n != 4, F.col("version")), "deleted": F.when(n != 5, F.col("deleted")),
    })
    seqs = fx.files(spark, d).select("folder", "doc_id", F.when(doc % 37 == 1, -F.col("sequence")).otherwise(F.col("sequence")).alias("seq"), F.when(doc % 37 != 2, F.col("name")).alias("name"))
    inbox = fx.inbox(spark, d).withColumns({"epoch": F.when(doc % 4 == 0, -1).otherwise(F.col("epoch")), "name": F.when(doc % 4 == 1, F.concat("name", F.lit("/.."))).otherwise(F.col("name"))})
    meta = twice(t["meta"].withColumn("max_sequence", F.when(F.col("folder") == "de", -1).otherwise(F.col("max_sequence"))), "folder = 'en'")
    peers = twice(fx.peers(spark, d).withColumn("max_sequence", F.when(F.col("device") != 5, F.col("max_sequence"))), "device = 7")
    ptrs = t["ptrs"].withColumn("hash", F.when(F.startswith("hash", F.lit("e0")), F.substring("hash", 1, 40)).otherwise(F.col("hash")))
    data = twice(t["data"].withColumn("blockseq", F.col("blockseq") - F.when(F.startswith("hash", F.lit("e1")), 1_000_000).otherwise(0)), "hash LIKE 'e2%'")
    return integrity.malformed_rows({"files": twice(files, n == 6), "seqs": twice(seqs, doc % 37 == 3), "inbox": inbox, "meta": meta, "peers": peers, "ptrs": ptrs, "data": data})


@query("SELECT folder, name || '#' || block_no AS subject FROM blocks WHERE NOT deleted AND hash LIKE 'ee%'")
def fsck_bad_hash_len(spark, d):
    cut = F.when(F.startswith("hash", F.lit("ee")), F.substring("hash", 1, 40)).otherwise(F.col("hash"))
    return integrity.bad_hashes(fx.blocks(spark, d).withColumn("hash", cut))


@query("SELECT folder, name || '#' || block_no AS subject FROM resolved WHERE NOT deleted AND source IN ('dangling', 'invalid')")
def fsck_unresolvable(spark, d):
    return integrity.unresolvable(_resolved(_tables(spark, d)))


@query("SELECT folder, name || '#' || block_no AS subject FROM resolved WHERE NOT deleted AND stored_size <> size")
def fsck_size_mismatch(spark, d):
    return integrity.wrong_sizes(_resolved(_tables(spark, d)))


@query("SELECT folder, name || '#' || block_no AS subject FROM resolved WHERE NOT deleted AND stored_hash <> hash")
def fsck_checksum(spark, d):
    return integrity.wrong_checksums(_resolved(_tables(spark, d)))


@query("SELECT folder, name || '#' || block_no AS subject FROM fileblocks WHERE NOT deleted AND inline_data IS NULL AND (hash LIKE '00%' OR size < 512)")
def fsck_missing_reverse(spark, d):
    t = _tables(spark, d)
    return integrity.missing_refs(t["blocks"], t["refs"])


@query("SELECT folder, dir || '/' || hash AS subject FROM ptrs WHERE hash LIKE 'cd%'")
def fsck_bad_blockseq(spark, d):
    return integrity.low_blockseqs(_tables(spark, d)["low"])


@query("SELECT folder, dir || '/' || hash AS subject FROM ptrs WHERE hash LIKE 'ff%'")
def fsck_missing_payload(spark, d):
    t = _tables(spark, d)
    return integrity.missing_payloads(t["ptrs"], t["data"])


@query("""SELECT DISTINCT folder, regexp_extract(name, '^(.*)/[^/]*$', 1) || '/' || hash AS subject FROM fileblocks WHERE NOT deleted AND inline_data IS NULL
    AND (hash LIKE 'a1%' OR size < 512 AND NOT EXISTS (SELECT 1 FROM ptrs p WHERE p.folder = fileblocks.folder AND p.hash = fileblocks.hash AND p.dir = regexp_extract(name, '^(.*)/[^/]*$', 1)))""")
def fsck_missing_pointer(spark, d):
    t = _tables(spark, d)
    return integrity.missing_pointers(t["blocks"], t["ptrs"].where(~F.startswith("hash", F.lit("a1"))))


@query("""SELECT folder, rule, count(*) AS n FROM (
    SELECT folder, 'inbox' AS rule FROM inbox WHERE doc_id % 4 = 0
    UNION ALL SELECT folder, 'dangling sequence' FROM seqs s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.folder = s.folder AND f.name = s.name)
    UNION ALL SELECT s.folder, 'sequence mismatch' FROM seqs s JOIN files f ON f.folder = s.folder AND f.name = s.name WHERE s.seq <> f.sequence
    UNION ALL SELECT s.folder, 'counter too low' FROM (SELECT folder, max(seq) AS high FROM seqs GROUP BY folder) s LEFT JOIN meta m ON m.folder = s.folder WHERE s.high > coalesce(m.max_sequence, 0)
    UNION ALL SELECT s.folder, 'counter below a file' FROM (SELECT folder, max(sequence) AS high FROM files GROUP BY folder) s LEFT JOIN meta m ON m.folder = s.folder WHERE s.high > coalesce(m.max_sequence, 0)
    UNION ALL SELECT folder, 'unresolvable block' FROM resolved WHERE NOT deleted AND source IN ('dangling', 'invalid')
    UNION ALL SELECT folder, 'missing reference' FROM fileblocks WHERE NOT deleted AND inline_data IS NULL AND (hash LIKE '00%' OR size < 512)
    UNION ALL SELECT folder, 'missing pointer' FROM (SELECT DISTINCT folder, regexp_extract(name, '^(.*)/[^/]*$', 1) AS dir, hash FROM fileblocks WHERE NOT deleted AND inline_data IS NULL AND size < 512)
    UNION ALL SELECT folder, 'missing payload' FROM ptrs WHERE hash LIKE 'ff%'
    UNION ALL SELECT folder, 'missing sequence' FROM files f WHERE NOT EXISTS (SELECT 1 FROM seqs s WHERE f.folder = s.folder AND f.name = s.name AND f.sequence = s.seq)
    UNION ALL SELECT folder, 'size mismatch' FROM resolved WHERE NOT deleted AND stored_size <> size
    UNION ALL SELECT folder, 'checksum' FROM resolved WHERE NOT deleted AND stored_hash <> hash
    UNION ALL SELECT folder, 'payload checksum' FROM ptrs WHERE hash LIKE 'ab%') GROUP BY folder, rule""")
def fsck_summary(spark, d):
    return integrity.summary(integrity.findings(_tables(spark, d), "full"))


@query("SELECT folder, CAST(n AS BIGINT) AS errors, n = 0 AS ok FROM (SELECT f.folder, count(s.seq) AS n FROM (SELECT DISTINCT folder FROM files) f LEFT JOIN (SELECT * FROM seqs s WHERE folder <> 'es' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.folder = s.folder AND f.name = s.name)) s ON f.folder = s.folder GROUP BY f.folder)")
def fsck_passed(spark, d):
    t = _tables(spark, d)
    return integrity.passed(integrity.dangling_seqs(t["seqs"].where("folder <> 'es'"), t["files"]), t["files"])


# --- garbage collection and statistics ---


@query("SELECT p.folder, p.blockseq FROM payloads p WHERE EXISTS (SELECT 1 FROM live l WHERE l.folder = p.folder AND l.blockseq = p.blockseq)")
def gc_block_data(spark, d):
    return collection.keep_live(fx.block_data(spark, d), _live(spark, d), ["folder", "blockseq"]).select("folder", "blockseq")


@query("SELECT folder, dir, hash FROM ptrs p WHERE EXISTS (SELECT 1 FROM live l WHERE l.folder = p.folder AND l.hash = p.hash)")
def gc_pointers(spark, d):
    return collection.keep_live(fx.block_ptrs(spark, d), _live(spark, d), ["folder", "hash"]).select("folder", "dir", "hash")


@query("SELECT folder, hash, name FROM refs p WHERE EXISTS (SELECT 1 FROM live l WHERE l.folder = p.folder AND l.hash = p.hash)")
def gc_reverse(spark, d):
    return collection.keep_live(fx.block_refs(spark, d), _live(spark, d), ["folder", "hash"]).select("folder", "hash", "name")


@query("SELECT folder, name FROM inbox WHERE epoch >= 3")
def gc_inbox_rows(spark, d):
    return collection.keep_inbox(fx.inbox(spark, d), fx.EPOCH).select("folder", "name")


def _floors(spark, d):
    """Floors low enough to leave some rows."""
    return index.peer_floor(fx.peers(spark, d)).withColumn("floor", (F.col("floor") / 20).cast("long"))


@query("SELECT s.folder, s.seq, s.name FROM seqs s LEFT JOIN floors f ON s.folder = f.folder WHERE f.floor IS NULL OR s.seq >= f.floor // 20")
def gc_seqs(spark, d):
    return collection.keep_seqs(fx.seqs(spark, d), _floors(spark, d)).select("folder", "seq", "name")


@query("SELECT s.folder, s.name FROM files s LEFT JOIN floors f ON s.folder = f.folder WHERE NOT s.deleted OR f.floor IS NULL OR s.sequence >= f.floor // 20")
def gc_tombstones(spark, d):
    return collection.keep_files(fx.files(spark, d), _floors(spark, d)).select("folder", "name")


@query("""SELECT folder, 'seqs' AS class, count(*) AS seen, CAST(sum(kept) AS BIGINT) AS kept FROM (SELECT s.folder, CASE WHEN f.floor IS NULL OR s.seq >= f.floor // 20 THEN 1 ELSE 0 END AS kept
    FROM seqs s LEFT JOIN floors f ON s.folder = f.folder) GROUP BY folder
    UNION ALL SELECT folder, 'inbox', count(*), CAST(sum(CASE WHEN epoch >= 3 THEN 1 ELSE 0 END) AS BIGINT) FROM inbox GROUP BY folder""")
def gc_counters(spark, d):
    seqs, inbox = fx.seqs(spark, d), fx.inbox(spark, d)
    return collection.sweep_counts({"seqs": (seqs, collection.keep_seqs(seqs, _floors(spark, d))), "inbox": (inbox, collection.keep_inbox(inbox, fx.EPOCH))})


_BUCKETS = ", ".join(f"CAST(sum(CASE WHEN bucket = {i} THEN 1 ELSE 0 END) AS BIGINT) AS bucket_{i}" for i in range(14))


@query(f"""SELECT prefix, count(*) AS seen, CAST(sum(CASE WHEN tombstone THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS dropped,
    CAST(sum(bytes) AS BIGINT) AS bytes_total, max(bytes) AS bytes_max, {_BUCKETS} FROM (SELECT *, CAST(CASE WHEN bytes < 16 THEN 0 WHEN bytes >= 134217728 THEN 13
    ELSE least(floor((floor(log2(bytes)) - 4) / 2) + 1, 12) END AS INTEGER) AS bucket FROM (SELECT folder AS prefix, deleted AS tombstone, doc_id % 7 = 0 AS dropped, CASE WHEN deleted THEN 0 ELSE size END AS bytes FROM files)) GROUP BY prefix""")
def prefix_stats(spark, d):
    rows = fx.files(spark, d).select(F.col("folder").alias("prefix"), "size", F.col("deleted").alias("tombstone"), (F.col("doc_id") % 7 == 0).alias("dropped"))
    return collection.prefix_stats(rows)


@query("""SELECT * FROM (SELECT folder, 'meta' AS segment, count(*) % 7 AS l0, count(*) % 3 AS runs FROM files GROUP BY folder) WHERE l0 >= 4 OR runs > 1
    UNION ALL SELECT * FROM (SELECT folder, 'blocks', count(*) % 64 AS l0, 1 AS runs FROM blocks GROUP BY folder) WHERE l0 >= 32""")
def compaction_candidates(spark, d):
    n = F.count("*")
    meta = fx.files(spark, d).groupBy("folder").agg((n % 7).alias("l0"), (n % 3).alias("runs")).select("folder", F.lit("meta").alias("segment"), "l0", "runs")
    data = fx.blocks(spark, d).groupBy("folder").agg((n % 64).alias("l0")).select("folder", F.lit("blocks").alias("segment"), "l0", F.lit(1).cast("long").alias("runs"))
    return collection.compaction_candidates(meta.unionByName(data))


# --- snapshots ---


def _schedules(spark):
    return spark.createDataFrame([("1h", 3600), ("1day", 86400), ("5m", 300), ("7days", 604800)], "name string, interval_s long")


def _now(spark, d):
    return fx.now(spark, d).first()["now"]


@query("SELECT DISTINCT f.folder, '1h' AS name, c.now AS create_time, c.now + INTERVAL 24 HOUR AS expire_time FROM files f, clock c".replace(", clock c", " JOIN clock c ON true"))
def checkpoint_rows(spark, d):
    return _ntz(snapshots.new_checkpoints(fx.files(spark, d).select("folder").distinct(), "1h", F.lit(_now(spark, d)), 86400))


def _ntz(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("SELECT folder, name, create_time, CASE WHEN name = '1day' THEN now + INTERVAL 48 HOUR ELSE expire_time END AS expire_time FROM checkpoints JOIN clock ON true")
def checkpoint_refresh(spark, d):
    return _ntz(snapshots.refresh(fx.checkpoints(spark, d), "1day", F.lit(_now(spark, d)), 2 * 86400))


@query("SELECT folder, name, create_time FROM checkpoints JOIN clock ON true WHERE expire_time > now")
def checkpoint_live(spark, d):
    return _ntz(snapshots.live(fx.checkpoints(spark, d), F.lit(_now(spark, d))).select("folder", "name", "create_time"))


@query("""SELECT c.name, CAST(s.interval_s AS BIGINT) AS interval_s, CAST(floor(epoch_us(max(now)) / 1e6 - epoch_us(max(create_time)) / 1e6) AS BIGINT) AS age_s
    FROM checkpoints c JOIN schedules s ON c.name = s.name JOIN clock ON true GROUP BY c.name, s.interval_s""")
def checkpoint_ages(spark, d):
    return snapshots.ages(fx.checkpoints(spark, d), fx.now(spark, d), _schedules(spark))


@query("""SELECT s.name, CAST(CASE WHEN a.age IS NULL THEN 0 ELSE greatest(s.interval_s - a.age, 0) END AS BIGINT) AS delay_s FROM schedules s LEFT JOIN
    (SELECT name, floor(epoch_us(max(now)) / 1e6 - epoch_us(max(create_time)) / 1e6) AS age FROM checkpoints JOIN clock ON true GROUP BY name) a ON s.name = a.name WHERE s.interval_s >= 600""")
def checkpoint_due(spark, d):
    schedules = _schedules(spark)
    return snapshots.due(schedules, snapshots.ages(fx.checkpoints(spark, d), fx.now(spark, d), schedules))


@query("SELECT name, CAST(interval_s AS BIGINT) AS interval_s FROM schedules WHERE interval_s >= 600")
def valid_schedules(spark, d):
    return snapshots.valid(_schedules(spark))


@query("SELECT folder, name, create_time, expire_time FROM checkpoints")
def list_snapshots(spark, d):
    return _ntz(fx.checkpoints(spark, d)).orderBy("folder", F.desc("create_time"))


@query("SELECT folder, strftime(create_time, '%Y-%m-%dT%H-%M') AS minute, max(create_time) AS create_time FROM checkpoints GROUP BY 1, 2")
def resolve_snapshot(spark, d):
    return _ntz(snapshots.by_minute(fx.checkpoints(spark, d)))


@query("SELECT create_time, strftime(create_time, '%Y-%m-%dT%H-%M') AS dir FROM checkpoints")
def snapshot_dir_name(spark, d):
    return _ntz(fx.checkpoints(spark, d).select("create_time", expr.snapshot_dir(F.col("create_time")).alias("dir")))


@query("""SELECT '/' AS path, 'root' AS level UNION ALL SELECT '/' || folder, 'folder' FROM (SELECT DISTINCT folder FROM checkpoints)
    UNION ALL SELECT DISTINCT folder || '/' || strftime(create_time, '%Y-%m-%dT%H-%M') || '/', 'snapshot' FROM checkpoints
    UNION ALL SELECT DISTINCT '/' || folder || '/' || strftime(create_time, '%Y-%m-%dT%H-%M') || '/a/b.txt', 'subpath' FROM checkpoints UNION ALL SELECT 'zz/2024', NULL""")
def parse_path(spark, d):
    found = fx.checkpoints(spark, d)
    minute = expr.snapshot_dir(F.col("create_time"))
    paths = spark.createDataFrame([("/",), ("zz/2024",)], "path string").unionByName(found.select(F.concat(F.lit("/"), "folder").alias("path")).distinct())
    paths = paths.unionByName(found.select(F.concat("folder", F.lit("/"), minute, F.lit("/")).alias("path")).distinct())
    paths = paths.unionByName(found.select(F.concat(F.lit("/"), "folder", F.lit("/"), minute, F.lit("/a/b.txt")).alias("path")).distinct())
    return snapshots.parse_paths(paths, found)


@query("""SELECT folder, regexp_extract(rest, '^([^/]*)', 1) AS entry, max(rest LIKE '%/%') AS is_dir, max(CASE WHEN rest NOT LIKE '%/%' THEN size END) AS size
    FROM (SELECT folder, substring(name, 9) AS rest, size FROM files WHERE NOT deleted AND name LIKE 'src1/en/%') GROUP BY folder, 2""")
def read_dir(spark, d):
    return snapshots.read_dir(fx.files(spark, d), DIRECTORY)


@query("""SELECT folder, name AS path, CASE WHEN deleted THEN 'not found' ELSE 'file' END AS kind, CASE WHEN NOT deleted THEN size END AS size FROM files
    UNION ALL SELECT folder, dir, CASE WHEN max(CASE WHEN deleted THEN 0 ELSE 1 END) = 1 THEN 'directory' ELSE 'not found' END, NULL
    FROM (SELECT *, regexp_extract(name, '^(.*)/[^/]*$', 1) AS dir FROM files) GROUP BY folder, dir""")
def file_metadata(spark, d):
    files = fx.files(spark, d)
    asked = files.select("folder", F.col("name").alias("path")).unionByName(files.select("folder", expr.dirname(F.col("name")).alias("path")).distinct())
    return snapshots.file_metadata(files, asked)


@query("""SELECT folder, name, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM files
    WHERE NOT deleted AND NOT (doc_id % 5 = 0 AND doc_id % 7 = 0) AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0)""")
def snapshot_diff(spark, d):
    files = fx.files(spark, d)
    after = files.where("doc_id % 7 <> 0").withColumn("sequence", F.col("sequence") + F.when(F.col("doc_id") % 3 == 0, 9).otherwise(0))
    return snapshots.snapshot_diff(files.where("doc_id % 5 <> 0"), after)


# --- the write half ---


def _meta(spark, d):
    return fx.files(spark, d).groupBy("folder").agg(F.max("sequence").alias("max_sequence")).withColumn("next_blockseq", F.when(F.col("folder") == "en", 5000).when(F.col("folder") == "de", 3).cast("long"))


def _stored(spark, d):
    changed = F.col("doc_id") % 5 == 0
    blocks = fx.blocks(spark, d, payload=True)
    incoming = blocks.select("folder", "name", F.when(changed, F.sha2(F.concat("hash", F.lit("!")), 256)).otherwise(F.col("hash")).alias("hash"), F.when(changed, F.concat("hash", F.lit("!"))).otherwise(F.col("chunk")).alias("data"))
    new = F.transform("blocks", lambda b: F.struct(F.when(changed, F.sha2(F.concat(b["hash"], F.lit("!")), 256)).otherwise(b["hash"]).alias("hash"), *[b[c].alias(c) for c in ("offset", "size", "blockseq", "inline_data")]))
    rows = fx.file_rows(spark, d, bare=True).withColumn("blocks", new)
    unknown = spark.createDataFrame([("en", "no/such.file", "0" * 64, "x"), ("xx", "none", "1" * 64, "x" * 600)], "folder string, name string, hash string, data string")
    return commit.store(rows, fx.block_refs(spark, d), fx.block_ptrs(spark, d), fx.block_data(spark, d), _meta(spark, d), incoming.unionByName(unknown), fx.INLINE)


@query("""SELECT i.folder, i.name, i.block_no, CASE WHEN strlen(i.data) >= 512 THEN g.blockseq END AS blockseq, CASE WHEN strlen(i.data) < 512 THEN CAST(strlen(i.data) AS INTEGER) END AS inline_size
    FROM incoming i LEFT JOIN given g ON i.folder = g.folder AND i.hash = g.hash""")
def store_blocks_write(spark, d):
    """What blocks that have come in make of file rows: data below the bound in the row, a number for the rest."""
    rows = _stored(spark, d)["rows"].select("folder", "name", F.posexplode("blocks").alias("block_no", "b"))
    return rows.select("folder", "name", "block_no", "b.blockseq", F.octet_length("b.inline_data").alias("inline_size"))


@query("""SELECT folder, dir, hash, blockseq FROM ptrs UNION ALL SELECT DISTINCT i.folder, i.dir, i.hash, g.blockseq FROM incoming i JOIN given g ON i.folder = g.folder AND i.hash = g.hash
    WHERE strlen(i.data) >= 512 AND NOT EXISTS (SELECT 1 FROM ptrs p WHERE p.folder = i.folder AND p.dir = i.dir AND p.hash = i.hash)""")
def store_blocks_pointers(spark, d):
    return _stored(spark, d)["ptrs"]


@query("SELECT folder, hash, name FROM refs UNION SELECT folder, hash, name FROM incoming WHERE strlen(data) >= 512")
def store_blocks_refs(spark, d):
    return _stored(spark, d)["refs"]


@query("SELECT folder, blockseq, sha256(data) AS hash FROM payloads UNION ALL SELECT f.folder, f.blockseq, min(sha256(i.data)) FROM fresh f JOIN incoming i ON f.folder = i.folder AND f.hash = i.hash GROUP BY f.folder, f.blockseq")
def store_blocks_payloads(spark, d):
    return _stored(spark, d)["data"].select("folder", "blockseq", F.sha2("data", 256).alias("hash"))


@query("""SELECT h.folder, h.high AS max_sequence, CASE WHEN f.n IS NOT NULL THEN CAST(CASE WHEN h.folder = 'en' THEN 5000 ELSE 1024 END + 256 * ceil(f.n / 256.0) AS BIGINT) WHEN h.folder = 'en' THEN 5000 WHEN h.folder = 'de' THEN 3 END AS next_blockseq
    FROM highs h LEFT JOIN (SELECT folder, count(*) AS n FROM fresh GROUP BY folder) f ON h.folder = f.folder""")
def store_blocks_counters(spark, d):
    return _stored(spark, d)["meta"]


@query("SELECT 'en' AS folder, 'no/such.file' AS name, 'not found' AS error UNION ALL SELECT 'xx', 'none', 'not found'")
def store_blocks_errors(spark, d):
    return _stored(spark, d)["errors"].drop("hash")


def _promoted(spark, d):
    doc = F.col("doc_id")
    staged = fx.inbox(spark, d).join(fx.file_rows(spark, d, bare=True).select("doc_id", "blocks"), "doc_id")
    other = fx.counters(F.lit(99), F.lit(0), F.lit(0))
    done = staged.select("folder", "epoch", "name", F.when(doc % 3 == 1, other).otherwise(F.col("version")).alias("version"))
    return commit.promote(staged, fx.file_rows(spark, d), fx.files(spark, d).select("folder", F.col("sequence").alias("seq"), "name"), _meta(spark, d), done)


@query("""SELECT f.folder, f.name, coalesce(r.sequence, f.sequence) AS sequence, CAST(coalesce(b.linked, 0) AS BIGINT) AS linked FROM files f LEFT JOIN
    (SELECT r.folder, r.name, h.high + row_number() OVER (PARTITION BY r.folder ORDER BY r.arrival, r.name) AS sequence FROM ready r JOIN highs h ON r.folder = h.folder) r ON f.folder = r.folder AND f.name = r.name
    LEFT JOIN (SELECT folder, name, count(*) AS linked FROM fileblocks WHERE inline_data IS NOT NULL OR blockseq IS NOT NULL GROUP BY folder, name) b ON f.folder = b.folder AND f.name = b.name""")
def promote_commit(spark, d):
    """Files after completions have been promoted and committed, with how many of their blocks can be resolved."""
    linked = F.size(F.filter("blocks", lambda b: b["blockseq"].isNotNull() | b["inline_data"].isNotNull())).cast("long")
    return _promoted(spark, d)["files"].select("folder", "name", "sequence", linked.alias("linked"))


@query("""SELECT folder, sequence AS seq, name FROM files f WHERE NOT EXISTS (SELECT 1 FROM ready r WHERE r.folder = f.folder AND r.name = f.name)
    UNION ALL SELECT r.folder, h.high + row_number() OVER (PARTITION BY r.folder ORDER BY r.arrival, r.name), r.name FROM ready r JOIN highs h ON r.folder = h.folder""")
def promote_seqs(spark, d):
    return _promoted(spark, d)["seqs"]


@query("SELECT h.folder, h.high + coalesce(r.n, 0) AS max_sequence FROM highs h LEFT JOIN (SELECT folder, count(*) AS n FROM ready GROUP BY folder) r ON h.folder = r.folder")
def promote_counters(spark, d):
    return _promoted(spark, d)["meta"].select("folder", "max_sequence")


@query("SELECT folder, epoch, name FROM inbox i WHERE NOT EXISTS (SELECT 1 FROM ready r WHERE r.folder = i.folder AND r.name = i.name)")
def promote_inbox(spark, d):
    return _promoted(spark, d)["inbox"].select("folder", "epoch", "name")


def _conflicts(spark, d, policy):
    remote = fx.updates(spark, d).join(fx.file_rows(spark, d, bare=True).select("doc_id", "blocks"), "doc_id").withColumn("arrival", F.col("doc_id"))
    local = fx.file_rows(spark, d)
    rows = commit.resolved(local.select("folder", "name", "version", "deleted", "size", "sequence", "blocks"), remote, policy)
    files = local.select("folder", "name", "version", "deleted", "size", "sequence", "blocks")
    meta, seqs = _meta(spark, d), fx.files(spark, d).select("folder", F.col("sequence").alias("seq"), "name")
    done = commit.commit(files, seqs, meta, rows, ["part"])
    return done["files"].join(rows.select("folder", "name"), ["folder", "name"], "left_semi").select("folder", "name", "sequence", F.array_join(F.transform("version", lambda c: c["value"].cast("string")), ",").alias("counters"), "deleted")


_SIDES = """(SELECT p.folder, p.name, p.doc_id, p.deleted, p.rdeleted, f.l1, f.l2, u.r1, u.r2, u.r3, CASE WHEN lt > rt THEN true WHEN lt < rt THEN false WHEN NOT p.deleted AND rdeleted THEN true WHEN p.deleted AND NOT rdeleted THEN false ELSE 0 > p.device END AS local
    FROM pairs p JOIN files f ON p.folder = f.folder AND p.name = f.name JOIN updates u ON p.folder = u.folder AND p.name = u.name WHERE relation = 'Concurrent')"""


@query(f"""SELECT c.folder, c.name, h.high + row_number() OVER (PARTITION BY c.folder ORDER BY c.doc_id, c.part) AS sequence, array_to_string(c.counters, ',') AS counters, c.deleted FROM (
    SELECT folder, name || '.sync-conflict' AS name, doc_id, 0 AS part, CASE WHEN local THEN [r1, r2, r3] ELSE [l1, l2, 0] END AS counters, CASE WHEN local THEN rdeleted ELSE deleted END AS deleted FROM {_SIDES}
    UNION ALL SELECT folder, name, doc_id, 1, CASE WHEN local THEN [l1, l2, 0] ELSE [r1, r2, r3] END, CASE WHEN local THEN deleted ELSE rdeleted END FROM {_SIDES}) c JOIN highs h ON c.folder = h.folder""")
def intake_conflict(spark, d):
    """What concurrent updates are resolved to if the loser is kept: its copy, then the winner, each with its own version."""
    return _conflicts(spark, d, "backup")


@query(f"""SELECT c.folder, c.name, h.high + row_number() OVER (PARTITION BY c.folder ORDER BY c.doc_id) AS sequence, array_to_string([r1, r2, r3], ',') AS counters, c.rdeleted AS deleted FROM {_SIDES} c JOIN highs h ON c.folder = h.folder""")
def intake_theirs(spark, d):
    """What concurrent updates are resolved to if the remote side always wins."""
    return _conflicts(spark, d, "theirs")


def _swept(spark, d):
    staged = fx.inbox(spark, d).join(fx.file_rows(spark, d).select("doc_id", "blocks"), "doc_id")
    tables = {"files": fx.file_rows(spark, d), "inbox": staged, "seqs": fx.seqs(spark, d), "block_data": fx.block_data(spark, d), "block_ptrs": fx.block_ptrs(spark, d), "block_refs": fx.block_refs(spark, d)}
    return tables, collection.sweep(tables, _floors(spark, d), fx.EPOCH)


@query("""SELECT class, CAST(sum(kept) AS BIGINT) AS kept, count(*) - CAST(sum(kept) AS BIGINT) AS dropped FROM (
    SELECT 'files' AS class, CASE WHEN EXISTS (SELECT 1 FROM keptfiles k WHERE k.doc_id = f.doc_id) THEN 1 ELSE 0 END AS kept FROM files f
    UNION ALL SELECT 'inbox', CASE WHEN epoch >= 3 THEN 1 ELSE 0 END FROM inbox
    UNION ALL SELECT 'seqs', CASE WHEN l.floor IS NULL OR s.seq >= l.floor // 20 THEN 1 ELSE 0 END FROM seqs s LEFT JOIN floors l ON s.folder = l.folder
    UNION ALL SELECT 'block_data', CASE WHEN EXISTS (SELECT 1 FROM keptblocks b WHERE b.folder = p.folder AND b.blockseq = p.blockseq) THEN 1 ELSE 0 END FROM payloads p
    UNION ALL SELECT 'block_ptrs', CASE WHEN EXISTS (SELECT 1 FROM keptblocks b WHERE b.folder = p.folder AND b.hash = p.hash AND b.inline_data IS NULL) THEN 1 ELSE 0 END FROM ptrs p
    UNION ALL SELECT 'block_refs', CASE WHEN EXISTS (SELECT 1 FROM keptblocks b WHERE b.folder = p.folder AND b.hash = p.hash AND b.inline_data IS NULL) THEN 1 ELSE 0 END FROM refs p) GROUP BY class""")
def compact_sweep(spark, d):
    """Rows that a sweep keeps and drops, by record class."""
    return collection.decision_counts(*_swept(spark, d))


@query("SELECT folder, blockseq FROM payloads p WHERE EXISTS (SELECT 1 FROM keptblocks b WHERE b.folder = p.folder AND b.blockseq = p.blockseq)")
def sweep_payloads(spark, d):
    return _swept(spark, d)[1]["block_data"].select("folder", "blockseq")


@query("SELECT folder, name, CASE WHEN doc_id % 3 = 0 THEN 'drop' ELSE 'tombstone' END AS decision FROM files WHERE deleted")
def prune_decisions(spark, d):
    dead = fx.files(spark, d).where("deleted").withColumns({"run": F.col("doc_id") % 3, "bottom_run": F.lit(0)})
    return collection.prune_decision(dead).select("folder", "name", "decision")


@query("SELECT DISTINCT folder, hash FROM blocks WHERE folder NOT IN ('en', 'de') OR (folder = 'en' AND hash < '8') OR (folder = 'de' AND hash < '4')")
def gc_safe_blocks(spark, d):
    """Hashes that both sweeps of one folder and the one of another know to be live; folders without a sweep are free."""
    hashes = fx.blocks(spark, d).select("folder", "hash").distinct()
    sweeps = spark.createDataFrame([("en", 1), ("de", 1), ("de", 2)], "folder string, sweep int")
    kept = hashes.join(F.broadcast(sweeps), "folder").where((F.col("hash") < "8") & ((F.col("folder") == "en") | (F.col("sweep") == 1) | (F.col("hash") < "4")))
    return collection.safe_blocks(hashes, kept, sweeps)


@query(f"SELECT DISTINCT n.folder, n.hash FROM {_NEEDED} n JOIN refs r ON n.folder = r.folder AND n.hash = r.hash WHERE n.hash < 'c'")
def has_block_in_sweep(spark, d):
    refs = fx.block_refs(spark, d)
    return block_ops.has_block(_needed(spark, d).select("folder", "hash").distinct(), refs, [refs.where("hash < 'c'")])


@query("SELECT folder, 'meta' AS segment, CAST(max(doc_id % 11) + 1 AS BIGINT) AS next_run FROM files GROUP BY folder")
def next_run(spark, d):
    return collection.next_run(fx.files(spark, d).select("folder", F.lit("meta").alias("segment"), (F.col("doc_id") % 11).alias("run")))


@query("""SELECT folder, segment, CAST(CASE WHEN segment = 'meta' THEN n ELSE least(n, 64) END AS BIGINT) AS sources FROM (SELECT folder, 'meta' AS segment, count(*) AS n FROM files GROUP BY folder UNION ALL SELECT folder, 'blocks', count(*) FROM blocks GROUP BY folder)""")
def merge_sources(spark, d):
    count = lambda df, segment: df.groupBy("folder").agg(F.count("*").alias("l0")).select("folder", F.lit(segment).alias("segment"), "l0")
    return collection.merge_sources(count(fx.files(spark, d), "meta").unionByName(count(fx.blocks(spark, d), "blocks"))).select("folder", "segment", "sources")


# --- registry and connections ---


@query("SELECT w.doc_id, f.sequence, f.doc_id IS NOT NULL AS found FROM (SELECT doc_id, folder, CASE WHEN doc_id % 4 = 0 THEN name || '?' ELSE name END AS name FROM files) w LEFT JOIN files f ON w.folder = f.folder AND w.name = f.name")
def file_get(spark, d):
    files = fx.files(spark, d)
    wanted = files.select(F.col("doc_id").alias("asked"), "folder", F.when(F.col("doc_id") % 4 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"))
    return index.point_get(files, wanted, ["folder", "name"]).select(F.col("asked").alias("doc_id"), "sequence", "found")


@query("SELECT folder, high AS max_sequence, CAST(CASE folder WHEN 'en' THEN 5000 WHEN 'de' THEN 3 ELSE 0 END AS BIGINT) AS next_blockseq FROM highs UNION ALL SELECT 'new', 0, 0")
def folder_state(spark, d):
    known = fx.files(spark, d).select("folder").distinct().unionByName(spark.createDataFrame([("new",)], "folder string"))
    return index.folder_state(known, _meta(spark, d))


_REGISTRY = "(SELECT folder AS id, 'folder_0000000' || (row_number() OVER (ORDER BY folder) - 1) AS storage_key, 'L-' || folder AS label, row_number() OVER (ORDER BY folder) - 1 AS key FROM highs)"


def _registry(spark, d):
    ids = fx.files(spark, d).select(F.col("folder").alias("id")).distinct()
    key = F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("id")) - 1
    return ids.select("id", expr.folder_storage_key(key).alias("storage_key"), F.concat(F.lit("L-"), "id").alias("label"), key.cast("long").alias("key"))


@query(f"SELECT id, storage_key, label, NULL AS error FROM {_REGISTRY} UNION ALL SELECT 'zz', NULL, NULL, 'not found'")
def resolve_folder(spark, d):
    registry = _registry(spark, d)
    return index.resolve_folders(registry, registry.select("id").unionByName(spark.createDataFrame([("zz",)], "id string")))


@query(f"""SELECT * FROM (VALUES ('aa', 'A', 0, NULL), ('bb', 'B', 1, NULL), ('en', 'E', NULL, 'duplicate'), ('cc', 'C', NULL, 'duplicate')) AS t(id, label, k, error)
    JOIN (SELECT max(key) + 1 AS high FROM {_REGISTRY}) ON true""".replace("SELECT * FROM (VALUES", "SELECT id, label, CAST(high + k AS BIGINT) AS key, error FROM (VALUES"))
def register_folder(spark, d):
    proposed = spark.createDataFrame([("bb", "B"), ("aa", "A"), ("en", "E"), ("cc", "C"), ("cc", "D")], "id string, label string")
    return index.register_folders(_registry(spark, d), proposed)


@query("SELECT folder, name FROM files WHERE folder <> 'es'")
def remove_folder(spark, d):
    return index.without_folders(fx.files(spark, d), spark.createDataFrame([("es",)], "folder string")).select("folder", "name")


@query("SELECT folder, name FROM files WHERE doc_id % 13 <> 0 AND doc_id % 5 <> 0")
def idle_files(spark, d):
    files = fx.files(spark, d)
    return index.idle(files, fx.inbox(spark, d), files.where("doc_id % 5 = 0"))


@query("SELECT source AS label, min(doc_id) AS position FROM documents GROUP BY source")
def folder_labels(spark, d):
    return index.labels_in_order(fx.table(spark, d, "documents").select(F.col("source").alias("label"), F.col("doc_id").alias("position")))


@query("SELECT folder, name, sequence AS last_sequence, CAST(0 AS BIGINT) AS prev_sequence FROM files WHERE doc_id % 13 = 0")
def index_updates(spark, d):
    return index.updates_to_send(fx.files(spark, d), fx.inbox(spark, d).select("folder", "name"))


@query("SELECT device, id, CASE WHEN place <= 16 THEN 'in flight' ELSE 'deferred' END AS state FROM (SELECT user_id AS device, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 10007, event_id) AS place FROM events)")
def requests_in_flight(spark, d):
    asked = fx.table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("id"), (F.col("event_id") * 7919 % 10007).alias("arrival"))
    return intake.in_flight(asked).select("device", "id", "state")


@query("""SELECT w.device, w.arrival, f.id FROM (SELECT user_id AS device, event_id AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) w JOIN
    (SELECT device, id, row_number() OVER (PARTITION BY device ORDER BY id) AS place FROM (SELECT DISTINCT e.user_id AS device, n.id FROM events e, (SELECT event_id + 1 AS id FROM events) n WHERE n.id <= 4000) x
    WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.user_id = x.device AND t.event_id % 50 = x.id AND x.id > 0)) f ON w.device = f.device AND w.place = f.place""".replace("events e, (", "events e JOIN (").replace(" n WHERE n.id <= 4000", " n ON n.id <= 4000"))
def request_ids(spark, d):
    """The least ids that a device has not in flight, for each of its new requests."""
    events = fx.table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("arrival"))
    return intake.free_ids(events, events.select("device", (F.col("arrival") % 50).alias("id")).where("id > 0"))


@query("SELECT user_id AS device, max_by(event_id, ts) AS id FROM events GROUP BY user_id")
def current_connections(spark, d):
    return intake.current_connections(fx.table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("ts").alias("connected"), F.col("event_id").alias("id")))


@query("SELECT DISTINCT user_id AS device, user_id IN (3, 7, 9) AS allowed FROM events")
def allowed_devices(spark, d):
    asked = fx.table(spark, d, "events").select(F.col("user_id").alias("device")).distinct()
    return index.allowed(asked, spark.createDataFrame([(3,), (7,), (9,), (-1,)], "device long"))


# --- listings and files ---


@query("""SELECT folder, name AS path, kind, CASE WHEN kind = 'file' THEN size ELSE 0 END AS size, modified_s * 1000000 + greatest(modified_ns, 0) // 1000 AS modified FROM
    (SELECT *, CASE WHEN type_code = 1 THEN 'directory' WHEN type_code IN (2, 3, 4) THEN 'symlink' ELSE 'file' END AS kind FROM files) WHERE NOT deleted""")
def entries(spark, d):
    return snapshots.entries(fx.files(spark, d).withColumn("type", expr.wire_type(F.col("type_code"))))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 9223372036854775807 ELSE (1700000000 + doc_id + 3600) * 1000000 END AS expires FROM files")
def expiry_times(spark, d):
    modified = F.when(F.col("doc_id") % 5 == 0, F.lit(2**63 - 10)).otherwise(F.col("modified_s") * 1_000_000)
    return fx.files(spark, d).select("doc_id", expr.expiry(modified, F.lit(3600)).alias("expires"))


@query("""SELECT doc_id, CASE WHEN target >= 0 THEN target END AS place FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id - 40 WHEN 1 THEN size + doc_id - 1000 ELSE 500 + doc_id - 600 END AS target FROM files)""")
def seek_places(spark, d):
    doc = F.col("doc_id")
    whence = F.when(doc % 3 == 0, "start").when(doc % 3 == 1, "end").otherwise("current")
    offset = F.when(doc % 3 == 0, doc - 40).when(doc % 3 == 1, doc - 1000).otherwise(doc - 600)
    return fx.files(spark, d).select("doc_id", expr.seek(F.lit(500), F.col("size"), whence, offset).alias("place"))


@query("SELECT doc_id, to_base64(encode(name)) AS text, name AS back FROM files")
def base64_text(spark, d):
    coded = fx.files(spark, d).select("doc_id", F.base64(F.encode("name", "UTF-8")).alias("text"))
    return coded.withColumn("back", F.decode(F.unbase64("text"), "UTF-8"))


@query("SELECT CAST(interval_s AS BIGINT) AS interval_s, CAST(ttl_s AS BIGINT) AS ttl_s FROM (VALUES (3600, 7200), (86400, 604800), (1800, 9000)) AS t(interval_s, ttl_s)")
def schedules_after(spark, d):
    rows = lambda *r: spark.createDataFrame(list(r), "interval_s long, ttl_s long")
    return snapshots.schedules_after(rows((3600, 86400), (86400, 604800), (600, 1200)), rows((3600, 7200), (1800, 9000)), rows((600, 0)).select("interval_s"))


@query("SELECT prefix, seen, row_number() OVER (ORDER BY seen DESC, prefix) AS place FROM (SELECT folder AS prefix, count(*) AS seen FROM files GROUP BY folder)")
def prefix_order(spark, d):
    stats = fx.files(spark, d).groupBy(F.col("folder").alias("prefix")).agg(F.count("*").alias("seen"))
    return collection.by_rows(stats).select("prefix", "seen", F.col("place").cast("long").alias("place"))


@query("SELECT 'folder' AS column, greatest(6, max(length(folder))) AS width FROM files UNION ALL SELECT 'name', greatest(4, max(length(name))) FROM files UNION ALL SELECT 'sequence', greatest(8, max(length(CAST(sequence AS VARCHAR)))) FROM files")
def column_widths(spark, d):
    return collection.column_widths(fx.files(spark, d).select("folder", "name", "sequence"))


# --- leases and errors ---


@query("SELECT lock, min(epoch) AS epoch, min_by(holder, epoch) AS holder, min_by(priority, epoch) AS priority FROM leases GROUP BY lock")
def lease_owner(spark, d):
    return leases.owner(fx.leases(spark, d))


@query("SELECT lock, epoch, holder FROM leases")
def lease_listing(spark, d):
    return leases.listing(fx.leases(spark, d)).select("lock", "epoch", "holder")


@query("SELECT lock, epoch, low_epoch, low_priority, state FROM scavenged")
def lease_scavenge(spark, d):
    return leases.scavenge(fx.leases(spark, d))


@query("""SELECT m.lock, m.epoch, CASE WHEN b.regression = 1 THEN 'QueuedBackwardClock' WHEN m.priority > b.owner_priority THEN 'Queued' WHEN b.epoch IS NOT NULL THEN 'Failed'
    WHEN EXISTS (SELECT 1 FROM leases h WHERE h.lock = m.lock AND h.epoch > m.epoch AND h.priority > m.priority AND m.modified < h.until) THEN 'Yielded' ELSE 'Owner' END AS outcome
    FROM leases m LEFT JOIN (SELECT lock, epoch, max(CASE WHEN state = 'regression' THEN 1 ELSE 0 END) AS regression, min_by(low_priority, low_epoch) AS owner_priority
    FROM scavenged WHERE state <> 'removed' GROUP BY lock, epoch) b ON m.lock = b.lock AND m.epoch = b.epoch""")
def lease_outcome(spark, d):
    return leases.outcomes(fx.leases(spark, d))


@query("""SELECT c.lock, c.holder, c.holder <> o.holder AND o.priority >= c.priority AND o.modified <= c.at AND c.at < o.until AS refused FROM
    (SELECT lock, 'h' || (epoch % 5) AS holder, epoch % 4 AS priority, modified + INTERVAL 90 SECOND AS at FROM leases) c
    JOIN (SELECT lock, min_by(holder, epoch) AS holder, min_by(priority, epoch) AS priority, min_by(modified, epoch) AS modified, min_by(until, epoch) AS until FROM leases GROUP BY lock) o ON c.lock = o.lock""")
def lease_refusal(spark, d):
    held = fx.leases(spark, d)
    at = F.col("last_modified") + F.make_dt_interval(secs=F.lit(90))
    return leases.refusals(held, held.select("lock", F.concat(F.lit("h"), (F.col("epoch") % 5).cast("string")).alias("holder"), (F.col("epoch") % 4).alias("priority"), at.alias("at")))


@query("SELECT lock, epoch FROM leases WHERE holder <> 'h1'")
def lease_release(spark, d):
    return leases.released(fx.leases(spark, d), "h1").select("lock", "epoch")


@query("""SELECT l.lock, l.epoch, coalesce(l.epoch = f.first, false) AS kept FROM leases l JOIN lockclock c ON l.lock = c.lock LEFT JOIN
    (SELECT l.lock, min(l.epoch) AS first FROM leases l JOIN lockclock c ON l.lock = c.lock WHERE l.epoch % 13 <> 0 AND l.until > c.now GROUP BY l.lock) f ON l.lock = f.lock""")
def lease_break(spark, d):
    held = fx.leases(spark, d)
    return leases.broken(held.withColumn("holder", F.when(F.col("epoch") % 13 != 0, F.col("holder"))), _lock_clock(held))


def _lock_clock(held):
    return held.groupBy("lock").agg((F.max("last_modified") - F.make_dt_interval(secs=F.lit(60))).alias("now"))


@query("""SELECT epoch, CASE WHEN s >= 2 * duration_s / 3.0 THEN 'lost' WHEN s >= duration_s / 3.0 + CASE WHEN epoch % 2 = 0 THEN 15 ELSE 0 END THEN 'renew' ELSE 'wait' END AS action
    FROM (SELECT epoch, duration_s, epoch * 7 % 300 AS s FROM leases)""")
def lease_renewal(spark, d):
    return fx.leases(spark, d).select("epoch", leases.renewal(F.col("duration_s"), F.col("epoch") * 7 % 300, F.col("epoch") % 2 == 0).alias("action"))


@query("SELECT l.lock, l.epoch, l.holder, CASE WHEN l.until > c.now THEN 'Active' ELSE 'Stale' END AS status FROM leases l JOIN lockclock c ON l.lock = c.lock")
def lease_status(spark, d):
    held = fx.leases(spark, d)
    return leases.status(held, _lock_clock(held))


@query("""SELECT l.lock, CASE WHEN bool_or(l.until > c.now) THEN 'Active' ELSE 'Stale' END AS status FROM leases l JOIN (SELECT lock, now + INTERVAL 4 MINUTE AS now FROM lockclock) c ON l.lock = c.lock GROUP BY l.lock
    UNION ALL SELECT 'none', 'Unlocked'""")
def lock_status(spark, d):
    held = fx.leases(spark, d)
    clock = _lock_clock(held).withColumn("now", F.col("now") + F.make_dt_interval(mins=F.lit(4)))
    return leases.lock_status(held.select("lock").distinct().unionByName(spark.createDataFrame([("none",)], "lock string")), held, clock)


@query("SELECT lock, max(epoch) + 1 AS next_epoch FROM leases GROUP BY lock")
def next_epoch(spark, d):
    return leases.next_epoch(fx.leases(spark, d))


_KINDS = ("transient_io", "corruption", "unsupported_version", "not_found", "standby", "invalid_input", "internal", "peer_bad_hello", "peer_bad_message", "peer_error", "network_error", "peer_closed")
_KIND = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


@query(f"""SELECT doc_id, CASE WHEN kind IN ('transient_io', 'network_error') THEN 'transient' WHEN kind IN ('corruption', 'internal', 'unsupported_version') THEN 'fatal' WHEN kind LIKE 'peer%' AND kind <> 'peer_closed' THEN 'peer' ELSE 'other' END AS class,
    CASE kind WHEN 'not_found' THEN 'corruption' WHEN 'invalid_input' THEN 'peer_bad_message' ELSE kind END AS protocol, CASE kind WHEN 'not_found' THEN 'NO_SUCH_FILE' ELSE 'GENERIC' END AS code FROM (SELECT doc_id, {_KIND} AS kind FROM documents)""")
def error_classes(spark, d):
    kind = F.expr(_KIND)
    return fx.files(spark, d).select("doc_id", expr.error_class(kind).alias("class"), expr.protocol_error(kind).alias("protocol"), expr.answer_code(kind).alias("code"))


@query("""SELECT folder, max_by(error, rank) AS error FROM (SELECT lang AS folder, CASE doc_id % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'transient' WHEN 2 THEN 'peer' ELSE 'fatal' END AS error,
    CASE WHEN lang = 'de' THEN 0 ELSE doc_id % 4 END AS rank FROM documents WHERE NOT (lang = 'de' AND doc_id % 4 <> 0)) GROUP BY folder""")
def error_priority(spark, d):
    """The gravest failure of each folder; in one folder all workers are merely closed."""
    doc = F.col("doc_id")
    error = F.when((doc % 4 == 0) | (F.col("folder") == "de"), "closed").when(doc % 4 == 1, "transient").when(doc % 4 == 2, "peer").otherwise("fatal")
    return integrity.gravest(fx.files(spark, d).select("folder", error.alias("error")))
