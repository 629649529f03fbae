"""Every query against its SQL twin, and the invariants of the data model as queries without rows."""

import datetime
import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratum.operators import blocks as block_ops
from stratum.operators import collection, integrity, leases, snapshots
from stratum.operators.numbering import arrival_bucket, numbered
from stratum.plans.catalogue import ORACLE_SQL, QUERIES, _tables
from stratum.sources import fixtures as fx


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "events"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows == sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())


FAULTY = "hash like '00%' or hash like 'ff%' or hash like 'ab%' or hash like 'b1%' or hash like 'b2%' or hash like 'd7%' or hash like 'd8%'"


def test_clean_tables_have_no_findings(spark, sf):
    t = _tables(spark, sf)
    files = t["files"]
    clean = t | {"seqs": fx.seqs(spark, sf, clean=True), "inbox": fx.inbox(spark, sf), "meta": files.groupBy("folder").agg(F.max("sequence").alias("max_sequence"))}
    clean |= {k: t[k].where(~F.expr(FAULTY)) for k in ("blocks", "ptrs", "data")}
    assert integrity.findings(clean, "full").collect() == []


def test_levels_are_cumulative(spark, sf):
    t = _tables(spark, sf)
    counts = [integrity.findings(t, level).count() for level in ("quick", "structural", "full")]
    assert counts == sorted(counts) and counts[0] < counts[2]


def test_faults_on_the_readers_path_are_found(spark):
    """Garbage inline, a number without payload though a pointer has one, one too low, and nothing at all."""
    sha = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("good", "bad!", "far", "low", "none")}
    rows = [(0, sha["good"], 4, None, b"good"), (1, sha["bad!"], 4, None, b"garbage"), (2, sha["far"], 3, 77777, None), (3, sha["low"], 3, 7, None), (4, sha["none"], 4, None, None), (5, "12", 4, None, None)]
    blocks = spark.createDataFrame([("f", "d/x", False, *r) for r in rows], "folder string, name string, deleted boolean, block_no int, hash string, size int, blockseq long, inline_data binary")
    data = spark.createDataFrame([("f", 2000, b"far"), ("f", 7, b"low")], "folder string, blockseq long, data binary")
    found = {(r.rule, r.subject) for r in integrity.block_findings(block_ops.resolve_blocks(blocks, data)).collect()}
    assert found == {("size mismatch", "d/x#1"), ("checksum", "d/x#1"), ("unresolvable block", "d/x#2"), ("unresolvable block", "d/x#3"), ("unresolvable block", "d/x#4"), ("hash length", "d/x#5")}


def test_range_reads_give_the_bytes(spark, sf):
    source = fx.files(spark, sf, text=True).select("folder", "name", "deleted", "text")
    asked = source.select("folder", "name", F.lit(1000).cast("long").alias("start"), F.lit(1500).cast("long").alias("length"))
    got = {r.name: (r.bytes, r.error) for r in block_ops.read_range(fx.files(spark, sf), fx.file_blocks(spark, sf), fx.block_data(spark, sf), asked).collect()}
    for r in source.collect():
        content, error = got[r.name]
        assert error == "not found" if r.deleted else error in (None, "short block")
        assert error or bytes(content) == (r.text or "").encode()[1000:2500]
    assert sum(e is None for _, e in got.values()) > 100


def test_numbers_equal_those_of_one_window(spark):
    rows = [("a" if i % 3 else "b", i * 7919 % 200_003, f"n{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "folder string, arrival long, name string")
    got = numbered(df, "folder", arrival_bucket(F.col("arrival")), ["arrival", "name"])
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("arrival", "name")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_listing_a_directory_pushes_its_prefix_to_the_scan(spark, tmp_path):
    spark.createDataFrame([("f", "a/b/c", 1, False)], "folder string, name string, size long, deleted boolean").write.parquet(f"{tmp_path}/files")
    plan = snapshots.read_dir(spark.read.parquet(f"{tmp_path}/files"), "a")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,a/)" in plan


def test_sweep_never_drops_live_rows(spark, sf):
    live = block_ops.live_blocks(fx.blocks(spark, sf), fx.block_ptrs(spark, sf))
    kept = collection.keep_live(fx.block_data(spark, sf), live, ["folder", "blockseq"])
    assert kept.count() == fx.block_data(spark, sf).count()


def test_compaction_thresholds(spark):
    rows = [("a", "meta", 3, 1), ("a", "meta", 4, 1), ("a", "meta", 0, 2), ("a", "blocks", 31, 9), ("a", "blocks", 32, 0)]
    df = spark.createDataFrame(rows, "folder string, segment string, l0 int, runs int")
    assert [(r.segment, r.l0) for r in collection.compaction_candidates(df).collect()] == [("meta", 4), ("meta", 0), ("blocks", 32)]


def test_read_dir_lists_each_name_once(spark):
    rows = [("f", "a/b/c", 1, False), ("f", "a/b/d", 2, False), ("f", "a/x", 3, False), ("f", "a/gone", 4, True), ("f", "ab/y", 5, False)]
    df = spark.createDataFrame(rows, "folder string, name string, size long, deleted boolean")
    assert {(r.entry, r.is_dir, r.size) for r in snapshots.read_dir(df, "a").collect()} == {("b", True, None), ("x", False, 3)}
    assert {r.entry for r in snapshots.read_dir(df, "").collect()} == {"a", "ab"} and snapshots.read_dir(df, "zz").collect() == []


def lease_rows(spark, rows):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    full = [("l", e, h, p, 60, at + datetime.timedelta(seconds=s)) for e, h, p, s in rows] + [("other", 0, "z", 9, 60, at)]
    return spark.createDataFrame(full, "lock string, epoch long, holder string, priority long, duration_s long, last_modified timestamp")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, "a", 0, 0)], ["Owner"]),
        ([(1, "a", 0, 0), (2, "b", 0, 10)], ["Owner", "Failed"]),
        ([(1, "a", 0, 0), (2, "b", 5, 10)], ["Yielded", "Queued"]),
        ([(1, "a", 0, 0), (2, "b", 0, 61)], ["Owner", "Owner"]),
        ([(1, "a", 0, 100), (2, "b", 0, 10)], ["Owner", "QueuedBackwardClock"]),
        ([(1, "a", 0, 0), (2, "a", 0, 1)], ["Owner", "Owner"]),
    ],
)
def test_lease_outcomes(spark, rows, want):
    assert [r.outcome for r in leases.outcomes(lease_rows(spark, rows)).where("lock = 'l'").orderBy("epoch").collect()] == want
