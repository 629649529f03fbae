"""Scalar builders against tables of cases."""

import pytest
from pyspark.sql import functions as F

from stratum.functions import device_id, expr
from stratum.sources.fixtures import counters
from stratum.sources.storage import check_credentials, check_schedules, format_duration, hadoop_settings, parse_duration, resolve_uri, retried, store_options


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


def test_names(spark):
    names = ["a/b/c.txt", "r.txt", "a//b/c.txt"]
    assert column(spark, names, "string", expr.dirname) == ["a/b", "", "a//b"]
    assert column(spark, names, "string", expr.basename) == ["c.txt", "r.txt", "c.txt"]
    keys = column(spark, names, "string", expr.file_key)
    assert keys == ["mna/b//c.txt", "mn//r.txt", "mna//b//c.txt"]
    assert column(spark, [*keys, "ms1"], "string", expr.parse_file_key) == [*names, None]
    bad = ["", "/a", "a\0b", "a//b", "a/", "../a", "a/..", "a/b", "a/..b", "a/../", "//", "a//.."]
    assert column(spark, bad, "string", expr.name_error) == ["empty", "absolute", "null byte", "empty component", "empty component", "traversal", "traversal", None, None, "traversal", "absolute", "empty component"]


def test_numbers(spark):
    assert column(spark, [0, 255, 2**62, -1], "long", expr.seq_key) == ["ms" + "0" * 16, "ms" + "0" * 14 + "FF", "ms4" + "0" * 15, None]
    assert column(spark, ["ms" + "0" * 14 + "FF", "x", "msFFFFFFFFFFFFFFFF"], "string", expr.parse_seq_key) == [255, None, None]
    bounds = [0, 15, 16, 63, 64, 255, 256, 1 << 10, 1 << 12, 1 << 14, 1 << 16, 1 << 18, 1 << 20, 1 << 22, 1 << 24, 1 << 26, (1 << 27) - 1, 1 << 27, 1 << 40]
    assert column(spark, bounds, "long", expr.size_bucket) == [0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12, 13, 13]
    assert column(spark, [-1, 0, 4095, 4096], "long", expr.is_inline) == [False, True, True, False]
    epochs = [0, 31, 32, 12345678, (1 << 40) - 1, 1 << 40, -1]
    texts = column(spark, epochs, "long", expr.base32_epoch)
    assert texts[:3] == ["00000000", "0000000Z", "00000010"] and texts[4] == "ZZZZZZZZ" and texts[5:] == [None, None]
    assert column(spark, [*texts[:5], "0000000I", "0000000z", "00000001.json", "1"], "string", expr.parse_base32_epoch) == [*epochs[:5], None, None, 1, None]
    assert column(spark, [0, 5, 6, 9, 10], "int", expr.backoff_seconds) == [1.0, 32.0, 60.0, 60.0, None]
    assert column(spark, [0, 1, 2, 3, 4, 9], "int", expr.wire_type) == ["FILE", "DIRECTORY", "SYMLINK", "SYMLINK", "SYMLINK", "FILE"]
    assert column(spark, ["YES", "0", "on", ""], "string", expr.truthy) == [True, False, True, False]


VECTORS = [
    ([(1, 5), (2, 3)], [(1, 5), (2, 3)], "Equal"), ([], [], "Equal"), ([(1, 6), (2, 3)], [(1, 5), (2, 3)], "Greater"), ([(1, 5)], [(1, 5), (2, 1)], "Less"),
    ([(1, 6), (2, 2)], [(1, 5), (2, 3)], "Concurrent"), ([(1, 1)], [(2, 1)], "Concurrent"), ([(1, 1), (2, 0)], [(1, 1)], "Equal"), ([(2, 3), (1, 5)], [(1, 5), (2, 3)], "Equal"),
    ([(1, 1), (1, 2)], [(1, 1)], "Invalid"), ([(1, 1)], [(3, 1), (3, 1)], "Invalid"), ([(1, 2**64 - 1)], [(1, 2**64 - 2)], "Greater"),
]


def test_version_vectors(spark):
    kind = "array<struct<id:decimal(20,0),value:decimal(20,0)>>"
    from decimal import Decimal

    rows = [(i, *[[(Decimal(k), Decimal(v)) for k, v in side] for side in (a, b)], want) for i, (a, b, want) in enumerate(VECTORS)]
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}, want string")
    assert df.where(expr.vv_compare(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    swap = {"Greater": "Less", "Less": "Greater"}
    for r in df.select("want", expr.vv_compare(F.col("b"), F.col("a")).alias("r")).collect():
        assert r.r == swap.get(r.want, r.want)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((2, False, 1), (1, False, 9), "a"), ((1, False, 9), (2, False, 1), "b"), ((1, False, 1), (1, True, 9), "a"), ((1, True, 9), (1, False, 1), "b"), ((1, False, 9), (1, False, 1), "a"), ((1, False, 1), (1, False, 1), "b")],
)
def test_conflict_winner(spark, a, b, want):
    side = lambda s: (counters(F.lit(s[0])), F.lit(s[1]), F.lit(s[2]))
    assert spark.range(1).select(expr.conflict_winner(*side(a), *side(b)).alias("w")).first().w == want


def test_block_lists(spark):
    h = "a" * 64
    cases = [
        (300, [(h, 0, 100), (h, 100, 200)], None), (0, [], None), (5, [], None), (-1, [], "negative size"), (300, [(h, 0, 0)], "block size"), (300, [(h, 0, -4)], "block size"),
        (1 << 25, [(h, 0, (16 << 20) + 1)], "block too large"), (100, [("ab", 0, 100)], "hash length"), (200, [(h, 0, 100), (h, 50, 100)], "gap"), (200, [(h, 10, 100)], "gap"),
        (250, [(h, 0, 100), (h, 100, 100)], "coverage"), (300, [(h, 0, 0), ("x", 7, 1)], "block size"),
    ]
    df = spark.createDataFrame(cases, "size long, blocks array<struct<hash:string,offset:long,size:int>>, want string")
    assert df.where(~expr.block_list_error(F.col("size"), F.col("blocks")).eqNullSafe(F.col("want"))).collect() == []


def test_device_ids(spark):
    raw = bytes(range(32))
    text = device_id.format_device_id(raw)
    assert len(text) == 63 and device_id.parse_device_id(text.lower()) == (raw, None)
    flipped = text[:3] + ("A" if text[3] != "A" else "B") + text[4:]
    assert device_id.parse_device_id(flipped) == (None, "check digit") and device_id.parse_device_id("ABC") == (None, "length")
    assert device_id.parse_device_id("1" + text[1:]) == (None, "character")
    df = spark.createDataFrame([(bytearray(raw),), (None,), (bytearray(b"x"),)], "raw binary").select(device_id.device_id_text(F.col("raw")).alias("t"))
    assert [r.t for r in df.collect()] == [text, None, None]
    back = df.select(device_id.device_id_bytes(F.col("t")).alias("b")).first().b
    assert bytes(back.raw) == raw and back.error is None


def test_driver_records(tmp_path):
    assert parse_duration("1h") == 3600 and parse_duration("7days") == 604800 and parse_duration("1day 2h") == 93600
    assert [format_duration(s) for s in (3600, 86400, 604800, 90, 0)] == ["1h", "1day", "7days", "1m 30s", "0s"]
    assert check_schedules({"1h": "24h", "1day": "7days"}) == {3600: 86400, 86400: 604800}
    with pytest.raises(ValueError, match="twice"):
        check_schedules({"60m": "1d", "1h": "1d"})
    with pytest.raises(ValueError):
        parse_duration("soon")
    assert resolve_uri(str(tmp_path)) == f"file://{tmp_path}" and resolve_uri("s3://b/p?x=1") == "s3a://b/p"
    assert store_options("s3://b?region=x&empty=", {"AWS_REGION": "", "AWS_KEY": "k"}, {"region": "d", "a": "1"}) == {"region": "x", "a": "1", "aws_key": "k"}
    with pytest.raises(ValueError):
        resolve_uri("nfs://x")


@pytest.mark.parametrize(
    ("uri", "environment", "fine"),
    [
        ("s3://b", {}, False), ("s3://b", {"AWS_ACCESS_KEY_ID": "k"}, True), ("s3a://b?access_key_id=k", {}, True), ("s3://b?skip_signature=true", {}, True), ("s3://b?skip_signature=no", {}, False),
        ("https://x.amazonaws.com/b", {}, False), ("https://example.org/b", {}, True), ("gs://b", {}, False), ("gs://b", {"GOOGLE_APPLICATION_CREDENTIALS": "/f"}, True),
        ("gs://b", {"AWS_ACCESS_KEY_ID": "k"}, False), ("gs://b", {"USE_AMBIENT_CREDS": " Yes "}, True), ("/tmp", {}, True), ("s3://b", {"AWS_ACCESS_KEY_ID": ""}, False),
    ],
)
def test_cloud_stores_need_credentials_by_name(uri, environment, fine):
    options = store_options(uri, environment)
    assert options["timeout"] == "10min"
    if fine:
        check_credentials(uri, options)
    else:
        with pytest.raises(PermissionError):
            check_credentials(uri, options)


def test_options_become_settings():
    options = store_options("s3://b?endpoint=http://h&skip_signature=1", {"AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s"})
    assert hadoop_settings(options) == {
        "fs.s3a.endpoint": "http://h", "fs.s3a.access.key": "k", "fs.s3a.secret.key": "s", "fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider",
    }


def test_transient_errors_are_tried_again():
    waits, left = [], [OSError(), OSError(), None]

    def run():
        error = left.pop(0)
        if error:
            raise error
        return 7

    assert retried(run, lambda e: isinstance(e, OSError), wait=waits.append) == 7 and waits == [1, 2]
    left[:] = [ValueError()]
    with pytest.raises(ValueError):
        retried(run, lambda e: isinstance(e, OSError), wait=waits.append)
    left[:] = [OSError()] * 20
    with pytest.raises(OSError):
        retried(run, lambda e: True, wait=waits.append)
    assert len(left) == 9 and max(waits) == 60
