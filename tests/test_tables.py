"""Versioned tables, streaming intake against a sequential model, and the engine's commands."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratum.engine import Engine
from stratum.operators import collection, leases
from stratum.sources.schema import COUNTERS, TABLES, UPDATES
from stratum.sources.tables import Conflict, Standby, TableStore, UnsupportedVersion
from stratum.streaming import ingest


def seqs(spark, *rows):
    return spark.createDataFrame(list(rows), TABLES["seqs"])


def test_commits_swap_or_conflict(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    base = store.current()
    first = store.commit(base, append={"seqs": seqs(spark, ("f", 1, "a"))})
    with pytest.raises(Conflict):
        store.commit(base, append={"seqs": seqs(spark, ("f", 2, "b"))})
    for i in range(2, 5):
        store.commit(store.current(), append={"seqs": seqs(spark, ("f", i, f"x{i}"))})
    assert store.read("seqs").count() == 4 and store.read("seqs", first).count() == 1 and store.read("peers").count() == 0
    key = store.checkpoint("1h", 100, now=1000.0)
    compacted = store.compact(store.current())
    assert len(compacted.tables["seqs"]) == 1 and store.read("seqs").count() == 4
    store.commit(compacted, replace={"seqs": seqs(spark, ("f", 9, "z"))})
    assert store.vacuum(now=1050.0) == 0  # what is young may be a writer's that has not published yet
    assert store.vacuum(now=1050.0, older_than_s=0) >= 1 and store.read("seqs", store.at(key)).count() == 4
    assert store.checkpoints(now=1050.0)[0]["id"] == key and store.checkpoints(now=1101.0) == []
    assert store.refresh_checkpoints("1h", 500, now=1060.0) == 1 and store.checkpoints(now=1101.0)[0]["id"] == key and store.checkpoints(now=1561.0) == []
    store.vacuum(now=1561.0, older_than_s=0)
    assert store.read("seqs").count() == 1


def test_manifests_are_whole_or_absent(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: _tried(store, i), range(8)))
    assert made.count(True) == 1 and store._read("manifests/000000000001.json")["writer"] in range(8)
    assert [p for p in (tmp_path / "manifests").iterdir() if p.suffix not in (".json", ".crc")] == []


def _tried(store, i):
    try:
        store._create("manifests/000000000001.json", {"writer": i})
        return True
    except Conflict:
        return False


def test_epochs_fence_and_formats_are_checked(spark, tmp_path):
    old, new = TableStore(spark, f"file://{tmp_path}"), TableStore(spark, f"file://{tmp_path}")
    old.activate(3)
    old.commit(old.current(), append={"seqs": seqs(spark, ("f", 1, "a"))})
    new.activate(4)
    with pytest.raises(Standby):
        old.commit(old.current(), append={"seqs": seqs(spark, ("f", 2, "b"))})
    with pytest.raises(Standby):
        old.activate(3)
    assert new.commit(new.current(), append={"seqs": seqs(spark, ("g", 2, "b"))}).epoch == 4
    new.remove_folder("f")
    assert [r.folder for r in new.read("seqs").collect()] == ["g"]
    raw = new.identity()
    assert len(raw) == 32 and old.identity() == raw != new.identity(regenerate=True) == old.identity()
    new._create("manifests/999999999999.json", {"generation": 1, "format": 99})
    with pytest.raises(UnsupportedVersion):
        new.current()


def version(*pairs):
    return [(Decimal(i + 1), Decimal(v)) for i, v in enumerate(pairs)]


BLOCK = hashlib.sha256(b"0123456789").hexdigest()
OTHER = hashlib.sha256(b"others").hexdigest()


def update(arrival, name, vector, block=BLOCK, deleted=False, device=5):
    return ("f", name, arrival, device, "FILE", 10, 0, 0, version(*vector), arrival + 1, [(block, 0, 10, None, None)], deleted, False)


def relation(new, old):
    above, below = any(a > b for a, b in zip(new, old)), any(a < b for a, b in zip(new, old))
    return "conflict" if above and below else "after" if above else "none"


def test_appended_rows_replace_those_of_their_key(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    for rows in ([("f", 1, "a"), ("f", 2, "b")], [("f", 3, "a")], [("f", 4, "c"), ("g", 1, "a")]):
        store.commit(store.current(), append={"seqs": seqs(spark, *rows)})
    want = [("f", 2, "b"), ("f", 3, "a"), ("f", 4, "c"), ("g", 1, "a")]
    assert sorted(map(tuple, store.read("seqs").collect())) == want
    store.compact(store.current(), least_files=2)
    assert len(store.current().tables["seqs"]) == 1 and sorted(map(tuple, store.read("seqs").collect())) == want


@pytest.mark.parametrize(("policy", "generations"), [("theirs", 16), ("backup", 16), ("backup", 1)])
def test_streaming_intake_equals_sequential_model(spark, tmp_path, policy, generations):
    store = TableStore(spark, f"file://{tmp_path}/store")
    rng = random.Random(11)
    names = [f"d/n{i}" for i in range(12)]
    start = [("f", n, "FILE", 10, 0, 0, version(1, 1), i + 1, [(BLOCK, 0, 10, None, b"0123456789")], False, False) for i, n in enumerate(names)]
    store.commit(store.current(), replace={"files": spark.createDataFrame(start, TABLES["files"]), "seqs": seqs(spark, *[("f", i + 1, n) for i, n in enumerate(names)])})
    updates = [update(i, rng.choice(names), (rng.randint(0, 4), rng.randint(0, 4)), rng.choice([BLOCK, BLOCK, BLOCK, OTHER]), rng.random() < 0.2) for i in range(60)]
    updates += [update(60, "/bad", (9, 9)), update(61, "d/new", (1, 0)), update(62, "d/n1", (9, 9))[:5] + (-1,) + update(62, "d/n1", (9, 9))[6:]]
    state, need, copies = {n: ((1, 1), BLOCK, False) for n in names}, {}, {}
    for u in updates:
        new = (tuple(int(v) for _, v in u[8]), u[10][0][0], u[11])
        if u[1] == "/bad" or u[5] < 0:
            continue
        if u[1] not in state:
            need[u[1]] = u[2]
            continue
        old = state[u[1]]
        kind = relation(new[0], old[0])
        if kind == "conflict":
            mine = policy == "backup" and (sum(old[0]), not old[2], 0) > (sum(new[0]), not new[2], 5)
            if policy == "backup":
                copies[u[1]] = new if mine else old
            state[u[1]] = old if mine else new
        elif kind == "after" and new[1] == old[1]:
            state[u[1]] = new
        elif kind == "after":
            need[u[1]] = u[2]
    source = f"{tmp_path}/updates"
    for part in (updates[:25], updates[25:]):
        spark.createDataFrame(part, UPDATES).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        ingest.start(ingest.source(spark, source, UPDATES, max_files=1), store, f"{tmp_path}/offsets", once=True, policy=policy, generations=generations).awaitTermination()
    assert len(store.current().tables["files"]) == (3 if generations == 16 else 1)
    rows = store.read("files").collect()
    row = lambda r: (tuple(int(c.value) for c in r.version), r.blocks[0].hash, r.deleted)
    assert {r.name: row(r) for r in rows if not r.name.endswith(".sync-conflict")} == state
    assert {r.name.removesuffix(".sync-conflict"): row(r) for r in rows if r.name.endswith(".sync-conflict")} == copies and bool(copies) == (policy == "backup")
    inherited = [r.blocks[0].inline_data for r in rows if r.name.endswith(".sync-conflict") and r.blocks[0].hash == BLOCK]
    assert policy == "theirs" or b"0123456789" in map(bytes, filter(None, inherited))
    assert {r.name: r.arrival for r in store.read("inbox").collect()} == need
    found = {r.rule for r in Engine(spark, f"{tmp_path}/store").check().collect()}
    assert found <= {"unresolvable block", "missing reference", "missing pointer"}  # of blocks that have not come in yet
    entries = {(r.name, r.seq) for r in store.read("seqs").collect()}
    assert entries == {(r.name, r.sequence) for r in rows} and len({s for _, s in entries}) == len(rows)
    assert store.read("folder_meta").first().max_sequence == max(s for _, s in entries)
    assert [(r.device, r.max_sequence) for r in store.read("peers").collect()] == [(5, 63)]
    before = store.current()
    ingest.Intake(store)(spark.createDataFrame(updates, UPDATES), 0)  # a replayed batch changes nothing
    assert store.current() == before


def test_blocks_come_in_files_are_promoted_and_swept(spark, tmp_path):
    """Staged, filled, promoted, checked, overwritten and swept, through the engine alone."""
    engine = Engine(spark, str(tmp_path))
    data = {c: c.encode() * 5000 for c in "abc"} | {"s": b"small"}
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in data.items()}

    def row(name, keys, vector=(1, 0), deleted=False):
        at, blocks = 0, []
        for k in keys:
            blocks.append((sha[k], at, len(data[k]), None, None))
            at += len(data[k])
        return ("f", name, at, "FILE", version(*vector), blocks, deleted)

    def staged(arrival, r, epoch=0):
        folder, name, size, kind, v, blocks, deleted = r
        return (folder, epoch, arrival, name, kind, size, 0, 0, v, None, blocks, deleted, False)

    assert [(r.id, r.key, r.error) for r in engine.register(spark.createDataFrame([("f", "F"), ("e", "E")], "id string, label string")).orderBy("id").collect()] == [("e", 0, None), ("f", 1, None)]
    assert [r.error for r in engine.register(spark.createDataFrame([("f", "F")], "id string, label string")).collect()] == ["duplicate"]
    assert [(r.folder, r.label) for r in engine.folders().collect()] == [("e", "E"), ("f", "F")]
    first, second = row("x/one", "abs"), row("y/two", "ac")
    engine.store.commit(engine.store.current(), replace={"inbox": spark.createDataFrame([staged(0, first), staged(1, second)], TABLES["inbox"])})
    done = lambda *rows: spark.createDataFrame([(r[0], 0, r[1], r[4]) for r in rows], f"folder string, epoch bigint, name string, version {COUNTERS}")
    assert [(r.name, r.missing) for r in engine.promote(done(first, second)).orderBy("name").collect()] == [("x/one", 3), ("y/two", 2)]
    blocks = lambda name, keys: spark.createDataFrame([("f", name, sha[k], data[k]) for k in keys], "folder string, name string, hash string, data binary")
    assert engine.store_blocks(blocks("x/one", "abs"), "inbox").count() == 0
    assert [r.error for r in engine.store_blocks(blocks("x/one", "c"), "inbox").collect()] == ["not found"]
    assert engine.store_blocks(blocks("y/two", "ac"), "inbox").count() == 0
    assert engine.promote(done(first, second)).count() == 0 and engine.store.read("inbox").count() == 0
    assert engine.check().collect() == [] and engine.store.read("block_data").count() == 3
    ask = spark.createDataFrame([("f", "x/one", 4000, 7000), ("f", "x/one", 9998, 99), ("f", "gone", 0, 5)], "folder string, name string, start long, length long")
    got = {(r["name"], r.start): (r.bytes, r.error) for r in engine.read(ask).collect()}
    whole = data["a"] + data["b"] + data["s"]
    assert got == {("x/one", 4000): (whole[4000:11000], None), ("x/one", 9998): (whole[9998:], None), ("gone", 0): (None, "not found")}
    key = engine.checkpoint("1h")
    third = row("x/one", "c", (2, 0))
    engine.store.commit(engine.store.current(), replace={"inbox": spark.createDataFrame([staged(2, third), staged(3, row("z", "a"), epoch=-1)], TABLES["inbox"])})
    engine.store_blocks(blocks("x/one", "c"), "inbox")
    assert engine.promote(done(third)).count() == 0 and engine.store.read("block_data").count() == 3
    counts = {r["class"]: (r.kept, r.dropped) for r in engine.compact().collect()}
    assert counts == {"files": (2, 0), "inbox": (0, 1), "seqs": (2, 0), "block_data": (2, 1), "block_ptrs": (4, 1), "block_refs": (4, 1)}
    assert engine.check().collect() == []
    engine.store.vacuum(older_than_s=0)
    assert {(r["name"], r.start): r.bytes for r in engine.read(ask, key).collect()}[("x/one", 4000)] == whole[4000:11000]  # the checkpoint pins it
    assert {r.bytes for r in engine.read(ask).where("name = 'x/one'").collect()} == {data["c"][4000:], b""}


def test_stateful_completion(spark, tmp_path):
    schema = "folder string, name string, version string, hash string, needed long"
    for rows in ([("f", "a", "1", "x", 2), ("f", "b", "1", "x", 1)], [("f", "a", "2", "y", 2)], [("f", "a", "2", "z", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ingest.completion(stream).writeStream.format("memory").queryName("completed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination()
    assert {(r["name"], r.version, r.blocks) for r in spark.table("completed").collect()} >= {("b", "1", 1)}
    assert spark.table("completed").where("name = 'a' AND version = '2'").count() == 1


def test_engine_commands(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    row = ("f", "a/b.txt", "FILE", 10, 0, 0, version(1), 1, [("0" * 64, 0, 10, None, None)], False, False)
    meta = spark.createDataFrame([("f", 2, None)], TABLES["folder_meta"])
    engine.store.commit(engine.store.current(), replace={"files": spark.createDataFrame([row], TABLES["files"]), "seqs": seqs(spark, ("f", 1, "a/b.txt"), ("f", 2, "gone")), "folder_meta": meta})
    assert [r.folder for r in engine.folders().collect()] == ["f"]
    assert {(r.rule, r.subject) for r in engine.check().collect()} == {("dangling sequence", "2"), ("unresolvable block", "a/b.txt#0"), ("missing reference", "a/b.txt#0"), ("missing pointer", "a/" + "0" * 64)}
    key = engine.checkpoint("1h")
    assert [(r.entry, r.is_dir) for r in engine.read_dir(key).collect()] == [("a", True)]
    with pytest.raises(ValueError):
        engine.checkpoint("5m")
    engine.set_schedule("2h", "3days")
    engine.set_schedule("1day", None)
    assert engine.schedules == {3600: 86400, 7200: 259200}
    assert len(engine.device_id()) == 63 and engine.device_id() == engine.device_id() != engine.device_id(regenerate=True)
    engine.remove("f")
    assert engine.folders().count() == 0


def test_claims_take_one_epoch_each(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda h: store.claim(h, 0, 180), "abcd")) == [0, 1, 2, 3]
    held = store.leases()
    first = leases.owner(held).first()
    assert first.epoch == 0 and {r.status for r in leases.status(held, held.selectExpr("lock", "last_modified as now").limit(1)).collect()} == {"Active"}
    store.drop_claims([r.epoch for r in held.join(leases.released(held, first.holder), ["lock", "epoch"], "left_anti").collect()])
    assert sorted(r.epoch for r in store.leases().collect()) == [1, 2, 3]
    assert store.claim("e", 0, 180) == 4


def test_sweeps_stop_at_a_corrupt_payload_key(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    tables = {t: store.read(t) for t in ("files", "inbox", "seqs", "block_ptrs", "block_refs")} | {"block_data": spark.createDataFrame([("f", 5, b"x")], TABLES["block_data"])}
    swept = collection.sweep(tables, spark.createDataFrame([], "folder string, floor long"), 0)
    with pytest.raises(Exception, match="corrupt payload key"):
        swept["block_data"].collect()


def test_entry_points_survive_without_the_optional_package(spark, monkeypatch):
    import __spark_entry__

    assert __spark_entry__._optional("stratum.not_there") is None and __spark_entry__._optional("stratum.not_there.deeper") is None
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).where(F.col("outcome").isNull()).count() == 0
