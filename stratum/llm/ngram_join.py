"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (words: lower case, split at white space), a set is a sketch of 64 min-hash
tokens. In each run a set takes the paths of the tokens that the run's hash selects, 1 / threshold of them on average, so
that sets of that similarity share one path on average. Sets on one path are a bucket. Buckets of up to BUCKET sets are
compared by brute force on sketches; larger ones are split again on newly selected tokens, in their task if it can hold
them, and after LEVELS selections are compared by brute force whatever their size. Runs repeat until the target recall,
reckoned for pairs that must survive all LEVELS selections.

The pairs found, with a margin for the sketch's error, connect provisional classes; inside these all sets are compared
exactly, block against block, on their whole shingle sets. So links are exact, a link that no run found is still counted
where its ends are connected otherwise, and no group lists its pairs. A bucket beyond what a task holds after LEVELS
selections is a provisional class by itself: its brute force is that of the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import SLICE_BYTES, col, materialize, mix, ship, sized_join, slices, texts, whole_groups
from stratum.llm.components import connected_components

WORDS, THRESHOLD, TOKENS = 5, 0.8, 64
#: Sets in a bucket that is compared by brute force; levels of splitting.
BUCKET, LEVELS = 256, 4
#: Sets and bytes of shingles in a block of a provisional class; a cell of its comparison holds two blocks. Classes of more
#: sets than BLOCK are dealt into DEALT blocks, or as many more or fewer as keep blocks between half of BLOCK and four times
#: as many sets: many enough that no cell is much of what a class shuffles, few enough that sets are not copied too often.
BLOCK, BLOCK_BYTES, DEALT = 256, 4 << 20, 24
#: Sets of one bucket that a task holds; larger buckets are dealt out again. Tokens in which sets must agree to be compared.
HELD = 40_000
CUT = (THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)) * TOKENS
_MULTIPLIERS = np.random.default_rng(64).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Shingle sets as sorted arrays of 64-bit hashes, with a bounded memory of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def sets(self, given: list[str]) -> list[np.ndarray]:
        if len(self.known) > 400_000:
            self.known.clear()
        known = self.known
        split = [t.lower().split() for t in given]
        for word in {w for words in split for w in words}:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        out = []
        with np.errstate(over="ignore"):
            for words in split:
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                if len(h) < WORDS:  # too short for a shingle: all its words are one
                    s = np.array([xxhash.xxh3_64_intdigest(" ".join(words))] if words else [], np.uint64)
                else:
                    s = h[: len(h) - WORDS + 1]
                    for i in range(1, WORDS):
                        s = s * _BASE + h[i : len(h) - WORDS + 1 + i]
                    s = np.unique(mix(s))
                out.append(s)
        return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Min-hash tokens of a set, 16 bits each."""
    least = np.full(TOKENS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1 << 12):
            least = np.minimum(least, (shingles[None, at : at + (1 << 12)] * _MULTIPLIERS[:, None]).min(1))
        return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _signed(x: int) -> int:
    return x - ((x >> 63) << 64)


def _describe(batches):
    shingler = Shingler()
    for batch in slices(batches, 1):
        sets = shingler.sets(texts(batch.column(1)))
        digest = [xxhash.xxh3_128_intdigest(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([_signed(d >> 64) for d in digest], pa.int64()),
                pa.array([_signed(d & (2**64 - 1)) for d in digest], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            ],
            names=["doc", "k1", "k2", "n", "sketch"],
        )


def choose(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths that go on from given ones: (row, new path). Token j of a set is taken if the hash of path, j and its value
    falls below 1 / (threshold * tokens)."""
    with np.errstate(over="ignore"):
        u = mix(path[:, None] + mix(tokens.astype(np.uint64) * np.uint64(TOKENS) + np.arange(TOKENS, dtype=np.uint64) + _BASE))
    row, token = np.nonzero(u < np.uint64(int(2**64 / (THRESHOLD * TOKENS))))
    return row, mix(u[row, token] ^ _BASE)


def survival(shared: int, levels: int) -> float:
    """The chance that sets which agree in so many tokens are still on one path after so many selections."""
    chance = 1.0
    for _ in range(levels):
        chance = 1 - (1 - chance / (THRESHOLD * TOKENS)) ** shared
    return chance


def missed(runs: int) -> float:
    """The chance that all runs miss a pair at the threshold whose buckets are all split LEVELS times, over the sketch's variance."""
    agree = [math.comb(TOKENS, k) * THRESHOLD**k * (1 - THRESHOLD) ** (TOKENS - k) for k in range(TOKENS + 1)]
    return sum(p * (1 - survival(k, LEVELS) * (k >= CUT)) ** runs for k, p in enumerate(agree))


def runs_for(recall: float) -> int:
    """The least number of runs with that recall; CUT alone misses some 10**-6."""
    return next(n for n in range(1, 1000) if missed(n) <= 1 - recall)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


STEP = "kind int, a long, b long, sketch binary"


def _frontier(node: np.ndarray, tokens: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
    row, path = choose(path, tokens)
    return _step(np.ones(len(row), np.int32), path.view(np.int64), node[row], [tokens[r].tobytes() for r in row.tolist()])


def _step(kind, a, b, sketches) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketches, pa.binary())], names=["kind", "a", "b", "sketch"])


def _start(runs: int):
    def run(batches):
        for batch in slices(batches, 1, SLICE_BYTES // 16):
            node, tokens = batch.column(0).to_numpy(), _tokens(batch.column(1))
            for r in range(runs):
                yield _frontier(node, tokens, mix(np.full(len(node), r + 1, np.uint64)))

    return run


def spanning(match: np.ndarray) -> list[tuple[int, int]]:
    """Edges (least member, member) of the components of a boolean matrix."""
    out, free = [], match.sum(1) > match.diagonal()  # sets that match another
    for i in np.flatnonzero(free).tolist():
        if free[i]:
            inside = np.zeros(len(match), bool)
            inside[i] = True
            edge = inside
            while edge.any():
                edge = match[edge].any(0) & ~inside
                inside |= edge
            free &= ~inside
            out += [(i, int(j)) for j in np.flatnonzero(inside) if j != i]
    return out


def similar(tokens: np.ndarray) -> np.ndarray:
    """Which pairs of sketches agree in enough tokens to be worth an exact comparison; no more than BUCKET sets."""
    if len(tokens) <= 40:
        return (tokens[:, None] == tokens[None]).sum(2) >= CUT
    same = np.zeros((len(tokens), len(tokens)), np.uint8)
    for j in range(TOKENS):
        same += tokens[:, j, None] == tokens[None, :, j]
    return same >= CUT


def within(node: np.ndarray, tokens: np.ndarray, path: int, level: int) -> list[tuple[int, int]]:
    """Edges that connect similar sets of one bucket, found by splitting it further as long as it is large."""
    if len(node) <= min(BUCKET, 256):  # counts of `similar` are bytes
        return [(int(node[i]), int(node[j])) for i, j in spanning(similar(tokens))]
    if level >= LEVELS:
        return [(int(node[i]), int(node[j])) for i, j in reached(tokens)]
    row, child = choose(np.full(len(node), path, np.uint64), tokens)
    order = np.argsort(child, kind="stable")
    row, child = row[order], child[order]
    begin = np.append(np.flatnonzero(np.append(True, child[1:] != child[:-1])), len(child)) if len(child) else np.zeros(1, int)
    out = []
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if hi - lo > 1:
            out += within(node[row[lo:hi]], tokens[row[lo:hi]], int(child[lo]), level + 1)
    return out


def reached(tokens: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of similar sketches, by brute force: each set is held against those not reached yet.

    The comparisons are those of all pairs where no two are similar, and a few for each set where most are.
    """
    out, free = [], np.arange(len(tokens))
    rest = np.ascontiguousarray(tokens.T)
    while len(free):
        first, queue = int(free[0]), [int(free[0])]
        free, rest = free[1:], rest[:, 1:]
        while queue and len(free):
            mine = tokens[queue.pop()]
            same = np.zeros(len(free), np.uint8)
            for j in range(TOKENS):
                same += rest[j] == mine[j]
            hit = same >= CUT
            if hit.any():
                found = free[hit].tolist()
                out += [(first, i) for i in found]
                queue += found
                free, rest = free[~hit], np.ascontiguousarray(rest[:, ~hit])
    return out


def forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that connect the same nodes without a cycle."""
    root: dict[int, int] = {}
    out = []
    for a, b in edges:
        x, y = a, b
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        while root.get(y, y) != y:
            root[y] = y = root.get(root[y], root[y])
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def _process(level: int):
    """Buckets are worked off where they lie, with all splits they need; only those too large for one task are dealt out
    again on their next paths (at the last level: connected as a whole)."""

    def run(batches):
        head = None  # path and first set of a bucket that comes in parts
        for table, big in whole_groups(batches, 0, 20_000, HELD, 16 << 20):
            path, node = table["a"].to_numpy(), table["b"].to_numpy()
            tokens = _tokens(table["sketch"])
            edges: list[tuple[int, int]] = []
            if big and level < LEVELS:
                yield _frontier(node, tokens, path.view(np.uint64))
                continue
            if big:
                head = head if head and head[0] == path[0] else (path[0], int(node[0]))
                edges = [(head[1], x) for x in node.tolist() if x != head[1]]
            else:
                begin = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
                size = np.diff(np.append(begin, len(path)))
                pairs = begin[size == 2]
                fit = pairs[(tokens[pairs] == tokens[pairs + 1]).sum(1) >= CUT]
                edges += zip(node[fit].tolist(), node[fit + 1].tolist())
                for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
                    edges += within(node[at : at + n], tokens[at : at + n], int(path[at]) % 2**64, level)
            edges = forest(edges)
            if edges:
                yield _step(np.zeros(len(edges), np.int32), [a for a, _ in edges], [b for _, b in edges], [None] * len(edges))

    return run


def _shingles(batches):
    shingler = Shingler()
    for batch in slices(batches, 1, SLICE_BYTES // 2):
        sets = [s.tobytes() for s in shingler.sets(texts(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *batch.columns[2:]], names=["node", "shingles", "root", "copies", "blocks"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices, some thousand elements at a time."""
    columns = max(256, (1 << 22) // len(sets))
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    number = np.cumsum(np.append(True, flat[1:] != flat[:-1])) - 1
    shared = np.bincount(number)[number] > 1
    number, row = number[shared], row[shared]
    number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1 if len(number) else number
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(number, [low, low + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], number[a:b] - low] = 1
        out += part @ part.T
    out[np.diag_indices(len(sets))] = [len(s) for s in sets]
    return out


CELLS = ("root", "low", "high")


def _compare(batches):
    """Cells (block against block of one provisional class): exact links of each set, weighted by copies, and spanning edges."""
    for table, _ in whole_groups(batches, 0, 2_000, 1 << 40, 4 * BLOCK_BYTES):
        keys = np.stack([table[c].to_numpy() for c in CELLS], 1)
        begin = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys))
        kind, a, b = [], [], []
        for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
            own = table.slice(lo, hi - lo)
            node, first = np.unique(own["node"].to_numpy(), return_index=True)  # rows that repeat an id count once
            own = own.take(pa.array(first))
            block, copies = own["block"].to_numpy(), own["copies"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in own["shingles"].to_pylist()]
            size = np.array([len(s) for s in sets])
            common = intersections(sets).astype(np.int64)
            match = 5 * common >= 4 * (size[:, None] + size[None, :] - common)  # THRESHOLD in whole numbers
            if keys[lo, 1] != keys[lo, 2]:  # two blocks: pairs within one are another cell's
                match &= block[:, None] != block[None, :]
            match[np.diag_indices(len(node))] = False
            links = match @ copies
            for i in np.flatnonzero(links).tolist():
                kind.append(2)
                a.append(int(node[i]))
                b.append(int(links[i]))
            for i, j in spanning(match):
                kind.append(0)
                a.append(int(node[i]))
                b.append(int(node[j]))
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id, n_links): one row per row of df with an id.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least 0.8. class_id is the least id that a
    document is connected to through links, its own if none; n_links counts the other rows linked to it, copies included.
    Texts of fewer than five words are one shingle; null texts and those without a word have none and no link. Rows with a
    null id are left out; rows that share an id share a class. recall sets the number of runs. Copies, equal sets (told by
    128 bits of hash), are one set throughout. An empty table gives an empty result; other columns play no part.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("doc"), col(text_col).alias("text"))
    known = materialize(spark, docs.mapInArrow(_describe, "doc long, k1 long, k2 long, n int, sketch binary"), "sets")
    sets = known.where("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("node"), F.count("*").alias("copies"), F.max("sketch").alias("sketch"), F.max("n").alias("n"))
    sets = materialize(spark, sets, "set-classes")

    rows, edges = sets.select("node", "sketch").mapInArrow(_start(runs_for(recall)), STEP), None
    for level in range(1, LEVELS + 1):
        ordered = rows.select("a", "b", "sketch").repartition("a").sortWithinPartitions("a", "b")
        done = materialize(spark, ordered.mapInArrow(_process(level), STEP), "paths")
        found = done.where("kind = 0").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        rows = done.where("kind = 1")
        if rows.isEmpty():
            break

    members = connected_components(edges)
    members = members.join(sets.select("node", "copies", "n"), "node")
    held = F.when(F.count("*") <= BLOCK, BLOCK).otherwise(F.greatest(F.lit(BLOCK / 2), F.least(F.lit(4 * BLOCK), F.count("*") / F.lit(DEALT))))
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / held, 8 * F.sum("n") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    members = materialize(spark, members.join(sizes, "root").select("node", "root", "copies", "blocks"), "members")
    wanted = sized_join(docs.withColumnRenamed("doc", "node"), members, "node", "inner", 40 * members.count())
    full = wanted.select("node", "text", "root", "copies", "blocks").mapInArrow(_shingles, "node long, shingles binary, root long, copies long, blocks int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = full.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "root", "block", "copies", "shingles", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    cells = dealt.select(F.xxhash64(*CELLS).alias("cell"), "*").repartition("cell").sortWithinPartitions("cell", *CELLS, "node")
    exact = cells.mapInArrow(_compare, "kind int, a long, b long")
    exact = materialize(spark, exact, "links")

    classes = connected_components(exact.where("kind = 0").select("a", "b"))
    links = exact.where("kind = 2").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    own = sets.join(classes, "node", "left").join(links, "node", "left")
    own = own.select("k1", "k2", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = known.select("doc", "k1", "k2", "n").join(own, ["k1", "k2"], "left")
    empty = F.col("n") == 0
    return out.select(F.col("doc").alias("doc_id"), F.when(empty, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))
