"""Exact removal of repeated byte strings: suffix arrays by two-stage sorting, over a corpus dealt out by content.

Every window of `length` bytes names the anchor in it, the 32-byte string of least hash (leftmost of equals). Equal windows
name equal anchors, so windows meet in the task that holds their anchor, and nothing else has to. Consecutive windows of one
anchor form a cell, some 130 bytes of text for 35 windows. Copies of a cell are merged before and after the shuffle: the
earliest stands for all, the windows of the others are repeats. The texts of cells that share an anchor but differ are
gathered, their suffixes are sorted in two stages (those smaller than their successors directly, the others induced from
them by bucket scans), and adjacent suffixes with a common prefix of `length` bytes form the classes of equal windows.

Hot anchors, those with over HOT_LOCAL different cells in a batch or HOT_TOTAL in all, are split: their cells fall into
single windows, which are dealt out with their texts by their own hash, so that no task gathers the texts around one common
line. Suffix arrays decide them like all others; a window with so many copies that they come in parts goes on from part to
part by what stood first. Both numbers decide where windows are compared, never the result.

What is a copy of a cell is told by two hashes of 64 bits, of the anchor and of the cell's text. Only cells of one anchor
are compared, HOT_TOTAL classes at most, so 3 * 10**12 cells (100 TB) expect 3 * 10**12 * 2048 / 2**64 < 0.0004 wrong merges.
Everything else compares bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm.common import col, map_rows, materialize, mix, ragged, ship, slices, utf8, whole_groups

ANCHOR = 32
BLOCK = 1 << 18
HOT_LOCAL, HOT_TOTAL = 64, 4096
#: Bytes of the texts that one suffix array holds, unless the cells of one anchor have more; rows of one key held at a time.
SORT_BYTES, PART = 3 << 19, 50_000
SEPARATOR = 0xFF  # never a byte of UTF-8
CELL, REPEAT, HOT_CELL, HOT_MARK = range(4)
_TABLE = np.random.default_rng(32).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROWS = "kind int, key long, cell long, doc long, start long, n int"
NAMES = ["kind", "key", "cell", "doc", "start", "n"]
TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


# --- suffix array ---------------------------------------------------------------------------------------------------------


def words_at(text: np.ndarray) -> np.ndarray:
    """For every position the next eight bytes as one big-endian number, zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(text)] << np.uint64(56 - 8 * i)
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the suffix one byte on; the last is not."""
    n = len(text)
    turn = np.flatnonzero(text[:-1] != text[1:])
    after = np.searchsorted(turn, np.arange(n))  # the next position whose byte differs from its successor's
    rising = np.append(text[turn] < text[turn + 1], False)
    return rising[after]


def sort_directly(text: np.ndarray, positions: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` bytes: by words of eight bytes, ties alone going on."""
    n = len(text)
    order = positions[np.argsort(words[positions], kind="stable")]
    key = words[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(order)]) - 1
    for at in range(8, depth, 8):
        rows = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
        if not len(rows):
            break
        p = order[rows]
        ahead = p + at
        key = words[np.minimum(ahead, n - 1)]
        # a suffix that has ended precedes one that goes on with zeros; of two that have, the shorter comes first
        done = ahead >= n
        key = np.where(done, (n - p).astype(np.uint64), key)
        rank = np.lexsort((key, ~done, group[rows]))
        order[rows] = p[rank]
        g, key, done = group[rows][rank], key[rank], done[rank]
        fresh = np.ones(len(order), bool)
        fresh[1:] = group[1:] != group[:-1]
        fresh[rows[1:]] |= (g[1:] != g[:-1]) | (key[1:] != key[:-1]) | (done[1:] != done[:-1])
        group = np.cumsum(fresh) - 1
    return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions by the order of their suffixes, exact in the first `depth` bytes (in all of them if None).

    Two stages: suffixes smaller than their successors are sorted directly and put at the ends of their buckets; one scan
    over the buckets, first byte by first byte, induces all others at the buckets' fronts. Scans go slab by slab: what a
    slab adds to its own bucket is the next slab.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = smaller_than_successor(text)
    direct = sort_directly(text, np.flatnonzero(small), n if depth is None else depth, words_at(text))
    sizes = np.bincount(text, minlength=256)
    front = np.cumsum(sizes) - sizes
    head, behind = front.copy(), front + sizes
    own = np.bincount(text[direct], minlength=256)
    out = np.empty(n, np.int64)
    out[ragged(behind - own, own)] = direct  # sorted suffixes are sorted by first byte

    def induce(slab: np.ndarray) -> None:
        before = slab[slab > 0] - 1
        before = before[~small[before]]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            byte = byte[order]
            new = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            count = np.diff(np.append(new, len(byte)))
            out[ragged(head[byte[new]], count)] = before[order]
            head[byte[new]] += count

    out[head[text[-1]]] = n - 1
    head[text[-1]] += 1
    for byte in np.flatnonzero(sizes):
        at = front[byte]
        while at < head[byte]:
            slab = out[at : head[byte]]
            at = head[byte]
            induce(slab)
        induce(out[behind[byte] - own[byte] : behind[byte]])
    return out


def share_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of each pair of positions has `length` bytes (8 or more); both must have as many left."""
    same = np.ones(len(a), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        rows = np.flatnonzero(same)
        same[rows] = words[a[rows] + at] == words[b[rows] + at]
    return same


def repeats_in(cells: list[bytes], doc: np.ndarray, start: np.ndarray, length: int):
    """Windows of the cells that also start earlier, in (doc, start) order, in another of them: (cell number, offset)."""
    sizes = np.array([len(c) for c in cells])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"".join(c + b"\xff" for c in cells), np.uint8)
    words = words_at(text)
    windows = np.zeros(len(text), bool)
    windows[ragged(begin, np.maximum(sizes - length + 1, 0))] = True
    order = suffix_array(text, length)
    order = order[windows[order]]
    if not len(order):
        return np.empty(0, int), np.empty(0, int)
    equal = share_prefix(words, order[:-1], order[1:], length)
    label = np.cumsum(np.append(True, ~equal)) - 1
    cell = np.searchsorted(begin, order, "right") - 1
    where = start[cell] + (order - begin[cell])
    later = _later(label, doc[cell], where)
    return cell[later], (order - begin[cell])[later]


def _later(label: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows of which an earlier (doc, start) has the same label."""
    order = np.lexsort((start, doc, label))
    l, d, s = label[order], doc[order], start[order]
    first = np.append(True, l[1:] != l[:-1])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    out = np.empty(len(label), bool)
    out[order] = (d != d[lead]) | (s != s[lead])
    return out


# --- cells ----------------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the text: the hash of its anchor, and the anchor's position."""
    hashed, power, width = _TABLE[data], np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while width < ANCHOR:
            hashed = hashed[:-width] * power + hashed[width:]
            power, width = power * power, 2 * width
        hashed = mix(hashed)
    low = np.uint64(BLOCK * 2 - 1)
    least = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    span, width = length - ANCHOR + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & low).astype(np.int64)
    return hashed[at].view(np.int64), at


def cells_of(data: np.ndarray, offsets: np.ndarray, length: int):
    """Cells of all texts of a batch: anchor, hash of the content, row, start in the row, number of windows."""
    parts = []
    starts, ends = offsets[:-1], offsets[1:]
    for low in range(0, len(data), BLOCK):  # a block and what its last windows reach into
        piece = data[low : low + BLOCK + length - 1]
        if len(piece) < length:
            break
        key, at = anchors(piece, length)
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(key), "left")
        # windows within one text
        lo, hi = np.maximum(starts[first:last] - low, 0), np.minimum(ends[first:last] - length + 1 - low, len(key))
        rows = np.flatnonzero(hi > lo)
        owner = np.repeat(first + rows, (hi - lo)[rows])
        where = ragged(lo[rows], (hi - lo)[rows])
        if not len(where):
            continue
        new = np.ones(len(where), bool)
        new[1:] = (at[where][1:] != at[where][:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(where)))
        view, left = memoryview(piece), where[begin]
        digest = [xxhash.xxh3_64_intdigest(view[s : s + n + length - 1]) for s, n in zip(left.tolist(), count.tolist())]
        parts.append((key[left], np.array(digest, np.uint64).view(np.int64), owner[begin], left + low - starts[owner[begin]], count))
    if not parts:
        return [np.empty(0, np.int64)] * 5
    return [np.concatenate(x) for x in zip(*parts)]


def _rows(kind, key, cell, doc, start, n) -> list[np.ndarray]:
    size = len(doc)
    return [np.broadcast_to(np.asarray(x, t.to_pandas_dtype()), size) for x, t in zip((kind, key, cell, doc, start, n), TYPES)]


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*parts), TYPES)], names=NAMES)


def _gather(length: int):
    """Texts to cells; copies within a batch are merged here, so that a reducer gets one row a batch of each."""

    def run(batches):
        for batch in slices(batches, 1):
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            key, cell, row, start, n = cells_of(data, offsets, length)
            if not len(key):
                continue
            doc = ids[row]
            order = np.lexsort((start, doc, cell, key))
            key, cell, row, doc, start, n = (x[order] for x in (key, cell, row, doc, start, n))
            new_key = np.append(True, key[1:] != key[:-1])
            new = new_key | np.append(True, cell[1:] != cell[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = ((doc != doc[lead]) | (start != start[lead])) & ~new
            keep = np.flatnonzero(new)
            group = np.cumsum(new_key) - 1
            hot = (np.bincount(group, new) > HOT_LOCAL)[group]
            cold = keep[~hot[keep]]
            parts = [_rows(CELL, key[cold], cell[cold], doc[cold], start[cold], n[cold])]
            marks = np.flatnonzero(new_key & hot)
            parts.append(_rows(HOT_MARK, key[marks], 0, doc[marks], 0, 0))
            parts.append(_merged(doc[later], start[later], n[later]))
            apart = keep[hot[keep]]
            parts.append(_rows(HOT_CELL, mix(cell[apart].view(np.uint64)).view(np.int64), cell[apart], doc[apart], start[apart], n[apart]))
            yield _batch(parts)

    return run


def _merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Repeats, adjoining ones of a document joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), (start + n)[order].astype(np.int64)
    if not len(doc):
        return _rows(REPEAT, 0, 0, doc, start, end)
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > _reach(doc, end)[:-1]))
    first = np.flatnonzero(new)
    return _rows(REPEAT, mix(doc[first].view(np.uint64)).view(np.int64), 0, doc[first], start[first], np.maximum.reduceat(end, first) - start[first])


def _reach(doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The furthest end so far within each document (rows sorted by document, then start)."""
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    lift = group * (int(end.max()) + 1)
    return np.maximum.accumulate(end + lift) - lift


def _merge_cells(batches):
    """Rows sorted by (key, cell, doc, start): repeats among identical cells, and the cells that texts must decide."""
    for table, big in whole_groups(batches, 1, 200_000, 4_000_000):
        kind, key, cell, doc, start, n = (table[c].to_numpy() for c in NAMES)
        parts = []
        other = np.flatnonzero((kind == REPEAT) | (kind == HOT_CELL))
        parts.append([x[other] for x in (kind, key, cell, doc, start, n)])
        marked = np.unique(key[kind == HOT_MARK])
        own = np.flatnonzero(kind == CELL)
        key, cell, doc, start, n = (x[own] for x in (key, cell, doc, start, n))
        if len(own):
            new_key = np.append(True, key[1:] != key[:-1])
            new = new_key | np.append(True, cell[1:] != cell[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[lead]) | (start != start[lead])
            parts.append(_rows(REPEAT, mix(doc[later].view(np.uint64)).view(np.int64), 0, doc[later], start[later], n[later]))
            group = np.cumsum(new_key) - 1
            classes = np.bincount(group, new)[group]
            hot = np.isin(key, marked) | (classes > HOT_TOTAL) | big
            ask = np.flatnonzero(new & ((classes > 1) | hot))
            parts.append(_rows(np.where(hot[ask], HOT_CELL, CELL), key[ask], 0, doc[ask], start[ask], n[ask]))
        yield _batch(parts)


TEXTS = "kind int, key long, doc long, start long, n int, text binary"
TEXT_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _cut_texts(length: int):
    """Documents with the list of their cells to decide: the texts of cells, and of the windows of hot ones.

    Equal windows of a batch are merged here, so that one row a batch of each goes on.
    """

    def run(batches):
        for batch in slices(batches, 1):
            out: list[list] = [[], [], [], [], [], []]
            windows: dict[bytes, tuple[int, int]] = {}
            later: list[tuple[int, int]] = []
            for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                for a in asked:
                    start = a["start"]
                    piece = data[start : start + a["n"] + length - 1]
                    if a["kind"] == CELL:
                        for x, v in zip(out, (CELL, a["key"], doc, start, a["n"], piece)):
                            x.append(v)
                        continue
                    for i in range(a["n"]):
                        window, place = piece[i : i + length], (doc, start + i)
                        first = windows.setdefault(window, place)
                        if first != place:
                            if place < first:
                                windows[window], place = place, first
                            later.append(place)
            for window, (doc, start) in windows.items():
                digest = xxhash.xxh3_64_intdigest(window, 1)
                for x, v in zip(out, (CELL, digest - ((digest >> 63) << 64), doc, start, 1, window)):
                    x.append(v)
            columns = [pa.array(x, t) for x, t in zip(out, TEXT_TYPES)]
            if later:
                doc, start = np.array(later, np.int64).T
                kind, key, _, doc, start, n = _merged(doc, start, np.ones(len(doc), np.int64))
                more = [pa.array(x, t) for x, t in zip((kind, key, doc, start, n), TEXT_TYPES)] + [pa.nulls(len(doc), pa.binary())]
                columns = [pa.concat_arrays([x, y]) for x, y in zip(columns, more)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "doc", "start", "n", "text"])

    return run


def _decide(length: int):
    """Cells of one key together: suffix arrays over a few megabytes of them at a time."""

    def run(batches):
        giant, lead = None, None  # a key whose cells come in parts, and what stood first in the parts so far
        for table, big in whole_groups(batches, 1, 1 + SORT_BYTES // 136, PART):
            kind, key, doc, start, n = (table[c].to_numpy() for c in ("kind", "key", "doc", "start", "n"))
            parts = []
            passed = np.flatnonzero(kind == REPEAT)
            parts.append(_rows(REPEAT, key[passed], 0, doc[passed], start[passed], n[passed]))
            cells = np.flatnonzero(kind == CELL)
            if len(cells):
                texts, doc, start = table["text"].take(pa.array(cells)).to_pylist(), doc[cells], start[cells]
                if big and giant == key[0]:
                    texts, doc, start = lead[0] + texts, np.append(lead[1], doc), np.append(lead[2], start)
                cell, offset = repeats_in(texts, doc, start, length)
                parts.append(_merged(doc[cell], start[cell] + offset, np.ones(len(cell), np.int64)))
                if big:
                    first = np.setdiff1d(np.arange(len(texts)), cell)
                    giant, lead = key[0], ([texts[i] for i in first], doc[first], start[first])
            yield _batch(parts)

    return run


def _join_runs(length: int):
    """Repeats sorted by (doc, start): the byte runs they cover, maximal, as one row a document."""

    def joined(doc, start, end):
        new_doc = np.append(True, doc[1:] != doc[:-1])
        first = np.flatnonzero(new_doc | np.append(True, start[1:] > _reach(doc, end)[:-1]))
        return doc[first], start[first], np.maximum.reduceat(end, first)

    def rows(doc, start, stop):
        owners = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        runs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(owners, len(doc)), pa.int32()), runs)
        return pa.RecordBatch.from_arrays([pa.array(doc[owners]), lists], names=["doc", "runs"])

    def run(batches):
        held = None  # the runs so far of a document whose repeats come in parts
        for table, big in whole_groups(batches, 0, 100_000, 1_000_000):
            doc, start, n = (table[c].to_numpy().astype(np.int64) for c in ("doc", "start", "n"))
            found = joined(doc, start, start + n + length - 1)
            if held and not (big and held[0][0] == doc[0]):
                yield rows(*held)
                held = None
            if big:
                held = joined(*(np.append(x, y) for x, y in zip(held, found))) if held else found
            else:
                yield rows(*found)
        if held:
            yield rows(*held)

    return run


# --- operator -------------------------------------------------------------------------------------------------------------

NO_ID = -(2**63)


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with __doc, a number for each different (id, text) in the order of the ids; the id itself if none has two texts.

    Texts of one id are ordered by a hash, and told apart by it. Ids and hashes alone are shuffled, in ranges; a range
    counts its own rows, and the driver adds up one count a range.
    """
    spark = df.sparkSession
    key, mark = F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(col(text_col), F.lit("")))
    pairs = df.select(key.alias("__doc"), mark.alias("__mark")).distinct()
    if pairs.groupBy("__doc").count().where("count > 1").isEmpty():
        return df.withColumn("__doc", key)
    placed = pairs.repartitionByRange("__doc", "__mark").sortWithinPartitions("__doc", "__mark")

    def count(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = pa.array(np.arange(seen, seen + batch.num_rows))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), place], names=["__doc", "__mark", "part", "place"])

    placed = materialize(spark, placed.mapInArrow(count, "__doc long, __mark long, part long, place long"), "suffix-ids")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    bases = spark.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes], "part long, base long")
    numbers = placed.join(F.broadcast(bases), "part").select(F.col("__doc").alias("__key"), "__mark", (F.col("base") + F.col("place")).alias("__doc"))
    same = (key == F.col("__key")) & (mark == F.col("__mark"))
    return df.join(numbers.hint("merge"), same).select(*[col(c) for c in df.columns], "__doc")


def repeated_runs(docs: DataFrame, doc_col: str, text_col: str = "text", length: int = 100) -> DataFrame:
    """(doc, runs): the maximal byte runs of each document that strings of `length` bytes with an earlier start cover.

    Earlier: in a document of smaller number (doc_col, a long that is never null), or at a smaller offset of the same;
    strings are judged on the input. Null texts are empty. Rows that repeat a number must repeat its text; they take nothing
    from each other. Texts may have any length.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be at least {ANCHOR + 8}")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(col(doc_col).alias("doc"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = docs.mapInArrow(_gather(length), ROWS).repartition("key").sortWithinPartitions("key", "cell", "doc", "start")
    known = materialize(spark, rows.mapInArrow(_merge_cells, ROWS), "suffix-cells")

    ask = known.where(F.col("kind").isin(CELL, HOT_CELL))
    lists = ask.groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "start", "n")).alias("asked"))
    asked = docs.join(lists.hint("merge"), "doc").select("doc", "text", "asked")  # both grow with the corpus: neither is broadcast
    texts = asked.mapInArrow(_cut_texts(length), TEXTS)
    found = texts.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(_decide(length), ROWS)

    repeats = known.where(F.col("kind") == REPEAT).unionByName(found).select("doc", "start", "n")
    runs = repeats.repartition("doc").sortWithinPartitions("doc", "start")
    return materialize(spark, runs.mapInArrow(_join_runs(length), "doc long, runs array<struct<start: int, end: int>>"), "suffix-runs")


KEPT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType())])


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep: list[str] | None = None, characters: bool = False
) -> DataFrame:
    """df with columns runs (see repeated_runs; null: none), kept (the bytes left, binary) and n_bytes (of the input).

    With `characters`, kept loses only whole characters, so that it is UTF-8. Every input row comes back once. Null texts
    are empty. Documents are ordered by id, a null id before all others. Rows that repeat id and text are one document, so
    equal rows take nothing from each other; rows that share an id (null too) but not a text are documents of their own, in
    the order of a hash of their texts. Empty tables give empty results. Input columns of these names, in any case, are
    replaced.
    """
    wanted = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("runs", "kept", "n_bytes")]
    source = _numbered(df.select(*{c: col(c) for c in [*wanted, id_col, text_col]}.values()), id_col, text_col)
    runs = repeated_runs(source, "__doc", text_col, length).withColumnsRenamed({"doc": "__owner", "runs": "__runs"})
    joined = source.join(runs.hint("merge"), F.col("__doc") == F.col("__owner"), "left")

    def make():
        def run(column, found):
            given = [b"" if t is None else t.encode() for t in column.to_pylist()]
            return [[cut(t, r or [], characters) for t, r in zip(given, found.to_pylist())], [len(t) for t in given]]

        return run

    out = map_rows(joined, [text_col, "__runs"], KEPT, make, [*wanted, "__runs"])
    return out.withColumnRenamed("__runs", "runs")


def cut(data: bytes, runs: list, characters: bool = False) -> bytes:
    """What is left of data without the runs; with `characters`, without the characters that lie wholly in them."""
    out, at = [], 0
    for r in runs:
        start, end = r["start"], r["end"]
        while characters and start < min(end, len(data)) and data[start] & 0xC0 == 0x80:
            start += 1
        while characters and start < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])

