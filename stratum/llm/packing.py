"""Best-fit decreasing packing of documents into sequences, with a segment tree over remaining capacities.

Lengths are at most the capacity, so what best-fit decreasing needs to know of a corpus is a histogram of `capacity` numbers.
The driver packs the histogram: bins of equal content are one group, and for each run of equal lengths the tree finds the
tightest open capacity in logarithmic time. The plan says of each length which ranks go to which bins at which offsets;
executors give every piece its rank and look it up.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import BROADCAST_BYTES, col, materialize, ship, slices, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class CapacityTree:
    """Counts of open groups by remaining capacity; finds the least capacity that is open and large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += change
            node //= 2

    def tightest(self, least: int) -> int | None:
        node = self.leaves + least
        if self.count[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, first bin, pieces of this length a bin, offset): best-fit decreasing.

    histogram[n] is the number of pieces of length n, 1 to capacity. Piece of rank r goes to bin
    first bin + (r - first rank) // pieces, at offset + (r - first rank) % pieces * length.
    """
    tree, open_ = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    rows, bins = [], 0

    def leave(first: int, count: int, rest: int) -> None:
        if count and rest:
            open_[rest].append((first, count))
            tree.add(rest, 1)

    for length in range(capacity, 0, -1):
        rank, total = 0, int(histogram[length])
        while rank < total:
            rest = tree.tightest(length)
            if rest is None:
                rest, per = capacity, capacity // length
                first, count = bins, -(-(total - rank) // per)
                bins += count
            else:
                first, count = open_[rest].pop()
                tree.add(rest, -1)
                per = rest // length
            full, more = divmod(min(total - rank, count * per), per)
            if full:
                rows.append((length, rank, rank + full * per, first, per, capacity - rest))
                leave(first, full, rest - per * length)
            if more:
                rows.append((length, rank + full * per, rank + full * per + more, first + full, more, capacity - rest))
                leave(first + full, 1, rest - more * length)
            used = full + (more > 0)
            leave(first + used, count - used, rest)
            rank += full * per + more
    return np.array(rows, np.int64).reshape(-1, 6)


@functools.cache
def tokenizer(path: str):
    """The vocabulary and added tokens of a tokenizers file, run by tiktoken: the same byte-level BPE, several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    vocabulary, added = given["model"]["vocab"], given["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path}: added tokens that look at their neighbours are not supported")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


def encode(path: str, text: str) -> np.ndarray:
    """The ids of a text as `tokenizers` gives them: added tokens are found in the text, the rest is encoded."""
    return tokenizer(path).encode_to_numpy(text, allowed_special="all", disallowed_special=())


def pieces(df: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents, each with end_id after it, cut from the front so that all but the first piece are full.

    (doc_id, piece, start, length, ids_crc32, part, rank): part is the task and rank the number of pieces of the same length
    that the task had before. The task order of a table's files is stable, so a task that runs again makes the same rows.
    """
    ship(df.sparkSession)
    docs = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, 1):
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = np.append(np.asarray(encode(path, text), "<u4"), np.uint32(end_id)).astype("<u4")
                end = (len(ids) - 1) % capacity + 1
                start, number = 0, 0
                while start < len(ids):
                    for x, v in zip(out, (doc, number, start, end - start, zlib.crc32(ids[start:end].tobytes()), part, seen[end - start])):
                        x.append(v)
                    seen[end - start] += 1
                    start, end, number = end, end + capacity, number + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.mapInArrow(run, PIECES)


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with sequence_id and offset: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are documents of the end id alone. Null ids and rows that repeat are packed like all others, each
    by itself; other columns play no part. No row is moved between tasks but for a count of each length a task; only the histogram, `capacity` numbers,
    and the plan made from it are on the driver. An empty table gives an empty result.
    """
    spark = df.sparkSession
    made = materialize(spark, pieces(df, path, capacity, end_id, id_col, text_col), "pieces")
    counts = made.groupBy("length", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(spark, counts.select("length", "part", "count", before.alias("base")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in bases.groupBy("length").agg(F.sum("count").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    table = plan(histogram, capacity)
    small = 48 * bases.count() <= BROADCAST_BYTES
    placed = made.join(F.broadcast(bases) if small else bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")
    )
    # rows of the plan are found by one search over length and rank together
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    step = int(histogram.max(initial=0)) + 1
    keys = table[:, 0] * step + table[:, 1]

    def assign(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = table[np.searchsorted(keys, length * step + rank, "right") - 1] if len(rank) else table[:0]
            place = rank - row[:, 1]
            made = [pa.array(row[:, 3] + place // row[:, 4]), pa.array(row[:, 5] + place % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
