"""Byte-level BPE as a reduction over a tree of halves.

The tokens of a string form a monoid under `join`: take the last tokens of the left part and the first of the right,
encode their bytes anew, and widen this window until the pairs at both its edges are stable, that is until encoding the two
tokens' bytes gives these two tokens again. A sequence of tokens that each encode to themselves and of which every adjacent
pair is stable is the encoding of its bytes, so tokens outside the window stand. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratum.llm.common import map_rows, texts

#: Pretokens, halves of up to 64 bytes, and bytes of longer halves that a worker remembers.
REMEMBER, HALVES, LONG = 300_000, 1 << 16, 16 << 20


class ByteBpe:
    """Encoder and decoder of one rank file (lines of base64 and rank) and pretoken pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pair = functools.lru_cache(1 << 17)(self._pair)
        self.short = functools.lru_cache(HALVES)(self._halves)
        self.long: dict[bytes, tuple[int, ...]] = {}
        self.long_bytes = 0
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Direct merges: of all adjacent parts the pair of least rank, leftmost first, until none has a rank."""
        if len(data) > 64:
            return self._merge_by_heap(data)
        ranks, none = self.ranks, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        near = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]  # rank of each part with the next
        while near and (best := min(near)) < none:
            at = near.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at:
                near[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(near):
                near[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def _merge_by_heap(self, data: bytes) -> list[int]:
        """The same merges in n log n steps, for windows that had to grow."""
        ranks, n = self.ranks, len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or ranks.get(both := part[i] + part[j]) != rank:
                continue  # one of the two has been merged since
            part[i], part[j] = both, b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(both + part[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := ranks.get(part[h] + both)) is not None:
                heapq.heappush(heap, (r, h))
        return [ranks[p] for p in part if p]

    def _pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens; they are stable if it is these two again."""
        return tuple(self.merge(self.tokens[a] + self.tokens[b]))

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right:
            return left + right
        pair = self.pair
        middle = pair(left[-1], right[0])
        if middle == (left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            fits_left = i >= len(left) or pair(left[-i - 1], middle[0]) == (left[-i - 1], middle[0])
            fits_right = j >= len(right) or pair(middle[-1], right[j]) == (middle[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + middle + right[j:]
            i, j = (i if fits_left else min(2 * i, len(left))), (j if fits_right else min(2 * j, len(right)))
            middle = tuple(self.merge(b"".join(self.tokens[t] for t in left[-i:] + right[:j])))

    def _halves(self, data: bytes) -> tuple[int, ...]:
        if len(data) == 1:
            return (self.ranks[data],)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one pretoken: its halves are encoded first, down to single bytes, and joined up the tree."""
        if len(data) <= 64:
            return self.short(data)
        if (found := self.long.get(data)) is None:  # a run of one sign has equal halves on every level
            found = self._halves(data)
            self.long_bytes += len(data) + 8 * len(found)
            if self.long_bytes > LONG:
                self.long.clear()
                self.long_bytes = 0
            self.long[data] = found
        return found

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian 32-bit numbers; each match of the pattern by itself."""
        pieces, known = self.pattern.findall(text), self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
            for piece in set(pieces):
                if piece not in known:
                    known[piece] = np.array(self.encode_bytes(piece.encode()), "<u4").tobytes()
            return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes, leaf: int = 1 << 14) -> bytes:
        """The bytes of tokens given as little-endian 32-bit numbers, up a tree of halves."""
        if len(ids) <= 4 * leaf:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


@functools.cache
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec a worker process and vocabulary."""
    return ByteBpe(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with a column ids (binary): the token ids of each whole text as little-endian 32-bit numbers.

    Null and empty texts have none. Rows that repeat get equal ids, an empty table gives an empty one. path names a rank file
    that every executor has. One pass, no shuffle; a worker keeps at most REMEMBER pretokens. Time grows with a text's length
    but for a logarithm, whatever it holds. An input column named ids, in any case, is replaced.
    """

    def make():
        bpe = codec(path, pattern)
        return lambda column: [pa.array([bpe.encode(t) for t in texts(column)], pa.binary())]

    return map_rows(df, [text_col], T.StructType([T.StructField("ids", T.BinaryType())]), make, keep)


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df with a column decoded (binary): the bytes of each row's ids; null stays null. An unknown id is an error."""

    def make():
        bpe = codec(path, pattern)
        return lambda column: [pa.array([None if x is None else bpe.decode(x) for x in column.to_pylist()], pa.binary())]

    return map_rows(df, [ids_col], T.StructType([T.StructField("decoded", T.BinaryType())]), make, keep)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with ids and decoded, as encode_texts() and then decode_ids() make them, in one Python process a task."""

    def make():
        bpe = codec(path, pattern)

        def run(column):
            ids = [bpe.encode(t) for t in texts(column)]
            return [pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())]

        return run

    return map_rows(df, [text_col], T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]), make, keep)
