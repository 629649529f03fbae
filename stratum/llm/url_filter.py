"""URL filters: all glob rules as one bit-parallel Shift-And automaton, run over a column of canonical URLs at once.

The canonical form is a dot, the host in lower case, and the path. In a glob `?` stands for any byte but a slash, `*` for any
run without a slash, `**` for any run; all else stands for itself. Each element of each glob is a bit in a row of 64-bit
words. A step shifts the row, masks it with the bits that the byte admits, and keeps the bits whose star admits the byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm.common import col, map_rows, utf8


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start as given ('/' first)."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class ShiftAnd:
    """Globs compiled to masks: admit[byte] and loop[byte] are rows of words; first and last are the bits of start and end."""

    def __init__(self, globs: list[str]):
        states: list[tuple[str, str]] = []  # of each bit: the byte that leads to it, and the star that stands after it
        self.first, self.last = [], []
        for glob in globs:
            self.first.append(len(states))
            states.append(("", ""))
            at = 0
            while at < len(glob):
                if glob[at] == "*":
                    run = len(glob[at:]) - len(glob[at:].lstrip("*"))
                    states[-1] = (states[-1][0], "**" if run > 1 or states[-1][1] == "**" else "*")
                    at += run
                else:
                    states.extend((chr(b), "") for b in (glob[at].encode() if glob[at] != "?" else b"\xff"))
                    at += 1
            self.last.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.admit, self.loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for i, (byte, star) in enumerate(states):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if byte == "\xff":
                self.admit[:, word] |= bit
                self.admit[ord("/"), word] &= ~bit
            elif byte:
                self.admit[ord(byte), word] |= bit
            if star:
                self.loop[:, word] |= bit
                if star == "*":
                    self.loop[ord("/"), word] &= ~bit
        self.begin = np.zeros(self.words, np.uint64)
        for i in self.first:
            self.begin[i // 64] |= np.uint64(1 << (i % 64))

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text (a range of the bytes) matches each glob: booleans [texts, globs]."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        start, size = offsets[:-1][order], lengths[order]
        state = np.tile(self.begin, (len(size), 1))
        live = len(size) - np.cumsum(np.bincount(size, minlength=1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(size[0]) if len(size) else 0):
            now = state[: live[t]]
            byte = data[start[: live[t]] + t]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[: live[t]] = (moved & self.admit[byte]) | (now & self.loop[byte])
        out = np.empty((len(size), len(self.last)), bool)
        for g, i in enumerate(self.last):
            out[order, g] = (state[:, i // 64] >> np.uint64(i % 64)) & one != 0
        return out


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://' or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


RESULT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def filter_urls(
    df: DataFrame, rules: list[Rule], globs: list[tuple[str, str]], url_col: str = "url", default: str = "allow", keep: list[str] | None = None
) -> DataFrame:
    """df with host, path, rule (the longest rule that fits, as host and path; else null) and verdict.

    Where no rule fits, the first of globs, (verdict, glob over the canonical URL), that matches gives the verdict, else it
    is `default`. Null URLs and those without '://' have an empty host and path and match only globs that fit a lone dot.
    Rules of equal length: the earlier listed. Rows that repeat are judged alike; an empty table gives an empty one. URLs may
    have any length: time grows with the bytes and with the words of the automaton. One pass without shuffle. Columns of
    these four names, in any case, are replaced.
    """
    taken = {"host", "path", "rule", "verdict"}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    known = df.select(*[col(c) for c in kept], host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    ranked = sorted(rules, key=lambda r: -len(r.name))

    def make():
        automaton = ShiftAnd([r.glob for r in ranked] + [g for _, g in globs])

        def run(host: pa.Array, path: pa.Array):
            hits = automaton.match(*utf8(pc.binary_join_element_wise(".", pc.cast(host, pa.string()), pc.cast(path, pa.string()), "")))
            own = hits[:, : len(ranked)]
            best = [int(row.argmax()) if row.any() else None for row in own]
            more = hits[:, len(ranked) :]
            other = [globs[int(row.argmax())][0] if row.any() else default for row in more]
            return [[None if b is None else ranked[b].name for b in best], [o if b is None else ranked[b].verdict for b, o in zip(best, other)]]

        return run

    return map_rows(known, ["host", "path"], RESULT, make, [*kept, "host", "path"])
