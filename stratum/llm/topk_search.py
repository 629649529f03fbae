"""Exact top-k inner-product search by columnar branch and bound.

Candidates are dealt into blocks of bounded bytes, one block a task at a time, and move once. Every query passes by every
block. In a block the vectors lie dimension by dimension; scores grow block of dimensions by block of dimensions, and
candidates whose bound (score so far plus the product of the norms of what remains, Cauchy-Schwarz) can't reach the k-th best
lower bound are dropped from the columns. A first block gives each query a k-th best score, below which all other blocks drop
candidates from the start. What survives all dimensions gets its exact score in whole numbers.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import col, materialize, ship


def quantize(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v): every component x as floor(scale * x), x as double.

    Rows whose id is null and vectors that are null, empty or hold null or non-finite components are left out.
    """
    v = col(vec_col)
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    made = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)))
    return df.where(col(id_col).isNotNull() & sound).select(col(id_col).cast("long").alias("id"), made.alias("v"))


def exact_top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, *, block_bytes: int = 32 << 20, dims: int = 8
) -> DataFrame:
    """The k candidates of highest inner product for each query, its own id excepted: (query_id, rank, id, score).

    Both sides are (id long, v array<long>), as quantize() returns. Ties go to the smaller id. Rows that repeat an id
    count once, with the least vector. Only vectors of one length meet. Scores are decimals of 38 digits; beyond that is an
    error. An empty side gives an empty result; fewer than k candidates are all returned. block_bytes bounds the candidates
    that a task holds, and with them memory: rows shuffled are the candidates, and the queries once a block. dims is the
    number of dimensions scored at a time.
    """
    spark = candidates.sparkSession
    ship(spark)
    queries, candidates = (materialize(spark, x.groupBy("id").agg(F.min("v").alias("v")), "vectors") for x in (queries, candidates))
    n, widest = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n * 8 * (widest or 1) // block_bytes), min(2 * tasks, n // 64))
    candidates = candidates.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    queries = queries.withColumn("floor", F.lit(None).cast("double"))
    first = materialize(spark, _search(queries, candidates.where("block = 0"), [0], k, dims), "top-first")
    if blocks > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
        queries = queries.drop("floor").join(floors, queries["id"] == floors["query_id"], "left").select("id", "v", "floor")
        first = first.unionByName(_search(queries, candidates.where("block > 0"), [1, blocks - 1], k, dims))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return first.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _search(queries: DataFrame, candidates: DataFrame, span: list[int], k: int, dims: int) -> DataFrame:
    """The best k of each block for each query; span: the first and last block."""
    everywhere = queries.select(F.explode(F.sequence(F.lit(span[0]), F.lit(span[-1]))).alias("block"), F.lit(1).alias("side"), "id", "v", "floor")
    rows = candidates.select("block", F.lit(0).alias("side"), "id", "v", F.lit(None).cast("double").alias("floor")).unionByName(everywhere)
    rows = rows.repartition("block").sortWithinPartitions("block", "side")  # a block's candidates come before its queries

    def run(batches):
        held: list[pa.Table] = []
        block, matrices = None, None
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if key[lo] // 2 != block:
                    block, held, matrices = key[lo] // 2, [], None
                if key[lo] % 2 == 0:
                    held.append(part)
                    continue
                if matrices is None and held:
                    table = pa.concat_tables(held)
                    matrices = {width: Columns(*_matrix(table, width)[:2], dims) for width in _widths(table)}
                    held = []
                found: list[list] = [[], [], []]
                for width in _widths(part):
                    if matrices and width in matrices:
                        qid, qv, floor = _matrix(part, width)
                        for at, (ids, scores) in zip(qid.tolist(), matrices[width].best(qv, qid, k, floor)):
                            found[0] += [at] * len(ids)
                            found[1] += ids
                            found[2] += map(Decimal, scores)
                types = [pa.int64(), pa.int64(), pa.decimal128(38, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types)], names=["query_id", "id", "score"])

    return rows.mapInArrow(run, "query_id long, id long, score decimal(38,0)")


def _widths(table: pa.Table) -> list[int]:
    return np.unique(table["v"].combine_chunks().value_lengths().to_numpy()).tolist()


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, their vectors, and floors (minus infinity for none) of the rows of one width."""
    vectors = table["v"].combine_chunks()
    fit = np.flatnonzero(vectors.value_lengths().to_numpy() == width)
    flat = vectors.take(pa.array(fit)).flatten().to_numpy()
    ids = table["id"].to_numpy()[fit]
    floor = np.nan_to_num(table["floor"].cast(pa.float64()).fill_null(-np.inf).to_numpy()[fit], neginf=-np.inf)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(-1, width)[order], floor[order]


class Columns:
    """Vectors (ids ascending) as columns, the heaviest dimensions first, with the norms of what remains after each block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims: int):
        self.ids, self.vectors = ids, vectors
        weight = np.zeros(vectors.shape[1])
        for at in range(0, len(vectors), 1 << 14):
            weight += (vectors[at : at + (1 << 14)].astype(float) ** 2).sum(0)
        order = np.argsort(-weight, kind="stable")
        self.blocks = [order[i : i + dims] for i in range(0, len(order), dims)]
        self.columns = [np.ascontiguousarray(vectors[:, b].T, dtype=float) for b in self.blocks]
        self.left = _tails(self.columns)
        self.most = float(np.abs(vectors.astype(float)).max(initial=0))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        """For each query the ids and exact integer scores of its best k vectors, its own id excepted.

        Sums of doubles are off by `error` at most; it is 0 where they are whole numbers below 2**52. Vectors whose score
        is below `floor` for certain may be left out.
        """
        rows = [np.ascontiguousarray(queries[:, b], dtype=float) for b in self.blocks]
        left = _tails([r.T for r in rows])
        width = queries.shape[1]
        for i, mine in enumerate(own):
            reach = float(np.abs(queries[i].astype(float)).max(initial=0)) * self.most * width
            error = 0.0 if reach < 2.0**52 else reach * (width + 2) * 2.0**-52
            score, alive = rows[0][i] @ self.columns[0], None
            at = int(np.searchsorted(self.ids, mine))
            if at < len(self.ids) and self.ids[at] == mine:
                alive = np.delete(np.arange(len(self.ids)), at)
                score = score[alive]
            for b in range(1, len(self.blocks) + 1):
                rest = left[b][i] * (self.left[b] if alive is None else self.left[b][alive]) if b < len(self.blocks) else np.zeros(len(score))
                slack = rest * (1 + 1e-9) + (1e-6 if b < len(self.blocks) else 0.0) + error
                bound = floor[i] - error - abs(floor[i]) * 1e-15 if np.isfinite(floor[i]) else -np.inf
                if len(score) > k:
                    bound = max(bound, np.partition(score - slack, len(score) - k)[len(score) - k])
                stay = np.flatnonzero(score + slack >= bound)
                if len(stay) < len(score):
                    alive = stay if alive is None else alive[stay]
                    score = score[stay]
                if b < len(self.blocks):
                    score = score + rows[b][i] @ (self.columns[b] if alive is None else self.columns[b][:, alive])
            ids = self.ids if alive is None else self.ids[alive]
            if error:
                exact = (self.vectors if alive is None else self.vectors[alive]).astype(object) @ queries[i].astype(object)
                top = sorted(range(len(ids)), key=lambda j: (-exact[j], ids[j]))[:k]
                yield [int(ids[j]) for j in top], [int(exact[j]) for j in top]
            else:
                top = np.lexsort((ids, -score))[:k]
                yield ids[top].tolist(), [int(s) for s in score[top]]


def _tails(parts: list[np.ndarray]) -> np.ndarray:
    """For each block of dimensions the norms of what it and all later ones hold."""
    return np.sqrt(np.cumsum([(p**2).sum(0) for p in parts[::-1]], 0)[::-1])
