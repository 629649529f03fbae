"""What the operators share: Arrow batches of bounded size, scratch tables, joins whose small side is measured."""

from __future__ import annotations

import bisect
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if its measured size is below this; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20
#: Text bytes that one step of a Python operator holds at a time, unless a single row has more.
SLICE_BYTES = 4 << 20

#: A key is heavy if more than one row in so many bears it; there are fewer heavy keys than this, whatever the table.
HEAVY = 1000
#: Rows and bytes of an Arrow batch, where the session has not chosen others.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**31 - 1), str(32 << 20))}


def configure(spark: SparkSession) -> None:
    """Lower Spark's defaults for Arrow batches, so that batches of long texts stay small.

    Operators never change settings of the session; the queries and the pipeline call this. Choices other than Spark's
    defaults are left alone.
    """
    for name, (default, value) in BATCHES.items():
        if spark.conf.get(name, default).removesuffix("b") == default:
            spark.conf.set(name, value)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_stratum_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.realpath(os.path.join(tempfile.mkdtemp(), "stratum_llm.zip"))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    context._stratum_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one will do only if all
    tasks run in the driver's process (local mode, as in tests); on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_stratum_scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = context._stratum_scratch = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="stratum-"))
    return found


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there and lost executors cost nothing."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on, how: str, right_bytes: int) -> DataFrame:
    """left join right; right is broadcast if its measured size allows, else both sides are shuffled (AQE splits skew)."""
    return left.join(F.broadcast(right) if right_bytes <= BROADCAST_BYTES else right, on, how)


def heavy_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left join right on one column; right has a key once at most, left (`rows` rows) may bear one key in most of its rows.

    Keys of more than one row in HEAVY are fewer than HEAVY, so they and their rows of right are broadcast, with a bound that
    no table can break; the rest is shuffled, where no key has more than one row in HEAVY.
    """
    if rows <= HEAVY:
        return left.join(right, key, "left")
    heavy = left.groupBy(key).count().where(F.col("count") * HEAVY > rows).select(key)
    found = right.join(F.broadcast(heavy), key, "left_semi")
    apart = left.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(found), key, "left")
    return left.join(F.broadcast(heavy), key, "left_anti").join(right, key, "left").unionByName(apart)


def col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than `limit` bytes of a string or binary column, single rows excepted."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def map_rows(
    df: DataFrame,
    needs: Sequence[str],
    new: T.StructType,
    make: Callable[[], Callable[..., Sequence]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns that Python computes from the columns `needs`, slice by slice.

    `make()` runs once per task and returns a function from Arrow arrays (of `needs`) to lists or Arrow arrays (of `new`).
    `keep` names the input columns that stay (all by default). An input column whose name clashes with a new one, in any
    case, is replaced by it. No shuffle; rows keep their order.
    """
    ship(df.sparkSession)
    taken = {f.name.lower() for f in new.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(*[col(c) for c in kept], *[col(c).alias(f"__need{i}") for i, c in enumerate(needs)])
    schema = T.StructType([source.schema[i] for i in range(len(kept))] + list(new.fields))
    names, types, first = schema.fieldNames(), [_arrow_type(f.dataType) for f in new.fields], len(kept)

    def run(batches):
        apply = make()
        for batch in slices(batches, first):
            made = apply(*[batch.column(i) for i in range(first, batch.num_columns)])
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(first)] + arrays, names=names)

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def texts(array: pa.Array) -> list[str]:
    """The strings of a column; null counts as empty."""
    return ["" if x is None else x for x in array.to_pylist()]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def whole_groups(batches: Iterable[pa.RecordBatch], key: int, rows: int, most: int, size: int = 64 << 20) -> Iterator[tuple[pa.Table, bool]]:
    """Join batches sorted by an integer column into tables of about `rows` rows or `size` bytes that end where a group ends.

    A group of more than `most` rows comes in parts, each marked True, so that no group must fit into memory.
    """
    held, count, bulk, giant = [], 0, 0, None
    for batch in batches:
        if giant is not None and batch.num_rows:
            ids = batch.column(key).to_numpy()
            own = int(np.searchsorted(ids, giant, "right"))
            if own:
                yield pa.Table.from_batches([batch.slice(0, own)]), True
            if own == batch.num_rows:
                continue
            batch, giant = batch.slice(own), None
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
            bulk += batch.nbytes
        if count >= rows or bulk >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column(key).to_numpy()
            cut = int(np.searchsorted(ids, ids[-1], "left"))
            if cut:
                yield table.slice(0, cut), False
            held, count, bulk = table.slice(cut).to_batches(), len(ids) - cut, 0
            if count > most:
                yield table.slice(cut), True
                held, count, giant = [], 0, ids[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False


class Taken:
    """Disjoint ranges in order; whether another one meets any of them is one search."""

    def __init__(self, ranges: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(ranges):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end

    def covers(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] <= start and end <= self.ends[at]

    def add(self, start: int, end: int) -> None:
        """Take a range that meets none."""
        at = bisect.bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (a multiply-xorshift finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
