"""Media columns: Netpbm and BMP files to numpy arrays, area-resized by integral images, as NPY tiles and difference hashes."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm.common import map_rows

_NUMBER = re.compile(rb"(?:\s|#[^\n]*\n?)*([0-9]{1,9})(?![0-9])")
_PLAIN = re.compile(rb"#[^\n]*")
#: Samples of a block whose integral image is held at a time.
BLOCK = 1 << 18


def decode(data: bytes) -> np.ndarray:
    """Samples [height, width, channels] of a Netpbm (P1 to P6) or an uncompressed BMP file.

    ValueError for all else: other formats, headers that are cut short, hold no number, or claim more samples than there are,
    no samples at all, a maximum of 0 or over 65535, samples beyond the maximum.
    """
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, header = int(data[1:2]), 2, []
    while len(header) < (2 if kind in (1, 4) else 3):
        m = _NUMBER.match(data, at)
        if not m:
            raise ValueError("header cut short or not a number")
        header.append(int(m[1]))
        at = m.end()
    width, height, most = *header[:2], header[2] if len(header) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if not n or n > 8 * len(data) or not 1 <= most <= 65535:
        raise ValueError("no samples, fewer than claimed, or no such maximum")
    if kind == 1:
        samples = 1 - np.frombuffer(re.sub(rb"\s", b"", _PLAIN.sub(b"", data[at:]))[:n], np.uint8).astype(int) + 48
    elif kind in (2, 3):
        samples = np.array([int(x) for x in _PLAIN.sub(b"", data[at:]).split()[:n] if len(x) < 10 or _fail("sample too long")], np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, height * (-(-width // 8)), at + 1).reshape(height, -1)
        samples = 1 - np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        samples = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(samples) < n:
        raise ValueError("samples cut short")
    if samples.min() < 0 or samples.max() > most:
        raise ValueError("sample beyond the maximum")
    return samples.astype(np.uint16 if most > 255 else np.uint8, copy=False).reshape(height, width, channels)


def _fail(why: str):
    raise ValueError(why)


def _decode_bmp(data: bytes) -> np.ndarray:
    offset, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("compressed BMP")
    if width <= 0 or not height or width * abs(height) * bits > 8 * len(data):
        raise ValueError("no samples, or fewer than claimed")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    unpacked = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)[:, :width]
    index = (unpacked * (1 << np.arange(bits - 1, -1, -1))).sum(2)
    colours = np.frombuffer(data, np.uint8, 4 * int(index.max(initial=0) + 1), 14 + header).reshape(-1, 4)
    return colours[index][:, :, 2::-1]


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP of [height, width, 3] samples."""
    height, width, _ = image.shape
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def encode_netpbm(image: np.ndarray) -> bytes:
    """A binary PGM or PPM of [height, width, 1 or 3] samples of 8 bits."""
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, width, height) + image.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the image over each cell of a grid, exact for fractional cells."""
    return area_grids(image, [(height, width)])[0]


def area_grids(image: np.ndarray, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The image's means over the cells of several grids (rows, columns).

    The integral image is made block by block, of BLOCK samples at most, so that memory does not grow with the image; in a
    block, cells end at its edges, and the sums of a cell's parts add up. Between samples the integral image is linear.
    """
    rows, columns, channels = image.shape
    across = min(columns, max(1, BLOCK // channels))
    down = max(1, BLOCK // (channels * across))
    sums = [np.zeros((h, w, channels)) for h, w in sizes]
    for top in range(0, rows, down):
        for left in range(0, columns, across):
            block = image[top : top + down, left : left + across]
            total = np.zeros((block.shape[0] + 1, block.shape[1] + 1, channels))
            np.cumsum(block, 0, out=total[1:, 1:])
            np.cumsum(total[1:, 1:], 1, out=total[1:, 1:])
            for out, (h, w) in zip(sums, sizes):
                (y0, y1), (x0, x1) = _met(rows, h, top, block.shape[0]), _met(columns, w, left, block.shape[1])
                part = _between(_between(total, rows, h, top, y0, y1, 0), columns, w, left, x0, x1, 1)
                out[y0:y1, x0:x1] += np.diff(np.diff(part, axis=0), axis=1)
    return [s * (s.shape[0] * s.shape[1] / (rows * columns)) for s in sums]


def _met(size: int, parts: int, begin: int, length: int) -> tuple[int, int]:
    """The cells that a block from begin on meets."""
    return begin * parts // size, min(parts, -(-(begin + length) * parts // size))


def _between(table: np.ndarray, size: int, parts: int, begin: int, first: int, last: int, axis: int) -> np.ndarray:
    """The integral image of a block at the edges of cells first to last, those beyond the block at its own edge."""
    length = table.shape[axis] - 1
    edge = np.clip(np.arange(first, last + 1) * (size / parts) - begin, 0, length)
    low = np.minimum(edge.astype(int), length - 1)
    share = (edge - low).reshape([-1 if a == axis else 1 for a in range(3)])
    return table.take(low, axis) * (1 - share) + table.take(low + 1, axis) * share


def difference_hash(image: np.ndarray) -> str:
    """64 bits, in hex: whether each cell of an 8 x 9 grid is darker than its right neighbour."""
    return _difference_hash(area_resize(image, 8, 9))


def _difference_hash(small: np.ndarray) -> str:
    grey = (small.mean(2) if small.shape[2] != 3 else small @ np.array([0.299, 0.587, 0.114])).round(6)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


_HEADERS: dict[tuple, bytes] = {}


def npy(array: np.ndarray) -> bytes:
    """The NPY file (version 1.0) of an array."""
    array = np.ascontiguousarray(array)
    if (array.dtype.str, array.shape) not in _HEADERS:
        head = f"{{'descr': '{array.dtype.str}', 'fortran_order': False, 'shape': {array.shape}, }}"
        head += " " * (-(len(head) + 11) % 64) + "\n"
        _HEADERS[array.dtype.str, array.shape] = b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode()
    return _HEADERS[array.dtype.str, array.shape] + array.tobytes()


RESULT = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("samples", T.BinaryType()),
        T.StructField("tiles", T.ArrayType(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("npy", T.BinaryType())]))),
        T.StructField("dhash", T.StringType()),
    ]
)


def media_columns(df: DataFrame, media_col: str = "media", *, size: tuple[int, int] = (64, 64), tile: int = 32, keep: list[str] | None = None) -> DataFrame:
    """df with width, height, channels, samples (decoded, binary), tiles (NPY files of the resized image), and dhash.

    size is (height, width) after area-resizing, tile the side of a tile; those at the right and lower edge may be smaller.
    Null media and files that aren't readable Netpbm or BMP images, empty ones included, give null in all six. Files that
    repeat give equal values, an empty table gives an empty one. One pass without shuffle; a task holds one slice of files,
    of which a file's samples and one block's integral image are held besides. Input columns that clash with the six, in
    any case, are replaced.
    """

    def one(data):
        try:
            image = decode(data)
        except (ValueError, IndexError, struct.error):
            return (None,) * 6
        height, width, channels = image.shape
        resized, grid = area_grids(image, [size, (8, 9)])
        small = resized.round().astype(image.dtype)
        tiles = [{"row": y // tile, "column": x // tile, "npy": npy(small[y : y + tile, x : x + tile])} for y in range(0, size[0], tile) for x in range(0, size[1], tile)]
        return width, height, channels, image.tobytes(), tiles, _difference_hash(grid)

    def make():
        def run(column: pa.Array):
            known: dict[bytes, tuple] = {}
            rows = []
            for data in column.to_pylist():
                if data is not None and data not in known:
                    known[data] = one(data)
                rows.append((None,) * 6 if data is None else known[data])
            return [list(x) for x in zip(*rows)]

        return run

    return map_rows(df, [media_col], RESULT, make, keep)


def text_payload(text: Column, row: int = 192) -> Column:
    """UTF-8 of a text (null: empty) with spaces appended up to a positive multiple of `row` bytes; binary."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(row))).cast("int")
    return F.rpad(data, rows * F.lit(row), F.lit(b" "))


def payload_ppm(payload: Column, row: int = 192) -> Column:
    """The payload as the samples of a binary PPM file of row / 3 pixels a line."""
    height = (F.octet_length(payload) / F.lit(row)).cast("int").cast("string")
    return F.concat(F.concat(F.lit(f"P6\n{row // 3} "), height, F.lit("\n255\n")).cast("binary"), payload)
