"""256-bit hashes of grey pictures, and how much there is to hash in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Fixed values of the hash: side of the picture that is transformed, of the block of frequencies that is kept, passes of
#: the box filter, and what the gradients' sum is divided by and cut at.
SIDE, KEPT, PASSES, QUALITY_STEP, QUALITY_MOST = 64, 16, 2, 90, 100
#: Hashes differ in so many bits at most to match; pictures of less quality have no hash that tells anything.
MATCH_BITS, MATCH_QUALITY = 31, 50


def box_filtered(x: np.ndarray, window: int, axis: int) -> np.ndarray:
    """Mean of the `window` values around each (fewer at the ends, the middle one right of centre for even windows)."""
    n = x.shape[axis]
    sums = np.insert(np.cumsum(x, axis=axis), 0, 0, axis=axis)
    at = np.arange(n)
    low, high = np.maximum(at - (window - 1) // 2, 0), np.minimum(at + window // 2 + 1, n)
    shape = [-1 if a == axis else 1 for a in range(x.ndim)]
    return (sums.take(high, axis) - sums.take(low, axis)) / (high - low).reshape(shape)


def shrunk(grey: np.ndarray) -> np.ndarray:
    """SIDE x SIDE values of a picture: box-filtered along both sides, then taken from the middle of each cell."""
    x = np.asarray(grey, dtype=np.float64)
    for _ in range(PASSES):
        for axis in (1, 0):
            x = box_filtered(x, -(-x.shape[axis] // (2 * SIDE)), axis)
    rows, columns = (((np.arange(SIDE) + 0.5) * n / SIDE).astype(int) for n in x.shape)
    return x[np.ix_(rows, columns)]


def quality(small: np.ndarray) -> int:
    """0 to 100: the steps between neighbours, in hundredths of the range of 255, summed and cut."""
    steps = [np.abs(np.trunc(np.diff(small, axis=a) * 100 / 255)).sum() for a in (0, 1)]
    return int(min(QUALITY_MOST, sum(steps) // QUALITY_STEP))


def picture_hash(grey: np.ndarray) -> tuple[list[int], int]:
    """Four signed 64-bit words (bit b of word w is bit 64 w + b of the hash), and the quality. A bit says that its frequency
    of the cosine transform, row by row from the second on, is over the median of all."""
    small = shrunk(grey)
    k, n = np.arange(1, KEPT + 1)[:, None], np.arange(SIDE)[None, :]
    basis = np.sqrt(2 / SIDE) * np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))
    low = (basis @ small @ basis.T).ravel()
    bits = low > np.sort(low)[(len(low) - 1) // 2]  # of an even number the lower middle one
    return np.packbits(bits, bitorder="little").view("<i8").tolist(), quality(small)


def hashed(df: DataFrame, grey: str = "grey", width: str = "width") -> DataFrame:
    """`df` with h (four longs) and quality of pictures: their values (0 to 255) row by row, and the length of a row. Null where
    a picture is null, empty, holds nulls or isn't a whole number of rows."""
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df[f"`{grey}`"].cast("array<double>").alias("g"), df[f"`{width}`"].cast("int").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list = []
            for g, w in zip(b.column(1), b.column(2).to_pylist()):
                whole = g.is_valid and w and w > 0 and len(g.values) and len(g.values) % w == 0 and not g.values.null_count
                found.append(picture_hash(g.values.to_numpy().reshape(-1, w)) if whole else (None, None))
            h, q = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.list_(pa.int64())), pa.array(q, pa.int32())], ["row", "h", "quality"])

    schema = StructType([rows.schema["row"], StructField("h", ArrayType(LongType())), StructField("quality", IntegerType())])
    return rows.mapInArrow(run, schema).select("row.*", "h", "quality")
