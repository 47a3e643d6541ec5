"""Pooling of frame features into descriptors. Vectors stay whole: a batch gives one row for each of its groups (sums, sums of
powers or maxima of the components), and a group's rows are put together after the shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.functions.vector import normalized

GEM_POWER, GEM_EPS = 3.0, 1e-6
KINDS = ("avg", "max", "gem")


def _reduced(df: DataFrame, keys: list[str], kinds: tuple[str, ...], f: str) -> DataFrame:
    """`keys`, n and a vector for each of `kinds`, of each group: the vectors' sum, maximum, or sum of powers."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            group = b.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            begin = np.flatnonzero(np.diff(group[order], prepend=-1))
            x = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)[order]
            out = [*b.select(keys).take(pa.array(order[begin])).columns, pa.array(np.diff(np.append(begin, len(order))))]
            for kind in kinds:
                y = np.maximum.reduceat(x, begin) if kind == "max" else np.add.reduceat(np.maximum(x, GEM_EPS) ** GEM_POWER if kind == "gem" else x, begin)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel())))
            yield pa.RecordBatch.from_arrays(out, [*keys, "n", *kinds])

    given = df.where(F.col(f).isNotNull()).select(*keys, F.col(f).cast("array<double>").alias("f"))
    ddl = ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys)
    parts = given.mapInArrow(part, f"{ddl}, n long, {', '.join(f'{k} array<double>' for k in kinds)}")
    gathered = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.collect_list(k).alias(k) for k in kinds])  # a row for each batch that has the group

    def together(kind: str) -> Column:
        join = (lambda a, b: F.greatest(a, b)) if kind == "max" else (lambda a, b: a + b)
        return F.aggregate(F.slice(kind, 2, F.size(kind)), F.get(F.col(kind), F.lit(0)), lambda s, v: F.zip_with(s, v, join)).alias(kind)

    return gathered.select(*keys, "n", *[together(k) for k in kinds])


def _finished(kind: str) -> Column:
    """The pooled vector of `_reduced`'s. gem: the generalised mean, in which what is under `GEM_EPS` counts as that."""
    if kind == "max":
        return F.col(kind)
    mean = lambda x: x / F.col("n")
    return F.transform(kind, lambda x: F.pow(mean(x), 1 / GEM_POWER) if kind == "gem" else mean(x))


def pool(df: DataFrame, keys: list[str], kind: str = "avg", f: str = "f") -> DataFrame:
    """`keys` and the pooled vector f. Null vectors take no part; those of a group have one length."""
    return _reduced(df, keys, (kind,), f).select(*keys, _finished(kind).alias("f"))


def spatial_pool(df: DataFrame, keys: list[str], kind: str = "gem") -> DataFrame:
    """Over regions: `kind` where their number is a square, else the mean."""
    root = F.round(F.sqrt("n"))
    found = _reduced(df, keys, tuple(dict.fromkeys((kind, "avg"))), "f")
    return found.select(*keys, F.when(root * root == F.col("n"), _finished(kind)).otherwise(_finished("avg")).alias("f"))


def descriptor(frames: DataFrame, kind: str = "gem") -> DataFrame:
    """video_id and v: regions pooled, frames averaged, length 1."""
    per_frame = spatial_pool(frames, ["video_id", "frame_idx"], kind)
    return pool(per_frame, ["video_id"], "avg").select("video_id", normalized(F.col("f")).alias("v"))


#: The overlap that neighbouring squares of the largest scale come nearest to, and how many of them the
#: longer side may hold.
OVERLAP, ALONG = 0.4, range(2, 8)


def evenly(length: int, side: int, count: int) -> list[int]:
    """Where `count` intervals of `side` begin that stand evenly from 0 to the end of `length`; rounded down."""
    return [(length - side) * i // (count - 1) if count > 1 else 0 for i in range(count)]


def squares_along(height: int, width: int) -> int:
    """How many squares of the shorter side's length stand on the longer side."""
    short, spare = min(height, width), abs(height - width)
    if not spare:
        return 1
    return min(ALONG, key=lambda count: abs(1 - spare / (count - 1) / short - OVERLAP))


def grid_regions(height: int, width: int, levels: int = 3) -> list[tuple[int, int, int, int, int]]:
    """(level, top, left, height, width) of the regions of a grid at several scales, row by row.

    Level 1 is the whole grid. At level l regions are squares of 2 / (l + 1) of the shorter side: l of them on the shorter
    side, and on the longer one l + m - 1, where m is `squares_along`. A side of no cells gives no regions.
    """
    short, more = min(height, width), squares_along(height, width) - 1
    found = [(1, 0, 0, height, width)]
    for level in range(2, levels + 1):
        if side := 2 * short // (level + 1):
            tops = evenly(height, side, level + (more if height > width else 0))
            lefts = evenly(width, side, level + (more if width > height else 0))
            found += [(level, top, left, side, side) for top, left in product(tops, lefts)]
    return found


def region_pool(cells: DataFrame, keys: list[str], height: int, width: int, kind: str = "max", levels: int = 3) -> DataFrame:
    """`keys`, region (number) and f, the pooled cells (y, x, f) of each region. The regions are a small table."""
    regions = cells.sparkSession.createDataFrame([(n, top, left, top + h, left + w) for n, (_, top, left, h, w) in enumerate(grid_regions(height, width, levels))], "region int, y0 int, x0 int, y1 int, x1 int")
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return pool(cells.join(F.broadcast(regions), inside), [*keys, "region"], kind)
