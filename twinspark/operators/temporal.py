"""Operators on sequences of frames, as arithmetic on their numbers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from inspect import signature

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def copies(n: Column, least: int, exceed: bool = False) -> Column:
    """How often a sequence of n is laid end to end when it is doubled until it has `least` (or, `exceed`, more)."""
    need = F.lit(float(least)) / n
    doublings = F.ceil(F.log2(need)) if not exceed else F.floor(F.log2(need)) + 1
    return F.pow(F.lit(2), F.greatest(F.lit(0), doublings)).cast("int")


def padded(frames: DataFrame, least: int = 4) -> DataFrame:
    """Frames with those of short videos repeated by doubling; frame_idx runs on."""
    n = frames.groupBy("video_id").agg(F.count_distinct("frame_idx").alias("n"))
    again = F.explode(F.sequence(F.lit(0), copies(F.col("n"), least) - 1)).alias("copy")
    return frames.join(n, "video_id").select("*", again).withColumn("frame_idx", F.col("frame_idx") + F.col("copy") * F.col("n")).drop("copy", "n")


def subsampled(frames: DataFrame, most: int = 60) -> DataFrame:
    """At most `most` frames of each video, evenly spread, first and last included; frame_idx from 0."""
    n = frames.groupBy("video_id").agg(F.count_distinct("frame_idx").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(most)) - 1)).alias("k")
    at = F.when(F.col("n") <= most, F.col("k")).otherwise(F.expr(f"k * (n - 1) div {max(1, most - 1)}"))
    wanted = n.select("video_id", "n", k).select("video_id", at.alias("frame_idx"), "k")
    return frames.join(wanted, ["video_id", "frame_idx"]).withColumn("frame_idx", F.col("k")).drop("k")


def cropped(frames: DataFrame, start: Column, size: int) -> DataFrame:
    """Frames start .. start + size - 1, numbered from 0."""
    i = F.col("frame_idx")
    return frames.where((i >= start) & (i < start + size)).withColumn("frame_idx", i - start)


def fast_forward(frames: DataFrame, k: int) -> DataFrame:
    return frames.where(F.col("frame_idx") % k == 0).withColumn("frame_idx", F.expr(f"frame_idx div {k}"))


def slow_motion(frames: DataFrame, k: int = 2) -> DataFrame:
    return frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("r")).withColumn("frame_idx", F.col("frame_idx") * k + F.col("r")).drop("r")


def reversed_frames(frames: DataFrame) -> DataFrame:
    last = frames.groupBy("video_id").agg(F.max("frame_idx").alias("last"))
    return frames.join(last, "video_id").withColumn("frame_idx", F.col("last") - F.col("frame_idx")).drop("last")


def paused(frames: DataFrame, start: int, duration: int) -> DataFrame:
    """Frame `start` shown `duration` times more."""
    i = F.col("frame_idx")
    more = F.when(i == start, F.sequence(F.lit(0), F.lit(duration))).otherwise(F.array(F.when(i > start, duration).otherwise(0)))
    return frames.select("*", F.explode(more).alias("shift")).withColumn("frame_idx", i + F.col("shift")).drop("shift")


def windows_shuffled(frames: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Whole windows of `size` frames in an order given by a hash; frames after the last whole window go."""
    n = frames.groupBy("video_id").agg(F.expr(f"count(distinct frame_idx) div {size}").alias("windows"))
    w = F.expr(f"frame_idx div {size}")
    f = frames.join(n, "video_id").withColumn("w", w).where("w < windows")
    place = f.select("video_id", "w").distinct().withColumn("to", F.row_number().over(Window.partitionBy("video_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "video_id", "w")), "w")) - 1)
    return f.join(place, ["video_id", "w"]).withColumn("frame_idx", F.col("to") * size + F.col("frame_idx") % size).drop("w", "to", "windows")


def windows_dropped(frames: DataFrame, size: int, dropped: Column) -> DataFrame:
    """Without the windows (column w) for which `dropped` holds, unless it holds for all of a video's."""
    f = frames.withColumn("w", F.expr(f"frame_idx div {size}")).withColumn("d", dropped)
    some = f.groupBy("video_id").agg(F.min(F.col("d").cast("int")).alias("all"))
    return f.join(some, "video_id").where("not d or all = 1").drop("w", "d", "all")


def sampled_frames(frames: DataFrame, video_fps: Column, fps: float, fallback: float = 25.0, most: float = 144.0) -> DataFrame:
    """Every round(video_fps / fps)-th frame; rates over `most` count as `fallback`."""
    rate = F.when(video_fps > most, fallback).otherwise(video_fps)
    return frames.where(F.col("frame_idx") % F.greatest(F.round(rate / fps).cast("int"), F.lit(1)) == 0)


def pick(u: Column, weights: dict[str, float]) -> Column:
    """The name whose share of the weights holds u, uniform in [0, 1)."""
    total, upto, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        upto += w / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(list(weights)[-1])


def hashed_uniform(*cols: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def box_intersection(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Area shared by two boxes given by columns x0, y0, x1, y1."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def label_matrix(items: DataFrame) -> DataFrame:
    """i, j of items (i, label) that share a label, i and j alike included."""
    a = items.select(F.col("i"), "label").distinct()
    return a.join(a.withColumnRenamed("i", "j"), "label").select("i", "j").distinct()


#: What a configuration may name, with the parameters of each after the frames.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "pad": padded, "subsample": subsampled, "crop": lambda frames, start, size: cropped(frames, F.lit(start), size), "fast_forward": fast_forward, "slow_motion": slow_motion,
    "reverse": reversed_frames, "pause": paused, "shuffle_windows": windows_shuffled,
}


def from_config(steps: list[dict]) -> Callable[[DataFrame], DataFrame]:
    """A transform of frames (video_id, frame_idx, f) from a list of steps like {"kind": "fast_forward", "k": 2}, taken in order.

    {"kind": "choice", "of": [{"weight": 2, "steps": [...]}, ...], "seed": 0} takes for each video one of several lists, in
    proportion to their weights (1 if not given), by a hash of its id. Unknown kinds are a ValueError, unknown parameters a TypeError, both
    when the configuration is read.
    """
    made = [_step(dict(s)) for s in steps]
    return lambda frames: reduce(lambda df, step: step(df), made, frames)


def _step(step: dict) -> Callable[[DataFrame], DataFrame]:
    kind = step.pop("kind", None)
    if kind == "choice":
        return _choice(**step)
    if kind not in STEPS:
        raise ValueError(f"unknown step {kind!r}; there are {sorted([*STEPS, 'choice'])}")
    signature(STEPS[kind]).bind(None, **step)
    return lambda frames: STEPS[kind](frames, **step)


def _choice(of: list[dict], seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    lists = [from_config(o["steps"]) for o in of]
    weights = {str(i): float(o.get("weight", 1)) for i, o in enumerate(of)}

    def run(frames: DataFrame) -> DataFrame:
        picked = pick(hashed_uniform("video_id", seed=seed), weights)
        return reduce(DataFrame.unionByName, [f(frames.where(picked == str(i))) for i, f in enumerate(lists)])

    return run
