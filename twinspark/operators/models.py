"""Models that are plugged in: embedders, and a learned comparator of frame matrices run pair by pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean and spread of the three channels that picture models are trained with.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


class Embedder(Protocol):
    """Frames of one video to features."""

    dim: int

    def __call__(self, pixels: list) -> list[list[float]]: ...


_EMBEDDERS: dict[str, Callable[..., Embedder]] = {}


def register_embedder(name: str, make: Callable[..., Embedder]) -> None:
    _EMBEDDERS[name] = make


def embedder(name: str, **options) -> Embedder:
    """The named embedder; ValueError for an unknown name."""
    if name not in _EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; known: {sorted(_EMBEDDERS)}")
    return _EMBEDDERS[name](**options)


def embedded(frames: DataFrame, name: str, batch: int = 256, **options) -> DataFrame:
    """video_id, frame_idx and f of frames (video_id, frame_idx, pixels), a batch of frames at a time; the model is made once a task."""

    embedder(name, **options)  # an unknown name fails here
    make = _EMBEDDERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make(**options)
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({"video_id": part.video_id, "frame_idx": part.frame_idx, "f": list(model(part.pixels.tolist()))})

    kind = frames.schema["video_id"].dataType.simpleString()
    return frames.select("video_id", "frame_idx", "pixels").mapInPandas(run, f"video_id {kind}, frame_idx long, f array<double>")


def channel_normalized(x: Column, channel: Column) -> Column:
    """A value of 0 to 255 of channel 0, 1 or 2, scaled as picture models expect."""
    at = (channel + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    return (x / 255.0 - pick(CHANNEL_MEAN)) / pick(CHANNEL_STD)


def crop_offset(size: Column, crop: int, share: Column | None = None) -> Column:
    """First row or column of a crop: centred, or at a share (0 to 1) of the room there is."""
    room = size - crop
    return F.floor(room / 2) if share is None else F.floor(share * (room + 1))


def check_heads(attention: bool, binarization: bool) -> None:
    """A network has an attention head or a binary one."""
    if attention and binarization:
        raise ValueError("attention and binarization exclude each other")


def _convolved(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(channels, rows, columns) by 3 x 3 kernels (out, channels, 3, 3) over a border of zeros."""
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(1, 2))
    return np.einsum("cijkl,ockl->oij", windows, w, optimize=True) + b[:, None, None]


def _halved(x: np.ndarray) -> np.ndarray:
    c, i, j = x.shape
    return x[:, : i // 2 * 2, : j // 2 * 2].reshape(c, i // 2, 2, j // 2, 2).max(axis=(2, 4))


def compare_matrix(s: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
    """A smaller matrix of refined similarities: three convolutions, halved after the first two, then one of 1 x 1. None for fewer than 4 rows or columns."""
    if min(s.shape) < 4:
        return None
    x = s[None].astype(np.float64)
    for layer, (w, b) in enumerate(weights[:3]):
        x = np.maximum(_convolved(x, w, b), 0)
        if layer < 2:
            x = _halved(x)
    w, b = weights[3]
    return np.einsum("cij,oc->oij", x, w.reshape(w.shape[0], -1))[0] + b[0]


def refined(weights: list[tuple[np.ndarray, np.ndarray]]) -> Callable[[np.ndarray], float | None]:
    """A score of a frame matrix for `chamfer.pair_scores`: refined, clamped, shifted to [0, 1], chamfered; None for too few frames."""

    def score(s: np.ndarray) -> float | None:
        out = compare_matrix(s, weights)
        return None if out is None else float((np.clip(out, -1, 1) / 2 + 0.5).max(axis=1).mean())

    return score
