"""Pixels to model input: triangle-filter resize and normalisation, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def triangle_weights(source: int, target: int) -> np.ndarray:
    """Rows of weights [target, source] of a triangle filter; widened when shrinking, clipped at the edges."""
    scale = source / target
    support = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale - 0.5
    weights = np.clip(1 - np.abs(np.arange(source) - centre[:, None]) / support, 0, None)
    return weights / weights.sum(1, keepdims=True)


def resize(image: np.ndarray, size: int) -> np.ndarray:
    """An (h, w, 3) image as (size, size, 3) bytes; the aspect ratio is not kept."""
    if image.shape[:2] == (size, size):
        return image
    rows, columns = triangle_weights(image.shape[0], size), triangle_weights(image.shape[1], size)
    out = np.einsum("yh,hwc->ywc", rows, image.astype(np.float64))
    out = np.einsum("xw,ywc->yxc", columns, out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def to_tensor(images: list[np.ndarray], size: int, mean: list[float], std: list[float]) -> np.ndarray:
    """(B, 3, size, size) floats: (x / 255 - mean) / std of the resized images."""
    batch = np.stack([resize(i, size) for i in images]).astype(np.float32) / 255
    return ((batch - np.float32(mean)) / np.float32(std)).transpose(0, 3, 1, 2)


def preprocess(data: Column, width: Column, height: Column, size: int, mean: list[float], std: list[float]) -> Column:
    """An image's tensor (3 * size * size floats, channel by channel) from packed RGB; null stays null."""

    @F.pandas_udf("array<float>")
    def run(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = [None if d is None else to_tensor([np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)], size, mean, std).ravel() for d, w, h in zip(data, width, height)]
        return pd.Series(out, index=data.index, dtype=object)

    return run(data, width, height)
