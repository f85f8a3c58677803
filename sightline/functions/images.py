"""Perceptual hashes of pictures as Spark's image source reads them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: comparisons per row and column of a hash.
HASH_SIDE = 8


def lanczos_weights(size: int, out: int, a: int = 3) -> np.ndarray:
    """Row i holds the weights with which ``size`` samples make sample i of ``out``."""
    scale = max(1.0, size / out)
    centre = (np.arange(out) + 0.5) * size / out
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def thumbnail_hash(grey: np.ndarray) -> tuple[int, int]:
    """(hash, brightness range) of a grey picture: 64 bits, left brighter than right, row by row from the highest bit; signed."""
    rows, cols = grey.shape
    thumb = lanczos_weights(rows, HASH_SIDE) @ grey.astype(float) @ lanczos_weights(cols, HASH_SIDE + 1).T
    thumb = np.clip(np.rint(thumb), 0, 255).astype(int)
    bits = (thumb[:, :-1] > thumb[:, 1:]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value, int(thumb.max() - thumb.min())


def _grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return px[:, :, 0]
    # Luma weights; the image source keeps blue first.
    return np.rint(px[:, :, 0] * 0.114 + px[:, :, 1] * 0.587 + px[:, :, 2] * 0.299)


def picture_hash(image: Column) -> Column:
    """struct(dhash, contrast) of an image struct; nulls where the picture couldn't be decoded."""

    def run(images: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in images.itertuples():
            if r.height is None or not r.height > 0 or not r.data:
                out.append((None, None))
            else:
                out.append(thumbnail_hash(_grey(int(r.height), int(r.width), int(r.nChannels), bytes(r.data))))
        return pd.DataFrame(out, columns=["dhash", "contrast"]).astype({"dhash": "Int64", "contrast": "Int64"})

    run.__annotations__ = {"images": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(run, "dhash long, contrast int")(image)
