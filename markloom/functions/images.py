"""Signatures and quality of decoded grayscale images (array<array<int>>, rows of pixels)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import batched

SIDE = 16
NEAR_IDENTICAL = 0.985


def signature_bits(values: Column) -> Column:
    """Q1 after the resize: a bit for each value, whether it is at least the median."""
    sorted_ = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    n = F.size(values)
    median = (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, F.aggregate(F.array(median), F.lit(""), lambda _, m: F.array_join(F.transform(values, lambda x: F.when(x.cast("double") >= m, F.lit("1")).otherwise(F.lit("0"))), "")))


def low_information(values: Column, least_std: float = 10.0, least_range: float = 25.0, white: float = 248.0, least_ink: float = 0.01) -> Column:
    """Q2: population deviation, range or inked share too small; an empty or null image has none."""
    v = F.transform(values, lambda x: x.cast("double"))
    n = F.size(values)
    sum_ = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    mean = sum_(lambda x: x) / n
    variance = F.aggregate(F.array(mean), F.lit(0.0), lambda _, m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))) / n
    ink = sum_(lambda x: (x < white).cast("double")) / n
    poor = (F.sqrt(variance) < least_std) | (F.array_max(v) - F.array_min(v) < least_range) | (ink < least_ink)
    return F.when(values.isNull() | (n == 0), F.lit(True)).otherwise(F.coalesce(poor, F.lit(True)))


def good_enough(pixels: Column, least_side: int = 50) -> Column:
    """Q4: there, at least 50 by 50, and not all black."""
    height = F.size(pixels)
    width = F.size(F.get(pixels, F.lit(0)))
    return F.coalesce((height >= least_side) & (width >= least_side) & F.exists(pixels, lambda r: F.exists(r, lambda x: x > 0)), F.lit(False))


def _lanczos(n: int, size: int, support: float = 3.0) -> np.ndarray:
    """Weights (size x n) of a Lanczos resize that widens its window when it shrinks."""
    scale = n / size
    reach = support * max(scale, 1.0)
    centre = (np.arange(size)[:, None] + 0.5) * scale
    at = (np.arange(n)[None, :] + 0.5 - centre) / max(scale, 1.0)
    w = np.where(np.abs(at) < support, np.sinc(at) * np.sinc(at / support), 0.0)
    w[np.abs(np.arange(n)[None, :] + 0.5 - centre) >= reach] = 0.0
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    out = _lanczos(image.shape[0], height) @ image.astype(float) @ _lanczos(image.shape[1], width).T
    return np.clip(np.rint(out), 0, 255)


def signature(image: np.ndarray | None) -> str | None:
    """Q1: 256 bits; None for an image that can't be read."""
    if image is None or image.ndim != 2 or not image.size:
        return None
    small = resize(image, SIDE, SIDE)
    return "".join("1" if x else "0" for x in (small >= np.median(small)).ravel())


def _window_mean(x: np.ndarray, k: int) -> np.ndarray:
    s = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def ssim(a: np.ndarray, b: np.ndarray, k: int = 7, top: float = 255.0) -> float:
    """Mean structural similarity over uniform windows with sample covariances."""
    a, b = a.astype(float), b.astype(float)
    if min(a.shape) < k:
        raise ValueError("images are smaller than the window")
    ma, mb = _window_mean(a, k), _window_mean(b, k)
    fix = k * k / (k * k - 1)
    va, vb, vab = (fix * (_window_mean(x, k) - y) for x, y in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    return float((((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def _shrunk(x: np.ndarray, most: int) -> np.ndarray:
    scale = min(1.0, most / max(x.shape))
    return x if scale == 1.0 else resize(x, max(1, int(x.shape[0] * scale)), max(1, int(x.shape[1] * scale)))


def image_ssim(a: np.ndarray, b: np.ndarray, most: int = 512) -> float:
    """Q5: both shrunk to `most` with their aspect, then cut to what they share; 0 if they can't be compared."""
    a, b = _shrunk(a, most), _shrunk(b, most)
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    try:
        return ssim(a[:h, :w], b[:h, :w])
    except ValueError:
        return 0.0


def is_different(a: np.ndarray, b: np.ndarray, threshold: float = NEAR_IDENTICAL) -> bool:
    """Q3: below the threshold on the common corner; images that can't be compared differ."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    try:
        return ssim(a[:h, :w], b[:h, :w]) < threshold
    except ValueError:
        return True


def as_image(pixels) -> np.ndarray | None:
    try:
        out = np.array([np.asarray(r, dtype=float) for r in pixels])
        return out if out.ndim == 2 and out.size else None
    except (TypeError, ValueError):
        return None


@batched("string")
def signature_udf(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda p: signature(as_image(p)))


@batched("double")
def ssim_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([image_ssim(x, y) if (x := as_image(p)) is not None and (y := as_image(q)) is not None else 0.0 for p, q in zip(a, b, strict=True)])


@batched("boolean")
def different_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([is_different(x, y) if (x := as_image(p)) is not None and (y := as_image(q)) is not None else True for p, q in zip(a, b, strict=True)])
