"""Similarity of pixel arrays: whole-array moments in SQL, windows and blurs in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbour_pairs(vectors: DataFrame) -> DataFrame:
    """(a, b, x, y): each vector and the one of the next id where both have a label, stretched to pixel values."""
    pixels = lambda c: F.transform(c, lambda v: v.cast("double") * 100 + 128)
    a = vectors.select(F.col("vec_id").alias("a"), "label", pixels(F.col("embedding")).alias("x"))
    b = vectors.select(F.col("vec_id").alias("b"), "label", pixels(F.col("embedding")).alias("y"), (F.col("vec_id") - 1).alias("a"))
    return a.join(b, ["a", "label"]).select("a", "b", "x", "y")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)


def array_errors(x: Column, y: Column) -> Column:
    """(mae, mse) of two arrays of one length."""
    d = F.zip_with(x, y, lambda a, b: a - b)
    n = F.size(x)
    return F.struct((_sum(F.transform(d, F.abs)) / n).alias("mae"), (_sum(F.transform(d, lambda v: v * v)) / n).alias("mse"))


def array_moments(x: Column, y: Column) -> Column:
    """(mx, my, vx, vy, cov): means, population variances and covariance."""
    n = F.size(x)
    mx, my = _sum(x) / n, _sum(y) / n
    square = lambda c, m: _sum(F.transform(c, lambda v: (v - m) * (v - m))) / n
    cov = _sum(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my))) / n
    return F.struct(mx.alias("mx"), my.alias("my"), square(x, mx).alias("vx"), square(y, my).alias("vy"), cov.alias("cov"))


def mask_iou(x: Column, y: Column, below: float) -> Column:
    """Intersection over union of the dark pixels; no dark pixel at all is 0."""
    both = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] < below) & (p["y"] < below)))
    any_ = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] < below) | (p["y"] < below)))
    return F.when(any_ == 0, 0.0).otherwise(both / (any_ + 1e-6))


def bbox(df: DataFrame, key: str, pixels: str, width: int, below: float) -> DataFrame:
    """Box (exclusive maxima) around the pixels below a value, nulls where there is none."""
    at = F.filter(F.transform(pixels, lambda v, i: F.when(v < below, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(at, lambda i: i % width), F.transform(at, lambda i: F.floor(i / width))
    return df.select(key, F.array_min(xs).cast("long").alias("x0"), F.array_min(ys).cast("long").alias("y0"), (F.array_max(xs) + 1).cast("long").alias("x1"), (F.array_max(ys) + 1).cast("long").alias("y1"))


def _window_mean(a: np.ndarray, k: int) -> np.ndarray:
    s = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def ssim_windowed(x: np.ndarray, y: np.ndarray, k: int = 7, span: float = 255.0) -> float:
    """Mean structural similarity over k x k windows with sample covariances, windows inside the image only."""
    n = k * k
    mx, my = _window_mean(x, k), _window_mean(y, k)
    unbias = n / (n - 1)
    vx, vy = unbias * (_window_mean(x * x, k) - mx * mx), unbias * (_window_mean(y * y, k) - my * my)
    cov = unbias * (_window_mean(x * y, k) - mx * my)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def blurred(a: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Gaussian blur, cut at four deviations, the image mirrored at its edges."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="symmetric"), w, "valid"), axis, a)
    return a


def ssim_blurred(x: np.ndarray, y: np.ndarray) -> float:
    x, y = blurred(x), blurred(y)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = x.mean(), y.mean()
    cov = ((x - mx) * (y - my)).mean()
    value = (2 * mx * my + c1) / (mx * mx + my * my + c1) * (2 * abs(cov) + c2) / (x.var() + y.var() + c2)
    return float(min(max(value, 0.0), 1.0))


def dilated(mask: np.ndarray, k: int = 5) -> np.ndarray:
    r = k // 2
    p = np.pad(mask, r)
    return np.lib.stride_tricks.sliding_window_view(p, (k, k)).any((2, 3))


def iou_relaxed(x: np.ndarray, y: np.ndarray, below: float = 245.0) -> float:
    """Dark pixels of x, grown by two, that meet those of y, over the union of both."""
    a, b = x < below, y < below
    if not a.any() and not b.any():
        return 0.0
    return float(min(1.0, (dilated(a) & b).sum() / ((a | b).sum() + 1e-6)))


def crop_to_content(x: np.ndarray, y: np.ndarray, below: float = 250.0) -> tuple[np.ndarray, np.ndarray]:
    """Both images cut to the box around the content of either."""
    at = np.argwhere((x < below) | (y < below))
    if not len(at):
        return x, y
    (r0, c0), (r1, c1) = at.min(0), at.max(0)
    return x[r0 : r1 + 1, c0 : c1 + 1], y[r0 : r1 + 1, c0 : c1 + 1]


def _weights(n: int, m: int, kernel: str) -> np.ndarray:
    """An m x n matrix that resamples n values to m; the kernel is stretched where there are fewer than before."""
    reach, shape = {
        "nearest": (0.5, lambda x: (np.abs(x) <= 0.5) * 1.0),
        "bilinear": (1.0, lambda x: np.maximum(0.0, 1 - np.abs(x))),
        "bicubic": (2.0, lambda x: np.where(np.abs(x) < 1, (1.5 * np.abs(x) - 2.5) * x * x + 1, np.where(np.abs(x) < 2, ((-0.5 * np.abs(x) + 2.5) * np.abs(x) - 4) * np.abs(x) + 2, 0.0))),
        "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)),
    }[kernel]
    scale = n / m
    wide = max(scale, 1.0) if kernel != "nearest" else 1.0
    centre = (np.arange(m) + 0.5) * scale
    if kernel == "nearest":
        return np.eye(n)[np.minimum(centre, n - 1).astype(int)]
    at = np.arange(n) + 0.5
    inside = (at[None, :] >= centre[:, None] - reach * wide - 0.5) & (at[None, :] <= centre[:, None] + reach * wide + 0.5)
    w = shape((at[None, :] - centre[:, None]) / wide) * inside
    return w / w.sum(1, keepdims=True)


def resized(a: np.ndarray, shape: tuple[int, int], kernel: str = "nearest") -> np.ndarray:
    """An image in another size: nearest neighbour, bilinear, bicubic or lanczos, with smoothing where it shrinks."""
    rows, cols = _weights(a.shape[0], shape[0], kernel), _weights(a.shape[1], shape[1], kernel)
    return np.tensordot(np.tensordot(rows, a, (1, 0)), cols, (1, 1)) if a.ndim == 2 else np.moveaxis(np.tensordot(np.tensordot(rows, a, (1, 0)), cols, (1, 1)), -1, 1)


def psnr(x: np.ndarray, y: np.ndarray) -> float:
    mse = ((x - y) ** 2).mean()
    return 1.0 if mse == 0 else float(min((20 * np.log10(255.0) - 10 * np.log10(mse)) / 40.0, 1.0))


def scores(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Metrics of a rendered image x against its source y, both gray and of one shape."""
    out = {"ssim_windowed": ssim_windowed(x, y) if min(x.shape) >= 7 else float("nan"), "mae": float(np.abs(x - y).mean() / 255)}
    a, b = crop_to_content(x, y)
    out |= {"iou": iou_relaxed(a, b), "ssim_global_abs": ssim_blurred(a, b), "psnr": psnr(a, b)}
    return out | {"visual": (out["iou"] + out["ssim_global_abs"] + out["psnr"]) / 3}


def image_scores(df: DataFrame, x: str, y: str, shape: tuple[int, int], keep: tuple[str, ...]) -> DataFrame:
    """`keep` and the scores of each row's pair of gray images, rounded to 9 decimals; failures are in `error`."""
    names = ["ssim_windowed", "mae", "iou", "ssim_global_abs", "psnr", "visual"]
    kept = df.select(*keep, x, y)
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} double" for n in names] + ["error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for a, b in zip(batch.column(x).to_pylist(), batch.column(y).to_pylist(), strict=True):
                try:
                    got = scores(np.array(a, float).reshape(shape), np.array(b, float).reshape(shape))
                    rows.append([round(got[n], 9) for n in names])
                    errors.append(None)
                except (TypeError, ValueError) as e:
                    rows.append([None] * len(names))
                    errors.append(f"{type(e).__name__}: {e}")
            cols = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols + [pa.array(errors, pa.string())], [*keep, *names, "error"])

    return kept.mapInArrow(run, schema)


def resampled(df: DataFrame, key: str, pixels: str, shape: tuple[int, int], to: tuple[int, int], kernel: str) -> DataFrame:
    """key and px: gray images, rows of pixels in one array, in another size; an array of another length is null."""
    kept = df.select(key, pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if v is None or len(v) != shape[0] * shape[1] else resized(np.array(v, float).reshape(shape), to, kernel).ravel().tolist() for v in batch.column(pixels).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(made, pa.list_(pa.float64()))], [key, "px"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, px array<double>")
