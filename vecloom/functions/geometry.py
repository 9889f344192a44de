"""Boxes, ranks and other scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cutmix_box(width: Column, height: Column, lam: Column, x: Column, y: Column) -> Column:
    """The box around (x, y) whose sides are sqrt(1 - lam) of the image's, cut at the image's edges, with lam after
    cutting."""
    w, h = (F.floor(side * F.sqrt(1 - lam)).cast("int") for side in (width, height))
    half = lambda v: F.floor(v / 2).cast("int")
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    x1, x2, y1, y2 = inside(x - half(w), width), inside(x + half(w), width), inside(y - half(h), height), inside(y + half(h), height)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), (1 - (x2 - x1) * (y2 - y1) / (width * height)).alias("lam"))


def centre_box(width: Column, height: Column, size: Column) -> Column:
    return F.struct(F.bround((width - size) / 2).cast("int").alias("left"), F.bround((height - size) / 2).cast("int").alias("top"))


def teacher_resize(image_size: Column, crop_share: Column) -> Column:
    return F.floor(image_size / crop_share).cast("int")


def bottleneck_rank(kh: Column, kw: Column, cin: Column, cout: Column) -> Column:
    """The rank at which two factors have as many weights as the kernel they stand for, at least 1."""
    a, b = kh * kw, cin + cout
    c = -F.greatest(cin, cout) * a
    return F.greatest(F.lit(1), F.bround((-b + F.sqrt(b * b - 4 * a * c)) / (2 * a)).cast("int"))


def ffn_width(dim: Column, factor: Column, step: int = 16) -> Column:
    return (F.ceil(dim * factor / step) * step).cast("int")


def fold_norm(kernel: Column, bias: Column, gamma: Column, mean: Column, var: Column, beta: Column, eps: float = 1e-5) -> Column:
    """A convolution's kernel and bias with the batch norm behind it folded in."""
    t = gamma / F.sqrt(var + eps)
    return F.struct(F.transform(kernel, lambda k: k * t).alias("kernel"), (beta + (bias - mean) * t).alias("bias"))


def drop_path(index: Column, blocks: Column, rate: float) -> Column:
    """Rises evenly with the block's index."""
    return F.try_divide(rate * index, blocks - 1)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def inverted(m: Column) -> Column:
    return F.map_from_arrays(F.map_values(m), F.map_keys(m))


def part_of(text: Column, start: Column, end: Column) -> Column:
    """Characters from start to end (exclusive); NULL if the range leaves the text."""
    return F.when((start >= 0) & (end <= F.length(text)) & (start <= end), F.substring(text, start + 1, end - start))


def score_bucket(s: Column, low: float = 0.15, high: float = 0.22, steps: int = 20) -> Column:
    """One of steps + 1 grey levels."""
    at = F.least(F.greatest(s - low, F.lit(0.0)), F.lit(high)) / (high - low)
    return F.least(F.round(at * steps).cast("int"), F.lit(steps))


def rate_text(mean: Column) -> Column:
    """Frames a second and milliseconds, of a mean duration in seconds."""
    return F.struct(F.round(F.try_divide(F.lit(1.0), mean)).cast("int").alias("fps"), (F.round(mean * 10000) / 10).alias("ms"))


def fused_branches(kernel: Column, point: Column, identity: bool = True) -> Column:
    """A square kernel (row by row) with a 1x1 branch, padded, and if asked the identity added at its centre."""
    centre = F.floor(F.size(kernel) / 2)
    return F.transform(kernel, lambda k, i: k + F.when(i == centre, point + float(identity)).otherwise(0.0))


def fused_mixer(mix: Column, norm: Column, scale: Column) -> Column:
    """The identity plus scale times the difference of two kernels of one shape."""
    delta = F.zip_with(mix, norm, lambda m, n: scale * (m - n))
    return fused_branches(delta, F.lit(0.0))
