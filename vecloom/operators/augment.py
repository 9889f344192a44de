"""Augmentation parameters: draw, compress, restore, apply."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.functions.geometry import cutmix_box
from vecloom.operators.samples import chosen, draw

#: Fixed orders: the operations of a RandAugment entry, and the transforms of a composition.
OPERATIONS = ["Identity", "ShearX", "ShearY", "TranslateX", "TranslateY", "Rotate", "Brightness", "Color", "Contrast", "Sharpness", "Posterize", "Solarize", "AutoContrast", "Equalize"]
ORDER = ["uint8", "resize", "center_crop", "random_crop", "random_resized_crop", "random_horizontal_flip", "rand_augment", "to_tensor", "normalize", "random_erasing", "mixup", "cutmix"]
NO_PARAMETERS = ["uint8", "resize", "center_crop", "to_tensor", "normalize"]
GREY = np.array([0.2989, 0.587, 0.114])
AFTER_COLLATE = ["mixup", "cutmix"]


def cleaned(config: dict[str, dict]) -> dict[str, dict]:
    """Entries that are enabled (the default), without that key."""
    return {k: {a: b for a, b in v.items() if a != "enable"} for k, v in config.items() if v.get("enable", True)}


def composed(config: dict[str, dict]) -> list[tuple[str, dict]]:
    """Known transforms in their fixed order; unknown names are passed over."""
    known = cleaned(config)
    return [(k, known[k]) for k in ORDER if k in known]


def split_config(config: dict[str, dict]) -> tuple[dict, dict]:
    """Before collating, after it."""
    return {k: v for k, v in config.items() if k not in AFTER_COLLATE}, {k: v for k, v in config.items() if k in AFTER_COLLATE}


def compressed(entry: Column) -> Column:
    """struct(rrc, ra) with operation numbers, of struct(rrc, ra) with names. NULL (skipped) stays NULL, an empty list
    stays empty; an unknown operation has number -1."""
    names = F.array(*map(F.lit, OPERATIONS))
    ops = F.transform(entry["ra"], lambda o: F.struct((F.array_position(names, o["op"]) - 1).cast("int").alias("op"), o["mag"].alias("mag")))
    return F.struct(entry["rrc"].alias("rrc"), ops.alias("ra"))


def decompressed(entry: Column) -> Column:
    names = F.array(*map(F.lit, OPERATIONS))
    ops = F.transform(entry["ra"], lambda o: F.struct(F.get(names, F.when(o["op"] >= 0, o["op"])).alias("op"), o["mag"].alias("mag")))
    return F.struct(entry["rrc"].alias("rrc"), ops.alias("ra"))


def to_list(params: dict, names: list[str], mixing: bool = False) -> list:
    """The positional form of named parameters: no names, no transforms without parameters, operations as numbers, and
    in front the partner's key if mixing is configured."""
    out = [params.get("id2")] if mixing else []
    for k in names:
        if k not in NO_PARAMETERS and k not in AFTER_COLLATE:
            v = params.get(k)
            out.append([[OPERATIONS.index(op), mag] for op, mag in v] if k == "rand_augment" and v is not None else v)
    return out


def from_list(entry: list, names: list[str], mixing: bool = False) -> dict:
    """The inverse: skipped transforms (null) are left out, those without parameters come back as empty."""
    out, rest = {}, iter(entry)
    if mixing and (other := next(rest)) is not None:
        out["id2"] = other
    for k in names:
        if k in NO_PARAMETERS:
            out[k] = ()
        elif k not in AFTER_COLLATE and (v := next(rest)) is not None:
            out[k] = [(OPERATIONS[op], mag) for op, mag in v] if k == "rand_augment" else v
    return out


def mixed_batch(rows: DataFrame, size: int, classes: int, choices: dict[str, float], by: Column | None = None, side: int = 8) -> DataFrame:
    """rows (batch, pos, v: a flat image of `side` columns, label) mixed with the row at the other end of their batch of
    `size`: v, target (shares of classes), kind. choices names mixup and cutmix with their lambda; one of them is drawn
    for each batch. cutmix replaces a centred box, and its labels go by the box's true area. A row without partner (in a
    partial batch) stays as it is, of kind "none"."""
    names = F.array(*map(F.lit, choices))
    other = rows.select("batch", (size - 1 - F.col("pos")).alias("pos"), F.col("v").alias("_v"), F.col("label").alias("_label"))
    x = rows.join(other, ["batch", "pos"], "left").withColumn("kind", F.when(F.col("_v").isNull(), "none").otherwise(chosen(names, draw(F.col("batch") if by is None else by, seed=5))))
    height = F.size("v") / side
    cut = F.lit(choices.get("cutmix", 1.0))
    b = cutmix_box(F.lit(side), height.cast("int"), cut, F.lit(side // 2), F.floor(height / 2).cast("int"))
    x = x.withColumn("_box", b)
    i, j = (lambda at: F.floor(at / side)), (lambda at: at % side)
    inside = lambda at: (j(at) >= F.col("_box.x1")) & (j(at) < F.col("_box.x2")) & (i(at) >= F.col("_box.y1")) & (i(at) < F.col("_box.y2"))
    pasted = F.transform("v", lambda a, at: F.when(inside(at), F.get("_v", at)).otherwise(a))
    mix, share = F.lit(choices.get("mixup", 1.0)), F.col("_box.lam")
    own, others = (V.one_hot(F.col(c), classes) for c in ("label", "_label"))
    kind = F.col("kind")
    v = F.when(kind == "mixup", V.blend(F.col("v"), F.col("_v"), mix)).when(kind == "cutmix", pasted).otherwise(F.col("v"))
    target = F.when(kind == "mixup", V.blend(own, others, mix)).when(kind == "cutmix", V.blend(own, others, share)).otherwise(own)
    return x.select(*(c for c in rows.columns if c not in ("v", "label")), v.alias("v"), target.alias("target"), "kind")


def expanded(samples: DataFrame, n: int) -> DataFrame:
    """Each sample n times, with aug from 0."""
    return samples.withColumn("aug", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def drawn(rng: np.random.Generator, width: int, height: int, config: dict[str, dict]) -> dict:
    """Random parameters for one image, by the enabled transforms of config."""
    out: dict = {}
    rows, columns = height, width  # of the image as it is collated
    for k, v in composed(config):
        if "size" in v and k in ("random_crop", "random_resized_crop", "center_crop"):
            rows = columns = v["size"]
        elif k == "resize":
            rows, columns = (round(n * v["size"] / min(rows, columns)) for n in (rows, columns))
        if k in NO_PARAMETERS:
            out[k] = ()
        elif k == "random_crop":
            s = v.get("size", min(width, height))
            out[k] = (int(rng.integers(0, height - s + 1)), int(rng.integers(0, width - s + 1)))
        elif k == "random_resized_crop":
            area = width * height * rng.uniform(*v.get("scale", (0.08, 1.0)))
            ratio = np.exp(rng.uniform(*np.log(v.get("ratio", (3 / 4, 4 / 3)))))
            w, h = min(width, max(1, round(np.sqrt(area * ratio)))), min(height, max(1, round(np.sqrt(area / ratio))))
            out[k] = (int(rng.integers(0, height - h + 1)), int(rng.integers(0, width - w + 1)), int(h), int(w))
        elif k == "random_horizontal_flip":
            out[k] = bool(rng.random() < v.get("p", 0.5))
        elif k == "rand_augment":
            if rng.random() < v.get("p", 1.0):
                out[k] = []
                for op in rng.integers(len(OPERATIONS), size=v.get("num_ops", 2)):
                    size, signed = magnitude(OPERATIONS[op], v.get("magnitude", 9), v.get("num_magnitude_bins", 31), rows, columns)
                    out[k].append((OPERATIONS[op], -size if signed and rng.random() < 0.5 else size))
        elif k == "random_erasing":
            if rng.random() < v.get("p", 0.5):
                out[k] = (-1, 0, 0, 0)  # no box fits
                for _ in range(10):
                    area, ratio = rows * columns * rng.uniform(*v.get("scale", (0.02, 0.33))), np.exp(rng.uniform(*np.log(v.get("ratio", (0.3, 3.3)))))
                    h, w = round(np.sqrt(area * ratio)), round(np.sqrt(area / ratio))
                    if h < rows and w < columns:
                        out[k] = (int(rng.integers(0, rows - h + 1)), int(rng.integers(0, columns - w + 1)), int(h), int(w))
                        break
        elif k in AFTER_COLLATE:
            a = v.get("alpha", 1.0)
            if a > 0 and rng.random() < v.get("p", 1.0):
                out[k] = float(rng.beta(a, a)) / v.get("div_by", 1.0)
                if k == "cutmix":
                    out[k] = (out[k], box(out[k], rows, columns, int(rng.integers(rows)), int(rng.integers(columns))))
    return out


def magnitude(op: str, bin_: int, bins: int, height: int, width: int) -> tuple[float, bool]:
    """An operation's strength in one of `bins` even steps of its range, and whether its sign is drawn."""
    share = bin_ / (bins - 1)
    if op in ("ShearX", "ShearY"):
        return 0.3 * share, True
    if op in ("TranslateX", "TranslateY"):
        return 150 / 331 * (width if op == "TranslateX" else height) * share, True
    if op == "Rotate":
        return 30 * share, True
    if op in ("Brightness", "Color", "Contrast", "Sharpness"):
        return 0.9 * share, True
    if op == "Posterize":  # bits kept
        return float(8 - round(bin_ / ((bins - 1) / 4))), False
    return (255 * (1 - share), False) if op == "Solarize" else (0.0, False)


def box(lam: float, height: int, width: int, i: int, j: int) -> tuple[int, int, int, int]:
    """Rows and columns (from, from, to, to) that cutmix replaces around (i, j)."""
    h, w = (int(n * np.sqrt(1 - lam)) // 2 for n in (height, width))
    return max(i - h, 0), max(j - w, 0), min(i + h, height), min(j + w, width)


def applied(image: np.ndarray, params: dict, config: dict[str, dict], other: np.ndarray | None = None) -> np.ndarray:
    """An image (height, width, channels; 0-255) with stored parameters applied; transforms that params lack are skipped.
    Magnitudes of rand_augment are in each operation's own unit, see magnitude(). random_erasing: first row, first
    column, height and width; a first row of -1 erases nothing. cutmix: (lambda, box)."""
    x = image
    for k, v in composed(config):
        p = params.get(k)
        if p is None:
            continue
        if k in ("random_resized_crop", "random_crop"):
            i, j, h, w = p if len(p) == 4 else (*p, v["size"], v["size"])
            x = x[i : i + h, j : j + w]
            if (size := v.get("size")) and k == "random_resized_crop":
                x = resized(x, size, size)
        elif k == "resize":
            scale = v["size"] / min(x.shape[:2])
            x = resized(x, round(x.shape[0] * scale), round(x.shape[1] * scale))
        elif k == "center_crop":
            i, j = round((x.shape[0] - v["size"]) / 2), round((x.shape[1] - v["size"]) / 2)
            x = x[i : i + v["size"], j : j + v["size"]]
        elif k == "random_horizontal_flip" and p:
            x = x[:, ::-1]
        elif k == "rand_augment":
            for op, mag in p:
                x = _operation(x, op, mag)
        elif k == "to_tensor":
            x = x / 255.0
        elif k == "uint8":
            x = (x * 255).astype(np.uint8)
        elif k == "normalize":
            x = (x - np.array(v["mean"])) / np.array(v["std"])
        elif k == "random_erasing" and p[0] >= 0:
            x = x.copy()
            x[p[0] : p[0] + p[2], p[1] : p[1] + p[3]] = 0
        elif k == "mixup" and other is not None:
            x = p * x + (1 - p) * other
        elif k == "cutmix" and other is not None:
            top, left, bottom, right = p[1]
            x = x.copy()
            x[top:bottom, left:right] = other[top:bottom, left:right]
    return x


def sampled(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The pixels that the given points (of the grid, from 0 at the edge) lie in; 0 outside."""
    i, j = np.floor(rows + 1e-9).astype(int), np.floor(columns + 1e-9).astype(int)
    inside = (i >= 0) & (i < x.shape[0]) & (j >= 0) & (j < x.shape[1])
    return np.where(inside[..., None], x[i.clip(0, x.shape[0] - 1), j.clip(0, x.shape[1] - 1)], 0).astype(x.dtype)


def equalized(channel: np.ndarray) -> np.ndarray:
    counts = np.bincount(channel.ravel(), minlength=256)
    step = (counts.sum() - counts[counts > 0][-1]) // 255
    if not step:
        return channel
    return ((np.cumsum(counts) - counts + step // 2) // step).clip(0, 255).astype(np.uint8)[channel]


def _operation(x: np.ndarray, op: str, mag: float) -> np.ndarray:
    if op == "Brightness":
        return np.clip(x * (1 + mag), 0, 255)
    if op == "Contrast":
        mean = (x @ GREY).mean() if x.shape[2] == 3 else x.mean()
        return np.clip((x - mean) * (1 + mag) + mean, 0, 255)
    if op == "Posterize":
        return x.astype(np.uint8) & np.uint8(256 - (1 << (8 - int(mag))) & 255)
    if op == "Solarize":
        return np.where(x >= mag, 255 - x, x)
    i, j = np.meshgrid(np.arange(x.shape[0]) + 0.5, np.arange(x.shape[1]) + 0.5, indexing="ij")
    if op == "ShearX":
        return sampled(x, i, j + mag * i)
    if op == "ShearY":
        return sampled(x, i + mag * j, j)
    if op == "TranslateX":
        return sampled(x, i, j - int(mag))
    if op == "TranslateY":
        return sampled(x, i - int(mag), j)
    if op == "Rotate":  # against the clock, in degrees
        c, s, di, dj = np.cos(np.radians(mag)), np.sin(np.radians(mag)), i - x.shape[0] / 2, j - x.shape[1] / 2
        return sampled(x, s * dj + c * di + x.shape[0] / 2, c * dj - s * di + x.shape[1] / 2)
    if op in ("Color", "Sharpness"):
        ratio = 1 + mag
        if op == "Color":
            plain = (x @ GREY)[..., None] if x.shape[2] == 3 else x
        else:
            plain = x.astype(np.float64)
            around = sum(plain[a : a + x.shape[0] - 2, b : b + x.shape[1] - 2] for a in range(3) for b in range(3))
            plain[1:-1, 1:-1] = (around + 4 * plain[1:-1, 1:-1]) / 13
        return np.clip(ratio * x + (1 - ratio) * plain, 0, 255)
    if op == "AutoContrast":
        lo, hi = x.min(axis=(0, 1)), x.max(axis=(0, 1)).astype(np.float64)
        return np.where(hi > lo, (x - lo) * (255 / np.where(hi > lo, hi - lo, 1)), x)
    if op == "Equalize":
        return np.stack([equalized(c) for c in np.moveaxis(np.clip(np.round(x), 0, 255).astype(np.uint8), 2, 0)], axis=2)
    if op != "Identity":
        raise ValueError(f"unknown operation {op}")
    return x


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, between the centres of pixels."""

    def along(a: np.ndarray, n: int, axis: int) -> np.ndarray:
        at = np.clip((np.arange(n) + 0.5) * a.shape[axis] / n - 0.5, 0, a.shape[axis] - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, a.shape[axis] - 1)
        w = (at - lo).reshape([-1 if d == axis else 1 for d in range(a.ndim)])
        return np.take(a, lo, axis) * (1 - w) + np.take(a, hi, axis) * w

    return along(along(x.astype(np.float64), height, 0), width, 1)


def preprocessed(image: np.ndarray, size: int) -> np.ndarray:
    """Resize the short side, crop the centre, scale to 0-1."""
    config = {"resize": {"size": size}, "center_crop": {"size": size}, "to_tensor": {}}
    return applied(image, {k: () for k in config}, config)
