"""Transformer encoders of tokens and images as batch functions (U1, U4, U6, and the attention block of U5).

A model is a dictionary of arrays, which from_file() reads once a worker, so weights of any size travel as a file and not
in a plan. Names: "tokens", "positions", "projection" [in, out], "final.scale", "final.shift"; for block i
"<i>.norm1.scale", "<i>.norm1.shift", "<i>.qkv" [dim, 3 * dim], "<i>.qkv.bias", "<i>.out", "<i>.out.bias", "<i>.norm2.scale",
"<i>.norm2.shift", "<i>.up", "<i>.up.bias", "<i>.down", "<i>.down.bias"; for images also "stem.<j>"
[rows, columns, in, out], "stem.<j>.bias" (a norm behind it being folded into both) and "class".
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from vecloom.functions.arrays import attention, resize_positions

Weights = dict[str, np.ndarray]
Predict = Callable[[np.ndarray], np.ndarray]


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - series * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * (1 + erf(x / math.sqrt(2))) / 2


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + eps) * scale + shift


def blocks(x: np.ndarray, w: Weights, heads: Sequence[int], mask: np.ndarray | None = None, padding: np.ndarray | None = None) -> np.ndarray:
    """x [batch, places, dim] through one block for each of heads, then the final norm. A block adds attention over the
    normed places, then two layers with a GELU between them over the normed sum."""
    n, places, dim = x.shape
    hidden = None if padding is None else padding[:, None, :]
    for i, many in enumerate(heads):
        normed = layer_norm(x, w[f"{i}.norm1.scale"], w[f"{i}.norm1.shift"])
        split = (normed @ w[f"{i}.qkv"] + w[f"{i}.qkv.bias"]).reshape(n, places, 3, many, dim // many)
        q, k, v = np.moveaxis(split, (2, 3), (0, 2))
        met = np.moveaxis(attention(q, k, v, mask, hidden), 1, 2).reshape(n, places, dim)
        x = x + met @ w[f"{i}.out"] + w[f"{i}.out.bias"]
        normed = layer_norm(x, w[f"{i}.norm2.scale"], w[f"{i}.norm2.shift"])
        x = x + gelu(normed @ w[f"{i}.up"] + w[f"{i}.up.bias"]) @ w[f"{i}.down"] + w[f"{i}.down.bias"]
    return layer_norm(x, w["final.scale"], w["final.shift"])


def text_encoder(w: Weights, heads: Sequence[int], causal: bool = True, pad: int | None = None, all_tokens: bool = False) -> Predict:
    """From token ids [batch, context] to vectors: the place of the greatest id (the end mark; the first of equal ones),
    projected; or, with all_tokens, every place, not projected. Positions are resized to the context. Without a causal
    mask, places of the id `pad` are not attended to."""

    def predict(ids: np.ndarray) -> np.ndarray:
        ids = np.asarray(ids).astype(np.int64)
        context = ids.shape[1]
        x = w["tokens"][ids] + resize_positions(w["positions"], context)
        mask = np.triu(np.full((context, context), -np.inf), 1) if causal else None
        x = blocks(x, w, heads, mask, None if causal or pad is None else ids == pad)
        return x if all_tokens else x[np.arange(len(ids)), ids.argmax(axis=1)] @ w["projection"]

    return predict


def patches(x: np.ndarray, w: Weights) -> np.ndarray:
    """Images [batch, rows, columns, channels] through the stem: convolutions whose steps are as wide as their kernels,
    with a GELU behind all but the last. Gives [batch, places, dim], by rows; an edge that fills no kernel is left out."""
    many = sum(k.startswith("stem.") and not k.endswith(".bias") for k in w)
    for j in range(many):
        kernel = w[f"stem.{j}"]
        a, b, into, out = kernel.shape
        n, rows, columns = x.shape[0], x.shape[1] // a, x.shape[2] // b
        tiles = x[:, : rows * a, : columns * b].reshape(n, rows, a, columns, b, into).transpose(0, 1, 3, 2, 4, 5)
        x = tiles.reshape(n, rows, columns, -1) @ kernel.reshape(-1, out) + w[f"stem.{j}.bias"]
        if j + 1 < many:
            x = gelu(x)
    return x.reshape(len(x), -1, x.shape[-1])


def image_encoder(w: Weights, heads: Sequence[int]) -> Predict:
    """From images [batch, rows, columns, channels] to vectors: a class place before the patches, which alone have
    positions; what the blocks make of it, projected."""

    def predict(images: np.ndarray) -> np.ndarray:
        x = patches(np.asarray(images, np.float64), w)
        x = x + resize_positions(w["positions"], x.shape[1])
        x = np.concatenate([np.broadcast_to(w["class"], (len(x), 1, x.shape[-1])), x], axis=1)
        return blocks(x, w, heads)[:, 0] @ w["projection"]

    return predict


def from_file(path: str, make: Callable[..., Predict], *args: object, **kwargs: object) -> Callable[[], Predict]:
    """For encoders.register: make (text_encoder or image_encoder) with the arrays of an .npz file, read on the worker."""

    def build() -> Predict:
        with np.load(path) as arrays:
            return make({k: arrays[k] for k in arrays.files}, *args, **kwargs)

    return build


def drawn(dim: int, layers: int, out: int, seed: int = 0, wide: float = 4.0, vocabulary: int = 0, places: int = 0, stem: Sequence[int] = (), channels: int = 3) -> Weights:
    """Untrained weights of the right shapes. The inner layers have wide * dim units, rounded up to a multiple of 16; stem
    gives the kernels of an image model."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.standard_normal(shape) / math.sqrt(math.prod(shape[:-1]) or 1)
    inner = math.ceil(dim * wide / 16) * 16
    w = {"positions": normal(places, dim), "projection": normal(dim, out), "final.scale": np.ones(dim), "final.shift": np.zeros(dim)}
    if vocabulary:
        w["tokens"] = rng.standard_normal((vocabulary, dim))
    for j, size in enumerate(stem):
        into, to = channels if j == 0 else max(32, dim // 4), dim if j + 1 == len(stem) else max(32, dim // 4)
        w |= {f"stem.{j}": normal(size, size, into, to), f"stem.{j}.bias": normal(to)}
    if stem:
        w["class"] = normal(dim)
    for i in range(layers):
        for k in (1, 2):
            w |= {f"{i}.norm{k}.scale": 1 + normal(dim) / 10, f"{i}.norm{k}.shift": normal(dim) / 10}
        for name, a, b in (("qkv", dim, 3 * dim), ("out", dim, dim), ("up", dim, inner), ("down", inner, dim)):
            w |= {f"{i}.{name}": normal(a, b), f"{i}.{name}.bias": normal(b) / 10}
    return w
