"""Encoders as batch functions (U1, U8, U9): built once a worker, swappable by name, ensembles by commas."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import types as T

Predict = Callable[[np.ndarray], np.ndarray]
_REGISTRY: dict[str, Callable[[], Predict]] = {}


def register(name: str, build: Callable[[], Predict]) -> None:
    """build makes a function from a batch of inputs to a matrix; it is called once a worker."""
    _REGISTRY[name] = build


def hash_encoder(dim: int = 64, seed: int = 0) -> Callable[[], Predict]:
    """A stand-in for a neural encoder: the same input always has the same unit vector."""

    def build() -> Predict:
        def predict(x: np.ndarray) -> np.ndarray:
            out = np.empty((len(x), dim), np.float32)
            for i, v in enumerate(x):
                body = v.tobytes() if isinstance(v, np.ndarray) else str(v).encode()
                rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(body + bytes([seed]), digest_size=8).digest(), "little"))
                out[i] = rng.standard_normal(dim)
            return out

        return predict

    return build


register("hash64", hash_encoder())
register("hash32", hash_encoder(32, 1))


def encode(name: str, column: Column, normalize: bool = True, batch_size: int = 256, input_shape: list[int] | None = None) -> Column:
    """Vectors of a column by one encoder, or by several "a,b", joined end to end (each normalised if asked for)."""
    missing = [n for n in name.split(",") if n not in _REGISTRY]
    if missing:
        raise ValueError(f"unknown encoder {missing[0]!r}; known: {', '.join(sorted(_REGISTRY))}")
    builds = [_REGISTRY[n] for n in name.split(",")]

    def make() -> Predict:
        models = [b() for b in builds]

        def predict(x: np.ndarray) -> np.ndarray:
            outs = [m(x) for m in models]
            if normalize:
                outs = [o / np.maximum(np.linalg.norm(o, axis=1, keepdims=True), 1e-12) for o in outs]
            return np.hstack(outs).astype(np.float32)

        return predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[input_shape] if input_shape else None)(column)


def size_of(name: str, sizes: dict[str, int]) -> int:
    """The input size of an image encoder: 256, or 224 for those listed."""
    return sizes.get(name, 256)
