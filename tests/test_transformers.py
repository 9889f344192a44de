"""Transformer encoders against plain loops over places, heads and pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import encoders, transformers


def plain_norm(v, scale, shift):
    mean = sum(v) / len(v)
    spread = math.sqrt(sum((x - mean) ** 2 for x in v) / len(v) + 1e-5)
    return [(x - mean) / spread * a + b for x, a, b in zip(v, scale, shift, strict=True)]


def plain_layer(v, w, name):
    return [sum(x * row[j] for x, row in zip(v, w[name], strict=True)) + w[f"{name}.bias"][j] for j in range(w[name].shape[1])]


def plain_gelu(x):
    return x * (1 + math.erf(x / math.sqrt(2))) / 2


def plain_blocks(rows, w, heads, seen):
    """seen(i, j): whether place i attends to place j."""
    for b, many in enumerate(heads):
        dim = len(rows[0])
        size = dim // many
        qkv = [plain_layer(plain_norm(r, w[f"{b}.norm1.scale"], w[f"{b}.norm1.shift"]), w, f"{b}.qkv") for r in rows]
        met = []
        for i in range(len(rows)):
            out = []
            for h in range(many):
                at = lambda j, part, h=h: qkv[j][part * dim + h * size : part * dim + (h + 1) * size]  # noqa: B023, E731
                score = {j: math.exp(sum(x * y for x, y in zip(at(i, 0), at(j, 1), strict=True)) / math.sqrt(size)) for j in range(len(rows)) if seen(i, j)}
                out += [sum(s * at(j, 2)[d] for j, s in score.items()) / sum(score.values()) for d in range(size)]
            met.append(out)
        rows = [[x + y for x, y in zip(r, plain_layer(m, w, f"{b}.out"), strict=True)] for r, m in zip(rows, met, strict=True)]
        grown = [plain_layer([plain_gelu(x) for x in plain_layer(plain_norm(r, w[f"{b}.norm2.scale"], w[f"{b}.norm2.shift"]), w, f"{b}.up")], w, f"{b}.down") for r in rows]
        rows = [[x + y for x, y in zip(r, g, strict=True)] for r, g in zip(rows, grown, strict=True)]
    return [plain_norm(r, w["final.scale"], w["final.shift"]) for r in rows]


IDS = [[1, 5, 9, 0, 0], [9, 3, 2, 9, 1], [4, 4, 4, 4, 9]]


@pytest.mark.parametrize("causal", [True, False])
def test_text_encoder(causal):
    w = transformers.drawn(8, 2, 3, seed=1, vocabulary=10, places=5)
    got = transformers.text_encoder(w, [2, 4], causal=causal, pad=0)(np.array(IDS))
    for ids, vector in zip(IDS, got, strict=True):
        seen = (lambda i, j: j <= i) if causal else (lambda i, j, ids=ids: ids[j] != 0)
        rows = plain_blocks([[*(w["tokens"][t] + w["positions"][i])] for i, t in enumerate(ids)], w, [2, 4], seen)
        assert np.allclose(vector, rows[ids.index(max(ids))] @ w["projection"], atol=1e-5)


def test_text_encoder_options():
    w = transformers.drawn(8, 1, 3, vocabulary=10, places=7)
    every = transformers.text_encoder(w, [2], all_tokens=True)(np.array(IDS))
    assert every.shape == (3, 5, 8)  # seven positions resized to a context of five
    later = [ids[: ids.index(9) + 1] + [2] * (4 - ids.index(9)) for ids in IDS]
    run = transformers.text_encoder(w, [2])
    assert np.allclose(run(np.array(IDS)), run(np.array(later)))  # nothing behind the end mark is seen


def test_image_encoder():
    w = transformers.drawn(8, 2, 3, seed=2, places=4, stem=(2, 2))
    images = np.random.default_rng(0).random((2, 9, 8, 3))  # the ninth row fills no kernel
    got = transformers.image_encoder(w, [2, 2])(images)

    def conv(x, j):
        kernel = w[f"stem.{j}"]
        return [[[sum(x[r * 2 + a][c * 2 + b][i] * kernel[a, b, i, o] for a in range(2) for b in range(2) for i in range(kernel.shape[2])) + w[f"stem.{j}.bias"][o] for o in range(kernel.shape[3])] for c in range(len(x[0]) // 2)] for r in range(len(x) // 2)]

    for image, vector in zip(images, got, strict=True):
        first = [[[plain_gelu(v) for v in cell] for cell in row] for row in conv(image.tolist(), 0)]
        cells = [cell for row in conv(first, 1) for cell in row]
        rows = [[*w["class"]]] + [[x + y for x, y in zip(c, p, strict=True)] for c, p in zip(cells, w["positions"], strict=True)]
        assert np.allclose(vector, np.array(plain_blocks(rows, w, [2, 2], lambda i, j: True)[0]) @ w["projection"], atol=1e-5)


def test_encoders_over_columns(spark, tmp_path):
    w = transformers.drawn(8, 1, 4, seed=3, vocabulary=10, places=5)
    np.savez(tmp_path / "w.npz", **w)
    encoders.register("drawn-text", transformers.from_file(str(tmp_path / "w.npz"), transformers.text_encoder, [2]))
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate(IDS)], "id int, ids array<int>")
    got = [r["v"] for r in df.select("id", encoders.encode("drawn-text", F.col("ids"), input_shape=[5]).alias("v")).orderBy("id").collect()]
    want = transformers.text_encoder(w, [2])(np.array(IDS))
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-5)
