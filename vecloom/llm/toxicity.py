"""Operator 6: toxicity by a chain of classifiers.

Features are the words of a text and their first four to six letters, present or not. The chain predicts the categories
in order, each by a linear model over the features that set its own labels apart and the probabilities of the categories
before it; in training these come from models that did not see the row (out of fold).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.shared import lean, table, written

#: The chain's categories in order, as conditions on the columns of labels. The last one is the verdict.
CATEGORIES = {"poor": "quality = 0", "toxic": "toxic = 1"}
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return {f"={w}" for w in words} | {w[:n] for w in words for n in (4, 5, 6) if len(w) > n}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Bits:
    """A matrix of zeros and ones, as the places of its ones by rows, and dense columns behind it."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int], dense: np.ndarray | None = None) -> None:
        self.row, self.column, self.shape = row, column, shape
        self.dense = np.zeros((shape[0], 0)) if dense is None else dense
        self.first = np.flatnonzero(np.diff(row, prepend=-1))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        out = self.dense @ w[self.shape[1] :]
        if len(self.first):
            out[self.row[self.first]] += np.add.reduceat(w[self.column], self.first)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        """Its transpose by r."""
        return np.concatenate([np.bincount(self.column, r[self.row], self.shape[1]), r @ self.dense])

    def having(self, *columns: np.ndarray) -> Bits:
        return Bits(self.row, self.column, self.shape, np.column_stack([self.dense, *columns]))

    def only(self, columns: np.ndarray) -> Bits:
        keep = np.zeros(self.shape[1], bool)
        keep[columns] = True
        keep = keep[self.column]
        return Bits(self.row[keep], self.column[keep], self.shape, self.dense)

    def rows(self, which: np.ndarray) -> Bits:
        keep, number = which[self.row], np.cumsum(which) - 1
        return Bits(number[self.row[keep]], self.column[keep], (int(which.sum()), self.shape[1]), self.dense[which])


def fit_linear(x: Bits, y: np.ndarray, rounds: int = 120, penalty: float = 1e-5) -> np.ndarray:
    """Logistic regression by accelerated gradient steps, rare labels weighing up to five times; the last weight is the
    constant. y: 0, 1, or NaN for rows without a label, which have no weight."""
    x = x.having(np.ones(x.shape[0]))
    w = v = np.zeros(x.shape[1] + x.dense.shape[1])
    told = np.isfinite(y)
    y, share = np.where(told, y, 0), float(y[told].mean()) if told.any() else 0.0
    weight = told * np.where(y > 0, np.clip((1 - share) / max(share, 1e-9), 1, 5), 1.0) / max(told.sum(), 1)
    top = np.ones(len(w))
    for _ in range(8):  # the largest curvature, by the power method
        top = x.back(weight * (x @ top))
        top /= (largest := float(np.linalg.norm(top))) or 1.0
    step = 4 / max(1.2 * largest, 1e-6)
    for t in range(rounds):
        g = x.back(weight * (sigmoid(x @ v) - y)) + penalty * v
        w, before = v - step * g, w
        v = w + t / (t + 3) * (w - before)
    return w


def predict(w: np.ndarray, x: Bits) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def fit_chain(x: Bits, labels: np.ndarray, uses: list[np.ndarray], folds: int = 5) -> list[np.ndarray]:
    """One model per column of labels over the columns of x that it uses and the chain before it; fold k holds the rows
    k, k + folds, ..."""
    fold, chain = np.arange(x.shape[0]) % folds, []
    for c in range(labels.shape[1]):
        y, seen, z = labels[:, c], np.zeros(x.shape[0]), x.only(uses[c])
        chain.append(fit_linear(z, y))
        if c + 1 < labels.shape[1]:
            for k in range(folds):
                if (fold == k).any() and (fold != k).any():
                    seen[fold == k] = predict(fit_linear(z.rows(fold != k), y[fold != k]), z.rows(fold == k))
            x = x.having(seen)
    return chain


def run_chain(chain: list[np.ndarray], x: Bits, uses: list[np.ndarray]) -> np.ndarray:
    for w, own in zip(chain, uses, strict=True):
        x = x.having(predict(w, x.only(own)))
    return x.dense


class Model:
    """The features that count, the categories' names, which features each uses, and their linear models in order."""

    def __init__(self, vocabulary: list[str], names: list[str], uses: list[np.ndarray], chain: list[np.ndarray]) -> None:
        self.place, self.names, self.uses, self.chain = {f: i for i, f in enumerate(vocabulary)}, names, uses, chain

    def places(self, text: str | None) -> list[int]:
        """The numbers of a text's features, in order, so that sums are the same everywhere."""
        return sorted(self.place[f] for f in self.place.keys() & features(text))

    def bits(self, places: list[list[int]]) -> Bits:
        row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        return Bits(row, np.array([i for p in places for i in p], np.int64), (len(places), len(self.place)))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return run_chain(self.chain, self.bits([*map(self.places, texts)]), self.uses) if self.chain else np.zeros((len(texts), len(self.names)))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = 6000, least: int = 3, apart: float = 3.0) -> Model:
    """A model from the labelled rows of docs (doc_id, text) and labels (doc_id and what categories name).

    categories: names and conditions on labels, in the chain's order (by default those of CATEGORIES
    whose column labels has). A condition that is null
    leaves the row out of that link's fit; labels without doc_id or verdict are left out. Of repeated labels of one
    doc_id the largest counts, of repeated texts the first in order. sample bounds the labelled rows (by hash of
    doc_id). A category uses features with `least` rows on either side and log odds `apart` standard errors from zero. If the sample's verdicts are all alike nothing is ever found toxic.
    """
    categories = categories or {name: told for name, told in CATEGORIES.items() if told.split()[0] in labels.columns}
    names = [*categories]
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(c).cast("int").alias(f"_{i}") for i, c in enumerate(categories.values())))
    told = told.where(f"doc_id IS NOT NULL AND _{len(names) - 1} IS NOT NULL").groupBy("doc_id").agg(*(F.max(f"_{i}").alias(f"_{i}") for i in range(len(names))))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = written(texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id"), "labelled")  # at most `sample` rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for whole in batches:
            for b in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                of = {(c, y): Counter() for c in range(len(names)) for y in (0, 1)}
                labels_ = [b.column(2 + c).to_pylist() for c in range(len(names))]
                for text, *ys in zip(b.column(1).to_pylist(), *labels_, strict=True):
                    found = features(text)
                    for c, y in enumerate(ys):
                        if y is not None:
                            of[c, y].update(found)
                for c in range(len(names)):
                    seen = [*{**of[c, 1], **of[c, 0]}]
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(seen), pa.int32()), pa.array(seen, pa.string()), pa.array([of[c, 1][f] for f in seen], pa.int64()), pa.array([of[c, 0][f] for f in seen], pa.int64())], names=["category", "feature", "yes", "no"])

    sums = rows.agg(*(f(F.col(f"_{i}") == y).alias(f"{i}{y}") for i in range(len(names)) for y, f in ((0, F.count_if), (1, F.count_if)))).first()
    last = len(names) - 1
    if not sums[f"{last}0"] or not sums[f"{last}1"]:
        return Model([], names, [], [])
    yes, no = (F.element_at(F.array(*(F.lit(sums[f"{i}{y}"] + 1.0) for i in range(len(names)))), F.col("category") + 1) for y in (1, 0))
    odds = F.log((F.col("yes") + 0.5) / yes * no / (F.col("no") + 0.5))
    error = F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    counted = rows.mapInArrow(count, "category int, feature string, yes long, no long").groupBy("category", "feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    best = counted.where((F.greatest("yes", "no") >= least) & (F.abs(odds) >= apart * error)).select("category", "feature").collect()  # features of the sample that pass
    shape = Model(sorted({r["feature"] for r in best}), names, [], [])
    uses = [np.array(sorted(shape.place[r["feature"]] for r in best if r["category"] == c), np.int64) for c in range(len(names))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            places = [np.array(shape.places(t), "<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.binary()), *b.columns[2:]], names=["doc_id", "places", *b.schema.names[2:]])

    fields = ", ".join(f"_{i} int" for i in range(len(names)))
    seen = rows.mapInArrow(look, f"doc_id long, places binary, {fields}").collect()  # at most `sample` rows of their features' numbers
    seen.sort(key=lambda r: r["doc_id"])
    x = shape.bits([np.frombuffer(r["places"], "<i4").tolist() for r in seen])
    y = np.array([[np.nan if r[f"_{i}"] is None else r[f"_{i}"] for i in range(len(names))] for r in seen], np.float64)
    return Model([*shape.place], names, uses, fit_chain(x, y, uses))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with a probability p_<category> (double) for each of the model's categories and is_toxic (the last one at
    least threshold).

    Null and empty texts have no features and get the constants' probabilities, like any text without known features.
    Rows are scored one by one, whole; equal texts alike. Columns of docs named like a result are replaced. No rows
    give no rows.
    """
    new = [f"p_{c}" for c in model.names]
    kept = docs.select(*(c for c in docs.columns if c not in [*new, "is_toxic"]))
    names = [*kept.columns, *new]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                p = model(part.column(at).cast(pa.string()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, i]) for i in range(len(new)))], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"{c} double" for c in new])
    return kept.mapInArrow(run, schema).withColumn("is_toxic", F.col(new[-1]) >= threshold)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {"op6_toxicity": toxicity}
SQL: dict[str, str] = {}
