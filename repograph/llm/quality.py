"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, under a linear hinge-loss model.

Features are indicators of hashed n-grams of a text: characters (1 to 4 bytes) and word shapes
(1 to 3 words; a shape keeps the kind of characters in a row, and whether the word repeats the one
before).  Each indicator is scaled by the log ratio of its class counts; a hinge-loss linear model
is fitted to the scaled indicators by dual coordinate descent, and its margins are turned into
probabilities by a logistic fit.  Scores depend on the text alone.

The model is fitted on at most ``sample`` labelled rows (a documented bound: the rows of the
smallest hash of the id); only their hashed features come to the driver.  Scoring covers all rows.

Defined results: a null text is empty and is scored like one (bias alone); null labels and labels
of unknown documents are ignored; an id that repeats among the labels counts once for each
(label, document) pair; without labels, or with labels of one class only, every score is the share
of label 1 with one pseudo-count a class; repeated rows and null ids are scored like any others; a
table without rows gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import support

BITS = 18
SCORES = "doc_id long, score double"


# -- features -------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A multiply-and-shift mix of 64-bit keys."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


# Kinds of bytes: 0 space, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, and each other byte its own.
KIND = np.arange(256, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[ord("a") : ord("z") + 1] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[128:] = 4


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers below 2**bits."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.empty(0, np.int32)
    keys = []
    wide = raw.astype(np.uint64)
    gram = np.zeros(len(raw), np.uint64)
    for n in range(1, 5):
        if len(raw) < n:
            break
        gram = (gram[: len(raw) - n + 1] << np.uint64(8)) | wide[n - 1 :]
        keys.append(mixed(gram + np.uint64(n << 40)))
    kind = KIND[raw]
    space = kind == 0
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if len(start):
        end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        # A word's shape: its kinds of bytes without repeats.  Both hashes are sums over the word's bytes.
        fresh = np.r_[True, kind[1:] != kind[:-1]]
        fresh[start] = True
        run = np.cumsum(fresh)
        inside = np.minimum(run - run[start][np.searchsorted(start, np.arange(len(raw)), "right").clip(1) - 1], 6).astype(np.uint64)
        shape = np.where(fresh & ~space, mixed(kind.astype(np.uint64) + (inside << np.uint64(8)) + np.uint64(1 << 41)), np.uint64(0))
        place = np.arange(len(raw)) - start[np.searchsorted(start, np.arange(len(raw)), "right").clip(1) - 1]
        letters = np.where(space, np.uint64(0), mixed(wide + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1 << 42)))
        ends = np.stack([start, end], axis=1).ravel()
        pad = np.append(shape, np.uint64(0)), np.append(letters, np.uint64(0))
        shapes, words = (np.add.reduceat(x, ends)[::2] for x in pad)
        shapes = shapes + np.r_[False, words[1:] == words[:-1]].astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
        keys.append(mixed(shapes))
        for n in (2, 3):
            if len(shapes) >= n:
                joined = shapes[: len(shapes) - n + 1]
                for j in range(1, n):
                    joined = mixed(joined) + shapes[j : len(shapes) - n + 1 + j]
                keys.append(mixed(joined + np.uint64(n << 43)))
    seen = np.zeros(1 << bits, bool)
    for key in keys:
        seen[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(found: np.ndarray) -> bytes:
    """Sorted numbers by their steps, compressed to about a third."""
    return zlib.compress(np.diff(found, prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def unpacked(found: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(found), "<i4"), dtype=np.int32)


# -- model ----------------------------------------------------------------------------------


@dataclass
class Model:
    weights: np.ndarray | None  # of the indicators, the ratios multiplied in
    bias: float
    slope: float
    shift: float

    def score(self, rows: np.ndarray) -> float:
        if self.weights is None:
            return self.shift
        z = self.slope * (self.margin(rows)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def margin(self, rows: np.ndarray) -> float:
        return float(self.weights[rows].sum() / np.sqrt(max(1, len(rows))) + self.bias)


@dataclass
class Scaled(Sequence):
    """Each row's ratios over the root of their number, taken anew at each access: held for all rows they would be twice the rows."""

    rows: list[np.ndarray]
    ratios: np.ndarray

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i):
        return self.ratios[self.rows[i]] / np.sqrt(max(1, len(self.rows[i])))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, size), alpha)
    for row, label in zip(rows, labels):
        counts[int(label), row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1]) - np.log(counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], signs: np.ndarray, size: int, cost: np.ndarray, rounds: int = 30, tolerance: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum cost_i * max(0, 1 - y_i (w x_i + b)), a coordinate of the dual at a time; the bias is a feature of 1."""
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            own = values[i]
            gradient = signs[i] * (float(weights[rows[i]] @ own) + bias) - 1
            projected = min(gradient, 0) if alpha[i] <= 0 else max(gradient, 0) if alpha[i] >= cost[i] else gradient
            if abs(projected) > 1e-12:
                worst = max(worst, abs(projected))
                before = alpha[i]
                alpha[i] = min(max(before - gradient / norms[i], 0.0), cost[i])
                step = (alpha[i] - before) * signs[i]
                weights[rows[i]] += step * own
                bias += step
        if worst < tolerance:
            break
    return weights, bias


def logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps on targets that are kept off 0 and 1."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x, beta = np.stack([margins, np.ones(len(margins))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = 1.0) -> Model:
    labels = np.asarray(labels)
    positive = int(labels.sum())
    if not positive or positive == len(labels):
        return Model(None, 0.0, 0.0, (positive + 1) / (len(labels) + 2))
    size = 1 << bits
    ratios = log_count_ratios(rows, labels, size)
    signs = np.where(labels == 1, 1.0, -1.0)
    costs = np.where(labels == 1, cost * len(labels) / (2 * positive), cost * len(labels) / (2 * (len(labels) - positive)))
    weights, bias = dual_coordinate_descent(rows, Scaled(rows, ratios), signs, size, costs)
    model = Model(weights * ratios, bias, 1.0, 0.0)
    model.slope, model.shift = logistic(np.array([model.margin(r) for r in rows]), labels)
    return model


# -- columns --------------------------------------------------------------------------------


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 4000, bits: int = BITS) -> Model:
    """Fits on the labelled documents that are not held out, at most ``sample`` pairs of id and label.

    Of rows that repeat an id the one of the least text is taken, inside the plan, so at most ``sample`` rows of features, each
    of at most 2**bits numbers, come to the driver, packed.
    """
    support.ready(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def task(batches):
        for batch in batches:
            found = [packed(features(t.as_py(), bits)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    one_each = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = one_each.mapInArrow(task, "doc_id long, label int, found binary").toArrow()
    ids, marks = got["doc_id"].to_pylist(), got["label"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i]))  # a pair of both comes once
    rows = [unpacked(got["found"][i].as_py()) for i in order]
    del got
    return train(rows, np.array([marks[i] for i in order]), bits)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, bits: int = BITS, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id alone if not given) and behind them the score of each row as ``name``.

    A null text scores as an empty one; repeated rows and null ids keep their rows; a table without rows gives no rows; a
    column of ``keep`` that is called ``name`` raises an error.
    """
    spark = support.ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    if name in keep:
        raise ValueError(f"the documents have a column {name}")
    kept = docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")))
    schema = StructType([*kept.schema.fields[:-1], StructField(name, DoubleType())])
    kept = support.numbered(kept)

    def task(batches):
        for batch in batches:
            scores = pa.array([sent.value.score(features(t.as_py(), bits)) for t in batch.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], [*keep, name])

    return kept.mapInArrow(task, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs, fit(docs, labels, sample=sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
