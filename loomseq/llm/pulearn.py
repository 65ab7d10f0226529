"""Quality classifier learned from positives and unlabelled text.

Texts are described by shares of character-class pairs and by how words and lines repeat. The model is logistic over
these, and its weights minimise the non-negative unbiased risk: trusted positives stand for good text, all documents for
the mixture of good and bad, and the share of good ones among them (the class prior) is estimated. No negative label is
read. Risk, gradient and curvature are sums over the whole table that Spark's tasks add up, so a Newton step is one
pass, and no sample is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, written

#: Classes of bytes: lower case, upper case, digits, blank, line end, sentence marks, other marks, beyond ASCII, control.
_CLASS = np.full(256, 8, np.uint8)
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3), (b"\n\r", 4), (b".,;:?'\"()-", 5), (b"!#$%&*+/<=>@[\\]^_`{|}~", 6)):
    _CLASS[list(_chars)] = _c
_CLASS[128:] = 7
_TABLE = _CLASS.tobytes()
CLASSES, OTHERS = 9, 8
BASE = CLASSES * CLASSES + OTHERS
#: Each description enters as it is (under a square root), and up to these shares only.
STEPS = (0.02, 0.2)
WIDTH = 1 + BASE * (1 + len(STEPS))
#: Weight decay, what is added to it for n positives, divided by n, since few of them scatter; Newton steps for each
#: estimate of the prior, the step size at which they end, and estimates of the prior.
L2, SCATTER, ROUNDS, STILL, PRIORS = 0.1, 200.0, 12, 1e-3, 2
#: Bins of scores from which the prior is estimated, their range, and the chance that its bound fails.
BINS, REACH, DELTA = 4000, 20.0, 0.1


def describe(text: str | None) -> np.ndarray:
    """Shares from 0 to 1: pairs of character classes, then repetition and make-up of words and lines, and length."""
    raw = (text or "").encode()
    out = np.zeros(BASE, np.float32)
    words = raw.split()
    if not words:
        return out
    of = np.frombuffer(raw.translate(_TABLE), np.uint8)
    out[: CLASSES * CLASSES] = np.bincount(of[:-1] * CLASSES + of[1:], minlength=CLASSES * CLASSES) / len(raw)
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[CLASSES * CLASSES :] = (
        len(set(words)) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        1 - len(set(zip(words, islice(words, 1, None), strict=False))) / max(1, n - 1),
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, sum(map(len, words)) / n / 20),
        min(1.0, np.log1p(n / len(lines)) / 8),
        min(1.0, np.log1p(n) / 16),
    )
    return out


def inputs(base: np.ndarray) -> np.ndarray:
    """The model's inputs: 1, then every share as it is and cut off at each step."""
    return np.concatenate([np.ones((len(base), 1)), np.sqrt(base), *[np.minimum(base / s, 1) for s in STEPS]], axis=1)


def _read(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return inputs(np.frombuffer(b"".join(batch.column(column).to_pylist()), np.float32).reshape(-1, BASE).astype(float))


#: Tasks whose sums the driver adds up itself; those of more are added in about as many tasks as their root first.
TASKS = 256


def _sums(table: DataFrame, width: int, of) -> np.ndarray:
    """The sum over the table of what `of` makes of each batch: as many numbers as `width` from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                total += of(_read(part, 0), part.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = table.select("base", "positive").mapInArrow(run, "sums binary")
    tasks = parts.rdd.getNumPartitions()
    if tasks > TASKS:
        parts = parts.repartition(int(tasks**0.5)).mapInArrow(add, "sums binary")
    total = np.zeros(width)
    for r in parts.toLocalIterator():
        total += np.frombuffer(r["sums"])
    return total


def risk(g: np.ndarray, n_u: float, n_p: float, prior: float, positive: np.ndarray) -> tuple[float, float]:
    """(risk of positives, risk of negatives) of scores under the logistic loss; the second may come out below 0."""
    loss = lambda z: np.logaddexp(0, -z).sum()
    return prior * loss(g[positive]) / n_p, loss(-g) / n_u - prior * loss(-g[positive]) / n_p


def fit(table: DataFrame, prior: float, w: np.ndarray, scale: tuple[np.ndarray, np.ndarray], n_u: int, n_p: int) -> np.ndarray:
    """Weights of least non-negative risk, by Newton steps from `w`; a step into negative estimated risk is halved.

    Where the estimated risk of negatives is above 0 the non-negative risk is the unbiased one, which is convex; at 0 it
    has no lower value further on, so the steps stay on this side.
    """
    mean, sd = scale

    def at(w: np.ndarray):
        def of(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            x = (x - mean) / sd
            g = x @ w
            s = 1 / (1 + np.exp(-g))
            gradient = x.T @ s / n_u - prior * x[positive].sum(0) / n_p
            curve = (x * (s * (1 - s))[:, None]).T @ x / n_u
            return np.concatenate([risk(g, n_u, n_p, prior, positive), gradient, curve.ravel()])

        total = _sums(table, 2 + WIDTH + WIDTH * WIDTH, of)
        decay = np.r_[0.0, np.full(WIDTH - 1, L2 + SCATTER / n_p)]
        return total[0] + max(0.0, total[1]) + (decay * w * w).sum() / 2, total[1], total[2 : 2 + WIDTH] + decay * w, total[2 + WIDTH :].reshape(WIDTH, WIDTH) + np.diag(decay + 1e-9)

    value, _, gradient, curve = at(w)
    step = -np.linalg.solve(curve, gradient)
    for _ in range(ROUNDS):
        new = at(w + step)
        if new[0] > value + 1e-12 or new[1] < 0:
            step = step / 2
        else:
            w, value = w + step, new[0]
            step = -np.linalg.solve(new[3], new[2])
        if np.abs(step).max() < STILL:
            break
    return w


def estimate_prior(of_all: np.ndarray, of_positive: np.ndarray) -> float:
    """The share of positives among all documents from histograms of scores, lowest bin first.

    For every threshold the share of all documents above it, over that of positives, is no less than the prior, and equal
    where only positives score so high. The threshold is the one of the least upper confidence bound.
    """
    n_u, n_p = of_all.sum(), of_positive.sum()
    u, p = (np.cumsum(x[::-1]) / x.sum() for x in (of_all, of_positive))
    slack = np.sqrt(np.log(4 / DELTA) / 2 / n_u) + np.sqrt(np.log(4 / DELTA) / 2 / n_p)
    ok = p > 0
    bound = np.where(ok, (u + slack) / np.where(ok, p, 1), np.inf)
    i = int(np.argmin(bound))
    return float(np.clip(u[i] / p[i], 0.01, 0.99))


def train(table: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], float] | None:
    """Weights, scale and prior from a table of base (binary), positive and other_half (boolean); None without positives.

    The prior is estimated on the half of the table that the weights behind it were not learned from: there, positives
    don't score higher for having been learned.
    """
    total = _sums(table, 2 + 2 * WIDTH, lambda x, positive: np.concatenate([[len(x), positive.sum()], x.sum(0), (x * x).sum(0)]))
    n_u, n_p = int(total[0]), int(total[1])
    if not n_p:
        return None
    mean = total[2 : 2 + WIDTH] / n_u
    sd = np.sqrt(np.maximum(0, total[2 + WIDTH :] / n_u - mean * mean))
    # an input that doesn't vary says nothing; the first is always 1
    scale = np.r_[0.0, mean[1:]], np.r_[1.0, np.where(sd[1:] > 1e-6, sd[1:], np.inf)]
    w, prior = np.zeros(WIDTH), 0.5
    half, other = table.where("not other_half"), table.where("other_half")
    n_half = _sums(half, 2, lambda x, positive: np.array([len(x), positive.sum()], float))
    for _ in range(PRIORS if 0 < n_half[1] < n_p else 0):
        w = fit(half, prior, w, scale, int(n_half[0]), int(n_half[1]))

        def bins(x: np.ndarray, positive: np.ndarray, w=w) -> np.ndarray:
            g = (x - scale[0]) / scale[1] @ w
            place = ((np.clip(g, -REACH, REACH) + REACH) / (2 * REACH) * (BINS - 1)).astype(int)
            return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place[positive], minlength=BINS)])

        hist = _sums(other, 2 * BINS, bins)
        prior = estimate_prior(hist[:BINS], hist[BINS:])
    return fit(table, prior, w, scale, n_u, n_p), scale, prior


def classify(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, score (0 to 1, higher is better), predicted (1 from 0.5 on).

    `positives` has the ids of trusted documents in a column of that name; every row of `docs` counts as unlabelled.
    Null, empty and blank texts are described by zeros and scored like any other; rows that repeat are scored alike.
    Null ids are never positive. Without positives every score is 0.5. An empty table gives no rows; other columns are
    ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([describe(t).tobytes() for t in texts], pa.binary())], ["doc_id", "base"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, base binary")
    trusted = positives.select(F.col(id_col).cast(kind).alias("trusted")).distinct()
    table = written(rows.join(trusted, F.col("doc_id") == F.col("trusted"), "left").select("doc_id", "base", F.col("trusted").isNotNull().alias("positive"), (F.xxhash64("base") % 2 != 0).alias("other_half")), "described")
    model = train(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                s = np.full(len(batch), 0.5)
            else:
                w, (mean, sd), _ = model
                s = np.concatenate([np.zeros(0), *[1 / (1 + np.exp(-((_read(batch.slice(a, 4096), 1) - mean) / sd @ w))) for a in range(0, len(batch), 4096)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return table.select("doc_id", "base").mapInArrow(score, f"doc_id {kind}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Whether the labels of a row are kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    out = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
