"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (toxic), 1 (poor) or 2 (good); any number of grades works. All
grades share one weight per hashed text feature; ordered thresholds cut the score s:
``P(grade <= k) = sigmoid(threshold_k - s)``. A document gets its expected grade and the
probability of each grade or better; selection keeps those whose ``P(grade >= min_grade)``
reaches a cut.

The model is fitted on at most ``max_rows`` labelled rows (a documented bound: the rows with
the least hash of doc_id over the whole table of labels), so the fit is one task of bounded
size at any corpus size. Scoring is a narrow pass over every whole text.

Defined results: a null text counts as empty and has only the features of an empty text.
Labels with a null doc_id, quality or toxic, or without a document, are left out; repeated
labels count as often as they stand. Without any usable label, or with one grade only,
there is nothing to tell apart: all weights are 0, all documents are kept. Equal texts get
equal scores; extra columns are dropped by score() and kept by select().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GRAM_MULT, LOWER, U64, mix64, slices, span_hashes, unclash, word_spans

#: Weights: 2**BITS hashed features.
BITS = 18
#: Labelled rows for the fit, documents that must have a feature for it to get a weight, and the L2 penalty.
MAX_ROWS, LEAST_DOCS, PENALTY, ROUNDS = 20_000, 4, 1.0, 60
GRADES = 3


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, one row per document."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed features of each text.

    Lower-case words; each ASCII sign with the power of two of its count per 64 words; the
    shares of words equal to the word before and of distinct words, in tenths.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs)
    h = span_hashes(data, starts, ends)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    keys, at = [h], [rows]

    def add(kind: int, row: np.ndarray, value: np.ndarray) -> None:
        keys.append(mix64(value.astype(U64) * U64(GRAM_MULT) + U64(kind)))
        at.append(row)

    sign = np.flatnonzero((data > 32) & (data < 127) & ~((data >= 48) & (data < 58)) & ~((data >= 97) & (data < 123)))
    counts = np.bincount((np.searchsorted(offs, sign, "right") - 1) * 128 + data[sign], minlength=128 * len(n))
    hit = np.flatnonzero(counts)
    rate = np.log2(1 + 64 * counts[hit] / np.maximum(1, n[hit // 128])).astype(np.int64)
    add(1, hit // 128, (hit % 128) * 64 + rate)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    add(2, np.arange(len(n)), 10 * np.bincount(rows, same, len(n)) // np.maximum(1, n))
    order = np.lexsort((h, rows))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    add(3, np.arange(len(n)), 10 * np.bincount(rows[order], new, len(n)) // np.maximum(1, n))
    pairs = np.unique((np.concatenate(at).astype(U64) << U64(BITS)) | (np.concatenate(keys) >> U64(64 - BITS)))
    return (pairs >> U64(BITS)).astype(np.int64), (pairs & U64((1 << BITS) - 1)).astype(np.int64)


def loss(theta: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, dims: int, grades: int) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood and gradient; theta: weights, first threshold, logs of the gaps."""
    w, gaps = theta[:dims], np.exp(theta[dims + 1:])
    cuts = theta[dims] + np.concatenate([[0], np.cumsum(gaps)])
    s = np.bincount(row, w[col], len(grade))
    ends = np.concatenate([[-np.inf], cuts, [np.inf]])
    lo, hi = sigmoid(ends[grade] - s), sigmoid(ends[grade + 1] - s)
    p = np.maximum(hi - lo, 1e-12)
    value = -np.log(p).sum() + 0.5 * PENALTY * w @ w
    g = np.zeros_like(theta)
    g[:dims] = np.bincount(col, (1 - lo - hi)[row], dims) + PENALTY * w
    up = np.bincount(grade, -hi * (1 - hi) / p, grades)[:-1] + np.bincount(grade, lo * (1 - lo) / p, grades)[1:]
    later = np.cumsum(up[::-1])[::-1]
    g[dims] = later[0]
    g[dims + 1:] = later[1:] * gaps
    return float(value), g


def minimise(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y in reversed(steps):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.abs(g).max()))
        for (s, y), a in zip(steps, reversed(alphas)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, t = float(g @ d), 1.0
        if slope > -1e-9:
            break
        while t > 1e-6:
            new, ng = f(x + t * d)
            if new <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, ng - g
        done = value - new < 1e-6 * abs(value)
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, value, g = x + s, new, ng
        if done:
            break
    return x


def fit_arrays(row: np.ndarray, col: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> Model:
    """Fit on (row, bucket) pairs; grades that no row has get thresholds far out."""
    present = np.unique(grade)
    flat = Model(np.zeros(1 << BITS, np.float32), np.full(grades - 1, -1e3))
    if len(present) < 2:
        return flat
    used = np.flatnonzero(np.bincount(col, minlength=1 << BITS) >= LEAST_DOCS)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    level = np.searchsorted(present, grade)
    share = np.cumsum(np.bincount(level))[:-1] / len(level)
    cuts = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(len(used)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    x = minimise(lambda t: loss(t, row, col, level, len(used), len(present)), x, ROUNDS)
    flat.weights[used] = x[:len(used)]
    found = x[len(used)] + np.concatenate([[0], np.cumsum(np.exp(x[len(used) + 1:]))])
    # threshold k parts grades <= k from those above: the cut below the least present grade above k
    for k in range(grades - 1):
        above = np.searchsorted(present, k, "right")
        flat.thresholds[k] = -1e3 if above == 0 else 1e3 if above == len(present) else found[above - 1]
    return flat


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good."""
    rows = unclash(labels, ["doc_id", "quality", "toxic"]).where("doc_id is not null and quality is not null and toxic is not null")
    return rows.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2).alias("grade"))


def fit(docs: DataFrame, graded: DataFrame, max_rows: int = MAX_ROWS, grades: int = GRADES) -> Model:
    """Fit on at most max_rows rows of ``graded`` (doc_id, grade)."""
    sample = graded.select("doc_id", F.col("grade").cast("long").alias("grade")).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "grade").limit(max_rows)
    # at most max_rows rows of two numbers: a proven bound, so the texts needn't move
    rows = unclash(docs, ["doc_id", "text"]).join(F.broadcast(sample), "doc_id").select("grade", "text")

    def hashed(batches):
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                row, col = features(data, offs)
                cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(col.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["grade", "buckets"])

    def train(batches):
        grade, size, col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            lists = batch.column(1)
            cut = lists.offsets.to_numpy()
            grade.append(batch.column(0).to_numpy(zero_copy_only=False))
            size.append(np.diff(cut))
            col.append(lists.values.to_numpy()[cut[0]:cut[-1]])
        size = np.concatenate(size)
        m = fit_arrays(np.repeat(np.arange(len(size)), size), np.concatenate(col).astype(np.int64), np.concatenate(grade).astype(np.int64), grades)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.thresholds.tolist()])], names=["w", "t"])

    one = rows.mapInArrow(hashed, "grade long, buckets array<int>").repartition(1).mapInArrow(train, "w binary, t array<double>").first()
    if one is None:  # Spark finds the sample empty
        return Model(np.zeros(1 << BITS, np.float32), np.full(grades - 1, -1e3))
    return Model(np.frombuffer(bytes(one["w"]), np.float32), np.array(one["t"]))


def score(docs: DataFrame, model: Model, min_grade: int = 2, cut: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_ge_1 .., kept for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats
    n = len(model.thresholds)
    tails = [f"p_ge_{k + 1}" for k in range(n)]

    def run(batches):
        m = shared.value
        for batch in batches:
            for piece, p in scored(m, batch):
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(p.sum(axis=1)), *[pa.array(p[:, k]) for k in range(n)], pa.array(p[:, min_grade - 1] >= cut)],
                    names=["doc_id", "expected_grade", *tails, "kept"])

    rows = unclash(docs, ["doc_id", "text"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_grade double, {', '.join(f'{t} double' for t in tails)}, kept boolean")


def scored(m: Model, batch: pa.RecordBatch):
    """(rows, their tail probabilities) of each slice of the batch."""
    for piece, data, offs in slices(batch, "text"):
        row, col = features(data, offs)
        yield piece, m.tails(np.bincount(row, m.weights[col].astype(np.float64), piece.num_rows))


def select(docs: DataFrame, model: Model, min_grade: int = 2, cut: float = 0.5) -> DataFrame:
    """The documents that reach the cut, with all their columns: one narrow pass, no join back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece, p in scored(shared.value, batch):
                yield piece.filter(pa.array(p[:, min_grade - 1] >= cut))

    return docs.mapInArrow(run, docs.schema)


def op1_ordinal(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: fit on the labels, score every document."""
    return score(docs, fit(docs, grades_of(labels)))
