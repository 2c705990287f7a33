"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad.  A line's features are counts of its words beside
those of the lines before and after it; transitions tie neighbouring labels.  The
forward-backward marginals of the good label, weighted by line length, make the mean
quality of a document, and a calibration on training documents makes its score.

Training: a document's lines take its label.  The fit maximises the penalised conditional
likelihood on at most ``TRAIN_DOCS`` labelled documents (those of least hash of
their id), whose line features, not texts, are gathered on the driver.  All lines of these
documents count, each beside its true neighbours; the fit alone cuts chains into runs of
``TRAIN_RUN`` neighbouring lines, whose transitions it sums.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import fresh, map_blocks
from quillspark.llm.textstats import word_stats

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCS = 4000
#: Neighbouring lines that make one chain in the fit; scores use whole chains.
TRAIN_RUN = 128
PREDICT_FROM = 0.3
OWN = 13  # features of a line itself


def lines_of(text: bytes | None) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.strip()] if text else []


def line_features(lines: list[bytes]) -> np.ndarray:
    """(lines, OWN) features of each line by itself."""
    s = word_stats(lines, windows=False)
    n = np.maximum(s["n_words"], 1).astype(float)
    size = s["word_chars"] / n
    out = [
        np.minimum(s["n_symbols"] / n, 2),
        np.minimum(5 * s["n_symbols"] / n, 1),  # a few are telling already
        s["caps_words"] / n,
        np.where(n >= 5, np.minimum(3 * s["same_words"] / n, 1), 0),
        np.where(n >= 2, s["same_words"] / n, 0),
        s["plain_words"] / n,
        np.minimum(s["exclaims"] / n, 2),
        np.minimum(s["digits"] / np.maximum(s["word_chars"], 1), 1),
        s["ends"],
        np.where(n >= 5, s["distinct_words"] / n, 1),
        np.minimum(np.abs(size - 5) / 5, 3),
        np.log1p(n) / 5,
        n < 4,
    ]
    return np.stack([x.astype(np.float64) for x in out], 1) if len(lines) else np.zeros((0, OWN))


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after (zeros at the ends of a text), and 1."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if not own.shape[0]:
        return np.zeros((0, 3 * own.shape[1] + 1))
    before[1:], after[:-1] = own[:-1], own[1:]
    begins = first[:-1][np.diff(first) > 0]
    before[begins] = 0
    after[np.append(begins[1:], own.shape[0]) - 1] = 0
    return np.concatenate([own, before, after, np.ones((own.shape[0], 1))], 1)


def marginals(unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions (2, 2) over all texts.

    ``unary`` (lines, 2) and ``pair`` (2, 2) are log potentials.  Texts advance together,
    longest first, so a step handles the texts that still have a line there.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, size = first[:-1][order], sizes[order]
    longest = int(size[0]) if size.size else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # texts of more than t lines
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)
    for t in range(longest):
        at = begin[: alive[t]] + t
        if t:
            a = alpha[at - 1][:, :, None] + pair
            alpha[at] = unary[at] + np.logaddexp(a[:, 0], a[:, 1])
        else:
            alpha[at] = unary[at]
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        b = pair + (unary[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    joint = alpha + beta
    good = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))
    inner = np.ones(unary.shape[0], bool)
    inner[first[:-1][sizes > 0]] = False
    at = np.flatnonzero(inner)
    both = alpha[at - 1][:, :, None] + pair + (unary[at] + beta[at])[:, None, :]
    both -= both.max(axis=(1, 2), keepdims=True)
    p = np.exp(both)
    return good, (p / p.sum(axis=(1, 2), keepdims=True)).sum(0)


def _odds(mean: np.ndarray) -> np.ndarray:
    """Log odds of a mean marginal, finite at 0 and 1."""
    return np.log((mean + 0.02) / (1.02 - mean))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # (features,): log odds of good
    pair: np.ndarray  # (2, 2)
    slope: float
    shift: float

    def line_quality(self, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        odds = with_neighbours(own, first) @ self.weights
        return marginals(np.stack([np.zeros_like(odds), odds], 1), self.pair, first)[0]

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _odds(mean) + self.shift, -700, 700)))


def document_means(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each text; 0 for a text without lines."""
    total = np.concatenate([[0.0], np.cumsum(good * length)])
    weight = np.concatenate([[0.0], np.cumsum(length)])
    w = weight[first[1:]] - weight[first[:-1]]
    return np.clip((total[first[1:]] - total[first[:-1]]) / np.maximum(w, 1e-9), 0, 1)


def runs_of(first: np.ndarray, most: int = TRAIN_RUN) -> np.ndarray:
    """Where the runs of at most ``most`` neighbouring lines begin, and the end of the last."""
    begins = [np.arange(a, b, most) for a, b in zip(first[:-1], first[1:])]
    return np.concatenate([*begins, first[-1:]]).astype(np.int64)


def fit(own: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 300) -> Model:
    """Gradient ascent (Adam) on the conditional likelihood of runs, then a logistic calibration on whole documents."""
    x = with_neighbours(own, first)
    owner = np.repeat(np.arange(label.size), np.diff(first))
    y = label[owner].astype(float)
    runs = runs_of(first)
    inner = np.ones(x.shape[0], bool)
    inner[runs[:-1]] = False
    seen = np.array([[np.sum(inner & (y == 0)), 0], [0, np.sum(inner & (y == 1))]], float)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(x.shape[0], 1)
    for step in range(1, rounds + 1):
        odds = x @ theta[:-4]
        pair = theta[-4:].reshape(2, 2)
        good, moves = marginals(np.stack([np.zeros_like(odds), odds], 1), pair, runs)
        gradient = np.concatenate([x.T @ (y - good), (seen - moves).ravel()]) / n - 1e-3 * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy(), 1.0, 0.0)
    mean = document_means(model.line_quality(own, first), length, first)
    slope, shift = calibrate(_odds(mean), label)
    return Model(model.weights, model.pair, slope, shift)


def calibrate(odds: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic calibration by Newton's method with a small penalty that keeps the slope near 1."""
    x = np.stack([odds, np.ones_like(odds)], 1)
    theta, start, penalty = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.diag([1.0, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -700, 700)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (label - p) - penalty @ (theta - start))
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never trained on: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold."""
    known = labels.filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # its size is bounded by `most`
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("__t")).join(F.broadcast(known), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("__t").to_pylist():
            lines = lines_of(text)
            own = line_features(lines)
            length = np.array([len(x) for x in lines], float)
            rows.append(pickle.dumps((own.astype(np.float32), length.astype(np.float32))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "quality", "lines"])

    found = map_blocks(texts, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, lines binary", "__t").collect()
    found.sort(key=lambda r: (r["doc_id"], r["lines"]))
    kept = [(r["quality"], *pickle.loads(r["lines"])) for r in found]
    own = np.concatenate([np.zeros((0, OWN)), *(k[1].astype(float) for k in kept)])
    length = np.concatenate([np.zeros(0), *(k[2].astype(float) for k in kept)])
    first = np.concatenate([[0], np.cumsum([k[1].shape[0] for k in kept])]).astype(np.int64)
    return fit(own, length, first, np.array([k[0] for k in kept], float))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with the double column ``__score``, which replaces one of that name.

    Null, empty and blank texts have no line and score as a document of mean quality 0;
    equal texts score alike; an empty table gives no rows; ids and other columns, null or
    not, are carried and are no input of the score.
    """
    held = fresh(docs, "__t")
    carried = [c for c in docs.columns if c != "__score"]
    fields = [f for f in docs.schema.fields if f.name != "__score"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [lines_of(t) for t in batch.column(held).to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
        flat = [x for lines in split for x in lines]
        good = model.line_quality(line_features(flat), first)
        mean = document_means(good, np.array([len(x) for x in flat], float), first)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(model.score(mean))], names=[*carried, "__score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return map_blocks(docs.select(*carried, F.col(text_col).cast("binary").alias(held)), run, f"{kinds}__score double", held)


def keep_good(docs: DataFrame, model: Model, cut: float = PREDICT_FROM) -> DataFrame:
    """The input rows whose score is at least ``cut``."""
    return score(docs, model).filter(F.col("__score") >= cut).select(*docs.columns)
