"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has a label, good or bad; features are statistics of the line and of the lines before and after it.  Fitting
gives every line the label of its document (a bounded sample of labelled documents).  The marginals of all lines from
the forward-backward recursion, weighted by line length, give the quality of a document, which a logistic function of
two parameters maps to the probability of label 1.  Recursions run over all documents of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats as T
from .sampling import bounded_sample
from .words import Words, mix, scan, slices

SAMPLE = 4000
#: Fitting takes runs of at most so many lines; a longer document gives FIT_RUNS of its runs, evenly spaced.
FIT_LINES = 128
FIT_RUNS = 2
N_LINE = 11


def line_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that have a word, their lengths in characters, and each document's first line."""
    edges, _ = T.lines(words)
    line = np.searchsorted(edges, words.start, "right") - 1
    total = len(edges) - 1
    n = np.bincount(line, minlength=total)
    of = lambda t: T.tally(words.data, edges, t)
    chars, upper, lower = of(T.IS_WORD_CHAR), of(T.IS_UPPER), of(T.IS_LOWER)
    repeat = np.bincount(line, T.repeated_words(words), total)
    doc = np.searchsorted(words.offsets, edges[:-1], "right") - 1
    body = np.zeros(total, np.uint64)
    np.add.at(body, line, mix(words.hash + (np.arange(len(line)) - np.searchsorted(line, line)).astype(np.uint64)))
    codes, _ = pd.factorize(mix(body + doc.astype(np.uint64)))
    twice = np.bincount(codes)[codes] > 1 if total else np.zeros(0, bool)
    x = np.stack(
        [
            np.log1p(chars), np.log1p(n), T.share(chars, n), T.share(of(T.IS_SYMBOL), chars), T.share(upper, upper + lower), T.share(of(T.IS_DIGIT), chars),
            T.share(of(T.IS_POINT), chars), T.share(of(T.IS_SHOUT), chars), T.share(repeat, n), twice, n < 4,
        ],
        axis=1,
    ).astype(float)
    full = n > 0
    return x[full], chars[full].astype(float), np.searchsorted(doc[full], np.arange(len(words.first)))


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of its neighbours in the document (0 where there is none), ends, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    some = first[1:] > first[:-1]
    head, tail = first[:-1][some], first[1:][some] - 1
    before[head], after[tail] = 0, 0
    ends = np.zeros((len(x), 2))
    ends[head, 0], ends[tail, 1] = 1, 1
    return np.concatenate((x, before, after, ends, np.ones((len(x), 1))), axis=1)


def forward_backward(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for all lines, and the expected label pairs of each document (documents x 2 x 2).

    ``unary`` is the score of label 1 over label 0; the documents are run side by side, the longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    docs, longest = len(order), int(size.max()) if len(size) else 0
    alive = np.searchsorted(-size[order], -np.arange(longest), "left")  # documents with more than t lines
    start = first[:-1][order]
    a, b = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    u = np.stack((np.zeros(len(unary)), unary), axis=1)
    for t in range(longest):
        at = start[: alive[t]] + t
        if t == 0:
            a[at] = u[at]
        else:
            z = a[at - 1][:, :, None] + trans
            a[at] = np.logaddexp(z[:, 0], z[:, 1]) + u[at]
        a[at] -= a[at].max(axis=1, keepdims=True)
    pair = np.zeros((len(size), 2, 2))
    for t in range(longest - 1, 0, -1):
        at = start[: alive[t]] + t
        z = trans + (u[at] + b[at])[:, None, :]
        joint = a[at - 1][:, :, None] + z
        e = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pair[order[: alive[t]]] += e / e.sum(axis=(1, 2), keepdims=True)
        back = np.logaddexp(z[:, :, 0], z[:, :, 1])
        b[at - 1] = back - back.max(axis=1, keepdims=True)
    s = a + b
    return 1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -500, 500))), pair


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float
    prior: float

    def quality(self, x: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted means of the line marginals; NaN for documents without a line."""
        unary = with_neighbours((x - self.mean) / self.scale, first) @ self.weights
        p, _ = forward_backward(unary, first, self.trans)
        some = first[1:] > first[:-1]
        out = np.full(len(first) - 1, np.nan)
        out[some] = np.add.reduceat(p * chars, first[:-1][some]) / np.add.reduceat(chars, first[:-1][some]) if some.any() else 0
        return out

    def score(self, x: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        q = self.quality(x, chars, first)
        z = self.slope * _logit(np.nan_to_num(q, nan=0.5)) + self.shift
        return np.where(np.isnan(q), self.prior, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(x: np.ndarray, chars: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.05, penalty: float = 1e-3) -> Model:
    """Maximum likelihood with every line labelled as its document; a document counts once, however many lines it has."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    rows = with_neighbours((x - mean) / scale, first)
    size = np.diff(first)
    y = np.repeat(label, size).astype(float)
    each = np.repeat(1 / np.maximum(size, 1), size) / len(size)
    seen = np.zeros((len(size), 2, 2))
    seen[np.arange(len(size)), label.astype(int), label.astype(int)] = np.maximum(size - 1, 0)
    theta = np.zeros(rows.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        p, pair = forward_backward(rows @ w, first, trans)
        g = np.r_[rows.T @ ((y - p) * each), ((seen - pair) / np.maximum(size, 1)[:, None, None]).sum(axis=0).ravel() / len(size)] - penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    prior = (label.sum() + 1) / (len(label) + 2)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0, float(prior))
    z = _logit(model.quality(x, chars, first))
    a = np.stack((z, np.ones(len(z))), axis=1)
    k = np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps with a small ridge towards (1, 0)
        p = 1 / (1 + np.exp(-np.clip(a @ k, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        k = k + np.linalg.solve(h, a.T @ (label - p) - 0.1 * (k - np.array([1.0, 0.0])))
    model.slope, model.shift = float(max(k[0], 1e-3)), float(k[1])
    return model


def _runs(n: int, most: int) -> list[tuple[int, int]]:
    """Ranges of a document's n lines to fit on."""
    count = -(-n // most)
    chosen = range(count) if count <= FIT_RUNS else [round(i * (count - 1) / (FIT_RUNS - 1)) for i in range(FIT_RUNS)]
    return [(i * most, min(n, (i + 1) * most)) for i in chosen]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_lines: int = FIT_LINES) -> Model | None:
    """A model from (doc_id, text) and (doc_id, label): about ``most`` labelled documents, in runs of up to ``most_lines``
    lines, so no document is too long to be learned from."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    marks = bounded_sample(known, "doc_id", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x, chars, first = line_features(scan(b.column("text")))
            cut = [(d, first[d] + lo, first[d] + hi) for d, n in enumerate(np.diff(first)) for lo, hi in _runs(int(n), most_lines)]
            rows = [(x[lo:hi].tobytes(), chars[lo:hi].tobytes()) for _, lo, hi in cut]
            yield pa.RecordBatch.from_arrays([b.column("label").take(pa.array([d for d, _, _ in cut], pa.int64())), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], ["label", "x", "chars"])

    sample = docs.join(F.broadcast(marks), "doc_id").select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "label int, x binary, chars binary").toPandas()
    if sample.empty or sample["label"].nunique() < 2:
        return None
    sample = sample.sort_values(["x", "label"])
    x = np.frombuffer(b"".join(sample["x"]), float).reshape(-1, N_LINE)
    chars = np.frombuffer(b"".join(sample["chars"]), float)
    first = np.r_[0, np.cumsum([len(c) // 8 for c in sample["chars"]])]
    return fit_chain(x, chars, first, (sample["label"].to_numpy() == 1).astype(float))


def quality_scores(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE, threshold: float = 0.7
) -> DataFrame:
    """One row per input row: doc_id, score (probability of label 1), predicted (1 if score >= threshold, else 0).

    ``train`` is a condition on doc_id that tells which labels may be learned from.  Scores use nothing but the text.

    Defined cases: a null or empty text, or one without a word, scores the share of label 1 among the sampled labels;
    null and repeated doc_ids are returned as they are (a null one is never learned from); of several labels of a
    doc_id the least counts; without labels of both
    kinds all scores are 0.5; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.where(F.coalesce(train, F.lit(False))).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(slim, marks, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in slices(batches, "text"):
            score = model.score(*line_features(scan(b.column("text")))) if model else np.full(b.num_rows, 0.5)
            yield T.arrow({"doc_id": b.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return slim.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
