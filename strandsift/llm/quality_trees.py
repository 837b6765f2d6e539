"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

The trees are fitted on a bounded sample of labelled rows with histogram splits.  Features with a monotonic
constraint can only move the score one way: more symbols, repeated lines or repeated word windows never raise it.
Scoring follows all rows of a batch down a tree level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as T
from .durable import durable
from .sampling import bounded_sample
from .words import Words, scan, slices

#: Features and their constraint: -1 means that a larger value never raises the score.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "duplicate_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "point_share": 0,
    "shout_share": -1,
    "distinct_share": 0,
    "words_per_line": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(words: Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts, and a row of features for each document."""
    n = words.counts().astype(np.int64)
    of = lambda t: T.tally(words.data, words.offsets, t)
    chars, symbols = of(T.IS_WORD_CHAR), of(T.IS_SYMBOL)
    cover = T.repeated_words(words)
    total = np.r_[0, np.cumsum(cover)]
    repeat = (total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)
    dup = T.duplicate_lines(words)
    upper, lower = of(T.IS_UPPER), of(T.IS_LOWER)
    lines = of(T.table(b"\n")) + 1
    rows = np.stack(
        [
            np.log1p(n), T.share(chars, n), T.share(symbols, chars), T.share(dup, lines), T.share(repeat, n), T.share(upper, upper + lower),
            T.share(of(T.IS_DIGIT), chars), T.share(of(T.IS_POINT), chars), T.share(of(T.IS_SHOUT), chars), T.share(T.distinct_words(words), n), T.share(n, lines),
        ],
        axis=1,
    )
    return dict(zip(BASE, (n, chars, symbols, dup, repeat), strict=True)), rows


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                node = np.where(rows[every, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def fit_trees(
    rows: np.ndarray, label: np.ndarray, constraint: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, penalty: float = 1.0
) -> Trees:
    """Boosting for the logistic loss with second-order gains over histograms of quantile bins."""
    cuts = [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) for x in rows.T]
    binned = np.stack([np.searchsorted(c, x, "left") for c, x in zip(cuts, rows.T, strict=True)])
    mean = float(np.clip(label.mean(), 1e-4, 1 - 1e-4))
    start = np.log(mean / (1 - mean))
    total = np.full(len(label), start)
    nodes: list[list] = []
    roots = []

    def grow(mine: np.ndarray, level: int, lo: float, hi: float) -> int:
        g, h = grad[mine], hess[mine]
        at = len(nodes)
        value = float(np.clip(-g.sum() / (h.sum() + penalty), lo, hi))
        nodes.append([0, np.inf, at, at, rate * value])
        best = (1e-6, None)
        if level < depth and h.sum() >= 2 * least * 1e-3 and len(mine) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[f, mine]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h, None))
                gr, hr, nr = g.sum() - gl, h.sum() - hl, len(mine) - nl
                wl, wr = np.clip(-gl / (hl + penalty), lo, hi), np.clip(-gr / (hr + penalty), lo, hi)
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g.sum() ** 2 / (h.sum() + penalty)
                gain[(nl < least) | (nr < least) | (constraint[f] * (wr - wl) < 0)] = -1
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (f, i, float(wl[i]), float(wr[i])))
        if best[1]:
            f, i, wl, wr = best[1]
            go = binned[f, mine] <= i
            mid = (wl + wr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[constraint[f]]
            left, right = grow(mine[go], level + 1, *bounds[0]), grow(mine[~go], level + 1, *bounds[1])
            nodes[at][:4] = [f, cuts[f][i], left, right]
        else:
            total[mine] += rate * value
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - label, p * (1 - p)
        roots.append(grow(np.arange(len(label)), 0, -np.inf, np.inf))
    feature, threshold, left, right, value = zip(*nodes, strict=True)
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, float(start))


def _measured(docs: DataFrame, kind: str, *keep: str) -> DataFrame:
    """Statistics of (doc_id, text), with the integer columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            base, rows = statistics(scan(b.column("text")))
            yield T.arrow({"doc_id": b.column("doc_id"), **{c: b.column(c) for c in keep}, **base, **{f: rows[:, i].astype(float) for i, f in enumerate(FEATURES)}})

    names = [f"doc_id {kind}", *(f"{c} int" for c in keep), *(f"{c} long" for c in BASE), *(f"{f} double" for f in FEATURES)]
    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join(names))


def _marks(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(doc_id, label) of about ``most`` labelled ids; of several labels of an id the least."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return bounded_sample(marks.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id", most)


def _fit(sample: DataFrame) -> Trees | None:
    """Trees from the statistics and labels of sampled rows."""
    rows = sample.select(*FEATURES, "label").toPandas()
    if rows.empty or rows["label"].nunique() < 2:
        return None
    rows = rows.sort_values([*FEATURES, "label"])
    return fit_trees(rows[list(FEATURES)].to_numpy(float), (rows["label"].to_numpy() == 1).astype(float), list(FEATURES.values()))


def _base_failed(n: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    return (n < 50) | (100 * repeat > 50 * n)


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000, threshold: float = 0.5
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    kept is false where base_failed (fewer than 50 words, or over half of them in repeated 3-word windows), else
    whether the trees' probability of label 1 reaches ``threshold``.  The trees are fitted on at most about ``most``
    labelled rows, chosen by a hash of the id; everything else covers all rows.

    Defined cases: a null or empty text has counts of 0 and fails the base rule; a null doc_id is scored like any
    other row but never fitted on; repeated rows are each returned; of several labels of a doc_id the least counts;
    an empty table gives an empty result; without
    labels of both kinds the base rule alone decides and score is null; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    measured = durable(_measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), kind), "statistics")
    model = _fit(measured.join(_marks(labels, id_col, label_col, most), "doc_id"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.stack([b.column(f).to_numpy() for f in FEATURES], axis=1)
            failed = _base_failed(b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy())
            score = model.score(rows) if model else np.ones(len(rows))
            kept = ~failed & (score >= threshold)
            yield T.arrow({"doc_id": b.column("doc_id"), **{c: b.column(c) for c in BASE}, "base_failed": failed, "kept": kept, "score": pa.array(score, mask=None if model else np.ones(len(rows), bool))})

    return measured.mapInArrow(judge, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in BASE), "base_failed boolean, kept boolean, score double"]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns, without a shuffle of texts.

    Defined cases: as in :func:`quality_rules`; other columns may have any names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marks = F.broadcast(_marks(labels, id_col, label_col, most))  # some 1.1 * most rows of an id and a label
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(marks, "doc_id")
    model = _fit(_measured(marked, kind, "label"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            base, rows = statistics(scan(b.column(text_col)))
            good = ~_base_failed(base["n_words"], base["n_repeat_words"])
            yield b.filter(pa.array(good & (model.score(rows) >= threshold) if model else good))

    return docs.mapInArrow(choose, docs.schema)
