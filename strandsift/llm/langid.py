"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased letters with one boundary for everything else; n-grams of one to three characters are hashed
into a fixed number of features.  Document frequencies come from all training texts.  The weights are trained on a
bounded sample with follow-the-regularised-leader updates under an elastic-net penalty, and a temperature is set on
a part of the sample that was kept back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import IS_CHAR, arrow, tally
from .words import FACTORS, buffers, lists, slices

BITS = 14
SIZE = 1 << BITS
SAMPLE = 6000
UNKNOWN = "und"
_STEPS = 1 << 30
_PIECE = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """The lower-case form of each letter, 0 for all other characters."""
    global _letters
    if _letters is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(len(out)):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters = out
    return _letters


def _characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one 0 for each run of other characters, a 0 at either end, and each text's first place."""
    points = np.frombuffer(data[off[0] : off[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
    n = tally(data, off, IS_CHAR)
    c = letters()[points]
    first = np.r_[0, np.cumsum(n)]
    keep = np.ones(len(c), bool)
    if len(c):
        keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
        keep[first[:-1][n > 0]] = True
    total = np.r_[0, np.cumsum(keep)]
    n = total[first[1:]] - total[first[:-1]]
    first = np.r_[0, np.cumsum(n + 2)]
    out = np.zeros(int(first[-1]), np.uint32)
    doc = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(doc)) + 2 * doc + 1] = c[keep]
    return out, first


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, times) of all n-grams, sorted, and which documents have a letter."""
    c, first = _characters(data, off)
    n = len(first) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first)) * np.int32(SIZE)
    shift = np.uint32(32 - BITS)
    a, b, d = (np.uint32(int(x) & 0xFFFFFFFF | 1) for x in FACTORS[30:33])
    scramble = lambda h: ((h ^ (h >> np.uint32(15))) * d) >> shift
    one = c > 0
    parts = [doc[one] + scramble(c[one] * a).astype(np.int32)]
    two = one[1:] | one[:-1]
    parts.append(doc[:-1][two] + scramble((c[1:] * b + c[:-1] * a + np.uint32(1))[two]).astype(np.int32))
    if len(c) > 2:
        three = one[1:-1]
        parts.append(doc[1:-1][three] + scramble((c[2:] * d + c[1:-1] * b + c[:-2] * a + np.uint32(2))[three]).astype(np.int32))
    count = np.zeros(n * SIZE, np.int32)
    for p in parts:
        count += np.bincount(p, minlength=len(count)).astype(np.int32)
    at = np.flatnonzero(count)
    some = np.zeros(n, bool)
    some[doc[one] // SIZE] = True
    return at // SIZE, at % SIZE, count[at], some


def pieces(col: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Features of a text column in pieces of bounded size, with the first row of each."""
    off, data = buffers(col)
    lo = 0
    while lo < len(col):
        hi = min(lo + 256, max(lo + 1, int(np.searchsorted(off, off[lo] + _PIECE, "right")) - 1))
        yield lo, features(data, off[lo : hi + 1])
        lo = hi


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def logits(self, doc: np.ndarray, feature: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        x = tf_idf(doc, feature, times, n, self.idf)
        out = np.stack([np.bincount(doc, x * self.weights[feature, k], n) for k in range(len(self.languages))], axis=1)
        return out + self.bias


def tf_idf(doc: np.ndarray, feature: np.ndarray, times: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """(1 + log tf) * idf, of length 1 for each document."""
    x = (1 + np.log(times)) * idf[feature]
    return x / np.sqrt(np.bincount(doc, x * x, n))[doc]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from per-coordinate FTRL-proximal updates; the last feature is the bias, without penalty."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(at):
        zz, big = z[at], np.abs(z[at]) > l1
        return np.where(big, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for (feature, x), y in zip(rows, label, strict=True):
            at, v = np.append(feature, SIZE), np.append(x, 1.0)
            w = weights(at)
            g = softmax(v @ w)
            g[y] -= 1
            g = v[:, None] * g
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature with the least loss, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(label)), label], 1e-12)).mean()
    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Of all training texts: their number, and in how many each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SIZE, np.int64), 0
        for b in slices(batches, "text"):
            for _, (_, feature, _, some) in pieces(b.column("text")):
                seen += np.bincount(feature, minlength=SIZE)
                n += int(some.sum())
        yield arrow({"feature": np.r_[-1, np.flatnonzero(seen)], "n": np.r_[n, seen[seen > 0]]})

    rows = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE)
    at = rows["feature"].to_numpy(np.int64)
    out[at[at >= 0]] = rows["n"].to_numpy()[at >= 0]
    return int(rows["n"][rows["feature"] == -1].sum()), out


def _sample(train: DataFrame, most: int) -> DataFrame:
    """About ``most`` training rows, with equal shares for the languages as far as they have rows."""
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return train
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(_STEPS, int(_STEPS * (most / len(sizes)) / n))))])
    return train.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(_STEPS)) < share[F.col("lang")])


def fit(train: DataFrame, most: int = SAMPLE) -> Model | None:
    """A model from (doc_id, text, lang); None without texts that have letters."""
    texts, seen = _document_frequencies(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for lo, (doc, feature, times, some) in pieces(b.column("text")):
                n = np.bincount(doc, minlength=len(some))
                part = b.slice(lo, len(some))
                yield arrow({"doc_id": part.column("doc_id"), "lang": part.column("lang"), "feature": lists(feature.astype(np.int32), n, pa.int32()), "times": lists(times, n, pa.int32())})

    kind = train.schema["doc_id"].dataType.simpleString()
    rows = _sample(train, most).mapInArrow(run, f"doc_id {kind}, lang string, feature array<int>, times array<int>").where("size(feature) > 0")
    sample = rows.withColumn("turn", F.xxhash64("feature", "times")).toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["turn", "lang"])
    languages = sorted(sample["lang"].unique())
    label = np.array([languages.index(x) for x in sample["lang"]])
    idf = np.log((1 + texts) / (1 + seen)) + 1
    rows = [(np.asarray(f, np.int64), tf_idf(np.zeros(len(f), int), np.asarray(f, np.int64), np.asarray(t, float), 1, idf)) for f, t in zip(sample["feature"], sample["times"], strict=True)]
    back = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    weights, bias = train_ftrl([r for r, x in zip(rows, back, strict=True) if not x], label[~back], len(languages))
    model = Model(languages, idf, weights, bias, 1.0)
    if back.any():
        held = np.stack([x @ weights[f] + bias for (f, x), k in zip(rows, back, strict=True) if k])
        model.temperature = fit_temperature(held, label[back])
    return model


def predict_languages(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (the calibrated probability of lang_pred).

    ``train`` is a condition; rows for which it is true and whose language isn't null are learned from: all of them
    for the document frequencies, about ``most`` for the weights.  Predictions use nothing but the text.

    Defined cases: a null text, or one without a letter, gets ``und`` with score 0, as do all rows when nothing can be
    learned; null and repeated doc_ids are returned as they are; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull())
    model = fit(chosen.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), most)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in slices(batches, "text"):
            name, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            if model:
                for lo, (doc, feature, times, some) in pieces(b.column("text")):
                    p = softmax(model.logits(doc, feature, times, len(some)) / model.temperature)
                    best = p.argmax(axis=1)
                    rows = lo + np.flatnonzero(some)
                    name[rows] = np.array(model.languages, object)[best[some]]
                    score[rows] = p.max(axis=1)[some]
            yield arrow({"doc_id": b.column("doc_id"), "lang_pred": pa.array(name, pa.string()), "score": score})

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
