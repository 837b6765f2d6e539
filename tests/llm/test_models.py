"""Trees, line labels, language id and the language model: brute force, held-out accuracy and odd tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandsift.llm import langid as L
from strandsift.llm import lm as B
from strandsift.llm import quality_lines as C
from strandsift.llm import quality_trees as Q
from strandsift.llm.words import FOLDED, scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "a b a b a b", "Line one.\nLine one.\n\nline two # $ %", "ü é\x85x | |", "x " * 500, "#\n#\n#", "one\r\ntwo\r\ntwo\r\n", "A"]


def base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(zip(w, w[1:], w[2:]))
    cover = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)


def test_statistics():
    got, rows = Q.statistics(scan(pa.array(TEXTS)))
    assert list(zip(*(got[c].tolist() for c in Q.BASE))) == [base(t) for t in TEXTS]
    assert np.isfinite(rows).all()


def test_trees_learn_and_keep_constraints():
    r = np.random.default_rng(3)
    x = r.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    free = Q.fit_trees(x, y, [0, 0, 0])
    assert ((free.score(x) > 0.5) == (y == 1)).mean() > 0.97
    down = Q.fit_trees(x, y, [-1, 0, 0])
    grid = np.linspace(0, 1, 50)
    for b, c in itertools.product((0.1, 0.5, 0.9), (0.2, 0.8)):
        s = down.score(np.stack((grid, np.full(50, b), np.full(50, c)), axis=1))
        assert (np.diff(s) <= 1e-12).all()


def good_and_bad(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        lines = []
        for _ in range(r.randint(3, 9)):
            w = [r.choice(words) for _ in range(r.randint(10, 25))]
            lines.append(" ".join(x + r.choice(["###", "$$$"]) for x in w) if bad else " ".join(w).capitalize() + ".")
        rows.append((i, "\n".join(lines), "x"))
        labels.append((i, 0 if bad else 1, 5))
    return rows, labels


def tables(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, n_words int")


def test_quality_rules(spark):
    rows, labels = good_and_bad(300)
    rows += [(1000, None, "x"), (1001, "", "x"), (None, rows[1][1], "x"), (1, rows[1][1], "x")]
    docs, marks = tables(spark, rows, [*labels, (None, 1, 0), (7, None, 0)])
    got = Q.quality_rules(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 1000:
            assert r["kept"] == (not r["base_failed"] and r["doc_id"] % 3 != 0)
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    kept = sorted(str(r["doc_id"]) for r in got if r["kept"])
    left = Q.keep_good(docs, marks)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == kept
    assert Q.quality_rules(docs.limit(0), marks).count() == 0
    assert Q.quality_rules(docs, marks.limit(0)).where("kept = base_failed").count() == 0


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(0)
    trans = r.normal(size=(2, 2))
    first = np.array([0, 3, 3, 4, 9])
    unary = r.normal(size=9)
    p, pair = C.forward_backward(unary, first, trans)
    for d, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        n = hi - lo
        marginal, pairs, z = np.zeros(n), np.zeros((2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(unary[lo + t] for t in range(n) if y[t]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            marginal += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        if n:
            assert np.allclose(p[lo:hi], marginal / z) and np.allclose(pair[d], pairs / z)
        else:
            assert not pair[d].any()


def test_line_features_of_odd_texts():
    x, chars, first = C.line_features(scan(pa.array(TEXTS)))
    want = [len([q for q in (t or "").split("\n") if WORD.search(q)]) for t in TEXTS]
    assert np.diff(first).tolist() == want and np.isfinite(x).all() and (chars > 0).all()


def test_line_classifier(spark):
    rows, labels = good_and_bad(300, 2)
    rows += [(1000, None, "x"), (1001, " \n ", "x"), (None, "abc", "x")]
    docs, marks = tables(spark, rows, labels)
    got = C.quality_scores(docs, marks, F.col("doc_id") % 4 != 2).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 4 == 2]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in held]) > 0.97
    assert C.quality_scores(docs.limit(0), marks, F.lit(True)).count() == 0
    assert {r["score"] for r in C.quality_scores(docs, marks.limit(0), F.lit(True)).collect()} == {0.5}


def test_long_documents_are_learned_from(spark):
    """All bad documents are longer than a run of lines."""
    rows, labels = good_and_bad(60, 4)
    rows = [(i, "\n".join([t] * 60) if i % 3 == 0 else t, x) for i, t, x in rows]
    docs, marks = tables(spark, rows, labels)
    got = {r["doc_id"]: r["predicted"] for r in C.quality_scores(docs, marks, F.lit(True)).collect()}
    assert all(got[i] == (i % 3 != 0) for i in got)
    assert C._runs(0, 128) == [] and C._runs(128, 128) == [(0, 128)] and C._runs(200, 128) == [(0, 128), (128, 200)] and C._runs(1000, 128) == [(0, 128), (896, 1000)]


def test_several_labels_of_a_document(spark):
    """The least label counts, so a fit doesn't hang on the order of rows."""
    rows, labels = good_and_bad(120, 5)
    docs, marks = tables(spark, rows, labels + [(i, 1, 0) for i, q, _ in labels if q == 0])
    once = tables(spark, rows, labels)[1]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(Q.quality_rules(docs, marks.repartition(5))) == key(Q.quality_rules(docs, once))
    assert key(C.quality_scores(docs, marks.repartition(5), F.lit(True))) == key(C.quality_scores(docs, once, F.lit(True)))


def test_language_features_do_not_cross_texts():
    one = [L.features(*reversed(_buf([t]))) for t in ("abc déf", "Ölig", "12 .")]
    all_ = L.features(*reversed(_buf(["abc déf", "Ölig", "12 ."])))
    for d, (_, feature, times, some) in enumerate(one):
        mine = all_[0] == d
        assert all_[1][mine].tolist() == feature.tolist() and all_[2][mine].tolist() == times.tolist() and all_[3][d] == some[0]
    assert not all_[3][2]


def _buf(texts):
    from strandsift.llm.words import buffers

    return buffers(pa.array(texts))


def test_language_id(spark):
    r = random.Random(6)
    parts = {"en": ["the", "ing", "and", "er", "wh"], "de": ["sch", "ung", "ein", "über", "ß"], "fr": ["eau", "é", "que", "ou", "ç"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))), k, "x") for i in range(240) for k in [r.choice(list(parts))]]
    rows += [(900, None, "en", "x"), (901, "123 ...", "de", "x"), (902, "the thing", None, "x"), (None, "eau que", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {x["doc_id"]: x for x in L.predict_languages(docs, F.col("doc_id") % 5 != 0).collect()}
    held = [x for x in rows[:240] if x[0] % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == k for i, _, k, _ in held]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en" and got[None]["lang_pred"] == "fr"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert L.predict_languages(docs.limit(0), F.lit(True)).count() == 0
    assert {x["lang_pred"] for x in L.predict_languages(docs, F.lit(False)).collect()} == {"und"}


def test_language_model(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocab).title() for _ in range(r.randint(0, 40))), "x") for i in range(80)] + [(80, None, "x"), (None, "Ab  ab\nnewword", "x"), (3, "zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    train = F.col("doc_id") % 7 != 2
    for frequent, bits in ((5, B.MAX_BITS), (1 << 17, 1 << 10)):  # a short table of frequent words; a filter that is far too small
        got = B.language_model_scores(docs, train, frequent=frequent, max_bits=bits).collect()
        tokens = [[w.lower() for w in WORD.findall(t or "")] + [None] for _, t, _ in rows]
        c = Counter(w for (d, _, _), t in zip(rows, tokens) if d is not None and d % 7 != 2 for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((str(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, _, _), t in zip(rows, tokens))
        assert sorted((str(x["doc_id"]), x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
        assert all(x["score"] <= 0 for x in got)
    assert B.language_model_scores(docs.limit(0), train).count() == 0
    none = B.language_model_scores(docs, F.lit(False)).collect()
    assert sorted(x["n_tokens"] for x in none) == sorted(map(len, tokens)) and {x["score"] for x in none} == {0.0}


def test_filter_gives_levels_back(spark):
    texts = [("a " * 40 + "b " * 9 + "c",)] * 3
    df = spark.createDataFrame(texts, "text string")
    blocks = B._gathered(df, 4).cache()
    bloom = B.build_filter(blocks, B._histogram(blocks), 4)
    words = scan(pa.array(["a b c zzz"]), FOLDED)
    assert bloom.counts(B._WORD, B.singles(words.hash)).tolist() == [120.0, 27.0, 3.0, 0.0]


def test_all_counts_are_kept_at_every_size(spark, monkeypatch):
    """Many ranges and slices, or one of each, give the same model: no count level is left out."""
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toks = [[w for w in t.split()] + [None] for _, t in rows]
    c1 = Counter(w for t in toks for w in t)
    c2 = Counter(p for t in toks for p in zip([None, *t], t))
    space, weight = sum(c1.values()) + len(c1) + 1, 200.0
    tally = Counter(c.bit_length() for c in c2.values())
    mean = {j: sum(c for c in c2.values() if c.bit_length() == j) / n for j, n in tally.items()}
    want = {}
    for (i, _), t in zip(rows, toks):
        near = [min(mean[c2[p].bit_length()], c1[p[1]]) for p in zip([None, *t], t)]
        want[i] = sum(math.log10((c + weight * (c1[w] + 1) / space) / (max(c1[v], c) + weight)) for c, v, w in zip(near, [None, *t], t))
    for most, chunk in ((B.MAX_BITS, 6 << 20), (1 << 12, 4000)):
        monkeypatch.setattr(B, "CHUNK", chunk, raising=False)
        got = {x["doc_id"]: x["score"] for x in B.language_model_scores(docs, F.lit(True), max_bits=most).collect()}
        far = sorted(abs(got[i] - want[i]) for i in want)
        assert far[100] < 0.5 and far[-1] < 3  # false probes raise a level now and then; without pairs 15 would be usual


def test_scores_of_trees_by_walking_each_row():
    """The flattened arrays against a walk from node to node."""
    r = np.random.default_rng(5)
    x = r.random((400, 4))
    x[:50, 1] = np.round(x[:50, 1], 1)
    y = ((x[:, 0] + x[:, 1] > 1) ^ (x[:, 2] > 0.8)).astype(float)
    trees = Q.fit_trees(x, y, [0, -1, 0, 1], trees=15)
    edge = np.concatenate((x, np.full((1, 4), trees.threshold[0]), np.zeros((1, 4)), np.ones((1, 4)) * 9))
    for row, got in zip(edge, trees.score(edge), strict=True):
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-12)


def test_document_scores_by_enumeration():
    """Marginals from all labellings, weighted by line length and calibrated, give the score of a document."""
    r = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 11])
    x, chars = r.normal(size=(11, C.N_LINE)), r.integers(1, 60, 11).astype(float)
    model = C.Model(x.mean(axis=0), x.std(axis=0), r.normal(size=3 * C.N_LINE + 3), r.normal(size=(2, 2)), 1.7, -0.3, 0.25)
    got = model.score(x, chars, first)
    z = (x - model.mean) / model.scale
    for d, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        if lo == hi:
            assert got[d] == 0.25
            continue
        none = np.zeros(C.N_LINE)
        unary = [
            float(np.concatenate((z[t], z[t - 1] if t > lo else none, z[t + 1] if t < hi - 1 else none, [t == lo, t == hi - 1, 1])) @ model.weights) for t in range(lo, hi)
        ]
        marginal, total = np.zeros(hi - lo), 0.0
        for y in itertools.product((0, 1), repeat=hi - lo):
            w = math.exp(sum(u for u, k in zip(unary, y) if k) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
            total, marginal = total + w, marginal + w * np.array(y)
        q = float((marginal / total * chars[lo:hi]).sum() / chars[lo:hi].sum())
        q = min(max(q, 1e-4), 1 - 1e-4)
        assert math.isclose(got[d], 1 / (1 + math.exp(-(1.7 * math.log(q / (1 - q)) - 0.3))), rel_tol=1e-9)


def test_ftrl_in_plain_python():
    """Per-coordinate updates, one example after another, with dictionaries."""
    r = random.Random(7)
    rows = [(np.array(sorted(r.sample(range(40), 6))), np.array([r.random() for _ in range(6)])) for _ in range(30)]
    label = np.array([r.randrange(3) for _ in rows])
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.1
    z, n = Counter(), Counter()

    def weight(i, k):
        if abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - math.copysign(l1, z[i, k])) / ((beta + math.sqrt(n[i, k])) / alpha + l2)

    for _ in range(2):
        for (feature, value), y in zip(rows, label):
            x = {**dict(zip(feature.tolist(), value.tolist())), L.SIZE: 1.0}
            w = {(i, k): weight(i, k) for i in x for k in range(3)}
            score = [math.exp(sum(x[i] * w[i, k] for i in x)) for k in range(3)]
            for i in x:
                for k in range(3):
                    g = x[i] * (score[k] / sum(score) - (k == y))
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / alpha
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    weights, bias = L.train_ftrl(rows, label, 3, 2, alpha, beta, l1, l2)
    assert np.allclose(weights[:40], [[weight(i, k) for k in range(3)] for i in range(40)]) and np.allclose(bias, [weight(L.SIZE, k) for k in range(3)])
    assert (weights == 0).any() and not weights[40:].any()


def test_tf_idf_and_temperature_in_plain_python():
    idf = np.zeros(L.SIZE)
    idf[[3, 5, 9]] = [1.0, 2.0, 0.5]
    got = L.tf_idf(np.array([0, 0, 1]), np.array([3, 5, 9]), np.array([4, 1, 2]), 2, idf)
    a, b = (1 + math.log(4)) * 1.0, 2.0
    assert np.allclose(got, [a / math.hypot(a, b), b / math.hypot(a, b), 1.0])
    r = np.random.default_rng(1)
    logits, label = r.normal(size=(200, 4)) * 5, r.integers(0, 4, 200)
    label[:150] = logits[:150].argmax(axis=1)
    loss = lambda t: -sum(math.log(math.exp(z[y] / t) / sum(math.exp(v / t) for v in z)) for z, y in zip(logits.tolist(), label.tolist()))
    best = min((x / 50 for x in range(25, 1000)), key=loss)
    assert abs(L.fit_temperature(logits, label) - best) < 0.05


def test_document_frequencies_cover_all_texts(spark):
    texts = [("abc",), ("abd ab",), ("",), (None,), ("12",)]
    n, seen = L._document_frequencies(spark.createDataFrame(texts, "text string"))
    want = Counter()
    for (t,) in texts[:2]:
        want.update(set(L.features(*reversed(_buf([t])))[1].tolist()))
    assert n == 2 and {int(i): int(c) for i, c in enumerate(seen) if c} == dict(want)
