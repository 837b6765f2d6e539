"""Patterns looked up in Arrow batches against plain Python, with repeated doc_ids and long common beginnings."""

import random

import pyarrow as pa
import pytest

from strandsift.operators import lookup
from strandsift.operators import text as T

DOCS = "doc_id long, text string"


@pytest.fixture
def case(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SEGMENT", 64)
    rng = random.Random(4)
    texts = [(i % 9, "".join(rng.choice("abé𝄞 ") for _ in range(rng.randrange(0, 300)))) for i in range(12)] + [(20, None), (21, "ab" * 60)]
    long = [t for _, t in texts if t and len(t) > 60]
    patterns = sorted({t[i : i + n] for t in long for i, n in ((3, 1), (7, 2), (11, 3), (0, 5), (20, 9), (1, 40))} | {"ab" * k for k in (3, 8, 9, 17)} | {"zz"})
    keys = [(7 * i, p, 1 + i) for i, p in enumerate(patterns)]
    hits = [(k, d, i, w, len(p)) for k, p, w in keys for d, t in texts if t for i in range(len(t)) if t.startswith(p, i)]
    return spark.createDataFrame(texts, DOCS), spark.createDataFrame(keys, "pattern_id int, pattern string, weight int"), keys, hits


def test_hits_inside_batches():
    known = lookup.table([b"a", b"aa", b"aab", "é".encode(), b"b" * 20])
    found = [(first + int(r), int(p), int(i)) for first, _, ps, rs, at in lookup.hits(known, pa.array(["aaab", None, "", "éaé", "b" * 21, "a"])) for p, r, i in zip(ps, rs, at)]
    assert sorted(found) == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0), (0, 1, 1), (0, 2, 1), (3, 0, 1), (3, 3, 0), (3, 3, 2), (4, 4, 0), (4, 4, 1), (5, 0, 0)]


def test_queries_on_occurrences(case):
    docs, patterns, keys, hits = case
    assert sorted(map(tuple, T.locate(docs, patterns).collect())) == sorted(h[:3] for h in hits)
    want = {k: (sum(h[0] == k for h in hits), len({h[1] for h in hits if h[0] == k})) for k, _, _ in keys}
    assert {r["pattern_id"]: (r["occ"], r["docc"]) for r in T.summary(docs, patterns).collect()} == want
    assert sorted(map(tuple, T.grep(docs, patterns).collect())) == sorted({h[:2] for h in hits})
    sums = {}
    for h in hits:
        sums[h[1:3]] = sums.get(h[1:3], 0) + h[3]
    assert {(r["doc_id"], r["pos"]): r["weight"] for r in T.weights(docs, patterns).collect()} == sums
    inside = {(h[1], i) for h in hits for i in range(h[2], h[2] + h[4])}
    got = [tuple(r) for r in T.covered(docs, patterns).collect()]
    assert sum(last - first + 1 for _, first, last in got) == len(inside) == len({(d, i) for d, a, b in got for i in range(a, b + 1)} & inside)
    assert all((d, a - 1) not in inside and (d, b + 1) not in inside for d, a, b in got)


def test_nothing_is_looked_up_by_a_row_for_each_place(spark):
    """The plan has no explode over places and no join with patterns: what made the time grow."""
    docs, patterns = spark.createDataFrame([(1, "abc")], DOCS), spark.createDataFrame([(1, "b", 1)], "pattern_id long, pattern string, weight int")
    for found in (T.locate(docs, patterns), T.occurrences(docs, patterns), T.weights(docs, patterns), T.covered(docs, patterns)):
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan
