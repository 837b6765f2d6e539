"""Near-dedup, substring dedup and their pipeline forms against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandsift.llm import minhash as M
from strandsift.llm import substring as S
from strandsift.llm import words as W
from strandsift.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, extra string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed=4):
    """Groups of near copies, chains, copies, passages, short and odd texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    out = ["", " \n ", "One", "one", "a b c d e", "A b  c\td e", None, "é\x85ü x", "the " * 400]
    for size in (12, 60, 200):
        base = text(size)
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 40))):
                w[r.randrange(size)] = r.choice(vocab)
            out.append(" ".join(w))
        chain = list(base)
        for _ in range(10):
            chain[r.randrange(size)] = r.choice(vocab)
            out.append("\n".join(chain).upper())
    passage = text(60)
    out += [" ".join(text(r.randint(5, 80)) + passage + text(r.randint(0, 80))) for _ in range(30)]
    out += out[-3:]
    return [(i, t) for i, t in enumerate(out)]


def test_words_are_bytes_between_white_space():
    texts = ["a  b\x0bc", "", None, "é x \x85y", "\n", "z" * 3000, "q " * 5, "A\x1cB"]
    w = W.scan(pa.array(texts))
    got = [[w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    assert W.scan(pa.array(["Ab ab"]), W.FOLDED).hash.tolist()[0] == W.scan(pa.array(["x ab"]), W.FOLDED).hash.tolist()[1]
    cut = pa.array(["skip", "b c", None, "d"]).slice(1)
    assert W.scan(cut).counts().tolist() == [2, 0, 1]


def test_segments_do_not_change_words(monkeypatch):
    texts = [t for _, t in corpus()]
    want = W.scan(pa.array(texts))
    monkeypatch.setattr(W, "SEGMENT", 37)
    got = W.scan(pa.array(texts))
    assert (got.hash == want.hash).all() and (got.start == want.start).all() and (got.first == want.first).all()


def test_registers_estimate_jaccard():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    b[:200] = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.sort(a), np.sort(b)]
    regs = M.registers(np.concatenate(sets), np.array([2000, 2000]))
    j = M.jaccard_estimate(regs[:1], regs[1:], np.array([2000]), np.array([2000]))[0]
    assert abs(j - 1800 / 2200) < 0.15


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rows = corpus()
    want = brute_components(rows, percent)
    got = M.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA), percent=percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_tables(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", "x"), (None, None, "x"), (7, "a b c", "x"), (7, "a b c", "x"), (3, "a b c", "x")]
    got = sorted(map(str, M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted(
        ["Row(doc_id=None, component_id=None, kept=True)"] * 2 + ["Row(doc_id=7, component_id=3, kept=False)"] * 2 + ["Row(doc_id=3, component_id=3, kept=True)"]
    )
    left = M.drop_near_duplicates(spark.createDataFrame([*rows[:2], *rows[2:4], (9, "z z", "e")], SCHEMA))
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, -1, 7, 9] and left.columns == ["doc_id", "text", "extra"]


def test_bitmap_of_ids(spark, monkeypatch):
    """All ids asked for are found, few others where there is room, and only more others where there isn't."""
    ids = spark.range(0, 6000, 3)
    docs = spark.range(-50, 6050).selectExpr("id", "cast(id as string) as text")
    for bits, least, most in ((28, 2000, 2600), (10, 2000, 6100)):
        monkeypatch.setattr(M, "MAX_BITS", bits)
        got = {r["id"] for r in M._full_sets(docs, ids).select("id").collect()}
        assert set(range(0, 6000, 3)) <= got and least <= len(got) <= most
    place = np.array([0, 1, 32768, 32769])
    bitmap = np.zeros((3, 4096), np.uint8)
    bitmap[0, 0], bitmap[1, 4095], bitmap[2, 0] = 1, 128, 1
    assert M._marked(place, bitmap).tolist() == [True, False, True, True]
    assert M._full_sets(docs.limit(0), ids).count() == 0


def test_sketch_bound():
    """The least bound with a chance of a miss below MISS."""
    from math import comb

    for percent in (80, 85):
        k, p = M.most_bits(percent), (1 - percent / 100) / 2
        tail = lambda m: sum(comb(128, i) * p**i * (1 - p) ** (128 - i) for i in range(m + 1, 129))
        assert tail(k) < M.MISS * 1.01 and tail(k - 1) >= M.MISS


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40, 0, -1)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 42)}, 100: 100, 101: 100}


def test_components_from_known_ones(spark):
    """New edges join known components, extend them and stand alone; repeated edges change nothing."""
    old = [(1, 2), (2, 3), (11, 10), (20, 21)]
    new = [(3, 10), (0, 21), (30, 31), (31, 30), (1, 2)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = components(table(old))
    got = {r["id"]: r["component"] for r in components(table(old + new), known).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 0, 21: 0, 0: 0, 30: 30, 31: 30}


def brute_windows(rows, n):
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[i : i + n]), d) < d:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), kept
    return out


@pytest.mark.parametrize(("window", "base"), [(50, 25), (20, 3), (12, 12)])
def test_repeated_windows(spark, window, base):
    rows = corpus(9)
    want = brute_windows(rows, window)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = S.repeated_windows(df, window=window, base=base).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {d: x for d, (x, _) in want.items()}
    cut = {r["doc_id"]: r["text"] for r in S.remove_repeats(df, window=window, base=base).collect()}
    assert {d: WORD.findall(t or "") for d, t in cut.items()} == {d: k.split(" ") if k else [] for d, (_, k) in want.items()}
    texts = dict(rows)
    assert all(cut[d] == texts[d] for d, (x, _) in want.items() if not x[1])


def test_repeated_windows_odd_tables(spark):
    assert S.repeated_windows(spark.createDataFrame([], SCHEMA)).count() == 0
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(None, t, "x"), (None, t, "x"), (4, t, "x"), (4, t, "x"), (4, t + " more", "x"), (6, "new " + t, "x")]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in S.repeated_windows(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0), (-1, 0), (4, 0), (4, 0), (4, 0), (6, 60)]


def test_remaining_text_keeps_layout():
    raw = "a b\nc  d e\n".encode()
    start = np.array([0, 2, 4, 7, 9])
    assert S.remaining_text(raw, start, np.array([False, True, True, False, False])) == "a d e\n"
    assert S.remaining_text(raw, start, np.array([False, False, False, True, True])) == "a b\nc"


def test_clashing_names(spark):
    """Columns with the names that helpers might have come out as they went in."""
    t = " ".join(f"w{i}" for i in range(70))
    rows = [(1, t, "a", "b", "c", "d", 4, "e"), (2, "x " + t, "f", "g", "h", "i", 5, "j"), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _id string, _Kept string, key string, n int, _n string")
    for out in (S.remove_repeats(df), M.drop_near_duplicates(df, percent=99)):
        assert out.columns == df.columns
        assert sorted(str(tuple(r)[2:]) for r in out.collect()) == sorted(str(r[2:]) for r in rows)
    assert {r["doc_id"]: r["text"] for r in S.remove_repeats(df).collect()} == {1: t, 2: "x", None: None}


def test_ids_of_other_types(spark):
    with pytest.raises(ValueError, match="whole number"):
        M.near_duplicates(spark.createDataFrame([("a", "b", "c")], "doc_id string, text string, extra string"))
