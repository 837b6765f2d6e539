"""Filter audit, WARC archives and whitening against plain Python."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.llm import queries as Q
from strandsift.llm import warc as W
from strandsift.llm import whitening as V
from strandsift.llm.audit import filter_audit, replay
from strandsift.storage import folder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, filter_order int, mask string"
LABELS = "doc_id long, quality int, toxic int, part string"


def audit_by_hand(docs, labels):
    marks = defaultdict(lambda: [False, False])
    for i, q, t, *_ in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= t == 1
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 50)
        fails += "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (i is not None and least[text] < i)
        rows.append((source or "", fails, *(marks[i] if i is not None else (False, False))))
    out, share = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                x, c = order[step - 1], [0] * 6
                for p, fails, good, toxic in rows:
                    if p != part:
                        continue
                    first = next((k for k, y in enumerate(order, 1) if y in fails), 6)
                    c[0] += first > step
                    c[1] += first == step
                    c[2] += x in fails and first < step
                    c[3] += fails == x
                    c[4] += first == step and good
                    c[5] += first == step and toxic
                out[part, order, step] = c
                share[part, x] += c[1]
    return {(p, o, s, *c, share[p, o[s - 1]]) for (p, o, s), c in out.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    rng = random.Random(5)
    good = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", "A", "A B # C", good, good, good + " $", good.upper(), "x " * 80, "x " * 80 + "|", "é" * 30, "\t\n\x0b\x0c\r ", " ".join(["long"] * 40_000), " ".join(f"w{i}" for i in range(60_000))]
    docs = [(i, rng.choice(texts), rng.choice(["web", "books", None, ""]), i, "c") for i in range(70)] + [(None, good, "web", 0, "c"), (None, good, "web", 0, "c"), (3, good, "web", 0, "c"), (3, good, "web", 0, "c")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1), "x") for i in range(0, 70, 2)] + [(4, 1, None, "x"), (4, None, 1, "x"), (None, 1, 1, "x"), (6, None, None, "x")]
    found = filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).select(AUDIT).collect()
    assert len(found) == 3 * 600
    assert {tuple(r) for r in found} == audit_by_hand(docs, labels)


def test_filter_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit(none, spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit(spark.createDataFrame([(1, "a", "s", 0, "")], DOCS), spark.createDataFrame([], LABELS))
    assert {r["shapley"] for r in one.collect()} == {0, 120} and one.count() == 600


def test_replay_of_three_filters(spark):
    flags = spark.createDataFrame([("p", 0b011, True, False), ("p", 0b100, False, True), ("p", 0, True, True)], "part string, mask int, good boolean, toxic boolean")
    rows = {(r["filter_order"], r["step"]): r for r in replay(flags, "XYZ").collect()}
    assert len(rows) == 18
    assert (rows["XYZ", 1]["removed"], rows["XYZ", 2]["removed"], rows["XYZ", 2]["redundant"], rows["XYZ", 3]["kept"]) == (1, 0, 1, 1)
    assert [rows[o, 1]["shapley"] for o in ("XYZ", "YXZ", "ZXY")] == [3, 3, 6]


PAGES = "page_id long, url string, html string, shard int, digest string"


def pages_by_hand(rows):
    least = {}
    for i, _, html, *_ in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    out = []
    for i, url, html, *_ in rows:
        data = (html or "").encode()
        first = least.get(html or "")
        again = first is not None and first != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None, url))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def some_pages():
    rng = random.Random(2)
    html = ["", None, "<p>a</p>", "<p>é€😀</p>", "\r\n\r\nWARC/1.1\r\n\r\n", "x" * 3_000_000, "<p>" + "".join(rng.choice("abcdef ") for _ in range(50_000))]
    rows = [(rng.choice([i, i, i, None, 7]), rng.choice(["http://a.example/x", None, "", "http://b/é", "http://c/\r\nX: y"]), rng.choice(html), 1, "d") for i in range(120)]
    return rows + rows[:5]


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]


def test_warc_round_trip(spark):
    rows = some_pages()
    found = W.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).select(COLS).collect()
    assert sorted(map(tuple, found), key=key) == sorted(pages_by_hand(rows), key=key)


def test_warc_files_are_the_same_each_time_and_rolled(spark):
    rows, paths = some_pages(), [f"{folder(spark)}/test-warc-{i}" for i in range(2)]
    for path, parts in zip(paths, (2, 5), strict=True):
        W.write_archive(spark.createDataFrame(rows, PAGES).repartition(parts), path, shard_bytes=2_000_000, roll_bytes=3_000)
    one, two = ([tuple(r) for r in W.manifest(spark, p).sort("name").collect()] for p in paths)
    assert one == two
    assert len({r[1] for r in one}) > 3 and max(r[2] for r in one) > 2
    system, top = W.file_system(paths[0])
    names = {f.base_name for f in system.get_file_info(W.pafs.FileSelector(f"{top}/data")) if not f.base_name.startswith(".")}
    assert names == {r[0] for r in one}
    assert system.get_file_info(f"{top}/_temporary").type == W.pafs.FileType.NotFound
    total = 0
    for name, _, _, records, size, sha in one:
        data = system.open_input_stream(f"{top}/data/{name}", compression=None).read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (size, sha)
        assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC-Block-Digest") >= records
        total += records
    assert total == len(rows)
    with pytest.raises(FileExistsError):
        W.write_archive(spark.createDataFrame(rows, PAGES), paths[0])


def test_warc_payloads_and_offsets(spark):
    path = f"{folder(spark)}/test-warc-payload"
    rows = [(1, "http://a", "<p>x</p>", 0, ""), (2, "http://b", "<p>x</p>", 0, ""), (3, None, None, 0, ""), (4, None, "", 0, "")]
    W.write_archive(spark.createDataFrame(rows, PAGES), path)
    found = {r["page_id"]: r for r in W.read_archive(spark, path, payload=True).collect()}
    assert {i: bytes(r["payload"]) if r["payload"] is not None else None for i, r in found.items()} == {1: b"<p>x</p>", 2: None, 3: b"", 4: None}
    system, top = W.file_system(path)
    for r in found.values():
        stream = system.open_input_file(f"{top}/data/{r['file']}")
        stream.seek(r["offset"])
        fields, _ = W.parse(next(iter(W.members(stream)))[1])
        assert json.loads(fields["x-page-id"]) == r["page_id"]


def test_warc_small_payloads_and_string_ids(spark):
    rows = [("b", None, "tiny"), ("a", None, "tiny"), ("c", None, "larger payload"), ("d", None, "larger payload")]
    found = W.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"), least_bytes=5).collect()
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in found} == {"a": ("response", None), "b": ("response", None), "c": ("response", None), "d": ("revisit", "c")}


def test_warc_of_an_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_files_of_lost_attempts_are_not_read(spark):
    """A file that the manifest does not list, and a commit that ran twice."""
    path = f"{folder(spark)}/test-warc-lost"
    W.write_archive(spark.createDataFrame([(1, "http://a", "x", 0, "")], PAGES), path)
    system, top = W.file_system(path)
    with system.open_output_stream(f"{top}/data/part-000009-0000.warc.gz", compression=None) as out:
        out.write(b"half a file")
    assert W.read_archive(spark, path).count() == 1
    name = W.manifest(spark, path).first()["name"]
    with system.open_output_stream(f"{top}/data/{name}", compression=None) as out:
        out.write(gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab"))
    with pytest.raises(Exception, match="block of"):
        W.read_archive(spark, path).count()


def whitened_by_hand(rows, most=4):
    dim = {}
    for _, v in rows:
        if v:
            dim[len(v)] = dim.get(len(v), 0) + 1
    d = max(dim, key=lambda x: (dim[x], x))
    ints = [(i, tuple(math.floor(256 * float(c)) + 0 for c in v)) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in ints})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float) - np.array(s) / n
    v = x.T @ x / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, y in ints:
        dev = sum((n * a - b) ** 2 for a, b in zip(y, s, strict=True))
        w = (np.array(y) - np.array(s) / n) @ u[:, :most] / np.sqrt(np.where(e[:most] > 1e-9, e[:most], np.inf))
        for c in range(min(most, d)):
            out.setdefault((i, c + 1), []).append((n, dev, w[c], e[c] / np.trace(v)))
    return out


def check_whitening(found, want):
    got = defaultdict(list)
    for r in found:
        got[r[0], r[1]].append(tuple(r[2:]))
    assert got.keys() == want.keys()
    sign = {}
    for (i, c), rows in want.items():
        assert len(rows) == len(got[i, c])
        for (n, dev, w, part), (n2, dev2, w2, part2, error) in zip(rows, got[i, c], strict=True):
            assert (n, dev) == (n2, dev2)
            assert part2 == pytest.approx(part, rel=1e-9) and error <= 1e-9
            if abs(w) > 1e-6:
                sign.setdefault(c, 1 if w * w2 > 0 else -1)
            assert w2 * sign.get(c, 1) == pytest.approx(w, abs=1e-7)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1])
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6) @ a]) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(300)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0]), (906, [-0.0] * 6), (907, [300.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component", F.lit("x")).repartition(5)
    check_whitening(V.whiten(df, "embedding", "vec_id").collect(), whitened_by_hand([r for r in rows if r[0] not in (900, 901, 902, 903, 904, 905)]))


def test_whitening_of_great_numbers(spark):
    """Integers beyond 32 bits: sums and deviations stay exact, and those beyond a long are null."""
    rows = [(i, [float(2**20 * i), float(i % 3), 1e-3 * i]) for i in range(40)]
    found = V.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding", "vec_id").collect()
    want = whitened_by_hand(rows)
    assert {(r[0], r[1]): (r[2], r[3]) for r in found} == {k: (v[0][0], v[0][1] if v[0][1] < 2**63 else None) for k, v in want.items()}
    huge = V.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<double>"), "embedding", "vec_id").collect()
    assert len(huge) == 6 and {r["n"] for r in huge} == {3}


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert V.whiten(spark.createDataFrame([], schema), "embedding", "vec_id").count() == 0
    assert V.whiten(spark.createDataFrame([(1, None), (2, []), (3, [None, 1.0])], schema), "embedding", "vec_id").count() == 0
    same = V.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), "embedding", "vec_id").collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 4
    line = V.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema), "embedding", "vec_id").collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True, 3: True}
    assert [r["explained"] for r in line if r["component"] == 1] == pytest.approx([1.0] * 9)


def test_packed_rows_are_the_same_for_the_same_numbers():
    x = np.array([[1, -128], [1, 128], [40_000, 0], [2**40, -(2**63)], [1, -128]])
    rows = V.pack(x)
    assert [len(r) for r in rows] == [3, 5, 9, 17, 3] and rows[0] == rows[4]
    assert (V.unpack(rows, 2) == x).all()


def test_queries_return_whole_tables(spark):
    pages, vectors = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "embeddings"))
    assert Q.op12_warc(spark, SF).select("page_id").distinct().count() == pages.count()
    assert Q.op13_embedding_whitening(spark, SF).count() == 4 * vectors.count()
    check_whitening(Q.op13_embedding_whitening(spark, SF).collect(), whitened_by_hand([(r["vec_id"], r["embedding"]) for r in vectors.collect()]))
