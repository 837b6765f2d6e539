"""Decontamination, mixing, html, token counts and the pipeline."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandsift.llm import decontaminate as D
from strandsift.llm import html as H
from strandsift.llm import mixing as X
from strandsift.llm import tokens as T


def edit(pattern, text):
    """The least edit distance of a pattern to any part of a text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(1)
    for _ in range(300):
        p, t = [r.randrange(4) for _ in range(r.randint(1, 90))], [r.randrange(4) for _ in range(r.randint(0, 120))]
        assert D.myers(D.pattern(p), len(p), t)[0] == edit(p, t)


def tokens(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(40)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate((1, 3, 8, 20, 20, 45, 70))] + [(90, ""), (91, None), (92, "...")]
    docs = []
    for i in range(120):
        w = text(r.randint(0, 60))
        if i % 2:
            w2 = tokens(items[r.randrange(3, 7)][1])
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(w2))
                w2[k : k + 1] = r.choice([[], ["zz"], [w2[k], "yy"]])
            at = r.randint(0, len(w))
            w = w[:at] + w2 + w[at:]
        docs.append((i, ", ".join(w).title(), "x"))
    docs += [(200, None, "x"), (201, "", "x"), (None, items[4][1], "x"), (7, docs[7][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(x["doc_id"]), x["item_id"], x["edits"]) for x in D.contamination(df, bench).collect())
    want = []
    for d, t, _ in docs:
        for i, q in items:
            p = tokens(q)
            if p and (e := edit(p, tokens(t))) <= int(D.RATE * len(p)):
                want.append((str(d), i, e))
    assert got == sorted(want)
    bad = {d for d, _, _ in want}
    long_ = bench.where("item_id >= 3")
    left = D.drop_contaminated(df, long_)
    hit = {d for d, i, _ in want if i >= 3}
    assert left.columns == df.columns and sorted(str(x["doc_id"]) for x in left.collect()) == sorted(str(d) for d, _, _ in docs if str(d) not in hit)
    assert bad >= hit
    assert D.contamination(df.limit(0), bench).count() == 0 and D.contamination(df, bench.limit(0)).count() == 0


def test_items_without_first_and_last_token():
    """A document that is shorter than the item, between two others in one slice, is verified itself."""
    item = [f"t{i}" for i in range(40)]
    texts = ["a b c d", " ".join(item[1:-1]), "e f g h", " ".join(item[3:-2]), "", "i j k l"]
    scan = lambda x: D.scan(pa.array(x), D.FOLDED, D.LOOSE)
    block = D.block(["q"], [scan([" ".join(item)]).hash], D.RATE)
    assert [f[:3] for f in D.find(scan(texts), block)] == [(1, 0, 2), (3, 0, 5)]


def test_items_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i} x y z v{i}") for i in range(30)], "doc_id long, text string")
    bench = df.withColumnRenamed("doc_id", "item_id")
    want = sorted(map(tuple, D.contamination(df, bench).collect()))
    left = sorted(map(tuple, D.drop_contaminated(df.union(spark.createDataFrame([(99, "clean")], df.schema)), bench).collect()))
    monkeypatch.setattr(D, "BLOCK_TOKENS", 20)
    assert len(list(D._blocks(bench, "item_id", "text", 0.2))) > 3
    assert sorted(map(tuple, D.contamination(df, bench).collect())) == want
    assert sorted(map(tuple, D.drop_contaminated(df.union(spark.createDataFrame([(99, "clean")], df.schema)), bench).collect())) == left == [(99, "clean")]


def test_equal_items_are_one_entry(spark):
    df = spark.createDataFrame([(1, "p q r s t")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "p q, r s t"), (2, "P q r s t"), (None, "p q r s t"), (7, "u v")], "item_id long, text string")
    assert len(next(D._blocks(bench, "item_id", "text", 0.2))[0].ids) == 2
    assert sorted(str(r["item_id"]) for r in D.contamination(df, bench).collect()) == ["2", "5", "None"]


def test_mixing(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else ("small" if i % 20 else None), "x") for i in range(4000)] + [(None, "n", "big", "x"), (None, None, "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")
    out = X.mix_sources(docs)
    got = out.collect()
    share = Counter(x["source"] for x in got)
    assert all(abs(share[s] - len(rows) / 3) < 5 * math.sqrt(len(rows) / 3) * 3 for s in ("big", "small", None))
    keys = [x["shuffle_key"] for x in got]
    assert keys == sorted(keys) and out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    copies = Counter(x["doc_id"] for x in got)
    assert all(sorted(x["copy"] for x in got if x["doc_id"] == d) == list(range(1, n + 1)) for d, n in list(copies.items())[:40] if d is not None)
    assert sorted(map(str, X.mix_sources(docs.repartition(7)).collect())) == sorted(map(str, got))
    only = X.mix_sources(docs, weights={"small": 1.0}, size=100)
    assert {x["source"] for x in only.select("source").distinct().collect()} == {"small"}
    assert X.mix_sources(docs.limit(0)).count() == 0


def test_mixing_clashing_names(spark):
    rows = [(i, f"t{i}", "s", i, "k", 2, "p", "o", "C") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key long, _times string, _steps int, _parts string, _of string, COPY string")
    got = X.mix_sources(docs).collect()
    plain = X.mix_sources(docs.select("doc_id", "text", "source")).collect()
    assert [(r["doc_id"], r["copy"], r["shuffle_key"]) for r in got] == [(r["doc_id"], r["copy"], r["shuffle_key"]) for r in plain]
    assert all((r["_key"], r["_times"], r["_steps"], r["_parts"], r["_of"]) == (r["doc_id"], "k", 2, "p", "o") for r in got)


@pytest.mark.parametrize("rate", [0.03, 1.0, 12.5])
def test_poisson_steps(spark, rate):
    steps = spark.range(1).select(X.poisson_steps(F.lit(rate)).alias("s")).first()["s"]
    want, total = [], 0.0
    for k in range(X.STEPS):
        total += math.exp(-rate) * rate**k / math.factorial(k)
        want.append(total)
    assert steps == pytest.approx(want, abs=1e-12)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x">
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside><p>Side</p></aside><script>var a="</p><p>no</p>";</script>
<div id="content"><article><h1>%s</h1><p>One &amp; <b>two</b>
 three&nbsp;four<br>five<p>Next <a href="x">link</a> text.</p><div class="ad"><p>Buy</p></div><ul><li>i<li>j</ul><!-- no <p>no</p> -->
<table><tr><td>c1<td>c2</table><p>Share this story now</p><section class="comments"><p>Me too</p></section></article></div>
<form><p>Mail</p><input></form><footer><p>&copy; us</p></footer></body></html>"""
BODY = ["One & two three four five", "Next link text.", "i", "j", "c1", "c2"]


def test_names_alone():
    assert H.main_text(PAGE % "Head") == "\n\n".join(["Head", *BODY, "Share this story now"])
    for odd in (None, "", "<", "<p", "plain", "<p>a", "</p></div>x", "<script>x", "<!-- x", "<p title='a>b'>c</p>", '<a title="x>y', "a < b & c"):
        H.main_text(odd)
    assert H.main_text("plain text") == "plain text" and H.main_text("<p>a<p>b") == "a\n\nb" and H.main_text("<div><p>1 &lt; 2</p></div>") == "1 < 2"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><body><p>x</p></body></html>", "x"),
        ("<html><head><meta charset=u><p>Hello</p>", "Hello"),
        ("<button>b<p>text</p>", "b\n\ntext"),
        ("<p>a</p><select><option>1<p>after</p>", "a\n\n1\n\nafter"),
        ("<object><p>in</p>", "in"),
        ("<p>a</p><button>b</button><select><option>1</select><svg><text>no</text></svg><p>c", "a\n\nc"),
        ("<div class='content with-sidebar'><article><p>A</p></article></div>", "A"),
        ("<form id=page><div class=top><main><p>A</p><form>mail</form></main></div></form>", "A"),
        ("<div class=sidebar><p>s</p></div><p>kept</p>", "kept"),
        ("<p>a<script>var x='</p><p>no</p>'</script>b</p>", "a b"),
    ],
)
def test_pages_without_ends_and_with_wrappers(page, want):
    assert H.main_text(page) == want


def test_deeply_nested_pages(spark):
    deep = "<div>" * 10_000 + "<p>in</p>" + "</div>" * 10_000
    texts = "<div>x" * 3000
    rows = [(i, "http://d.example/", x) for i, x in enumerate((deep, texts, "<section>" * 10_000 + "q"))]
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "in", 1: "\n\n".join(["x"] * 3000), 2: "q"}


def random_tree(r, n):
    tree = [(-1, "")]
    for _ in range(n):
        tree.append((r.randrange(len(tree)), r.choice(["a", "b.x", "b.y"])))
    order = sorted(range(len(tree)), key=lambda i: (depth(tree, i), i))
    place = {x: i for i, x in enumerate(order)}
    return [(place.get(tree[i][0], -1), tree[i][1]) for i in order]


def depth(tree, i):
    return 0 if tree[i][0] < 0 else 1 + depth(tree, tree[i][0])


def brute_match(a, b, i=0, j=0):
    """The weight of simple tree matching by its recursion."""
    x, y = [k for k, n in enumerate(a) if n[0] == i], [k for k, n in enumerate(b) if n[0] == j]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x)):
        for q in range(len(y)):
            same = a[x[p]][1][:1] == b[y[q]][1][:1]
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + brute_match(a, b, x[p], y[q]) if same else 0)
    return best[-1][-1] + 1 + (a[i][1] == b[j][1])


def test_simple_tree_matching():
    r = random.Random(8)
    for _ in range(300):
        a, b = random_tree(r, r.randint(0, 12)), random_tree(r, r.randint(0, 12))
        pairs = H.match(a, b)
        same_order = [x for x, _ in pairs if x] and all(a[x][0] < 0 or (a[x][0], b[y][0]) in pairs for x, y in pairs)
        assert same_order or len(pairs) == 1
        if [n for _, n in a] != [n for _, n in b]:  # children in equal order are paired at once, without weighing
            assert sum(1 + (a[x][1] == b[y][1]) for x, y in pairs) <= brute_match(a, b)
        if all(sum(p == i for p, _ in a) < 2 for i in range(len(a))):
            assert sum(1 + (a[x][1] == b[y][1]) for x, y in pairs) == brute_match(a, b)
        both = H.merged(a, b)
        assert len(both) == len(a) + len(b) - len(pairs) and all(p < i for i, (p, _) in enumerate(both))
        assert H.merged(both, a) == both or len(H.merged(both, a)) >= len(both)
    a, b = H.outline("<div><h1>a</h1><p>b</p><ul><li>c</ul></div>")[0], H.outline("<div><h1>x</h1><table><tr><td>y</table><ul><li>z</ul></div>")[0]
    assert len(H.match(a, b)) == 5  # root, div, h1, ul, li


def induced(pages):
    """A host's template from its pages in plain Python."""
    trees, cells, having = None, {}, Counter()
    outlines = [H.outline(p) for p in pages]
    for tree, _ in outlines:
        trees = tree if trees is None else H.merged(trees, tree)
    for tree, texts in outlines:
        of = H.aligned(trees, tree)
        having.update(x for x in of if x >= 0)
        for (node, text), (size, links) in texts.items():
            x = cells.setdefault((of[node], text), [0, 0, 0])
            x[0], x[1], x[2] = x[0] + 1, x[1] + size, x[2] + links
    slots = {}
    for (node, text), (n, size, links) in cells.items():
        s = slots.setdefault(node, {"size": 0, "links": 0, "varying": 0, "constant": []})
        s["size"], s["links"] = s["size"] + size, s["links"] + links
        if not (n >= 2 and n >= H.CONSTANT * having[node]):
            s["varying"] += size - links
        if n >= H.LEAST and n >= H.CONSTANT_IN_MAIN * having[node]:
            s["constant"].append((text, size))
    return H.decide(trees, slots)


R = random.Random(2)
WORDS = [" ".join(R.choice("lorem ipsum dolor sit amet sed quis non vel nam".split()) for _ in range(30)) for _ in range(200)]


def plain_page(i):
    """No tag and no class names an article, a menu or an advert."""
    lead = f"Menu of {i}" if i % 3 else ""
    extra = f"<div>Reader offer {i % 3}</div>" if i % 2 else ""
    body = [f"Story {i} {WORDS[i * 3 % 200]}", f"More {i} {WORDS[i * 7 % 200]}"]
    html = (
        f"<html><body><div><span><a href=/a{i}>{lead} Section one</a> <a href=/b>Section two</a></span></div>{extra}"
        f"<div><h2>Heading {i}</h2><p>{body[0]}</p><p>Read on below</p><p>{body[1]}</p></div><div><p>Imprint of the house</p></div></body></html>"
    )
    return html, [f"Heading {i}", *body]


def named_page(i):
    """Boilerplate with and without names, inside and outside the article."""
    body = [f"Text {i} {WORDS[i * 5 % 200]}", f"Second {i} {WORDS[i * 11 % 200]}"]
    html = (
        f"<html><head><title>T{i}</title><body class='page with-sidebar'><header><h1>The Site</h1></header><nav><a href=/>Home {i}</a></nav><div class='wrap top'>"
        f"<article><header><h1>Title {i}</h1></header><p>{body[0]}</p><div class=ad>Buy {WORDS[(i + 50) % 200]}</div><p>Follow our channel</p><p>{body[1]}</p>"
        f"<section class=comments><p>Reader {i}: {WORDS[(i + 90) % 200]} {WORDS[(i + 91) % 200]}</p></section></article></div>"
        f"<aside><p>Side {WORDS[(i + 20) % 200]}</p></aside><form><p>Mail {i}</p></form><footer>&copy; us {i}</footer></body></html>"
    )
    return html, [f"Title {i}", *body]


@pytest.mark.parametrize("make", [plain_page, named_page])
def test_gold_pages(spark, make):
    pages = [make(i) for i in range(40)]
    rows = [(i, f"http://g.example/{i}", p) for i, (p, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(x) for i, (_, x) in enumerate(pages)}
    template = induced([p for p, _ in pages])
    assert all(H.main_text(p, template) == "\n\n".join(x) for p, x in pages)
    assert sum(H.main_text(p) != "\n\n".join(x) for p, x in pages) == 40  # names alone get no page right


def test_names_break_ties_only(monkeypatch):
    """On pages of the kind of the tables the template finds the article where no name counts at all."""
    page = lambda i: (
        f"<html><body><nav><ul><li><a href=/{i}>Link {i}</a></li><li><a href=/x>x{i % 7}</a></li></ul></nav><div class=ad>Buy number {i}</div>"
        f"<article><h1>Title {i}</h1><p>{WORDS[i]} {i}</p><p>{WORDS[i + 100]} {i}</p></article><footer>&copy; h.example {i % 4}</footer></body></html>"
    )
    pages = [page(i) for i in range(30)]
    monkeypatch.setattr(H, "unwanted", lambda name, inside=True: 0)
    monkeypatch.setattr(H, "is_main", lambda name: False)
    template = induced(pages)
    want = [f"Title {i}\n\n{WORDS[i]} {i}\n\n{WORDS[i + 100]} {i}" for i in range(30)]
    assert [H.main_text(p, template) for p in pages] == want
    assert all(H.main_text(p) != w for p, w in zip(pages, want, strict=True))


def test_copies_of_one_article_are_no_template():
    pages = [PAGE % f"Head {i}" for i in range(12)]
    template = induced(pages)
    assert all(H.main_text(p, template).startswith(f"Head {i}\n\n" + BODY[0]) for i, p in enumerate(pages))


def test_templates(spark):
    pages = [(i, f"http://h.example/{i}", plain_page(i)[0]) for i in range(12)]
    pages += [(50, "http://other.example/", PAGE % "Alone"), (51, None, None), (52, "http://h.example/e", ""), (None, "odd", "<p>x y</p>"), (0, "http://h.example/0", pages[0][2])]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, template string")
    got = H.extract_main_text(df).collect()
    assert len(got) == len(pages)
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert all(text[(i, f"http://h.example/{i}")] == "\n\n".join(plain_page(i)[1]) for i in range(12))
    assert text[(50, "http://other.example/")] == "\n\n".join(["Alone", *BODY, "Share this story now"])
    assert text[(51, None)] == "" and text[(52, "http://h.example/e")] == "" and text[(None, "odd")] == "x y"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_headings_and_link_lists_of_marked_articles(spark):
    """Eight pages of one host whose articles share two headings and end with links: nothing of the article is lost, while
    menus, the footer and a line that all articles have go."""
    rows, want = [], {}
    for i in range(8):
        paragraphs = [f"Page {i} begins with its own words about subject {i * 7}.", f"A second paragraph of page {i} goes on for a while."]
        links = [f"Source {i} number {j}" for j in range(3)]
        items = "".join(f"<li><a href=/s{i}{j}>{x}</a></li>" for j, x in enumerate(links))
        rows.append((i, f"http://w.example/{i}", f"<body><nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><h2>Summary</h2><p>{paragraphs[0]}</p><p>{paragraphs[1]}</p><p>Share this story now</p><h2>Sources</h2><ul>{items}</ul></article><footer>About us</footer></body>"))
        want[i] = "\n\n".join([f"Title {i}", "Summary", *paragraphs, "Sources", *links])
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_layouts_that_few_pages_have(spark, monkeypatch):
    """One page in twenty of a host has its own layout; its fixed line is template there, by all pages of the layout."""
    page = lambda i: f"<div class=rare><p>Text number {i} here</p><h4>Our fixed line</h4></div>" if i % 20 == 0 else f"<div><p>Plain text {i}</p></div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract_main_text(df).collect()
    assert not any("Our fixed line" in r["text"] for r in got)
    assert all(f"{r['page_id']}" in r["text"] for r in got)
    monkeypatch.setattr(H, "BROADCAST_HOSTS", 0)  # the joined form gives the same
    assert sorted(map(tuple, H.extract_main_text(df).collect())) == sorted(map(tuple, got))


def model_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    parts = ["a", "the", "é", "▁", " ", "  ", "\n", "\t", "<s>", "</s>", "日本", " ", "\r", ";\r", "\x0b", "\x0c", "ing", ".", "123", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(2000)] + ["", None, " ", "\n", " \n", "word " * 3000, "z" * 5000]
    with open(path, "rb") as f:
        counter = T.Counter(f.read())
    assert not counter.whole
    assert counter.count(pa.array(texts)).tolist() == [len(sp.encode(t or "")) for t in texts]
    rows = [(i, t, "x") for i, t in enumerate(texts[-40:])] + [(None, "a b", "x"), (3, "a b", "x")]
    got = T.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), path, limit=100).collect()
    want = [(str(d), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for d, t, _ in rows]
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in got) == sorted(want)
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows and columns with names that helpers might have."""
    r = random.Random(12)
    words = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    good = [" ".join(r.choice(words) for _ in range(90)) for _ in range(3)]
    more = "_key string, _digest string, _kept string, _times string, _n string, _parts string, label int, score double, page binary, count long"
    rows = [(0, good[0]), (1, good[1]), (1, good[1]), (1, good[2]), (None, good[0]), (None, good[0]), (7, None), (8, ""), (None, None)]
    wide = spark.createDataFrame([(d, t, None, None, None, *"abcdef", 1, 2.0, b"x", 3) for d, t in rows], f"{DOCS}, {more}")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {
        "quality_rules": [(None, good[0])] * 2 + [(0, good[0]), (1, good[1]), (1, good[1]), (1, good[2])],
        "near_dedup": [(None, good[0])] * 2 + [(0, good[0]), (1, good[1]), (1, good[2])],
    }
    left = wide
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, wide.limit(0), str(tmp_path))
        assert empty.count() == 0
        left = stage(spark, left, str(tmp_path)).cache()
        names = [*wide.columns, "copy", "shuffle_key"] if name == "mixing" else wide.columns
        assert left.columns == names and empty.columns == names
        got = left.collect()
        assert all((x["_key"], x["_kept"], x["label"], x["score"], x["count"]) == ("a", "c", 1, 2.0, 3) for x in got)
        if name != "mixing":
            want[name] = want.get(name, want["near_dedup"])
            assert sorted(map(str, ((x["doc_id"], x["text"]) for x in got))) == sorted(map(str, want[name]))
    for name, stage in corpus_pipeline.STAGES[1:4]:  # null and empty texts stay where a stage doesn't judge texts
        got = Counter((x["doc_id"], x["text"]) for x in stage(spark, wide, str(tmp_path)).collect())
        assert got[(7, None)] == got[(8, "")] == got[(None, None)] == 1 and got[(None, good[0])] == 2


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(11)
    vocab = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    clean = [text(120) for _ in range(60)]
    passage, item = text(55), text(30)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[3]), (101, clean[4] + " extra"), (102, " ".join(w + "###" for w in clean[5].split())), (103, text(60) + " " + passage + " " + text(60)), (104, text(60) + " " + passage + " " + text(60))]
    rows += [(105, text(80) + " " + item + " " + text(80)), (106, "short"), (107, None), (None, clean[6])]
    docs = spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 2}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(102, 0, 0)] * 1, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path)).cache()
        seen[name] = {x["doc_id"]: x["text"] for x in left.collect()}
        if name != "mixing":
            assert left.columns == docs.columns
    ids = set(range(60))
    assert ids <= seen["quality_rules"].keys() and not {106, 107} & seen["quality_rules"].keys()
    assert seen["near_dedup"].keys() == seen["quality_rules"].keys() - {100, 101}
    assert passage in seen["substring_dedup"][103] and passage not in seen["substring_dedup"][104]
    assert all(seen["substring_dedup"][i] == clean[i] for i in ids)
    assert seen["decontamination"].keys() == seen["substring_dedup"].keys() - {105}
    assert left.columns == [*docs.columns, "copy", "shuffle_key"]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, left.collect()))
