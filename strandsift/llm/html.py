"""Main text of web pages by wrapper induction.

Pages of one host come from the same templates.  Each page is parsed into a tree of its block elements; repeated siblings
(paragraphs, list items, records of one structure) are one node, which leaves a small skeleton.  The skeletons of a host
are laid over one another by simple tree matching, one after another, into one template tree.  A node's texts over all
different pages then tell what it is: a text that most pages with the node have there is template, the others vary, and
so the node is a slot.  The part of the template that holds most of the varying text outside links is the host's article;
what lies outside of it, constant texts inside it, and slots that mostly hold links are not content.

Tag and class names only break ties: a varying part inside the article whose name says advert, comments, form or the
like is left out, and doesn't count when the article is looked for.  A page whose host has no other page, or that lacks
the host's article, is judged by these names alone.

Scale: html is parsed inside tasks, a page at a time, and leaves them as a skeleton and hashes of its texts by node.
Equal pages are one.  Skeletons are counted first and then folded in sorted runs, a salted run at a time and then the
runs of a host, so a task holds one template and never all of a host; counts are partial sums by host, node and text.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import drop, durable

BROADCAST_HOSTS = 20_000
#: Runs that the skeletons of one host are folded in.
RUNS = 64
#: A text that this share of the different pages with its node has there is template (two pages at least).  Inside the
#: article nearly all pages, and LEAST of them, must have it, and such texts are no more than half of the article: pages
#: may be copies of one another.
CONSTANT = 0.6
CONSTANT_IN_MAIN = 0.95
LEAST = 5
#: The article holds this share of a host's varying text.
MOST = 0.7
#: Siblings of one name that stay nodes of their own; more of them are a list, and one node.
SIBLINGS_APART = 16

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")

#: Elements whose whole content is no text of the page.  Where the end tag is missing, script and style reach to the end
#: of the page; of the others the tag alone is left out, so an open button or select swallows nothing.
RAW = frozenset("script style noscript template svg iframe textarea select button object math title".split())
TO_END = frozenset(("script", "style"))
IN_HEAD = frozenset("base link meta noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table td th body html div section article".split())
#: Elements that hold text and are repeated: those of one name in one parent are one node.
TEXTUAL = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot figure header hgroup".split())
NEVER = frozenset("nav footer aside form menu dialog fieldset head".split())
MAIN = frozenset(("article", "main"))
UNWANTED = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|alert|newsletter|subscribe"
    r"|subscription|signup|login|sidebar|side|rail|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|masthead|comment|comments|commentlist|disqus|reply|replies|respond"
    r"|share|sharing|social|related|recommended|popular|widget|popup|modal|overlay|pagination|pager|toolbar|skip|copyright|outbrain|taboola|search|tags|hidden)(?:$|[-_\s])",
    re.I,
)
#: Words of a layout, not of the part that bears them: "with-sidebar", "no-ads".
_LAYOUT = re.compile(r"(?:^|\s)(?:with|has|no|without|show|hide|is)[-_]\S*", re.I)
SITE_HEADER = re.compile(r"(?:^|[-_\s])(?:header|site-header|page-header|topbar|top)(?:$|[-_\s])", re.I)
ROLES = re.compile(r"@(?:navigation|banner|contentinfo|complementary|search|form|alert)")


@lru_cache(8192)
def _signature(tag: str, attrs: str) -> str:
    """A node's name: tag, class and id without digits, role; '!' marks a hidden one."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag
    words, hidden = [], ""
    for name, *value in _ATTR.findall(attrs):
        v = next((x for x in value if x), "").lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and v == "true"):
            hidden = "!"
        elif v:
            words.append({"class": ".", "id": "#", "role": "@", "itemprop": "%"}.get(name, "?") + re.sub(r"\d+", "", v))
    return tag + "".join(sorted(words)) + hidden


@lru_cache(8192)
def tag_of(name: str) -> str:
    return re.match(r"[a-z0-9:-]*", name)[0]


@lru_cache(8192)
def is_main(name: str) -> bool:
    return tag_of(name) in MAIN or "@main" in name or "%articlebody" in name


@lru_cache(8192)
def unwanted(name: str, inside: bool = True) -> int:
    """2 for a part that is never in an article, 1 for one whose name says so but that may be a wrapper, else 0; a header
    is part of an article that it is ``inside`` of."""
    tag = tag_of(name)
    if name.endswith("!") or tag in NEVER and tag != "form" or (tag == "header" and not inside):
        return 2
    if tag in ("", "html", "body"):
        return 0
    words = _LAYOUT.sub(" ", re.sub(r"[.#@%]", " ", name[len(tag) :]))
    return int(tag == "form" or bool(UNWANTED.search(words)) or (not inside and bool(SITE_HEADER.search(words))) or bool(ROLES.search(name)))


class Page:
    """A parsed page: its nodes in document order by parent and name (the first is the root), and the runs of text
    between block boundaries as (node, text, characters in links)."""

    __slots__ = ("blocks", "name", "parent")

    def __init__(self):
        self.parent, self.name, self.blocks = [-1], [""], []


def parse(page: str | None) -> Page:
    """The block elements and texts of a page; scripts, styles, comments and markup are left out."""
    page = page or ""
    out = Page()
    tags: list[str] = []
    nodes: list[int] = [0]
    text: list[str] = []
    missing: set[str] = set()
    links = depth = at = 0

    def flush() -> None:
        nonlocal links
        if text:
            t = "".join(text)
            if "&" in t:
                t = htmllib.unescape(t)
            t = _SPACE.sub(" ", t).strip()
            if t:
                out.blocks.append((nodes[-1], t, min(links, len(t))))
            text.clear()
        links = 0

    def pop(n: int) -> None:
        del tags[n:], nodes[n + 1 :]

    m = _TOKEN.search(page)
    while m:
        if m.start() > at:
            text.append(page[at : m.start()])
            if depth:
                links += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag:
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    depth = 0 if m["end"] else 1
            elif tag in RAW:
                if not m["end"] and tag not in missing:
                    close = _closing(tag).search(page, at)
                    if close and not close["again"]:
                        at = close.end()
                    elif not close:
                        missing.add(tag)
                        at = len(page) if tag in TO_END else at
                text.append(" ")
            else:
                flush()
                if tags and tags[-1] == "head" and tag not in IN_HEAD:
                    pop(len(tags) - 1)
                if m["end"]:
                    if tag in tags:
                        pop(len(tags) - 1 - tags[::-1].index(tag))
                        depth = 0
                else:
                    if tag in CLOSES_P and "p" in tags[-2:]:
                        pop(len(tags) - 1 - tags[::-1].index("p"))
                    if near := SIBLINGS.get(tag):
                        for i in range(len(tags) - 1, -1, -1):
                            if tags[i] in near:
                                pop(i)
                                break
                            if tags[i] in FENCES and tags[i] not in ("td", "th"):
                                break
                    if not (tag in VOID or m["attrs"].endswith("/") and tag not in ("p", "div")):
                        tags.append(tag)
                        out.parent.append(nodes[-1])
                        out.name.append(_signature(tag, m["attrs"]))
                        nodes.append(len(out.name) - 1)
        m = _TOKEN.search(page, at)
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


@lru_cache(64)
def _closing(tag: str) -> re.Pattern:
    """The end tag of a raw element; a button or select that begins anew before it closes the one before."""
    again = rf"|(?P<again><{tag}\b)" if tag in ("button", "select", "textarea", "title") else "|(?P<again>(?!))"
    return re.compile(rf"</{tag}\s*>{again}", re.I)


def skeleton(page: Page) -> tuple[list[tuple[int, str]], list[int]]:
    """The nodes that hold text and those above them, repeated siblings as one, by parent and name in document order of
    levels; and the node of the skeleton for each node of the page (-1: none)."""
    n = len(page.name)
    alive = [False] * n
    for i, _, _ in page.blocks:
        alive[i] = True
    kids: list[list[int]] = [[] for _ in range(n)]
    inner: list[set] = [set() for _ in range(n)]
    shape = [0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        if alive[i]:
            shape[i] = hash((page.name[i], frozenset(inner[i])))
            if i:
                p = page.parent[i]
                alive[p] = True
                inner[p].add(shape[i])
                kids[p].append(i)
    out: list[tuple[int, str]] = [(-1, "")]
    of = [-1] * n
    of[0] = 0
    members: list[list[int]] = [[0]]
    at = 0
    while at < len(out):
        groups: dict = {}
        for i in members[at]:
            for c in reversed(kids[i]):
                name = page.name[c]
                groups.setdefault(name if tag_of(name) in TEXTUAL else (name, shape[c]), []).append(c)
        if len(groups) > SIBLINGS_APART:
            often: dict[str, int] = {}
            for g in groups.values():
                often[page.name[g[0]]] = often.get(page.name[g[0]], 0) + 1
            merged: dict = {}
            for key, g in groups.items():
                name = page.name[g[0]]
                merged.setdefault(name if often[name] > SIBLINGS_APART else key, []).extend(g)
            groups = merged
        for g in groups.values():
            for c in g:
                of[c] = len(out)
            out.append((at, page.name[g[0]]))
            members.append(g)
        at += 1
    return out, of


def _children(tree: list[tuple[int, str]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in tree]
    for i, (p, _) in enumerate(tree):
        if p >= 0:
            out[p].append(i)
    return out


def match(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of nodes of two trees that keep tags, levels and order, the roots first, with the
    largest total weight; a pair weighs 2 where the whole names are equal, else 1.

    Trees are lists of (parent, name), parents first.  Pairs that may match are listed level by level and weighed from
    the last to the first, so nothing recurses; children in the same order with equal names are paired at once.
    """
    ka, kb = _children(a), _children(b)
    pairs: list[tuple[int, int]] = [(0, 0)]
    below: list[list[tuple[int, int, int]]] = []  # of each pair: (place of the child in a, in b, pair)
    at = 0
    while at < len(pairs):
        i, j = pairs[at]
        ca, cb = ka[i], kb[j]
        own = []
        if [a[x][1] for x in ca] == [b[y][1] for y in cb]:
            for k, (x, y) in enumerate(zip(ca, cb, strict=True)):
                own.append((k, k, len(pairs)))
                pairs.append((x, y))
        else:
            strict = len(ca) * len(cb) > 10_000
            for k, x in enumerate(ca):
                tag, name = tag_of(a[x][1]), a[x][1]
                for h, y in enumerate(cb):
                    if name == b[y][1] or not strict and tag == tag_of(b[y][1]):
                        own.append((k, h, len(pairs)))
                        pairs.append((x, y))
        below.append(own)
        at += 1
    weight = [0] * len(pairs)
    chosen: list[list[int]] = [[] for _ in pairs]
    for p in range(len(pairs) - 1, -1, -1):
        i, j = pairs[p]
        weight[p], chosen[p] = _best(below[p], weight, len(kb[j]))
        weight[p] += 1 + (a[i][1] == b[j][1])
    out, todo = [], [0]
    while todo:
        p = todo.pop()
        out.append(pairs[p])
        todo.extend(chosen[p])
    return sorted(out)


def _best(own: list[tuple[int, int, int]], weight: list[int], width: int) -> tuple[int, list[int]]:
    """The heaviest set of child pairs that keeps the order on both sides."""
    if all(k == h for k, h, _ in own) and len({k for k, _, _ in own}) == len(own):
        return sum(weight[q] for _, _, q in own), [q for _, _, q in own]
    best: list[tuple[int, tuple | None]] = [(0, None)] * (width + 1)  # by children of b used so far: weight, chain of pairs
    at = 0
    while at < len(own):
        k = own[at][0]
        new = list(best)
        while at < len(own) and own[at][0] == k:
            _, h, q = own[at]
            got = best[h][0] + weight[q]
            if got > new[h + 1][0]:
                new[h + 1] = (got, (q, best[h][1]))
            at += 1
        for h in range(1, width + 1):
            if new[h][0] < new[h - 1][0]:
                new[h] = new[h - 1]
        best = new
    total, chain = best[width]
    picked = []
    while chain:
        picked.append(chain[0])
        chain = chain[1]
    return total, picked[::-1]


def aligned(template: list[tuple[int, str]], tree: list[tuple[int, str]]) -> list[int]:
    """The template's node for each node of a tree; -1 where there is none."""
    if template == tree:
        return list(range(len(tree)))
    of = [-1] * len(tree)
    for t, s in match(template, tree):
        of[s] = t
    return of


def merged(template: list[tuple[int, str]], tree: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """A template that also has the nodes of ``tree`` that match none of its own: each behind the sibling before it."""
    of = aligned(template, tree)
    if min(of) >= 0:
        return template
    kids, names = _children(template), [n for _, n in template]
    last: dict[int, int] = {}  # the template's node of the sibling before, by the template's parent
    for i, (p, name) in enumerate(tree):
        if i == 0:
            continue
        above = of[p]
        if of[i] < 0:
            of[i] = len(names)
            names.append(name)
            kids.append([])
            kids[above].insert(kids[above].index(last[above]) + 1 if above in last else 0, of[i])
        last[above] = of[i]
    out: list[tuple[int, str]] = [(-1, names[0])]
    order = [0]
    at = 0
    while at < len(order):
        for c in kids[order[at]]:
            out.append((at, names[c]))
            order.append(c)
        at += 1
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def outline(page: str | None) -> tuple[list[tuple[int, str]], dict[tuple[int, int], list[int]]]:
    """The skeleton of a page, and by node and hash of the text the characters and those in links."""
    parsed = parse(page)
    tree, of = skeleton(parsed)
    texts: dict[tuple[int, int], list[int]] = {}
    for i, t, links in parsed.blocks:
        x = texts.setdefault((of[i], _hash(t)), [0, 0])
        x[0] += len(t)
        x[1] += links
    return tree, texts


def _names_alone(names: list[str], parents: list[int], wraps: list[bool], top: int = 0) -> list[bool]:
    """Which nodes are in an unwanted part by their names; nodes in ``wraps`` hold the article and are no such part for a
    name that may be a wrapper's.  ``top`` counts as the beginning of an article."""
    bad, inside = [False] * len(names), [False] * len(names)
    for i, name in enumerate(names):
        p = parents[i]
        within = p >= 0 and inside[p]
        level = 0 if i == top else unwanted(name, within or bool(top))
        bad[i] = p >= 0 and bad[p] and i != top or level == 2 or level == 1 and not wraps[i]
        inside[i] = within or is_main(name)
    return bad


def _above(parents: list[int], marked: list[bool]) -> list[bool]:
    """The marked nodes and all nodes above one."""
    out = list(marked)
    for i in range(len(parents) - 1, 0, -1):
        if out[i]:
            out[parents[i]] = True
    return out


def article(tree: list[tuple[int, str]], varying: dict[int, int]) -> int:
    """The node of a template that is the article: the lowest one with MOST of the varying text, or the one around it where
    that is a mere paragraph or list or where only headings and paragraphs are added; -1 where nothing varies."""
    parents, names = [p for p, _ in tree], [n for _, n in tree]
    bad = _names_alone(names, parents, _above(parents, [is_main(n) for n in names]))
    own = [0 if bad[i] else varying.get(i, 0) for i in range(len(tree))]
    if not sum(own):
        own = [varying.get(i, 0) for i in range(len(tree))]
    sums = list(own)
    for i in range(len(tree) - 1, 0, -1):
        sums[parents[i]] += sums[i]
    if not sums[0]:
        return -1
    kids = _children(tree)
    r = 0
    while kids[r] and sums[c := max(kids[r], key=lambda x: (sums[x], -x))] >= MOST * sums[0]:
        r = c
    while r > 0 and tag_of(names[r]) in TEXTUAL | LISTS:
        r = parents[r]
    while r > 0:
        others, plain = [c for c in kids[parents[r]] if c != r and sums[c]], True
        while others and plain:
            c = others.pop()
            plain = tag_of(names[c]) in TEXTUAL | LISTS
            others += [x for x in kids[c] if sums[x]]
        if not plain or sums[parents[r]] == sums[r]:
            break
        r = parents[r]
    return r


def decide(tree: list[tuple[int, str]], slots: dict[int, dict]) -> dict:
    """What a template says: its tree, the node of the article, and by node inside it whether its slot is content and which
    texts are constant.  ``slots`` has size, links, varying and constant [(text hash, size)] by node.

    Where a page marks its article, headings that all pages share and lists of links are parts of it like others."""
    top = article(tree, {i: s["varying"] for i, s in slots.items()})
    out: dict = {"tree": tree, "article": top, "nodes": {}}
    if top < 0:
        return out
    inside = [i == top for i in range(len(tree))]
    for i, (p, _) in enumerate(tree):
        inside[i] = inside[i] or p >= 0 and inside[p]
    mine = {i: s for i, s in slots.items() if inside[i]}
    names, up = [n for _, n in tree], top
    while up >= 0 and not is_main(names[up]):
        up = tree[up][0]
    own = {i for i in mine if up >= 0 and tag_of(names[i]) in HEADINGS | ITEMS}
    content = {i: i in own or s["links"] <= 0.5 * s["size"] for i, s in mine.items()}
    total = sum(s["size"] for i, s in mine.items() if content[i])
    fixed = sum(size for i, s in mine.items() if content[i] and i not in own for _, size in s["constant"])
    for i, s in mine.items():
        texts = sorted(t for t, _ in s["constant"]) if 2 * fixed <= total and i not in own else []
        if texts or not content[i]:
            out["nodes"][str(i)] = [content[i], texts]
    return out


def _wanted(page: Page, tree: list[tuple[int, str]], template: dict) -> tuple[list[bool], list[frozenset]] | None:
    """By node of a skeleton whether the template takes it for content, and the constant texts; None where the page lacks
    the article."""
    of = aligned(template["tree"], tree)
    top = template["article"]
    if top not in of:
        return None
    at = of.index(top)
    parents, names = [p for p, _ in tree], [n for _, n in tree]
    inside = [i == at for i in range(len(tree))]
    for i, p in enumerate(parents):
        inside[i] = inside[i] or p >= 0 and inside[p]
    bad = _names_alone(names, parents, [False] * len(tree), at)
    info = [template["nodes"].get(str(t), (True, ())) for t in of]
    return [inside[i] and not bad[i] and info[i][0] for i in range(len(tree))], [frozenset(x[1]) for x in info]


def by_names(page: Page) -> str:
    """The main text by names alone: the article where one is marked, else what isn't in an unwanted part or in links."""
    marked = [is_main(n) for n in page.name]
    bad = _names_alone(page.name, page.parent, _above(page.parent, marked))
    main = list(marked)
    for i, p in enumerate(page.parent):
        main[i] = main[i] or p >= 0 and main[p]
    scope = any(main[i] and not bad[i] for i, _, _ in page.blocks)
    return "\n\n".join(t for i, t, links in page.blocks if not bad[i] and (main[i] if scope else links <= 0.5 * len(t)))


def main_text(page: str | None, template: dict | None = None, known: dict | None = None) -> str:
    """The article's blocks, joined by an empty line.  ``known`` keeps what a template says of skeletons."""
    parsed = parse(page)
    if not parsed.blocks:
        return ""
    if template and template["article"] >= 0:
        tree, of = skeleton(parsed)
        key = tuple(tree)
        if known is None or key not in known:
            found = _wanted(parsed, tree, template)
            if known is not None:
                known[key] = found
        else:
            found = known[key]
        if found:
            wanted, fixed = found
            kept = [t for i, t, _ in parsed.blocks if wanted[s := of[i]] and not (fixed[s] and _hash(t) in fixed[s])]
            if kept:
                return "\n\n".join(kept)
    return by_names(parsed)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _outlines(pages: DataFrame) -> DataFrame:
    """(host, page, shape, tree, texts): a hash of the page's outline, one of its skeleton, the skeleton, and its texts."""
    item = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64()), ("size", pa.int64()), ("links", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                keys, shapes, trees, texts = [], [], [], []
                for p in part.column("html"):
                    tree, found = outline(p.as_py())
                    trees.append(json.dumps(tree, separators=(",", ":")))
                    shapes.append(_hash(trees[-1]))
                    rows = sorted(found.items())
                    keys.append(hashlib.blake2b(repr((shapes[-1], [k for k, _ in rows])).encode(), digest_size=16).digest())
                    texts.append([{"node": n, "text": t, "size": s, "links": x} for (n, t), (s, x) in rows])
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array(keys, pa.binary()), pa.array(shapes, pa.int64()), pa.array(trees, pa.string()), pa.array(texts, item)],
                    ["host", "page", "shape", "tree", "texts"],
                )

    kind = "host string, page binary, shape long, tree string, texts array<struct<node:int,text:long,size:long,links:long>>"
    return pages.select("host", "html").mapInArrow(run, kind)


def _folded(trees: DataFrame, *by: str) -> DataFrame:
    """(by, shape, pages, tree): the trees of each run, merged in the order of pages (most first) and shape."""
    keys = [*by, "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, head, pages = None, None, 0, 0
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows = list(zip(*done, strict=True)) or [()] * (len(by) + 3)
            kinds = [*(pa.string() if c == "host" else pa.int32() for c in by), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], [*keys, "pages", "tree"])

        for b in batches:
            for row in b.to_pylist():
                own = tuple(row[c] for c in by)
                new = [tuple(x) for x in json.loads(row["tree"])]
                if own != key:
                    if key is not None:
                        done.append((*key, head, pages, json.dumps(tree, separators=(",", ":"))))
                        if len(done) >= 256:
                            yield flush()
                            done.clear()
                    key, tree, head, pages = own, new, row["shape"], row["pages"]
                else:
                    tree, pages = merged(tree, new), pages + row["pages"]
        if key is not None:
            done.append((*key, head, pages, json.dumps(tree, separators=(",", ":"))))
        yield flush()

    run_sorted = trees.select(*keys, "pages", "tree").repartition(*by).sortWithinPartitions(*by, F.desc("pages"), "shape")
    return run_sorted.mapInArrow(run, ", ".join([*(f"{c} {'string' if c == 'host' else 'int'}" for c in by), "shape long, pages long, tree string"]))


def _aligned_shapes(shapes: DataFrame, trees: DataFrame) -> DataFrame:
    """(host, shape, of): the template's node for each node of each skeleton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select(["template", "tree"]).to_pylist()
            of = [aligned([tuple(x) for x in json.loads(r["template"])], [tuple(x) for x in json.loads(r["tree"])]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("shape"), b.column("pages"), pa.array(of, pa.list_(pa.int32()))], ["host", "shape", "pages", "of"])

    both = shapes.join(trees.select("host", F.col("tree").alias("template")), "host")
    return both.select("host", "shape", "pages", "tree", "template").mapInArrow(run, "host string, shape long, pages long, of array<int>")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) from (host, html), over all pages, for hosts with two different pages at least."""
    different = durable(_outlines(pages).dropDuplicates(["host", "page"]), "outlines")
    shapes = durable(different.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.first("tree").alias("tree")), "skeletons")
    runs = _folded(shapes.withColumn("run", F.pmod("shape", F.lit(RUNS)).cast("int")), "host", "run")
    trees = durable(_folded(runs, "host").where("pages > 1"), "trees")
    of = durable(_aligned_shapes(shapes, trees), "aligned")
    having = of.select("host", "pages", F.explode("of").alias("node")).where("node >= 0").groupBy("host", "node").agg(F.sum("pages").alias("pages"))
    cells = different.select("host", "shape", F.explode("texts").alias("x")).join(of.select("host", "shape", "of"), ["host", "shape"])
    cells = cells.select("host", F.get("of", F.col("x.node")).alias("node"), "x.text", "x.size", "x.links").where("node >= 0")
    cells = cells.groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    cells = cells.join(having, ["host", "node"])
    often = (F.col("n") >= 2) & (F.col("n") >= CONSTANT * F.col("pages"))
    always = (F.col("n") >= LEAST) & (F.col("n") >= CONSTANT_IN_MAIN * F.col("pages"))
    slots = cells.groupBy("host", "node").agg(
        F.sum("size").alias("size"),
        F.sum("links").alias("links"),
        F.sum(F.when(often, 0).otherwise(F.col("size") - F.col("links"))).alias("varying"),
        F.collect_list(F.when(always, F.struct("text", "size"))).alias("constant"),
    )

    def write(tree: str, rows: list | None) -> str:
        found = {r["node"]: {"size": r["size"], "links": r["links"], "varying": r["varying"], "constant": [(x["text"], x["size"]) for x in r["constant"]]} for r in rows or []}
        return json.dumps(decide([tuple(x) for x in json.loads(tree)], found), separators=(",", ":"))

    by_host = slots.groupBy("host").agg(F.collect_list(F.struct("node", "size", "links", "varying", "constant")).alias("slots"))
    out = durable(trees.join(by_host, "host").select("host", F.udf(write, "string")("tree", "slots").alias("template")), "templates")
    drop(different, shapes, trees, of)
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (blocks joined by an empty line), n_chars (code points of text).

    Character references are decoded; white space inside a block is one space.

    Defined cases: a null or empty page, or one without content, has an empty text; pages with a null or odd url
    share one host; null and repeated page_ids are returned as they are; an empty table gives an empty result; tags may
    be nested to any depth and may lack their ends; other columns are not read.
    """
    kinds = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    known = templates(slim)
    hosts, size = known.agg(F.count("*"), F.sum(F.length("template"))).first()
    small = hosts <= BROADCAST_HOSTS and (size or 0) <= 32 << 20
    if small:  # a bounded table: the workers get it once, not a copy with every page
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in known.collect()})
        joined = slim.withColumn("template", F.lit(None).cast("string"))
    else:
        sent = None
        joined = slim.join(known, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, tuple] = {}
        for b in batches:
            texts = []
            for page, host, template in zip(b.column("html"), b.column("host"), b.column("template"), strict=True):
                t = template.as_py() or sent and sent.value.get(host.as_py())
                if t not in read:
                    if len(read) > 256:
                        read = {}
                    found = json.loads(t) if t else None
                    if found:
                        found["tree"] = [tuple(x) for x in found["tree"]]
                    read[t] = (found, {})
                found, shapes = read[t]
                if len(shapes) > 1024:
                    shapes.clear()
                texts.append(main_text(page.as_py(), found, shapes))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "host", "template").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
