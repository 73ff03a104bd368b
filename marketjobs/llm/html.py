"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at its block-level tags. A classifier gives each block a score, the log of the odds that it is content;
the score's size is the capacity to the source (content) or to the sink (boilerplate). Blocks that follow each other, and blocks under
the same parent, are joined by smoothness edges, weaker the further apart they are in the tree. The maximum flow from source to sink
leaves the cut of least cost: what the source still reaches is content.

The classifier is a logistic regression in two parts. What the text itself shows (length, punctuation, links, place in the page, paragraph
or heading) is fitted to blocks whose part is stated by elements or names. What elements and names say of a block is evidence, with
weights fitted on top, each kind against the labels of the other: boilerplate evidence against "lies in an article", and article evidence
against "lies in boilerplate". Both are fitted to a bounded sample of the pages (FIT_PAGES), both classes weighing the same, and pulled
to fixed weights, which stand alone where a class is missing. Inside an article a name counts by the share of the class that it makes,
so that `related-work` lowers a score and does not decide; blocks of an article that nothing speaks against are always above zero.

Pages are independent rows: no shuffle, and a task holds one batch. Time is linear in a page but for the flow, which runs in
phases over its blocks and edges (at most two edges a block).

Defined results: null and empty pages give empty text; broken markup (open tags, open comments, stray ends) is read as browsers do in
the main; a page whose blocks all look like boilerplate gives empty text, unless it has an article: then all blocks of the
article that nothing speaks against are its text; repeated rows are extracted each; other columns are kept by
`extracted`, but columns named as those of its result are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>",
    re.S,
)
ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Tags and names by their part in a page.
SKIPPED = frozenset("canvas head iframe math noscript object script select style svg template textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
BOILERPLATE_TAGS = frozenset("aside button dialog footer menu nav".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad adbox ads adsbygoogle adslot adunit adv advert adverts advertisement advertising advertorial alert announcement banner billboard bookmark breadcrumb breadcrumbs byline captcha comment commentform commentlist comments consent cookie cookiebar cookies copyright cta disclaimer discussion disqus donate feedback filter flyout footer foot gdpr header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice notices notification optin overlay pager pagination paywall popup popular privacy promo promoted promotion rating recommend recommended related replies reply replyform respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar trending widget widgets".split()
)
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())
#: Parts of a class name that say nothing of what it holds.
CARRIERS = CONTENT_NAMES | frozenset("area bar block bottom box button buttons card cell col column container count form group hero icon icons inner item items left list module outer page panel posts right row section site slot top unit wrap wrapper".split())
#: Names of boilerplate that are subjects of articles as well: inside an article they count half.
AMBIGUOUS = frozenset("discussion feedback legal popular privacy rating related social trending".split())
#: Names that belong to an article if they are inside it.
OF_ARTICLE = frozenset("byline header meta tags".split())
#: A class with one of these names describes a page's layout and not the part inside.
LAYOUT_NAMES = frozenset("has is layout no with without".split())
#: Parts of a class name: at hyphens and the like, and at capitals.
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PHRASES = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b|\bsign (?:in|up)\b|\blog in\b|share this|read more|terms of (?:use|service)|privacy policy", re.I)
ENDING = ".!?…:;\"»”’)。！？"
#: Smoothness of blocks that follow each other under one parent, and of the next ones under a parent that are apart; both halve with each further step in the tree, and are
#: multiplied by BORDER where only one of the blocks is under boilerplate (by less where names say so in part).
FOLLOWS, SIBLINGS, BORDER = 2.0, 1.0, 0.1
#: The classifier is fitted to some FIT_PAGES pages, and pulled to the fixed weights with this strength, at least, or this share of the blocks.
FIT_PAGES, PULL, PULL_SHARE = 1000, 10.0, 0.005
#: What the text shows, and the weights where pages cannot be fitted. Its part of a score is at most LIMIT on either side.
TEXT = ("one", "log_words", "ends", "links", "marks", "edge", "paragraph", "heading")
FIXED_TEXT = (-2.5, 0.9, 0.8, -3.5, 2.0, -0.8, 0.5, 0.5)
LIMIT = 2.5
#: Evidence: inside an article; under a content name outside one; under an element, role or style of boilerplate; under its names; a phrase of it, outside an article.
EVIDENCE = ("article", "content", "stated", "named", "phrase")
FIXED_EVIDENCE = (4.0, 1.5, -8.0, -8.0, -2.0)
FEATURES, FIXED = TEXT + EVIDENCE, FIXED_TEXT + FIXED_EVIDENCE
PARAGRAPHS, HEADINGS = frozenset("blockquote figcaption p pre".split()), frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class Node:
    """An open element: number, parent, depth; whether an element or role puts it in boilerplate, how much names do (0 to 1), and whether it lies in an article or under a content name."""

    tag: str
    number: int
    parent: Node | None
    depth: int
    stated: bool = False
    by_form: bool = False
    named: float = 0.0
    article: bool = False
    content: bool = False

    @property
    def bad(self) -> float:
        return 1.0 if self.stated else self.named


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    in_links: int = 0
    score: float = 0.0
    main: bool = False


def name_share(parts: list[str], article: bool) -> float:
    """How much a class name speaks for boilerplate: outside an article any of its parts may, inside one by their share."""
    own = BOILERPLATE_NAMES.intersection(parts)
    if not article:
        return float(bool(own))
    own -= OF_ARTICLE
    if not own:
        return 0.0
    share = len(own) / len(own.union(parts) - (CARRIERS - own))
    return share / 2 if own <= AMBIGUOUS else share


def opened(tag: str, attrs: str, number: int, parent: Node) -> Node:
    node = Node(tag, number, parent, parent.depth + 1, parent.stated, parent.by_form, parent.named, parent.article, parent.content)
    if tag in ("article", "main"):
        if node.by_form or tag == "main":
            node.stated, node.by_form, node.named = False, False, 0.0
        node.article = node.article or not node.bad
    elif tag in BOILERPLATE_TAGS or tag == "header" and not node.article:
        node.stated, node.by_form = True, False
    elif tag == "form" and not node.stated:
        node.stated = node.by_form = True
    if attrs and tag not in ("body", "html"):
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                for word in value.split():
                    parts = [x.lower() for x in NAME.findall(word)]
                    if LAYOUT_NAMES.intersection(parts):
                        continue
                    share = name_share(parts, node.article) if tag != "main" else 0.0
                    node.named = max(node.named, share)
                    node.content = node.content or not share and not CONTENT_NAMES.isdisjoint(parts)
                continue
            value = value.lower()
            if name == "role" and value in BOILERPLATE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                node.stated, node.by_form = True, False
            elif name == "role" and value in ("main", "article"):
                node.article = node.article or not node.bad
    return node


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, unlabelled."""
    out: list[Block] = []
    node = root = Node("", 0, None, 0)
    pieces: list[str] = []
    count = links = in_links = at = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, node, min(links, len(text))))
            pieces.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        raw = entities.unescape(raw) if "&" in raw else raw
        pieces.append(raw)
        if in_links:
            links += len(raw.strip())

    def close(tag: str) -> None:
        nonlocal node
        up = node
        while up is not root and up.tag != tag:
            up = up.parent
        if up is not root:
            node = up.parent

    def find(what: str, at: int) -> int:
        """Place of `what` from `at` on; what is not there is looked for once."""
        if what in missing:
            return -1
        place = low.find(what, at)
        if place < 0:
            missing.add(what)
        return place

    size, low, missing = len(page), None, set()
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        tag, end = m["name"].lower(), m["end"]
        if tag in SKIPPED:
            if not end and not m["attrs"].endswith("/"):
                low = low or page.replace("İ", "ı").lower()  # as long as the page: İ is the only letter that lower() makes longer
                stop = find(f"</{tag}", at)
                if tag == "head" and (body := find("<body", at)) >= 0 and (stop < 0 or body < stop):
                    stop = body  # head may stay open
                    at = stop
                    continue
                at = size if stop < 0 and tag != "head" else at if stop < 0 else (find(">", stop) + 1 or size)
        elif tag == "a":
            in_links = 0 if end else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in INLINE:
            continue
        elif end:
            flush()
            close(tag)
        else:
            flush()
            if tag in ENDS_P and node.tag == "p" or tag == node.tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                node = node.parent
            count += 1
            node = opened(tag, m["attrs"], count, node)
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page: edge is 0 in the middle of the page's text and 1 at its ends."""
    out, total, before = np.zeros((len(found), len(FEATURES))), sum(len(b.text) for b in found), 0
    for row, b in zip(out, found, strict=True):
        text, size, node = b.text, len(b.text), b.node
        words = text.count(" ") + 1
        marks = sum(map(text.count, ",.;:!?")) / words
        edge = abs(2 * (before + size / 2) / total - 1)
        phrase = not node.article and size < 200 and PHRASES.search(text) is not None
        shown = (1.0, math.log(words), text[-1] in ENDING, b.in_links / size, min(marks, 0.5), edge, node.tag in PARAGRAPHS, node.tag in HEADINGS)
        row[:] = (*shown, node.article, node.content and not node.article, node.stated, 0.0 if node.stated else node.named, phrase)
        before += size
    return out


def shown(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The part of scores that the text gives."""
    return np.clip(x[:, : len(TEXT)] @ weights[: len(TEXT)], -LIMIT, LIMIT)


def scores(found: list[Block], weights: np.ndarray) -> list[float]:
    x = features(found)
    return (shown(x, weights) + x[:, len(TEXT) :] @ weights[len(TEXT) :]).tolist()


def regression(x: np.ndarray, y: np.ndarray, fixed: np.ndarray, offset: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights of a logistic regression beside an offset, both classes weighing the same, pulled towards fixed; fixed if a class is missing."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if not n.all():
        return fixed
    pull, share, w = max(PULL, PULL_SHARE * len(y)), (len(y) / (2 * n))[y.astype(int)], fixed.copy()
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        slope = x.T @ (share * (y - p)) - pull * (w - fixed)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


def weights_of(x: np.ndarray) -> np.ndarray:
    """Weights from rows of FEATURES, a row for each block of which elements or names say something. Blocks of an article with evidence against them have no label."""
    column, k = {f: x[:, i] for i, f in enumerate(FEATURES)}, len(TEXT)
    article, bad = column["article"] > 0, (column["stated"] > 0) | (column["named"] > 0)
    known = article != bad
    out = np.array(FIXED)
    out[:k] = regression(x[known, :k], article[known].astype(float), out[:k])
    base, kinds = shown(x, out), np.array([f in ("article", "content") for f in EVIDENCE])
    for own, label in ((~kinds, article), (kinds, ~bad)):
        out[k:][own] = regression(x[known, k:][:, own], label[known].astype(float), out[k:][own], base[known])
    return out


def fitted(pages: DataFrame, most: int = FIT_PAGES) -> np.ndarray:
    """Weights of FEATURES, from the blocks of some `most` different pages, chosen by a hash of the page and so at random; at most 64 blocks a page. Reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column("html"):
                found = blocks(page.as_py() or "")
                known = [i for i, b in enumerate(found) if b.node.bad or b.node.article]
                rows += features(found)[known[:: max(1, -(-len(known) // 64))]].tolist()
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64()))], names=["row"])

    h = F.pmod(F.xxhash64("html"), F.lit(1 << 30))
    total = pages.count()
    some = pages.select("html").where(h < math.ceil((1 << 30) * min(1.0, most / max(1, total)))).distinct()
    some = some.orderBy(h, "html").limit(2 * most).repartition(8, "html")
    rows = sorted(r.row for r in some.mapInArrow(run, "row array<double>").collect())
    return weights_of(np.array(rows).reshape(-1, len(FEATURES)))


def apart(a: Node, b: Node) -> int:
    """Steps between two elements of the tree, at most 8."""
    n = 0
    while a is not b and n < 8:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}

    def join(a: int, b: int, weight: float) -> None:
        out.append((a, b, weight * (1 - (1 - BORDER) * abs(found[a].node.bad - found[b].node.bad))))

    for i, b in enumerate(found):
        if i:
            join(i - 1, i, FOLLOWS / 2 ** max(0, apart(found[i - 1].node, b.node) - 2))
        up = b.node.parent.number if b.node.parent is not None else -1
        if up in last and last[up] < i - 1:
            join(last[up], i, SIBLINGS)
        last[up] = i
    return out


def min_cut(scores: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it is on the source's side of the minimum cut. Positive scores hang on the source, negative on the sink.

    Dinic's phases: levels from all nodes that can still get flow, then augmenting paths along rising levels.
    """
    n = len(scores)
    if min(scores, default=0.0) >= 0 or max(scores, default=0.0) <= 0:
        return [s > 0 for s in scores]
    head: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in joined:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]  # both ways
    supply, demand = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]
    eps = 1e-9
    while True:
        level = [0 if s > eps else -1 for s in supply]
        queue = deque(i for i in range(n) if level[i] == 0)
        found = False
        while queue:
            u = queue.popleft()
            found = found or demand[u] > eps
            for e in head[u]:
                if room[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not found:
            return [x >= 0 for x in level]
        turn = [0] * n
        for source in range(n):
            while level[source] == 0 and supply[source] > eps:
                path, u = [], source
                while demand[u] <= eps:
                    while turn[u] < len(head[u]) and not (room[e := head[u][turn[u]]] > eps and level[to[e]] == level[u] + 1):
                        turn[u] += 1
                    if turn[u] < len(head[u]):
                        path.append(head[u][turn[u]])
                        u = to[path[-1]]
                    elif path:
                        u = to[path.pop() ^ 1]
                        turn[u] += 1
                    else:
                        break
                if demand[u] <= eps:
                    break
                flow = min([supply[source], demand[u], *(room[e] for e in path)])
                supply[source] -= flow
                demand[u] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def labelled(page: str, weights: np.ndarray | None = None) -> list[Block]:
    found = blocks(page)
    for b, x in zip(found, scores(found, np.array(FIXED) if weights is None else weights) if found else [], strict=True):
        b.score = x
    for b, main in zip(found, min_cut([b.score for b in found], edges(found)), strict=True):
        b.main = main
    if not any(b.main for b in found):
        for b in found:
            b.main = b.node.article and not b.node.bad
    return found


ADDED = {"text": "string", "n_chars": "long", "n_blocks": "int", "n_main": "int", "n_changed": "int"}


def extracted(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """pages (html and other columns) with the columns of ADDED instead of html. weights: of FEATURES; without them they are fitted to the pages.

    n_changed: blocks whose label the cut changes against the sign of their score.
    """
    weights = fitted(pages) if weights is None else weights
    others = [f for f in pages.schema.fields if f.name not in ("html", *ADDED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for page in batch.column("html"):
                found = labelled(page.as_py() or "", weights)
                texts.append(" ".join(b.text for b in found if b.main))
                counts.append((len(texts[-1]), len(found), sum(b.main for b in found), sum(b.main != (b.score > 0) for b in found)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            numbers = [pa.array([c[k] for c in counts], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([*(batch.column(f.name) for f in others), pa.array(texts, pa.string()), *numbers], names=[*(f.name for f in others), *ADDED])

    kept = [F.col(f"`{f.name}`") for f in others]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"{n} {t}" for n, t in ADDED.items())])
    return pages.select(*kept, "html").mapInArrow(run, schema)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
