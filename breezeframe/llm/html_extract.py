"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded from the root down.

Each page is parsed into a tree; every element has features of its tag, its attribute
tokens and those of its ancestors, its depth, its place and share among its siblings,
and the text, link and tag density of its subtree. Trees fitted by Spark ML on labelled
sample pages (`html_samples`) give the chance that a subtree holds main text. Decoding
takes the labelling of the whole tree with the highest likelihood in which no element
is kept below a dropped one, so an ancestor and its descendants never contradict each
other. The text of kept elements is emitted in page order.

Block elements and line breaks separate blocks; inline elements do not. Scripts,
styles and other elements that show no text are skipped by their tags.

Nulls and ties: a null or empty page gives an empty text; markup without end, stray end
tags and unclosed elements are read as browsers do, roughly; a very long page is read in
linear time; repeated rows have equal results. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_samples import sample_pages

#: Sample pages that train the model, and its size.
SAMPLE_PAGES, TREES, DEPTH = 800, 25, 5

#: A tag from its < on. Quotes count after = only; no part can give back what it took, so a tag is read once.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Classes of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SILENT = RAW | frozenset("head svg math object canvas audio video select option button datalist map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody thead tr body article div section form".split())

#: Words of class, id and role that tell what an element is for.
GROUPS = {
    "main": "article content post entry body story main text prose",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager",
    "header": "header masthead topbar top brand logo",
    "footer": "footer copyright legal colophon bottom",
    "side": "sidebar side aside rail widget related recommended more trending popular teaser",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "comments": "comment comments disqus reply replies respond responses discussion",
    "share": "share sharing social follow",
    "form": "search login form contact",
    "frame": "page wrapper container site",
}
GROUP_OF = {w: k for k, words in enumerate(GROUPS.values()) for w in words.split()}
TAGS = {t: k for k, ts in enumerate(("article main", "nav menu", "header", "footer", "aside", "form fieldset label", "div section", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody tr td th", "blockquote pre figure figcaption", "html body", "a", "b i em strong span")) for t in ts.split()}
N_TAGS, N_GROUPS = 17, len(GROUPS)
#: Tags from article to form are also features of all that stands in them.
N_ABOVE = 6
NUMERIC = ("depth", "place", "siblings", "children", "chars", "words", "share", "links", "density", "punctuation", "starts", "sibling_chars", "same_tag", "own_chars", "commas")
N_FEATURES = N_TAGS + 2 * N_GROUPS + N_ABOVE + len(NUMERIC)
ROOT = 0


class Page:
    """A parsed page: its elements as parallel lists in page order, and its text runs.

    A run is (element, text); a block's edge has None for its text.
    """

    __slots__ = ("parent", "tags", "attrs", "index", "children", "silent", "inline", "runs")

    def __init__(self) -> None:
        self.parent, self.tags, self.attrs, self.index, self.children = [-1], ["html"], [""], [0], [0]
        self.silent, self.inline, self.runs = [False], [False], []

    def add(self, tag: str, attrs: str, parent: int) -> int:
        self.parent.append(parent)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.index.append(self.children[parent])
        self.children[parent] += 1
        self.children.append(0)
        self.silent.append(self.silent[parent] or tag in SILENT)
        self.inline.append(tag in INLINE)
        return len(self.tags) - 1


def parse(html: str) -> Page:
    """Read a page in one pass; markup that never ends takes the rest of the page with it."""
    page = Page()
    tags, parent, runs = page.tags, page.parent, page.runs
    top, at, text_from = ROOT, 0, 0
    open_tags: dict[str, int] = {}  # tags from the root to `top`
    has_body = False
    raw_ends: dict[str, re.Pattern] = {}

    def close_up_to(node: int) -> None:
        nonlocal top
        while top != node:
            open_tags[tags[top]] -= 1
            top = parent[top]

    block = [ROOT]  # for each element, the nearest one around it, or itself, that is no inline element
    stops: dict[str, dict[int, int]] = {}

    def nearest_stop(tag: str) -> int:
        """The nearest open element that a new `tag` closes, or that keeps it from closing any; each climb is made once."""
        known, p, passed = stops.setdefault(tag, {}), top, []
        while p != ROOT and p not in known and tags[p] not in SAME[tag] and (tags[p] not in SCOPE or tag == "tr" and tags[p] == "tr"):
            passed.append(p)
            p = parent[p]
        found = known.get(p, p)
        known.update(dict.fromkeys(passed, found))
        return found

    while (at := html.find("<", at)) >= 0:
        follows = html[at + 1 : at + 2]
        if follows in ("!", "?") or follows == "/" and not html[at + 2 : at + 3].isalpha():
            mark = "-->" if html.startswith("<!--", at) else ">"
            m, last = None, html.find(mark, at + len(mark) + 1 if mark == "-->" else at)
            end = len(html) if last < 0 else last + len(mark)
        elif follows == "/" or follows.isalpha() and follows.isascii():
            m = TAG.match(html, at)
            end = m.end() if m else len(html)
        else:
            at += 1
            continue
        if text_from < at:
            runs.append((top, html[text_from:at]))
        at = text_from = end
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if not open_tags.get(tag):
                continue
            p = top
            while tags[p] != tag:
                p = parent[p]
            if tag not in INLINE:
                runs.append((p, None))
            close_up_to(parent[p])
            continue
        if tag == "html" or tag == "body" and has_body:
            continue
        has_body |= tag == "body"
        if tag not in INLINE:
            if tag in CLOSES_P:
                p = block[top]
                if tags[p] == "p":
                    close_up_to(parent[p])
            elif tag in SAME and any(map(open_tags.get, SAME[tag])):
                p = nearest_stop(tag)
                if p != ROOT and tags[p] in SAME[tag]:
                    if tag == "tr" and tags[p] != "tr":
                        while p != ROOT and tags[p] != "tr":
                            p = parent[p]
                    close_up_to(max(parent[p], ROOT))
            runs.append((top, None))
        if tag in VOID:
            continue
        node = page.add(tag, m[3], top)
        block.append(block[top] if tag in INLINE else node)
        if tag in RAW:  # all up to its end tag is text of it
            pattern = raw_ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*+>", re.I))
            close = pattern.search(html, at)
            at = text_from = close.end() if close else len(html)
        elif not m[3].endswith("/"):
            top = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if text_from < len(html):
        runs.append((top, html[text_from:]))
    page.runs = [(k, entities.unescape(t) if t and "&" in t else t) for k, t in runs]
    return page


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Elements by depth, the roots first."""
    depth = np.zeros(len(parent), int)
    for k, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[k] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


def _parents(pages: list[Page]) -> np.ndarray:
    """Parents of the elements of all pages, numbered through."""
    out, base = [], 0
    for page in pages:
        out.extend([-1, *(p + base for p in page.parent[1:])])
        base += len(page.parent)
    return np.array(out, int)


def node_features(pages: list[Page]) -> np.ndarray:
    """A row of N_FEATURES for each element of the pages."""
    parent = _parents(pages)
    levels, n = _levels(parent), len(parent)
    # Sums over subtrees: characters, words, characters in links, sentence ends, commas, elements.
    sums, own, starts, totals = np.zeros((n, 6)), np.zeros(n), np.full(n, np.inf), np.zeros(n)
    attr, tag, same = np.zeros((n, N_GROUPS)), np.zeros(n, int), np.zeros(n)
    base = 0
    for page in pages:
        seen, linked = 0, [False]
        for k in range(1, len(page.tags)):
            linked.append(page.tags[k] == "a" or linked[page.parent[k]])
        for k, text in page.runs:
            if text is None or page.silent[k] or not (words := text.split()):
                continue
            chars = sum(map(len, words))
            at = base + k
            own[at] += chars
            sums[at] += (chars, len(words), chars * linked[k], text.count(".") + text.count("!") + text.count("?"), text.count(","), 0)
            starts[at] = min(starts[at], seen)
            seen += chars
        totals[base : base + len(page.tags)] = max(seen, 1)
        family: dict[tuple[int, str], int] = {}
        for k, t in enumerate(page.tags):
            tag[base + k] = TAGS.get(t, N_TAGS - 1)
            key = (page.parent[k], t)
            family[key] = family.get(key, 0) + 1
            if "=" in page.attrs[k]:
                for name, *values in ATTRIBUTE.findall(page.attrs[k]):
                    if name.lower() in ("class", "id", "role", "aria-label"):
                        for w in NAME_PART.findall(" ".join(values)):
                            if (g := GROUP_OF.get(w.lower())) is not None:
                                attr[base + k, g] = 1
        same[base : base + len(page.tags)] = [family[p, t] - 1 for p, t in zip(page.parent, page.tags)]
        base += len(page.tags)
    sums[:, 5] = 1
    for level in levels[:0:-1]:
        np.add.at(sums, parent[level], sums[level])
        np.minimum.at(starts, parent[level], starts[level])
    above, above_tag, depth = np.zeros((n, N_GROUPS)), np.zeros((n, N_ABOVE)), np.zeros(n)
    for d, level in enumerate(levels[1:], 1):
        p = parent[level]
        depth[level] = d
        above[level] = np.maximum(above[p], attr[p])
        above_tag[level] = np.maximum(above_tag[p], tag[p][:, None] == np.arange(N_ABOVE))
    children = np.concatenate([np.array(page.children) for page in pages])
    index = np.concatenate([np.array(page.index) for page in pages])
    siblings = np.where(parent >= 0, children[parent], 1)
    others = np.maximum(siblings - 1, 1)
    chars, words, links, dots, commas, elements = sums.T
    peers = np.where(parent >= 0, sums[parent, 0] - chars, 0) / others
    numeric = (depth, index / others, siblings, children, np.log1p(chars), np.log1p(words), chars / totals, links / np.maximum(chars, 1), chars / elements, dots / np.maximum(words, 1), np.minimum(starts / totals, 1), np.log1p(np.maximum(peers, 0)), same / others, np.log1p(own), commas / np.maximum(words, 1))
    return np.column_stack([tag[:, None] == np.arange(N_TAGS), attr, above, above_tag, *numeric]).astype(float)


class Trees:
    """A sum of regression trees as arrays, scored for many rows at once."""

    def __init__(self, weights: list[float], trees: list[tuple[list, list, list, list, list]]):
        self.weights = weights
        self.trees = [tuple(np.array(x) for x in t) for t in trees]  # feature, cut, left, right, value

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for w, (feature, cut, left, right, value) in zip(self.weights, self.trees):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, np.where(x[rows, f] <= cut[at], left[at], right[at]), at)
            total += w * value[at]
        return 2 * total  # Spark's margin is half of the log odds


def labelled_nodes(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all elements, and whether each holds an element marked as main text."""
    parsed, ys = [parse(p) for p in pages], []
    for page in parsed:
        y = np.array(['data-y="1"' in a for a in page.attrs], float)
        for k in range(len(y) - 1, 0, -1):
            y[page.parent[k]] = max(y[page.parent[k]], y[k])
        for k in range(1, len(y)):  # inline elements go with what they stand in
            if page.inline[k]:
                y[k] = y[page.parent[k]]
        ys.append(y)
    return node_features(parsed), np.concatenate(ys)


def train(spark: SparkSession, pages: int = SAMPLE_PAGES) -> Trees:
    """Fit Spark ML's gradient-boosted trees on the sample pages and read them as arrays."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    x, y = labelled_nodes(sample_pages(pages))
    rows = pa.table({"label": y, "x": pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())})
    data = spark.createDataFrame(rows).repartition(4).select("label", array_to_vector("x").alias("features")).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=32).fit(data)
    data.unpersist()
    trees = []
    for tree in model.trees:
        feature, cut, left, right, value = [], [], [], [], []

        def walk(node, out=(feature, cut, left, right, value)) -> int:
            k = len(out[0])
            inner = node.subtreeDepth() > 0
            for column, v in zip(out, (node.split().featureIndex() if inner else -1, float(node.split().threshold()) if inner else 0.0, 0, 0, float(node.prediction()))):
                column.append(v)
            if inner:
                out[2][k], out[3][k] = walk(node.leftChild(), out), walk(node.rightChild(), out)
            return k

        walk(tree._call_java("rootNode"))
        trees.append((feature, cut, left, right, value))
    return Trees(list(model.treeWeights), trees)


_TRAINED: dict[str, Trees] = {}


def trained(spark: SparkSession) -> Trees:
    """The model of this application; it depends on the sample pages alone."""
    key = spark.sparkContext.applicationId
    if key not in _TRAINED:
        _TRAINED[key] = train(spark)
    return _TRAINED[key]


def decode(pages: list[Page], log_odds: np.ndarray) -> np.ndarray:
    """For the elements of the pages, the most likely labelling in which none is kept below a dropped one."""
    parent, inline = _parents(pages), np.concatenate([np.array(page.inline) for page in pages])
    # Inline elements have no say: they follow what they stand in.
    keep = np.where(inline, 0.0, -np.logaddexp(0, -log_odds))
    drop = np.where(inline, 0.0, -np.logaddexp(0, log_odds))
    levels = _levels(parent)
    for level in levels[:0:-1]:
        np.add.at(keep, parent[level], np.where(inline[level], keep[level], np.maximum(keep[level], drop[level])))
        np.add.at(drop, parent[level], drop[level])
    kept = keep > drop
    for level in levels[1:]:
        kept[level] = kept[parent[level]] & (inline[level] | (keep[level] > drop[level]))
    return kept


def main_text(page: Page, kept: np.ndarray) -> str:
    """The text of kept elements: white space inside a block is one space, blocks are joined by one."""
    keep = kept.tolist()
    blocks, now = [], []
    for k, text in page.runs:
        if text is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif keep[k] and not page.silent[k]:
            now.append(text)
    blocks.append("".join(now))
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def extract(pages: list[str], model: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    kept = decode(parsed, model.log_odds(node_features(parsed)))
    cuts = np.cumsum([len(p.tags) for p in parsed])[:-1]
    return [main_text(p, k) for p, k in zip(parsed, np.split(kept, cuts))]


def extract_pages(pages: DataFrame, model: Trees) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            for at in range(0, len(rows), 64):
                texts = extract([h.as_py() or "" for h in rows[at : at + 64]], model)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 64], batch.column(1)[at : at + 64], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return narrow.mapInArrow(run, "page_id long, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), trained(spark)).withColumn("n_chars", F.length("text").cast("long"))
