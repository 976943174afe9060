"""Main text of HTML pages by a tree-structured graphical model.

A tolerant reader turns a page into a tree of block elements and the runs of text that they
own. Each node is neutral (a wrapper), content or boilerplate. Unary potentials come from
the element's tag, its class, id and role words, and the length, links and punctuation of
its own text; parent-child potentials connect the DOM nodes. Sum-product messages pass
upward and downward, which is exact on a tree, for all pages of a batch at once, level by
level. Weights are those of the exact likelihood, found by gradient ascent in numpy from
labelled pages that a seeded generator writes (``training_pages``).

A null or empty page has the empty text. Unclosed, stray and misnested tags are read like a
browser's block structure; scripts, styles, titles and text areas that are never closed run to
the page's end, other skipped elements (svg, select, button, video and the like) that are empty,
never closed or closed only after a block that can't be theirs take nothing with them. A text
run without any block belongs to the page. Ties between labels count as no content. Repeated
rows repeat in the result, an empty table gives an empty one, and extra columns are ignored,
whatever their names. Whole pages are read, however long, in slices.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import segment_sums, ship, slices, texts_of

ship(__name__)

# Names in HTML.
RAW = "script|style|title|textarea"
SKIPPED = frozenset("noscript template svg math iframe object select button xmp noframes noembed canvas audio video".split())
NESTED = frozenset("svg math object template".split())
PHRASING = frozenset("select button svg math".split())  # of which a block's start tag is no part
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
TAGS = "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr td th figure figcaption nav header footer aside form fieldset head details summary address center dialog menu".split()
WORDS = {
    "content": "article content main post entry story body text prose lead abstract",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc skip topbar toolbar",
    "head": "header masthead banner brand logo hero top",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar side aside rail related recommended recommendations popular trending more widget widgets secondary complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adslot dfp",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup paywall disclaimer warning contentinfo",
    "comment": "comment comments reply replies disqus discussion respond feedback reader readers responses",
    "social": "share sharing social follow facebook twitter tools actions",
    "form": "form search login contact poll survey",
    "note": "byline author date meta tags tag caption credit",
}
MODIFIERS = frozenset("has have with without no not is hide show in".split())  # what follows says something about a neighbour
LEXICON = {w: kind for kind, words in WORDS.items() for w in words.split()}
FEATURES = ["bias", "leaf", *[f"t:{t}" for t in TAGS], "t:other", *[f"c:{k}" for k in WORDS], "c:other", "len0", "len1", "len2", "len3", "len4", "link0", "link1", "link2", "stop", "nostop", "sub0", "sub1", "sub2", "sub3", "sublink0", "sublink1", "sublink2", "sentences"]
F_OF = {f: i for i, f in enumerate(FEATURES)}
NEUTRAL, CONTENT, BOILER = range(3)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>(?:.*?</\1\s*>|.*\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([/]?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
BLOCK = re.compile(r"<(?:p|h[1-6]|article|section|main|blockquote|table|ul|ol|dl|header|footer|nav|aside|form)(?=[\s/>])", re.I)
SAME = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in SKIPPED}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def skipped_to(source: str, tag: str, lo: int, hi: int) -> int:
    """Where a skipped element whose start tag is source[lo:hi] ends; ``hi`` if it is empty or never closed as its content allows."""
    if source[lo:hi].endswith("/>"):
        return hi
    depth = 1
    for m in SAME[tag].finditer(source, hi):
        if m[1]:
            depth -= 1
        elif tag not in NESTED:
            return hi
        elif not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return hi if tag in PHRASING and BLOCK.search(source, hi, m.start()) else m.end()
    return -1


@functools.lru_cache(100_000)
def element_features(tag: str, attributes: str) -> tuple[int, ...]:
    """Tag and lexicon features of a start tag."""
    out = [F_OF["bias"], F_OF.get(f"t:{tag}", F_OF["t:other"])]
    if "=" in attributes:
        found = set()
        for m in NAMES.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                before = ""
                for w in map(str.lower, PART.findall(name)):
                    found.add("other" if before in MODIFIERS else LEXICON.get(w, "other"))
                    before = w
        out += [F_OF[f"c:{k}"] for k in sorted(found)]
    return tuple(out)


class Page:
    """Nodes of a page in document order, and its text runs in page order."""

    __slots__ = ("parent", "features", "length", "linked", "stops", "runs", "depth")

    def __init__(self, source: str):
        self.parent, self.depth = [-1], [0]
        self.features = [(F_OF["bias"], F_OF["t:other"])]
        self.length, self.linked, self.stops = [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        text: list[str] = []
        links = in_link = at = 0
        open_for_good: set[str] = set()  # skipped elements that nothing closes any more

        def flush():
            nonlocal links
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if joined:
                    node = stack[-1][1]
                    self.runs.append((node, joined))
                    self.length[node] += len(joined)
                    self.linked[node] += min(links, len(joined))
                    self.stops[node] += joined[-1] in ".!?:;…\"'”"
            links = 0

        for m in TOKEN.finditer(source):
            lo, hi = m.span()
            if lo < at:  # inside a skipped element, or its end
                at = max(at, hi)
                continue
            if lo > at:
                text.append(source[at:lo])
                if in_link:
                    links += lo - at
            at = hi
            tag = m[3] or m[6]
            if not tag:
                continue
            tag = tag.lower()
            closing = bool(m[2] or m[5])
            if tag in SKIPPED:
                if not closing and tag not in open_for_good:
                    at = skipped_to(source, tag, lo, hi)
                    if at < 0:
                        open_for_good.add(tag)
                        at = hi
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not closing
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    text.append(" ")
                continue
            flush()
            in_link = 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends.split():
                        del stack[k:]
                        break
                    if stack[k][0] in within:
                        break
            me = len(self.parent)
            self.parent.append(stack[-1][1])
            self.depth.append(self.depth[stack[-1][1]] + 1)
            self.features.append(element_features(tag, m[4] or m[7] or ""))
            self.length.append(0)
            self.linked.append(0)
            self.stops.append(0)
            stack.append((tag, me))
        if at < len(source):
            text.append(source[at:])
        flush()


class Forest:
    """The nodes of many pages as arrays, with their features."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        base = np.cumsum(sizes) - sizes
        self.base = base
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, int(sizes.sum()))
        self.root = parent < 0
        self.parent = np.where(self.root, -1, parent + np.repeat(base, sizes))
        self.depth = np.fromiter((x for p in pages for x in p.depth), np.int64, len(parent))
        self.by_depth = [np.flatnonzero(self.depth == d) for d in range(1, int(self.depth.max(initial=0)) + 1)] if self.depth.max(initial=0) < 64 else self._levels()
        length = np.fromiter((x for p in pages for x in p.length), np.int64, len(parent))
        linked = np.fromiter((x for p in pages for x in p.linked), np.int64, len(parent))
        stops = np.fromiter((x for p in pages for x in p.stops), np.int64, len(parent))
        has = np.bincount(self.parent[~self.root], minlength=len(parent)) > 0
        size = np.where(length == 0, 0, np.searchsorted([25, 80, 240], length, "right") + 1)
        share = linked / np.maximum(1, length)
        own = np.stack([
            F_OF["len0"] + size,
            np.where(length == 0, -1, F_OF["link0"] + (share > 0.2) + (share > 0.6)),
            np.where(length == 0, -1, np.where(stops > 0, F_OF["stop"], F_OF["nostop"])),
            np.where(has, -1, F_OF["leaf"]),
            *self._below(has, length, linked, stops),
        ])
        counts = np.fromiter((len(f) for p in pages for f in p.features), np.int64, len(parent))
        self.flat = np.fromiter((x for p in pages for f in p.features for x in f), np.int64, int(counts.sum()))
        self.counts, self.own = counts, own

    def _below(self, has: np.ndarray, length: np.ndarray, linked: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
        """Features of all text below a node with children: how much, how much of it links, whether it holds several sentences."""
        total, links, ends = length.copy(), linked.copy(), stops.copy()
        for rows in reversed(self.by_depth):
            for x in (total, links, ends):
                np.add.at(x, self.parent[rows], x[rows])
        inner = has & ~self.root
        share = links / np.maximum(1, total)
        size = np.searchsorted([1, 120, 600], total, "right")
        return [np.where(inner, F_OF["sub0"] + size, -1), np.where(inner & (total > 0), F_OF["sublink0"] + (share > 0.15) + (share > 0.5), -1), np.where(inner & (ends >= 3), F_OF["sentences"], -1)]

    def _levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max()) + 2))
        return [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def unary(self, w: np.ndarray) -> np.ndarray:
        padded = np.concatenate([w, np.zeros((1, 3))])  # -1: no feature
        return segment_sums(w[self.flat], self.counts) + padded[self.own].sum(axis=0)

    def grad(self, g: np.ndarray) -> np.ndarray:
        """Sum of ``g`` (a row a node) by feature."""
        out = np.zeros((len(FEATURES) + 1, 3))
        np.add.at(out, self.flat, np.repeat(g, self.counts, axis=0))
        for row in self.own:
            np.add.at(out, row, g)
        return out[:-1]


def sum_product(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals, and the expected number of each (parent state, child state)."""

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    up = unary.copy()
    message = np.zeros_like(unary)
    for rows in reversed(forest.by_depth):
        message[rows] = lse(up[rows][:, None, :] + pair[None], 2)
        np.add.at(up, forest.parent[rows], message[rows])
    belief = up.copy()
    edges = np.zeros((3, 3))
    for rows in forest.by_depth:
        above = belief[forest.parent[rows]] - message[rows]
        joint = above[:, :, None] + pair[None] + up[rows][:, None, :]
        belief[rows] = lse(joint, 1)
        e = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        edges += (e / e.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), edges


def training_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    """Seeded labelled pages: HTML, and the label of each block element in the order of start tags."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = "ka to ri en der st la mo ver il sa un te por is an".split()

    def words(lo, hi):
        return " ".join("".join(pick(*syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(lo, hi + 1))))

    def sentence(lo=1, hi=30):
        return words(lo, hi).capitalize() + "."

    def write() -> tuple[str, list[int]]:
        out: list[str] = []
        labels: list[int] = []
        brief = chance(0.3)  # an article of a few words

        def el(tag, label, inner, names=""):
            labels.append(label)
            out.append(f"<{tag}{f' {names}' if names else ''}>")
            inner() if callable(inner) else out.append(inner)
            if not (tag in ("p", "li") and chance(0.15)):
                out.append(f"</{tag}>")

        def name(*kinds):
            w = pick(*WORDS[pick(*kinds)].split())
            return f'{pick("class", "class", "id")}="{pick("", "site-", "page-", "x-", "js-")}{w}{pick("", "-box", "-wrap", "_1", " clearfix", "-inner")}"'

        def misled():
            """A name of an article's element that speaks of other things, as sites' own styles do, or of nothing."""
            w = pick(*WORDS[pick(*WORDS)].split())
            odd = pick(f"{w}-{words(1, 1)}", f"{words(1, 1)}-{w}", f"has-{w}", f"with-{w}", words(1, 1), f"{w}-item-page")
            return f'class="{odd}{pick("", "", f" {words(1, 1)}", " story", " entry")}"'

        def named(tag, kind):
            return tag, name(kind) if tag in ("div", "section") or chance(0.5) else ""

        def links(label, lo=2, hi=8):
            def items():
                for _ in range(int(rng.integers(lo, hi + 1))):
                    el("li", label, f'<a href="/{words(1, 1)}">{words(1, 3)}</a>')

            el("ul", label, items)

        def paras(label, lo, hi, long=True):
            for _ in range(int(rng.integers(lo, hi + 1))):
                body = sentence(1, 4) if brief and label == CONTENT else " ".join(sentence(1, 25) for _ in range(int(rng.integers(1, 6 if long else 2))))
                if chance(0.15):
                    body += f' <a href="/x">{words(1, 4)}</a>.'
                if chance(0.1):
                    body = f"<b>{body}<br>"
                el("p", label, body)

        def boiler():
            kind = pick("nav", "header", "footer", "aside", "ad", "notice", "comments", "form", "share", "related")
            b = BOILER
            if kind == "nav":
                el(pick("nav", "div", "nav"), b, lambda: links(b), name("nav")) if chance(0.7) else el("nav", b, lambda: links(b))
            elif kind == "header":
                own = named(pick("header", "header", "div"), "head")
                el(own[0], b, lambda: (el(pick("h1", "div", "p"), b, words(1, 5)), chance(0.5) and links(b)), own[1])
            elif kind == "footer":
                own = named(pick("footer", "footer", "div"), "foot")
                el("footer", b, f"&copy; {words(1, 4)} &middot; {sentence(2, 10)}") if chance(0.5) else el(own[0], b, lambda: (paras(b, 0, 2, False), chance(0.5) and links(b)), own[1])
            elif kind in ("aside", "related"):
                own = named(pick("aside", "aside", "div", "section"), "side")
                el(own[0], b, lambda: (chance(0.6) and el(pick("h2", "h3", "h4"), b, words(1, 4)), paras(b, 0, 3), chance(0.6) and links(b)), own[1])
            elif kind == "ad":
                el(pick("div", "div", "aside", "section"), b, sentence(2, 25) if chance(0.6) else lambda: paras(b, 1, 2), name("ad"))
            elif kind == "notice":
                el(pick("div", "section", "p"), b, sentence(3, 30), name("notice"))
            elif kind == "comments":
                def one():
                    el(pick("div", "li", "article"), b, lambda: (chance(0.5) and el("p", b, words(1, 3)), paras(b, 1, 2)), name("comment") if chance(0.8) else "")

                el(pick("div", "section", "ol"), b, lambda: (chance(0.6) and el("h3", b, words(1, 3)), [one() for _ in range(int(rng.integers(1, 5)))]), name("comment"))
            elif kind == "form":
                el("form", b, lambda: (el("p", b, words(2, 8)), out.append("<label>" + words(1, 3) + '</label> <input type="text">')), name("form") if chance(0.4) else "")
            else:
                el(pick("div", "ul"), b, lambda: [el("li", b, f'<a href="#">{words(1, 2)}</a>') for _ in range(3)], name("social"))

        def content():
            c = CONTENT
            if chance(0.85):
                el(pick("h1", "h1", "h2"), c, words(2, 12))
            for _ in range(int(rng.integers(1, 3 if brief else 6))):
                kind = pick("p", "p", "p", "p", "list", "quote", "table", "figure", "div", "h", "boiler", "dl", "pre")
                if kind == "p":
                    paras(c, 1, 5)
                elif kind == "list":
                    el(pick("ul", "ol"), c, lambda: [el("li", c, sentence(1, 20)) for _ in range(int(rng.integers(2, 6)))])
                elif kind == "quote":
                    el("blockquote", c, lambda: paras(c, 1, 2))
                elif kind == "table":
                    el("table", c, lambda: [el("tr", c, lambda: [el(pick("td", "td", "th"), c, words(1, 5)) for _ in range(3)]) for _ in range(2)])
                elif kind == "figure":
                    el("figure", c, lambda: (out.append('<img src="x.png">'), el("figcaption", c, sentence(2, 12))))
                elif kind == "div":
                    el(pick("div", "section"), c, lambda: paras(c, 1, 3), name("content") if chance(0.3) else misled() if chance(0.4) else "")
                elif kind == "h":
                    el(pick("h2", "h3", "h4"), c, words(1, 7))
                elif kind == "dl":
                    el("dl", c, lambda: (el("dt", c, words(1, 3)), el("dd", c, sentence(2, 15))))
                elif kind == "pre":
                    el("pre", c, words(3, 20))
                else:
                    boiler()

        def middle():
            for _ in range(int(rng.integers(0, 3))):
                boiler()
            how = pick("article", "article", "article", "main", "div", "section", "bare", "both")
            if how == "bare":
                content()
            elif how == "both":
                el("main", NEUTRAL if chance(0.5) else CONTENT, lambda: el("article", CONTENT, content, name("content") if chance(0.3) else misled() if chance(0.3) else ""))
            elif how in ("article", "main"):
                el(how, CONTENT, content, name("content") if chance(0.4) else misled() if chance(0.3) else "")
            else:
                el(how, CONTENT, content, name("content") if chance(0.7) else misled())
            for _ in range(int(rng.integers(0, 4))):
                boiler()

        def page():
            labels.append(NEUTRAL)
            out.append('<html lang="x">')
            if chance(0.9):
                labels.append(NEUTRAL)
                out.append('<head><meta charset="utf-8"><title>t</title></head>')
            labels.append(NEUTRAL)
            out.append("<body>")
            el("div", NEUTRAL, lambda: el("div", NEUTRAL, middle) if chance(0.3) else middle(), pick("", 'id="wrapper"', 'class="container"', 'class="row"')) if chance(0.35) else middle()
            out.append("</body></html>")

        page()
        return "".join(out), labels

    return [write() for _ in range(count)]


@functools.lru_cache(4)
def train(pages: int = 500, seed: int = 7, steps: int = 250, rate: float = 0.5, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights (a row a feature) and parent-child potentials."""
    made = training_pages(pages, seed)
    read = [Page(x) for x, _ in made]
    for p, (source, labels) in zip(read, made, strict=True):
        if len(p.parent) != len(labels) + 1:
            raise AssertionError(f"labels don't match the elements of {source[:200]}")
    forest = Forest(read)
    y = np.concatenate([[NEUTRAL, *labels] for _, labels in made])
    truth = np.eye(3)[y]
    pairs = np.zeros((3, 3))
    child = ~forest.root
    np.add.at(pairs, (y[forest.parent[child]], y[child]), 1)
    w, pair = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    moment, square = np.zeros(w.size + 9), np.zeros(w.size + 9)
    for step in range(1, steps + 1):  # Adam on the exact likelihood
        p, edges = sum_product(forest, forest.unary(w), pair)
        g = np.concatenate([(forest.grad(truth - p) / len(y) - shrink * w).ravel(), ((pairs - edges) / len(y) - shrink * pair).ravel()])
        moment = 0.9 * moment + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        delta = rate * (1 - step / (steps + 1)) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, pair = w + delta[:-9].reshape(w.shape), pair + delta[-9:].reshape(3, 3)
    return w, pair


def extract_texts(sources: list[str], model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5) -> list[str]:
    """The main text of each page: its content runs in page order, joined by a line feed."""
    pages = [Page(x) for x in sources]
    if not pages:
        return []
    forest = Forest(pages)
    p, _ = sum_product(forest, forest.unary(model[0]), model[1])
    good = p[:, CONTENT] > threshold
    return ["\n".join(t for node, t in page.runs if good[base + node]) for page, base in zip(pages, forest.base, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; one pass without a shuffle."""
    model = train()

    def run(batches):
        for batch in batches:
            sources = texts_of(batch.column("html"))
            for lo, hi in slices(sources):
                texts = extract_texts([s.decode("utf-8", "replace") for s in sources[lo:hi]], model, threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(lo, hi - lo), batch.column("url").slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
