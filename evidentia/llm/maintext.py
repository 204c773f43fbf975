"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that choices agree along each path.

A page becomes a tree of elements; plain inline elements belong to the element around them. Each node has
features of its subtree (characters, link and punctuation density, elements), of its place (depth, text
before it), of its siblings, of its tag and attribute tokens, and of those of its ancestors. Spark's
gradient-boosted trees give the probability that a node is main text.

Decoding picks, for each page, the most likely labelling of all its nodes in which a node is outside (so is
all below it), inside (what is below is inside or outside for good), or a frame around a part that is inside.
No inside node can stand below an outside one, nor below an outside node within the main text.

Training needs no labelled pages: from the text blocks of a bounded sample of pages, layouts are composed
whose parts are known (menus, headers, notices, adverts, forms, sidebars, comments, footers around and
inside an article, with semantic tags or mere class names); sampled pages that mark one article themselves
are used as they are, too.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, chunks, own_worker, shared_dir, stored, trim

#: Pages of the training sample at most, and layouts composed for each.
SAMPLE_PAGES, LAYOUTS = 200, 3
#: Trees, their depth and the weight of each.
TREES, DEPTH, STEP = 20, 5, 0.3
CHUNK_BYTES = 1_000_000

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
NO_TEXT = frozenset("head title script style template noscript iframe object svg math canvas audio video map datalist".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
# What class, id and role tokens say, by group.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pager pagination toc skip sitemap",
    "head": "header masthead topbar banner logo branding top",
    "foot": "footer copyright legal colophon bottom contentinfo",
    "side": "sidebar side aside related widget rail recommended popular trending complementary",
    "note": "notice cookie cookies consent gdpr alert popup modal overlay dialog warning message",
    "ads": "ad ads advert adverts advertisement sponsor sponsored promo promotion teaser outbrain",
    "form": "form subscribe newsletter signup login search share sharing social rating",
    "talk": "comment comments reply replies discussion disqus respond thread reader",
    "main": "article content post entry story body main text prose page document",
}
GROUPS = list(TOKENS)
_GROUP = {t: 1 << i for i, g in enumerate(GROUPS) for t in TOKENS[g].split()}
TAGS = "p h li ul div section article main nav header footer aside form table cell figure quote control root other".split()
_TAG = {"p": "p", "li": "li", "ul": "ul", "ol": "ul", "dl": "ul", "menu": "nav", "nav": "nav", "dt": "li", "dd": "li", "div": "div", "center": "div", "section": "section", "article": "article", "main": "main", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "aside", "table": "table", "tbody": "table", "thead": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "cell", "figure": "figure", "figcaption": "figure", "blockquote": "quote", "pre": "quote", "details": "quote", "button": "control", "select": "control", "option": "control", "textarea": "control", "label": "control", "legend": "control", "html": "root", "body": "root"} | {f"h{i}": "h" for i in range(1, 7)}
ANCESTORS = "li article main nav header footer aside form table quote".split()
_ANC = {t: 1 << i for i, t in enumerate(ANCESTORS)}
_PUNCT = re.compile(r"[.,;:!?]")
FEATURES = 21 + len(TAGS) + 2 * len(GROUPS) + len(ANCESTORS)


@lru_cache(maxsize=10_000)
def groups_of(value: str) -> int:
    """The token groups of an attribute's value, as bits."""
    out = 0
    for t in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
        out |= _GROUP.get(t, 0)
    return out


class Page(HTMLParser):
    """Nodes of a page in document order, and its texts with their node and block. Any input gives a tree."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.kind, self.own, self.above, self.tags_above, self.depth, self.last = [-1], ["root"], [0], [0], [0], [0], [0]
        self.elements, self.keep = [0], [None]
        self.texts: list[tuple[int, int, str, bool]] = []  # node, block, text, inside a link
        self.stack: list[tuple[str, int]] = []  # tag, node that is open in it
        self.open: dict[str, int] = {}
        self.block = self.hidden = self.links = 0
        self.feed(html)
        self.close()
        while self.stack:
            self._pop()
        self.last[0] = len(self.parent)

    def error(self, message):  # older parsers call it
        pass

    def _pop(self) -> str:
        tag, node = self.stack.pop()
        self.open[tag] -= 1
        if tag in BLOCKS:
            self.block += 1
        if tag in NO_TEXT:
            self.hidden -= 1
        if tag == "a":
            self.links -= 1
        if not self.stack or self.stack[-1][1] != node:
            self.last[node] = len(self.parent)
        return tag

    def _close(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Closes the innermost open element of these tags, unless one of `within` is nearer."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in within:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            if self.open.get("head") and tag not in ("title", "noscript"):
                self._close(("head",), ())
            self._close(("p",), ("td", "th", "button", "object"))
            self.block += 1
        if tag in CLOSES:
            for _ in CLOSES[tag]:
                self._close(CLOSES[tag], HOLDS[tag])
        elif tag[:1] == "h" and tag[1:].isdigit():
            self._close(("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section", "article"))
        at = self.stack[-1][1] if self.stack else 0
        self.elements[at] += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        bits, keep = 0, None
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                bits |= groups_of(value)
            elif name == "data-keep":
                keep = value == "1"
        if tag in BLOCKS or bits:
            node = len(self.parent)
            self.parent.append(at)
            self.kind.append(_TAG.get(tag, "other"))
            self.own.append(bits)
            self.above.append(self.above[at] | self.own[at])
            self.tags_above.append(self.tags_above[at] | _ANC.get(self.kind[at], 0))
            self.depth.append(self.depth[at] + 1)
            self.last.append(0)
            self.elements.append(0)
            self.keep.append(self.keep[at] if keep is None else keep)
            at = node
        self.stack.append((tag, at))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += tag in NO_TEXT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_data(" ")
        elif tag in BLOCKS:
            self._close((tag,), ())
        elif self.open.get(tag):
            self._close((tag,), ("td", "th"))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.texts.append((self.stack[-1][1] if self.stack else 0, self.block, data, self.links > 0))


def _sums(values: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each node's subtree: nodes are in document order, a subtree ends before `last`."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[last] - total[: len(last)]


def features(pages: list[Page]) -> np.ndarray:
    """A row for each node of the pages."""
    sizes = [len(p.parent) for p in pages]
    base = np.cumsum([0] + sizes)
    cat = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
    shift = np.repeat(base[:-1], sizes)
    root = shift.copy()
    parent = np.maximum(cat("parent") + shift, root)
    last = cat("last") + shift
    n = len(parent)
    chars, link, punct, paragraphs = (np.zeros(n, np.int64) for _ in range(4))
    at = np.array([b + t[0] for p, b in zip(pages, base) for t in p.texts], np.int64)
    size = np.array([len(t[2].strip()) for p in pages for t in p.texts], np.int64)
    np.add.at(chars, at, size)
    np.add.at(link, at, size * np.array([t[3] for p in pages for t in p.texts], np.int64))
    np.add.at(punct, at, np.array([len(_PUNCT.findall(t[2])) for p in pages for t in p.texts], np.int64))
    kind = np.array([TAGS.index(k) for p in pages for k in p.kind])
    paragraphs[kind == 0] = 1
    all_chars, all_link, all_punct, all_p, all_el = (_sums(x, last) for x in (chars, link, punct, paragraphs, cat("elements")))
    depth, own, above, tags = cat("depth"), cat("own"), cat("above"), cat("tags_above")
    # siblings: in document order, by parent
    order = np.argsort(parent, kind="stable")
    order = order[order != root[order]]
    p = parent[order]
    count = np.bincount(p, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    index = np.zeros(n, np.int64)
    index[order] = np.arange(len(order)) - first[p]
    siblings = count[parent]
    alike = np.zeros(n, np.int64)
    pair = parent[order] * len(TAGS) + kind[order]
    _, inverse, many = np.unique(pair, return_inverse=True, return_counts=True)
    alike[order] = many[inverse]
    biggest = np.zeros(n, np.int64)
    np.maximum.at(biggest, p, all_chars[order])
    before = np.concatenate(([0], np.cumsum(chars)))[:-1]
    start = before - before[root]
    whole = np.maximum(all_chars[root], 1)
    ratio = lambda a, b: a / np.maximum(b, 1)
    x = np.empty((n, FEATURES), np.float32)
    columns = [
        depth, index, siblings, ratio(index, siblings - 1), np.log1p(all_chars), all_chars / whole, ratio(all_link, all_chars), np.log1p(chars), np.log1p(all_el),
        np.log1p(ratio(all_chars, all_el + 1)), 100 * ratio(all_punct, all_chars), np.log1p(all_p), ratio(alike, siblings), ratio(all_link, all_chars)[parent], np.log1p(all_chars[parent]),
        ratio(all_chars, all_chars[parent]), ratio(all_chars, biggest[parent]), start / whole, (whole - start - all_chars) / whole, np.log1p(last - np.arange(n)), np.log1p(whole),
        *[kind == i for i in range(len(TAGS))], *[(own >> i) & 1 for i in range(len(GROUPS))], *[(above >> i) & 1 for i in range(len(GROUPS))], *[(tags >> i) & 1 for i in range(len(ANCESTORS))],
    ]
    for i, c in enumerate(columns):
        x[:, i] = c
    return x


# ---------------------------------------------------------------- training pages


def _blocks_of(page: Page) -> list[str]:
    out: dict[int, list[str]] = {}
    for _, block, text, _ in page.texts:
        out.setdefault(block, []).append(text)
    return [x for x in (" ".join("".join(v).split()) for v in out.values()) if x]


class Composer:
    """Pages whose parts are known, from given texts."""

    def __init__(self, seed: int, texts: list[str]):
        self.r, self.words = random.Random(seed), [w for t in texts for w in t.split()] or ["text"]

    def say(self, lo: int, hi: int) -> str:
        n, at = self.r.randint(lo, hi), self.r.randrange(len(self.words))
        return escape(" ".join((self.words + self.words)[at : at + n]))

    def named(self, group: str, tags: str, inner: str, plain: float = 0.0) -> str:
        """An element that its tag (the first of `tags`, sometimes) or a class token gives away; without either in the share `plain`."""
        own, *others = tags.split()
        if self.r.random() < 0.5:
            return f"<{own}>{inner}</{own}>"
        tag = self.r.choice(others or [own])
        if self.r.random() < plain:
            return f"<{tag}>{inner}</{tag}>"
        token = self.r.choice(TOKENS[group].split())
        name = self.r.choice(["{0}", "{0}", "site-{0}", "{0}-box", "{0} block", "{0}_1"]).format(token)
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'

    def links(self, lo: int, hi: int) -> str:
        each = [f'<a href="/{i}">{self.say(1, 3)}</a>' for i in range(self.r.randint(lo, hi))]
        form = self.r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if form < 0.6 else (" | " if form < 0.8 else " ").join(each)

    def prose(self, lo: int, hi: int) -> str:
        text = self.say(lo, hi)
        form = self.r.random()
        if form < 0.15:
            return f"<b>{text}</b>"
        if form < 0.3:
            return f'{text} <a href="/x">{self.say(1, 3)}</a> {self.say(2, 12)}'
        return text

    def paragraph(self) -> str:
        form, text = self.r.random(), self.prose(1 if self.r.random() < 0.2 else 15, 120)
        return f"<p>{text}</p>" if form < 0.75 else f"<p>{text}" if form < 0.9 else f"<p><b>{text}<br>"

    def outside(self, where: str) -> str:
        say = self.say
        wrap = lambda x: f"<p>{x}</p>" if self.r.random() < 0.5 else x
        if where == "before":
            parts = [
                lambda: self.named("menu", "nav div ul", self.links(3, 9)), lambda: self.named("head", "header div", f"<h2>{say(1, 5)}</h2>" + wrap(say(2, 12))), lambda: self.named("ads", "aside div section", wrap(say(4, 30))),
                lambda: f'<div class="{self.r.choice(TOKENS["ads"].split())}">{say(3, 30)}</div>', lambda: self.named("note", "dialog div p", wrap(say(6, 30)) + "<button>ok</button>"), lambda: f'<form action="/s"><label>{say(1, 3)}</label><input name="q"><button>{say(1, 1)}</button></form>',
            ]
        elif where == "after":
            comment = lambda: f'<div class="{self.r.choice(["comment", "reply", "item"])}"><b>{say(1, 2)}</b><p>{say(4, 60)}</p></div>'
            parts = [
                lambda: self.named("foot", "footer div p", f"&copy; {say(1, 3)} &middot; {wrap(say(2, 25))}"), lambda: self.named("side", "aside div", f"<h3>{say(1, 4)}</h3>" + self.links(3, 8)), lambda: self.named("side", "aside div", wrap(say(5, 60))),
                lambda: f'<section class="{self.r.choice(TOKENS["talk"].split())}">' + "".join(comment() for _ in range(self.r.randint(1, 6))) + "</section>", lambda: self.named("form", "form div", f"<p>{say(3, 20)}</p><input><button>{say(1, 2)}</button>"),
                lambda: self.named("ads", "aside div", wrap(say(4, 30))), lambda: f"<footer>{say(2, 30)}</footer>",
            ]
        else:
            parts = [lambda: self.named("ads", "aside div p", say(3, 25)), lambda: self.named("side", "aside div", f"<p>{say(2, 6)}</p>" + self.links(2, 5)), lambda: f'<form class="{self.r.choice(TOKENS["form"].split())}"><p>{say(3, 15)}</p><button>{say(1, 2)}</button></form>', lambda: f'<div class="share">{self.links(2, 5)}</div>']
        return re.sub(r"^<(\w+)", r'<\1 data-keep="0"', self.r.choice(parts)())

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.say(2, 14)}</h1>")
        for _ in range(r.randint(1, 14)):
            form = r.random()
            if form < 0.8:
                parts.append(self.paragraph())
            elif form < 0.86:
                parts.append(f"<h{r.choice('234')}>{self.say(1, 8)}</h{r.choice('234')}>" if r.random() < 0.1 else f"<h2>{self.say(1, 8)}</h2>")
            elif form < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.prose(2, 30)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif form < 0.93:
                parts.append(f"<blockquote><p>{self.prose(5, 50)}</p></blockquote>")
            elif form < 0.95:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.say(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif form < 0.97:
                parts.append(f"<figure><img src=x><figcaption>{self.say(3, 20)}</figcaption></figure>")
            else:
                parts.append(f"<div>{self.prose(10, 90)}</div>")
            if r.random() < 0.06:
                parts.append(self.outside("within"))
        if r.random() < 0.1:
            parts.append(self.outside("after"))
        tag = r.choice(["article", "article", "article", "main", "div", "div", "div", "section"])
        name = "" if tag in ("article", "main") and r.random() < 0.8 or r.random() < 0.15 else f' {r.choice(["class", "id"])}="{r.choice(["{0}", "{0}-content", "page-{0}", "main {0}"]).format(r.choice(TOKENS["main"].split()))}"'
        return f'<{tag}{name} data-keep="1">' + "".join(parts) + f"</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [self.outside("before") for _ in range(r.randint(0, 4))]
        after = [self.outside("after") for _ in range(r.randint(0, 4))]
        middle = self.article()
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            name = r.choice(["", ' class="container"', ' class="wrapper"', ' id="page"', ' class="row"', ' id="content"'])
            k, j = r.randint(0, len(before)), r.randint(0, len(after))
            middle = f"<div{name}>" + "".join(before[k:]) + middle + "".join(after[:j]) + "</div>"
            before, after = before[:k], after[j:]
        return f"<!DOCTYPE html><html><head><title>{self.say(2, 10)}</title><style>p{{margin:0}}</style></head><body>" + "".join(before) + middle + "".join(after) + ("</body></html>" if r.random() < 0.9 else "")


def _marked(page: Page) -> list[int] | None:
    """Labels of a page that marks exactly one article itself: its nodes, but for those of other parts inside."""
    found = [i for i, k in enumerate(page.kind) if k == "article"]
    if len(found) != 1:
        return None
    lo, hi = found[0], page.last[found[0]]
    other = {"nav", "aside", "footer", "form", "control"}
    out = [0] * len(page.kind)
    for i in range(lo, hi):
        out[i] = int((i == lo or out[page.parent[i]] == 1) and page.kind[i] not in other)
    return out


def _training(layouts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("maintext")
        for batch in batches:
            for raw in as_bytes(batch.column("html")):
                own = Page(raw.decode())
                made = [Page(Composer(zlib.crc32(raw) + i, _blocks_of(own)).page()) for i in range(layouts)]
                pages, labels = made, [[int(bool(k)) for k in p.keep] for p in made]
                if marked := _marked(own):
                    pages, labels = [own, *made], [marked, *labels]
                x = features(pages)
                yield pa.record_batch([pa.array(list(x.astype(np.float64)), pa.list_(pa.float64())), pa.array(np.concatenate(labels).astype(np.float64))], names=["x", "label"])
        trim()

    return run


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES, trees: int = TREES, depth: int = DEPTH) -> list[tuple[np.ndarray, ...]] | None:
    """Trees as arrays (feature, threshold, left, right, value); None if the sample has no text.

    The sample has the pages of the least hashes of page_id and html, `sample` at most.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = pages.sparkSession
    least = pages.filter(F.octet_length("html") > 0).select("html", F.xxhash64("page_id", "html").alias("rank")).orderBy("rank", "html").limit(sample)
    rows = stored(least.mapInArrow(_training(LAYOUTS), "x array<double>, label double"), "nodes")
    if rows.select("label").distinct().count() < 2:
        return None
    few = rows.coalesce(4).select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=STEP, seed=7, maxBins=32).fit(few)
    path = f"{shared_dir(spark)}/trees"
    model.save(path)
    out = []
    data = spark.read.parquet(f"{path}/data")
    each: dict[int, list] = {}
    for r in data.collect():  # the model: at most trees * 2 ** (depth + 1) rows
        each.setdefault(r["treeID"], []).append(r["nodeData"])
    for k in sorted(each):
        nodes = sorted(each[k], key=lambda x: x["id"])
        split = [(n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]) if n["leftChild"] >= 0 else (0, math.inf) for n in nodes]
        left = np.array([max(n["leftChild"], 0) if n["leftChild"] >= 0 else n["id"] for n in nodes], np.int64)
        right = np.array([n["rightChild"] if n["leftChild"] >= 0 else n["id"] for n in nodes], np.int64)
        out.append((np.array([s[0] for s in split], np.int64), np.array([s[1] for s in split]), left, right, np.array([n["prediction"] for n in nodes]) * model.treeWeights[k]))
    return out


def chances(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], depth: int = DEPTH) -> np.ndarray:
    """The probability of main text of each row."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        total += value[at]
    return 1 / (1 + np.exp(-2 * total))


def decode(page: Page, chance: np.ndarray) -> list[bool]:
    """Whether each node is inside, in the most likely labelling without contradictions."""
    n = len(page.parent)
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    out, inside, frame = no[:], yes[:], no[:]  # best values of the subtree if its top is so
    for v in range(n - 1, 0, -1):
        u = page.parent[v]
        best = inside[v] if inside[v] > out[v] else out[v]
        out[u] += out[v]
        inside[u] += best
        frame[u] += best if best > frame[v] else frame[v]
    state = [""] * n
    for v in range(n):
        above = state[page.parent[v]] if v else "frame"
        if above == "out":
            state[v] = "out"
        elif above == "in":
            state[v] = "in" if inside[v] > out[v] else "out"
        else:
            state[v] = "in" if inside[v] > max(out[v], frame[v]) else "frame" if frame[v] > out[v] else "out"
    return [s == "in" for s in state]


def text_of(page: Page, inside: list[bool]) -> str:
    """The blocks of the inside nodes, white space within them as one space, an empty line between them."""
    blocks: dict[int, list[str]] = {}
    for node, block, text, _ in page.texts:
        if inside[node]:
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(x for x in (" ".join("".join(v).split()) for v in blocks.values()) if x)


def _extract(trees: list[tuple[np.ndarray, ...]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("maintext")
        for batch in batches:
            for piece in chunks(batch, "html", CHUNK_BYTES):
                pages = [Page(x.decode()) for x in as_bytes(piece.column("html"))]
                chance = chances(features(pages), trees)
                cuts = np.cumsum([0] + [len(p.parent) for p in pages])
                texts = [text_of(p, decode(p, chance[a:b])) for p, a, b in zip(pages, cuts, cuts[1:])]
                yield pa.record_batch([piece.column("page_id").cast(pa.int64()), piece.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
        trim()

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars (code points).

    Character references are decoded, white space (Unicode's) inside a block becomes one space, blocks are
    trimmed and joined by two line ends in page order; nothing else is dropped or cut. A null or empty html,
    and a page without main text, gives an empty text. Repeated rows give equal rows; null page_id and url
    stay null; other columns are not read. An empty table gives an empty one, as do tables without any text.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    trees = learn(pages)
    if trees is None:
        return rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    return rows.mapInArrow(_extract(trees), "page_id long, url string, text string, n_chars long")
