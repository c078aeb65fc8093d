"""Main text of web pages: a recurrent labeller over the blocks of a page.

A page is cut into leaf blocks, that is runs of text between block-level tags, with scripts, styles, markup and
the head left out. Each block becomes a vector: the tags and the class and id words of all elements it stands in
(hashed), all its words (hashed), and a few sizes. A bidirectional LSTM in numpy reads the whole sequence of a page
both ways and labels every block with the document's context in view; the blocks labelled as article are joined.
Vectors are sparse: a block's share of the input product is a sum of a few rows of the weights. A page is read in
chunks of blocks that carry the state on, and of each block one number is kept, so memory follows its text.

The labeller is trained here, on pages that a seeded generator makes up: layouts with navigation, headers,
sidebars, notices, adverts, forms, comments and footers around and inside an article, with blocks of known label.
No page of the input is used. Training takes seconds, happens once per driver process and is deterministic.

Defined cases: null and empty pages have an empty text; a head ends at its end tag or at the first tag or text that
can't be in one; a quote that is never closed ends with its tag; unclosed, truncated or unknown tags are read as far
as they go, and a ``<`` that begins no tag is text; white space is what ``str.split`` takes as such; repeated rows
are repeated; null ids stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PATH_DIM, WORD_DIM, SIZES = 1024, 256, 6
INPUT = PATH_DIM + WORD_DIM + SIZES
HIDDEN = 20
TRAIN_PAGES = 1600
EPOCHS = 8
#: Blocks read at once: pages are batched up to so many steps times rows, and a longer page is read in such chunks.
BATCH_CELLS = 20_000
PRODUCT_ROWS = 256

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is no text of the page.
HIDDEN_TAGS = frozenset("script style template noscript iframe svg math canvas object audio video head title textarea select datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Tags that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
#: An opening tag closes an open element of these, unless one of the barriers stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
LISTS, TABLES = frozenset("ul ol menu dl table td th".split()), frozenset(("table",))
BARRIERS = dict.fromkeys(("li", "dt", "dd", "option"), LISTS) | dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), TABLES)
#: What an end tag, and a paragraph's implied end, can't reach through.
SCOPE = frozenset("table td th caption button object template".split())
BLOCK_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TAG = r"<(/?)([a-zA-Z][^\s/>]*)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|{_TAG}((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|{_TAG}([^>]*)>", re.S)
#: A tag that the end of the page cuts off: a name, and attributes that have values.
_OPEN_END = re.compile(r"</?[a-zA-Z][a-zA-Z0-9-]*(?:\s+[a-zA-Z_:@-][^\s=<]*\s*=\s*(?:\"[^\"]*\"?|'[^']*'?|[^\s\"'<]*))*\s*/?\Z|<![^>]*\Z|</?\Z")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Block(NamedTuple):
    text: str
    #: Slots of the names on its path, each once; how many elements it stands in; how many characters of links it has.
    path: tuple[int, ...]
    depth: int
    linked: int


@functools.lru_cache(maxsize=50_000)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


class _Words(dict):
    """Slots of the words seen; it starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = PATH_DIM + zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIM
        return found


_WORDS = _Words()


def _names(tag: str, attributes: str) -> tuple[int, ...]:
    found = [_slot(tag, PATH_DIM)]
    if attributes and "=" in attributes:
        for match in _NAMED.finditer(attributes):
            found += [_slot("." + x, PATH_DIM) for x in _SPLIT.split((match[1] or match[2] or match[3] or "").lower()) if x]
    return tuple(found)


class _Reader:
    """Open elements of a page while its blocks are cut."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.opened: Counter[str] = Counter()
        self.live: Counter[int] = Counter()
        self.path: tuple[int, ...] | None = ()
        self.linked = self.hidden = 0

    def close(self) -> None:
        """Ends the block that is being read."""
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                if self.path is None:
                    self.path = tuple(self.live)
                self.out.append(Block(text, self.path, len(self.stack), self.linked))
            self.parts.clear()
        self.linked = 0

    def push(self, tag: str, names: tuple[int, ...]) -> None:
        self.stack.append((tag, names))
        self.opened[tag] += 1
        self.live.update(names)
        self.hidden += tag in HIDDEN_TAGS
        self.path = None

    def pop(self, name: str) -> None:
        """Closes the innermost element of a name and what is open within it."""
        while self.stack:
            top, names = self.stack.pop()
            self.opened[top] -= 1
            for x in names:
                self.live[x] -= 1
                if not self.live[x]:
                    del self.live[x]
            self.hidden -= top in HIDDEN_TAGS
            if top == name:
                break
        self.path = None

    def near(self, names: tuple[str, ...], barriers: frozenset[str]) -> str | None:
        """The innermost open element of these names, if no barrier stands before it."""
        if any(self.opened[x] for x in names):
            for top, _ in reversed(self.stack):
                if top in names:
                    return top
                if top in barriers:
                    return None
        return None

    def text(self, text: str) -> None:
        if self.opened["head"] and self.stack[-1][0] == "head" and not text.isspace():
            self.pop("head")
        if not self.hidden:
            self.parts.append(text)
            self.linked += len(text) * (self.opened["a"] > 0)

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.close()
        if found := self.near((tag,), SCOPE if tag not in SCOPE and tag not in BARRIERS else BARRIERS.get(tag, frozenset())):
            self.pop(found)

    def begin(self, tag: str, attributes: str) -> None:
        if self.opened["head"] and tag not in IN_HEAD and self.stack[-1][0] == "head":
            self.pop("head")
        if tag not in INLINE:
            self.close()
            if tag in BLOCK_CLOSES_P and self.near(("p",), SCOPE):
                self.pop("p")
            if old := self.near(CLOSES.get(tag, ()), BARRIERS.get(tag, frozenset())):
                self.pop(old)
        elif tag == "a" and self.near(("a",), SCOPE):
            self.pop("a")
        if tag == "br":
            self.parts.append(" ")
        if tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
            self.push(tag, _names(tag, attributes))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    if not page:
        return []
    reader, at, last = _Reader(), 0, page.rfind(">") + 1
    while found := _TOKEN.search(page, at, last):
        if found.start() > at:
            reader.text(page[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            reader.end(tag)
            continue
        reader.begin(tag, found[3] or found[6] or "")
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    # A tag that the end of the page cuts off is none of its text; any other "<" is.
    rest = page[at:]
    if rest:
        cut = _OPEN_END.search(rest, max(rest.rfind("<"), 0)) or (rest.startswith("<!--") and re.match(".*", rest, re.S))
        reader.text(rest[: cut.start()] if cut else rest)
    reader.close()
    return reader.out


class Vectors(NamedTuple):
    """Blocks as sparse rows: (block, slot, weight) ordered by block, where each block begins, and the sizes."""

    slot: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    sizes: np.ndarray

    def product(self, weights: np.ndarray) -> np.ndarray:
        """Rows times a matrix of INPUT rows."""
        out = self.sizes @ weights[-SIZES:]
        ends = np.append(self.first, len(self.slot))
        for i in range(0, len(out), PRODUCT_ROWS):  # a few rows at a time, so that what is gathered stays small
            first = self.first[i : i + PRODUCT_ROWS]
            some = slice(first[0], ends[i + len(first)])
            out[i : i + PRODUCT_ROWS] += np.add.reduceat(weights[self.slot[some]] * self.weight[some, None], first - first[0], 0)
        return out

    def transposed(self, d: np.ndarray) -> np.ndarray:
        """The gradient of ``product`` by the matrix, given that of the result."""
        out = np.zeros((INPUT, d.shape[1]), np.float32)
        block = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.slot))))
        order = np.argsort(self.slot, kind="stable")
        slot = self.slot[order]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        out[slot[starts]] = np.add.reduceat(d[block[order]] * self.weight[order, None], starts, 0)
        out[-SIZES:] = self.sizes.T @ d
        return out


def vectors(page: list[Block], start: int = 0, stop: int | None = None) -> Vectors:
    """The vectors of the blocks from start to stop of a page."""
    slot, weight, first, sizes, total = [], [], [], [], len(page)
    for i, block in enumerate(page[start:stop], start):
        first.append(len(slot))
        slot += block.path or (0,)
        weight += [1.0] * max(1, len(block.path))
        words = block.text.lower().split()
        # Words of one slot, and the weights they add up to, may stand apart.
        count, share = Counter(words), 0.5 / len(words)
        slot += map(_WORDS.__getitem__, count)
        weight += [x * share for x in count.values()]
        n = len(block.text)
        sizes.append((np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, block.linked / n), block.text[-1] in ".!?…\"'", i / total, min(1.0, block.depth / 16)))
    return Vectors(np.array(slot, np.int64), np.array(weight, np.float32), np.array(first, np.int64), np.array(sizes, np.float32).reshape(-1, SIZES))


def joined(some: list[Vectors]) -> Vectors:
    shift = np.cumsum([0, *[len(v.slot) for v in some[:-1]]])
    return Vectors(np.concatenate([v.slot for v in some]), np.concatenate([v.weight for v in some]), np.concatenate([v.first + k for v, k in zip(some, shift, strict=True)]), np.concatenate([v.sizes for v in some]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(seed: int = 7) -> dict[str, np.ndarray]:
    rng, w = np.random.default_rng(seed), {}
    for side in "fb":
        w["x" + side] = rng.normal(0, 0.07, (INPUT, 4 * HIDDEN)).astype(np.float32)
        w["h" + side] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w["c" + side] = np.zeros(4 * HIDDEN, np.float32)
        w["c" + side][HIDDEN : 2 * HIDDEN] = 1.0
        w["o" + side] = rng.normal(0, 0.2, HIDDEN).astype(np.float32)
    w["b"] = np.zeros(1, np.float32)
    return w


def _cell(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gates, new cell and its tanh of one step."""
    g, u = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
    i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
    new = f * c + i * u
    return i, f, o, u, new, np.tanh(new)


class Batch:
    """Some pages side by side, the longest first, so that at each step the first rows are the ones still running."""

    def __init__(self, pages: list[list[Block]]) -> None:
        self.pages, self.steps = pages, len(pages[0])
        lengths = np.array([len(p) for p in pages])
        self.running = (lengths[None, :] > np.arange(self.steps)[:, None]).sum(1)

    def place(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(step, row) of the blocks from start to stop, page by page."""
        spans = [min(stop, len(p)) - start for p in self.pages if len(p) > start]
        return np.concatenate([np.arange(n) for n in spans]), np.repeat(np.arange(len(spans)), spans)

    def vectors(self, start: int, stop: int) -> Vectors:
        return joined([vectors(p, start, stop) for p in self.pages if len(p) > start])


def scores(w: dict[str, np.ndarray], pages: list[list[Block]]) -> np.ndarray:
    """Probability of article (steps, rows) for pages in order of length, the longest first."""
    batch, rows = Batch(pages), len(pages)
    out, chunk = np.full((batch.steps, rows), w["b"][0], np.float32), max(1, BATCH_CELLS // rows)
    starts = range(0, batch.steps, chunk)
    kept = batch.vectors(0, chunk) if len(starts) == 1 else None
    for side in "fb":
        h = c = np.zeros((rows, HIDDEN), np.float32)
        for start in starts if side == "f" else reversed(starts):
            stop = min(start + chunk, batch.steps)
            pre = np.zeros((stop - start, rows, 4 * HIDDEN), np.float32)
            pre[batch.place(start, stop)] = (kept or batch.vectors(start, stop)).product(w["x" + side]) + w["c" + side]
            for t in range(start, stop) if side == "f" else range(stop - 1, start - 1, -1):
                k = batch.running[t]
                _, _, o, _, new, tanh = _cell(pre[t - start, :k] + h[:k] @ w["h" + side], c[:k])
                c, h = np.concatenate([new, c[k:]]), np.concatenate([o * tanh, h[k:]])
                out[t, :k] += h[:k] @ w["o" + side]
    return _sigmoid(out)


def label(w: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """Of each page which blocks are article."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        some, most = [], len(pages[order[-1]])
        while order and (not some or (len(some) + 1) * most <= BATCH_CELLS):
            some.append(order.pop())
        p = scores(w, [pages[i] for i in some])
        for k, i in enumerate(some):
            out[i] = p[: len(pages[i]), k] >= 0.5
    return out


def gradients(w: dict, pages: list[list[Block]], labels: list[np.ndarray], known: Vectors | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss over the blocks of pages in order of length, the longest first."""
    batch, rows, grad = Batch(pages), len(pages), {"b": np.zeros(1, np.float32)}
    known, place = known or batch.vectors(0, batch.steps), batch.place(0, batch.steps)
    shape, kept, ahead = (batch.steps, rows), {}, np.full((batch.steps, rows), w["b"][0], np.float32)
    for side in "fb":
        pre = np.zeros((*shape, 4 * HIDDEN), np.float32)
        pre[place] = known.product(w["x" + side]) + w["c" + side]
        h, c, kept[side] = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32), [None] * batch.steps
        for t in range(batch.steps) if side == "f" else range(batch.steps - 1, -1, -1):
            k = batch.running[t]
            cell = _cell(pre[t, :k] + h[:k] @ w["h" + side], c[:k])
            kept[side][t] = h[:k], c[:k], *cell
            c, h = np.concatenate([cell[4], c[k:]]), np.concatenate([cell[2] * cell[5], h[k:]])
            ahead[t, :k] += h[:k] @ w["o" + side]
    d = np.zeros(shape, np.float32)
    d[place] = (_sigmoid(ahead)[place] - np.concatenate(labels)) / len(known.first)
    grad["b"][0] = d.sum()
    for side in "fb":
        dz_all, out, dh, dc = np.zeros((*shape, 4 * HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        grad["h" + side] = np.zeros_like(w["h" + side])
        for t in range(batch.steps - 1, -1, -1) if side == "f" else range(batch.steps):
            k = batch.running[t]
            h, c, i, f, o, u, _, tanh = kept[side][t]
            out += d[t, :k] @ (o * tanh)
            dhk = dh[:k] + d[t, :k, None] * w["o" + side]
            dn = dc[:k] + dhk * o * (1 - tanh * tanh)
            dz = np.concatenate([dn * u * i * (1 - i), dn * c * f * (1 - f), dhk * tanh * o * (1 - o), dn * i * (1 - u * u)], 1)
            grad["h" + side] += h.T @ dz
            dz_all[t, :k] = dz
            dh, dc = np.concatenate([dz @ w["h" + side].T, dh[k:]]), np.concatenate([dn * f, dc[k:]])
        grad["o" + side] = out
        grad["x" + side], grad["c" + side] = known.transposed(dz_all[place]), dz_all.sum((0, 1))
    return grad


BOILERPLATE = {
    "nav": "menu nav navbar navigation breadcrumb breadcrumbs topnav links tabs pagination pager toc".split(),
    "header": "header masthead top banner logo branding site".split(),
    "footer": "footer bottom copyright legal colophon site".split(),
    "aside": "sidebar aside widget related recommended popular trending rail secondary teaser".split(),
    "div": "ad ads advert advertisement advertising sponsor sponsored promo adsense banner notice cookie cookies consent gdpr alert newsletter subscribe signup share sharing social popup modal overlay paywall hint warning".split(),
    "form": "form search login contact subscribe signup".split(),
    "section": "comments comment commentlist replies reply respond disqus discussion responses reader readers feedback thread".split(),
}
CONTENT = "content post entry article body story text main page single hentry prose copy".split()
NEUTRAL = "row col container wrap wrapper inner outer grid box layout region block cell site page".split()
#: Words that boilerplate has and articles seldom have.
STOCK = {
    "nav": "home about contact menu products services blog news login sitemap next previous".split(),
    "header": "welcome to our site the daily online home of".split(),
    "footer": "copyright all rights reserved privacy policy terms imprint powered by contact us".split(),
    "aside": "related articles most popular read more also trending tags archives recent posts".split(),
    "div": "advertisement sponsored buy now offer cookies accept we use this site subscribe newsletter share tweet free click here".split(),
    "form": "name email password search send submit subscribe log in your message".split(),
    "section": "comments says reply posted by guest great thanks nice article i agree leave a comment ago".split(),
}


def _example(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A made-up page and the labels of its blocks."""
    labels: list[bool] = []
    pick = lambda xs: xs[rng.integers(len(xs))]
    some = lambda p: rng.random() < p
    syllables = ["an", "er", "th", "on", "re", "le", "qu", "sch", "ó", "ie", "ti", "ñ", "ê", "st"]
    common = "the of and a in to is was for that it with as his on be at by had which".split()
    word = lambda: pick(common) if some(0.2) else "".join(pick(syllables) for _ in range(rng.integers(1, 4)))

    def prose(low: int, high: int, kind: str | None = None) -> str:
        """Words of an article, or of boilerplate of a kind."""
        labels.append(kind is None)
        words = [pick(STOCK[kind]) if kind and some(0.5) else word() for _ in range(rng.integers(low, high))]
        if some(0.2):
            words = [x + pick(["###", "%%%", "&amp;&amp;&amp;", "!!"]) for x in words]
        return " ".join(words).capitalize() + pick([".", ".", "", "!"])

    def name(xs: list[str]) -> str:
        given = pick(xs) + pick(["", "", "-box", "-area", "-1", "s-list", "_wrap"])
        given = pick(NEUTRAL) + " " + given if some(0.15) else given
        return f' class="{given}"' if some(0.65) else f" id='{given}'" if some(0.8) else f" class={given.split()[-1]}"

    def wrapped(inner: str) -> str:
        """Within elements that tell nothing."""
        while some(0.25):
            inner = f'<div{pick(["", f" class={chr(34)}{pick(NEUTRAL)}{chr(34)}"])}>{inner}</div>'
        return inner

    def list_of(low: int, high: int, kind: str) -> str:
        tag = pick(["ul", "ul", "ol"])
        return f"<{tag}>" + "".join(f'<li><a href="/x">{prose(1, 4, kind)}</a>{pick(["</li>", "</li>", ""])}' for _ in range(rng.integers(low, high))) + f"</{tag}>"

    def remarks() -> str:
        """Comments of readers."""
        title = f"<h3>{prose(1, 4, 'section')}</h3>" if some(0.5) else ""
        many, style = rng.integers(1, 5), rng.integers(5)
        one = lambda: f"<p>{prose(2, 40, 'section')}</p>"
        if style == 0:
            return title + "".join(one() for _ in range(many))
        if style == 1:
            return title + "<ol>" + "".join(f"<li>{prose(2, 40, 'section')}</li>" for _ in range(many)) + "</ol>"
        if style == 2:
            return title + "".join(f'<div class="{pick(["comment", "reply", "media", "comment-body"])}"><b>{prose(1, 3, "section")}</b>{one()}</div>' for _ in range(many))
        if style == 3:
            return title + "".join(f"<article>{one()}</article>" for _ in range(many))
        return title + "<ul>" + "".join(f"<li><div>{prose(1, 4, 'section')}</div>{one()}{one() if some(0.3) else ''}</li>" for _ in range(many)) + "</ul>"

    def junk(kind: str) -> str:
        tag = kind if some(0.6) or kind == "form" else pick(["div", "div", "section", "aside"] if kind != "nav" else ["div", "ul"])
        named = name(BOILERPLATE[kind])
        if tag in ("nav", "aside", "footer", "form", "header") and some(0.3):
            named = ""  # the tag tells
        if kind == "nav":
            inner = list_of(2, 9, kind) if tag != "ul" else "".join(f"<li><a href=/x>{prose(1, 4, kind)}</a></li>" for _ in range(rng.integers(2, 7)))
        elif kind == "form":
            inner = f"<label>{prose(1, 4, kind)}</label><input><button>{prose(1, 3, kind)}</button>" if some(0.7) else f"<p>{prose(2, 12, kind)}</p><input type=text><button>{prose(1, 3, kind)}</button>"
        elif kind == "section":
            inner = remarks()
        elif kind == "aside":
            inner = f"<h3>{prose(1, 4, kind)}</h3>" + (list_of(2, 6, kind) if some(0.5) else f"<p>{prose(3, 30, kind)}</p>")
        elif some(0.4):
            inner = f"<p>{prose(2, 30, kind)}</p>"
        elif some(0.2) and kind == "div":
            return f"<p{named}>{prose(2, 20, kind)}</p>"
        else:
            inner = ("&copy; " if kind == "footer" else "") + prose(2, 30, kind)
        return f"<{tag}{named}>{wrapped(inner)}</{tag}>"

    def inside() -> str:
        kind = rng.random()
        if kind < 0.68:
            return f"<p{name(CONTENT) if some(0.05) else ''}>{pick(['', '', '<b>'])}{prose(1, 90)}{pick(['', '', '<br>'])}{pick(['</p>', '</p>', '</p>', ''])}"
        if kind < 0.74:
            head = pick(["h2", "h2", "h3", "h4"])
            return f"<{head}>{prose(1, 8)}</{head}>"
        if kind < 0.80:
            tag = pick(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{prose(1, 20)}{f'<ul><li>{prose(1, 8)}</li></ul>' if some(0.15) else ''}</li>" for _ in range(rng.integers(1, 5))) + f"</{tag}>"
        if kind < 0.84:
            return f"<blockquote><p>{prose(4, 40)}</p></blockquote>"
        if kind < 0.87:
            return "<table>" + "".join(f"<tr><td>{prose(1, 5)}</td><td>{prose(1, 5)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>"
        if kind < 0.89:
            return f"<pre>{prose(3, 20)}</pre>"
        if kind < 0.91:
            return f"<figure><img src=x><figcaption>{prose(2, 12)}</figcaption></figure>"
        if kind < 0.92:
            return f"<dl><dt>{prose(1, 4)}</dt><dd>{prose(3, 20)}</dd></dl>"
        return junk(pick(["div", "div", "aside", "form", "nav"]))

    def article() -> str:
        out = [f"<h1>{prose(2, 14)}</h1>"] if some(0.9) else []
        for _ in range(rng.integers(1, 12)):
            part = inside()
            out.append(f"<{(tag := pick(['div', 'section']))}>{part}</{tag}>" if some(0.08) and not part.endswith((".", "!")) else part)
        return "".join(out) + (junk("section") if some(0.25) else "") + (junk("footer") if some(0.1) else "")

    page = [pick(["<html><head><title>x</title></head><body>", "<head><title>x</title><body>", "<!doctype html><html><head><meta charset=utf-8></head><body>"])]
    for kind in ("header", "nav", "div"):
        if some(0.7):
            page.append(wrapped(junk(kind)))
    body = pick(["article", "article", "article", "main", "div", "section", "td", "body"])
    named = f' {pick(["class", "id"])}="{pick(CONTENT)}{pick(["", "-body", "-content"])}"' if body in ("div", "section") or some(0.3) else ""
    start, end = ("", "") if body == "body" else (f"<table><tr><td{named}>", "</td></tr></table>") if body == "td" else (f"<{body}{named}>", f"</{body}>")
    wrap = pick([("", ""), ("", ""), ("<main>", "</main>"), ('<div id="wrapper">', "</div>"), ("<section>", "</section>")])
    page.append(f"{wrap[0]}{wrapped(f'{start}{article()}{end}')}{wrap[1]}")
    for kind in ("aside", "section", "div", "form", "nav", "footer"):
        if some(0.8 if kind == "footer" else 0.3):
            page.append(wrapped(junk(kind)))
    return "".join(page) + "</body></html>", labels


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights of the labeller, by Adam on made-up pages."""
    rng, w, data = np.random.default_rng(seed), init(), []
    while len(data) < pages:
        page, labels = _example(rng)
        cut = blocks(page)
        if len(cut) == len(labels):
            data.append((cut, np.array(labels, np.float32)))
    data.sort(key=lambda x: -len(x[0]))
    batches = [([a for a, _ in data[i : i + 25]], [b for _, b in data[i : i + 25]]) for i in range(0, len(data), 25)]
    batches = [(a, b, Batch(a).vectors(0, len(a[0]))) for a, b in batches]
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs)
        for at in rng.permutation(len(batches)):
            grad = gradients(w, *batches[at])
            step += 1
            for k in w:
                g = np.clip(grad[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def main_text(w: dict, pages: list[str | None]) -> list[str]:
    cut = [blocks(p) for p in pages]
    return [" ".join(b.text for b, keep in zip(page, kept, strict=True) if keep) for page, kept in zip(cut, label(w, cut), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text."""
    small_batches(pages.sparkSession)
    w = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main_text(w, batch.column(2).to_pylist()), pa.string())], names=["page_id", "url", "text"])

    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = pages.schema
    return pages.mapInArrow(run, f"page_id {kind['page_id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string")
