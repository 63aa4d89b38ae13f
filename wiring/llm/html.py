"""Main text of web pages: boosted trees over DOM nodes, decoded so that no choice contradicts another.

A page becomes a tree of block elements; stretches of text and inline elements between them are its
leaves (runs).  Each node has features of its subtree (length, link and sign density, share of the
page), its tag, its ancestors, depth and siblings; and, hashed into ``BUCKETS`` yes-or-no features each, the
words of the class, id and role of the node itself and of its two nearest ancestors that have any.
Gradient-boosted trees give the chance that a node holds main text; which words matter they learn.  Decoding
maximises the likelihood of all nodes together where a node may hold main text only if its parent does,
by one pass up and one down the tree.  Kept runs are the blocks of the text, in page order.

The trees are fitted (``fit``) on pages made here by a seeded generator that knows which runs are main text, some
of them with misleading words on the article; ``trees.npz`` beside this module holds the fitted ones.
Reading a page takes time in proportion to its length, whatever its markup: tags that never end, elements that
are never closed, deep nesting and stray end tags included.

Defined results: a null or empty page, or one without main text, has the empty text; markup that is
never closed or wrongly nested is read as browsers do in the common cases; pages of any length are
read whole; rows are kept one to one, repeated ones too; an empty table gives an empty table; of
other columns only those in ``keep`` are carried along.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- tree -------------------------------------------------------------------------------------

_APART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_HEAD = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_REST = re.compile(r"((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
#: Elements whose content is never text of the page: code, form fields, drawings and what only shows where media fail.
_RAW = frozenset("script style template iframe svg head title textarea select canvas audio video annotation annotation-xml".split())
#: Elements that are read as if their tags were not there; formulas and fallbacks inside a paragraph stay in it.
_CLEAR = frozenset("math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics mstyle mpadded mphantom menclose mfenced mspace object".split())
#: Blocks whose text ``noscript`` is part of; elsewhere it is a block of its own.
_SAYING = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split())
#: Those that run to the end of the page when nothing closes them.
_TO_END = frozenset("script style textarea title iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key ends an open element of the value, up to a container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAIN = frozenset("ul ol dl table body html div section article main aside nav header footer form td th blockquote".split())
_PARAGRAPH = {"p"}
_SPACE = re.compile(r"\s+")

TAGS = ("p", "h1", "h2", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "td", "body", "blockquote", "pre", "figure", "other")
_ALIAS = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "dl": "ul", "dt": "li", "dd": "li", "th": "td", "table": "td", "tr": "td", "tbody": "td", "html": "body", "figcaption": "figure", "button": "form", "fieldset": "form"}
_CODE = {t: k for k, t in enumerate(TAGS)}
_INSIDE = ("article", "main", "nav", "header", "footer", "aside", "form", "ul")


class Node:
    """A block element, or a run of text where ``tag`` is None."""

    __slots__ = ("tag", "parent", "children", "tokens", "parts", "linked", "text", "hidden", "label")

    def __init__(self, tag: str | None, parent: Node | None, tokens: frozenset[str] = frozenset(), hidden: bool = False):
        self.tag, self.parent, self.tokens, self.hidden = tag, parent, tokens, hidden
        self.children: list[Node] = []
        self.parts: list[str] | None = [] if tag is None else None
        self.linked, self.text, self.label = 0, "", None


class _Ends:
    """Where the tag whose name ends at a place ends itself, as ``_REST`` has it, for all places of a page in one pass from its end."""

    def __init__(self, page: str):
        found = [(m.start(), m[0]) for m in re.finditer("[\"'>]", page)]
        self.places = [at for at, _ in found]
        self.ends: list[int | None] = [None] * (len(found) + 1)
        last: dict[str, int] = {}
        for k in range(len(found) - 1, -1, -1):
            at, sign = found[k]
            if sign == ">":
                self.ends[k] = at
            else:
                if sign in last:  # goes on behind the closing quote
                    self.ends[k] = self.ends[last[sign] + 1]
                last[sign] = k

    def after(self, place: int) -> int | None:
        return self.ends[bisect.bisect_left(self.places, place)]


class _Open:
    """The open elements, with what is open counted so that no question walks through them."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [("html", root)]  # inline elements stand on it with their block
        self.blocks: dict[str, int] = {}
        self.inline: list[dict[str, int] | None] = [None]  # of each open block, the inline elements open right inside
        self.boxes: list[tuple[int, dict[str, int]]] = [(0, {})]  # of each open container, its place and the blocks open right inside
        self.links = 0

    def push(self, tag: str, node: Node | None = None) -> None:
        if node is None:
            self.links += tag == "a"
            inside = self.inline[-1] = self.inline[-1] or {}
            inside[tag] = inside.get(tag, 0) + 1
            self.stack.append((tag, self.stack[-1][1]))
            return
        self.blocks[tag] = self.blocks.get(tag, 0) + 1
        self.inline.append(None)
        if tag in _CONTAIN:
            self.boxes.append((len(self.stack), {}))
        else:
            inside = self.boxes[-1][1]
            inside[tag] = inside.get(tag, 0) + 1
        self.stack.append((tag, node))

    def pop(self, to: int) -> bool:
        """Close all from a place on; whether a block was among them."""
        block = False
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            if tag in _INLINE:
                self.links -= tag == "a"
                self.inline[-1][tag] -= 1
                continue
            block = True
            self.blocks[tag] -= 1
            self.inline.pop()
            if self.boxes[-1][0] == len(self.stack):
                self.boxes.pop()
            else:
                self.boxes[-1][1][tag] -= 1
        return block

    def _top(self, tags: frozenset[str] | set[str]) -> int:
        k = len(self.stack) - 1
        while self.stack[k][0] not in tags:
            k -= 1  # all of these are closed next
        return k

    def end(self, tag: str) -> int | None:
        """The place of the element that an end tag closes; an inline one does not close blocks."""
        some = self.inline[-1] if tag in _INLINE else self.blocks
        return self._top({tag}) if some and some.get(tag) else None

    def ended(self, tags: set[str]) -> int | None:
        """The place of the last open element among ``tags``, up to the last container, itself included."""
        place, inside = self.boxes[-1]
        for t in tags:
            if inside.get(t):
                return self._top(tags)
        return place if place and self.stack[place][0] in tags else None


def parse(page: str) -> Node:
    """The tree of block elements and runs."""
    root = Node("body", None)
    held = _Open(root)
    run: Node | None = None
    ends: _Ends | None = None  # made when the first tag without an end is met
    unclosed: set[str] = set()

    def say(text: str) -> None:
        nonlocal run
        if not text or (run is None and text.isspace()):
            return
        if run is None:
            run = Node(None, held.stack[-1][1])
            run.parent.children.append(run)
        text = entities.unescape(text)
        run.parts.append(text)
        if held.links:
            run.linked += len(text.strip())

    said = at = 0  # what is said, and where the next markup is sought
    while (less := page.find("<", at)) >= 0:
        if page[less + 1 : less + 2] in ("!", "?"):
            m = _APART.match(page, less)
            say(page[said:less])
            said = at = m.end()
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        head = _HEAD.match(page, less)
        if head is None:
            at = less + 1
            continue
        if ends is None:
            rest = _REST.match(page, head.end())
            end = rest.end() - 1 if rest else None
            if rest is None:
                ends = _Ends(page)
        else:
            end = ends.after(head.end())
        if end is None:  # no tag, but text
            at = less + 1
            continue
        attributes_text = page[head.end() : end]
        say(page[said:less])
        said = at = end + 1
        tag = head[2].lower()
        if head[1]:
            if tag == "head":
                continue
            to = held.end(tag)
            if to is not None:
                if held.pop(to):
                    run = None
            elif tag == "p":
                run = None
            continue
        if tag == "svg" and attributes_text.endswith("/") or tag in _CLEAR or tag == "noscript" and held.stack[-1][1].tag in _SAYING:
            continue
        if tag in _RAW:
            close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if close is not None:
                said = at = close.end()
            elif tag in _TO_END:
                said = at = len(page)
            else:
                unclosed.add(tag)
            if tag in ("head", "title"):
                run = None
            continue
        if tag in ("html", "body"):
            root.tokens |= _tokens(_ATTRIBUTE.findall(attributes_text))
            continue
        if tag in _VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                run = None
            continue
        if tag in _INLINE:
            held.push(tag)
            continue
        to = held.ended(_ENDS.get(tag, _PARAGRAPH))
        if to is not None:
            held.pop(to)
        if tag in _ENDS and held.boxes[-1][1].get("p"):
            held.pop(held.ended(_PARAGRAPH))
        above = held.stack[-1][1]
        if attributes_text:
            attributes = _ATTRIBUTE.findall(attributes_text)
            node = Node(tag, above, _tokens(attributes), _hidden(attributes))
        else:
            node = Node(tag, above)
        above.children.append(node)
        run = None
        if not attributes_text.rstrip().endswith("/"):
            held.push(tag, node)
    say(page[said:])
    return root


def _tokens(attributes) -> frozenset[str]:
    return frozenset(w.lower() for name, *values in attributes if name.lower() in ("class", "id", "role") for v in values for w in _TOKEN.findall(v))


def _hidden(attributes) -> bool:
    for name, *values in attributes:
        name, value = name.lower(), "".join(values).lower().replace(" ", "")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and ("display:none" in value or "visibility:hidden" in value)):
            return True
    return False


# --- features ---------------------------------------------------------------------------------

BUCKETS = 512
_N_SELF = 13
N_DENSE = _N_SELF + len(TAGS) + len(_INSIDE)


class Features:
    """Rows of numbers, and the yes-or-no features from ``N_DENSE`` on as pairs of row and feature."""

    def __init__(self, dense: np.ndarray, rows: np.ndarray, cols: np.ndarray):
        self.dense, self.rows, self.cols = dense, rows, cols

    def __len__(self) -> int:
        return len(self.dense)

    @staticmethod
    def joined(parts: list[Features]) -> Features:
        begins = np.cumsum([0, *(len(p) for p in parts[:-1])])
        return Features(np.concatenate([p.dense for p in parts]), np.concatenate([p.rows + b for p, b in zip(parts, begins, strict=True)]), np.concatenate([p.cols for p in parts]))

    def columns(self, wanted: np.ndarray, begin: int, end: int) -> np.ndarray:
        """The features numbered ``wanted`` (ascending) of some rows as a table."""
        out = np.zeros((end - begin, len(wanted)), np.float32)
        dense = wanted[wanted < N_DENSE]
        out[:, : len(dense)] = self.dense[begin:end, dense]
        lo, hi = np.searchsorted(self.rows, (begin, end))
        at = np.searchsorted(wanted, self.cols[lo:hi]).clip(0, max(len(wanted) - 1, 0))
        known = wanted[at] == self.cols[lo:hi] if len(wanted) else np.zeros(hi - lo, bool)
        out[self.rows[lo:hi][known] - begin, at[known]] = 1
        return out


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def nodes_of(root: Node) -> tuple[list[Node], list[int], Features]:
    """All nodes that hold text, in page order, the place of each one's parent, and their features."""
    every, ups = [], []
    todo = [(root, -1)]
    while todo:
        node, up = todo.pop()
        if node.tag is None:
            node.text = _SPACE.sub(" ", "".join(node.parts)).strip()
            if not node.text:
                continue
        k = len(every)
        every.append(node)
        ups.append(up)
        todo += [(c, k) for c in reversed(node.children)]
    full = [node.tag is None for node in every]
    for k in range(len(every) - 1, 0, -1):
        if full[k]:
            full[ups[k]] = True
    full[0] = True
    places, nodes, parents = [0] * len(every), [], []
    for k, node in enumerate(every):
        if full[k]:
            places[k] = len(nodes)
            nodes.append(node)
            parents.append(places[ups[k]] if k else -1)
    n = len(nodes)
    chars, linked, signs, runs, longest, kids, before = ([0] * n for _ in range(7))
    total = 0
    for k, node in enumerate(nodes):
        before[k] = total
        if node.tag is None:
            size = len(node.text)
            chars[k], linked[k], runs[k], longest[k] = size, min(node.linked, size), 1, size
            signs[k] = sum(map(node.text.count, ".,;:!?"))
            total += size
    for k in range(n - 1, 0, -1):
        up = parents[k]
        chars[up] += chars[k]
        linked[up] += linked[k]
        signs[up] += signs[k]
        runs[up] += runs[k]
        kids[up] += 1
        if longest[k] > longest[up]:
            longest[up] = longest[k]
    depth, inside, hidden, code = ([0] * n for _ in range(4))
    told: list[tuple[tuple[int, ...], ...]] = [()] * n  # the buckets of the two nearest ancestors that have words
    rows, cols = [], []
    for k, node in enumerate(nodes):
        up = parents[k]
        own = tuple(sorted({_bucket(t) for t in node.tokens})) if node.tokens else ()
        tag = node.tag or nodes[up].tag
        tag = _ALIAS.get(tag, tag)
        code[k] = _CODE.get(tag, len(TAGS) - 1)
        hidden[k] = node.hidden
        if up >= 0:
            depth[k], inside[k], hidden[k] = depth[up] + 1, inside[up], node.hidden or nodes[up].hidden
            above = told[up]
            cols += own
            around = {b for part in above for b in part}
            cols += [BUCKETS + b for b in sorted(around)]
            rows += [k] * (len(own) + len(around))
            told[k] = (own, *above)[:2] if own else above
        if node.tag and tag in _INSIDE:
            inside[k] |= 1 << _INSIDE.index(tag)
    x = np.zeros((n, N_DENSE), np.float32)
    size, up = np.array(chars, float), np.array(parents)
    whole = max(total, 1)
    x[:, 0] = [node.tag is None for node in nodes]
    x[:, 1] = hidden
    x[:, 2] = np.log1p(size)
    x[:, 3] = np.array(linked) / np.maximum(size, 1)
    x[:, 4] = np.array(signs) / np.maximum(size, 1)
    x[:, 5] = size / whole
    x[:, 6] = np.where(up >= 0, size / np.maximum(size[up], 1), 1)
    x[:, 7] = np.array(before) / whole
    x[:, 8] = np.log1p(kids)
    x[:, 9] = depth
    x[:, 10] = np.log1p(longest)
    x[:, 11] = np.log1p(runs)
    x[:, 12] = np.log1p(np.where(up >= 0, np.array(kids)[up], 1))
    x[np.arange(n), _N_SELF + np.array(code)] = 1
    x[:, _N_SELF + len(TAGS) :] = (np.array(inside)[:, None] >> np.arange(len(_INSIDE))) & 1
    return nodes, parents, Features(x, np.array(rows, np.int64), np.array(cols, np.int64) + N_DENSE)


# --- boosted trees ----------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted trees of fixed depth for the logistic loss, over binned features."""

    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = n_trees, depth, rate, bins, least

    def fit(self, features: Features, y: np.ndarray) -> Boosted:
        x = features.dense
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        words = 2 * BUCKETS
        rows, cols = features.rows, features.cols - N_DENSE
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.n_trees, inner), np.int64)
        self.threshold = np.full((self.n_trees, inner), np.inf, np.float32)
        self.leaf = np.zeros((self.n_trees, inner + 1), np.float32)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.start)
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            place = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level

                def gains(gl, hl, gs, hs):
                    gr, hr = gs - gl, hs - hl
                    value = gl**2 / (hl + self.least) + gr**2 / (hr + self.least) - gs**2 / (hs + self.least)
                    value[(hl < 0.5) | (hr < 0.5)] = -np.inf
                    return value

                all_g, all_h = np.bincount(place, g, width)[:, None], np.bincount(place, h, width)[:, None]
                gain = np.full((width, m, self.bins), -np.inf)
                for j in range(m):
                    key = place * self.bins + binned[:, j]
                    gl = np.bincount(key, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hl = np.bincount(key, h, width * self.bins).reshape(width, -1).cumsum(1)
                    gain[:, j, : len(cuts[j])] = gains(gl, hl, all_g, all_h)[:, : len(cuts[j])]
                key = place[rows] * words + cols  # all words at once: those that have them, against the rest
                has = gains(np.bincount(key, g[rows], width * words).reshape(width, -1), np.bincount(key, h[rows], width * words).reshape(width, -1), all_g, all_h)
                best, word = gain.reshape(width, -1).argmax(1), has.argmax(1)
                right = np.zeros(n, bool)
                for q in range(width):
                    j, b = divmod(int(best[q]), self.bins)
                    here = place == q
                    if max(gain[q, j, b], has[q, word[q]]) <= 1e-6:
                        continue
                    if has[q, word[q]] > gain[q, j, b]:
                        self.feature[t, first + q], self.threshold[t, first + q] = N_DENSE + word[q], 0.5
                        with_word = np.zeros(n, bool)
                        with_word[rows[cols == word[q]]] = True
                        right |= here & with_word
                    else:
                        self.feature[t, first + q], self.threshold[t, first + q] = j, cuts[j][b]
                        right |= here & (x[:, j] > np.float32(cuts[j][b]))
                place = 2 * place + right
            gl, hl = np.bincount(place, g, inner + 1), np.bincount(place, h, inner + 1)
            self.leaf[t] = -self.rate * gl / (hl + self.least)
            score += self.leaf[t, place]
        return self

    def predict(self, features: Features) -> np.ndarray:
        """The chance of each row."""
        used, at = np.unique(self.feature, return_inverse=True)
        at = at.reshape(self.feature.shape)
        parts = []
        for begin in range(0, len(features), 50_000):
            x = features.columns(used, begin, min(len(features), begin + 50_000))
            rows, score = np.arange(len(x)), np.full(len(x), self.start)
            for feature, threshold, leaf in zip(at, self.threshold, self.leaf, strict=True):
                place = np.zeros(len(x), np.int64)
                for level in range(self.depth):
                    k = (1 << level) - 1 + place
                    place = 2 * place + (x[rows, feature[k]] > threshold[k])
                score += leaf[place]
            parts.append(1 / (1 + np.exp(-score)))
        return np.concatenate(parts) if parts else np.zeros(0)

    def save(self, path: str) -> None:
        np.savez_compressed(path, feature=self.feature.astype(np.int16), threshold=self.threshold, leaf=self.leaf, start=self.start)

    @staticmethod
    def load(path: str) -> Boosted:
        with np.load(path, allow_pickle=False) as z:
            trees = Boosted(*z["feature"].shape[:1], int(z["feature"].shape[1] + 1).bit_length() - 1)
            trees.feature, trees.threshold, trees.leaf, trees.start = z["feature"].astype(np.int64), z["threshold"], z["leaf"], float(z["start"])
        return trees


def decode(parents: list[int], chance: np.ndarray) -> np.ndarray:
    """The likeliest choice in which a node is chosen only if its parent is."""
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    for k in range(len(parents) - 1, 0, -1):
        up = parents[k]
        yes[up] += max(yes[k], no[k])
        no[up] += no[k]
    kept = np.zeros(len(parents), bool)
    for k, up in enumerate(parents):
        kept[k] = (up < 0 or kept[up]) and yes[k] > no[k]
    return kept


# --- pages to learn from ----------------------------------------------------------------------


class Maker:
    """Pages whose main text is known: ``<m>`` and ``</m>`` stand around what is main text until they are cut out."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choices("abcdefghijklmnoprstuvwzéèüñß", k=self.r.randint(1, 3))) for _ in range(60)]
        self.shouting = self.r.random() < 0.1
        self.sign = self.r.choice(["", "", "", "", "&amp;&amp;", "!!", "###", " |"])

    def word(self) -> str:
        w = "".join(self.r.choices(self.syllables, k=self.r.randint(1, 4)))
        return (w.upper() if self.shouting else w) + self.sign

    def words(self, low: int, high: int) -> str:
        out, n = [], self.r.randint(low, high)
        for k in range(n):
            out.append(self.word() + ("," if self.r.random() < 0.08 else "." if self.r.random() < 0.08 else ""))
        return " ".join(out) + self.r.choice([".", ".", "", "?"])

    def cls(self, *names: str, sure: float = 0.8) -> str:
        if self.r.random() > sure:
            return self.r.choice(["", f' class="{self.r.choice("abcdxyz")}{self.r.randint(1, 99)}"'])
        kind = self.r.choice(["class", "class", "id"])
        return f' {kind}="{self.r.choice(names)}{self.r.choice(["", "", "-box", " c1", "-wrap"])}"'

    def misled(self, *names: str, sure: float = 0.8) -> str:
        """As ``cls`` for an article, at times with a word that elsewhere names what is not main text."""
        if self.r.random() > 0.3:
            return self.cls(*names, sure=sure)
        odd = self.r.choice("comment comments reply ad ads advert promo share social related sidebar header footer menu nav notice banner cookie widget newsletter subscribe login breadcrumbs copyright".split())
        odd = odd + self.r.choice(["-policy", "-free", "-guide", "-history", "-page", ""]) if self.r.random() < 0.5 else self.r.choice(["no-", "our-", "about-", "the-"]) + odd
        words = self.r.sample([odd, self.r.choice(names)], 2) if self.r.random() < 0.7 else [odd]
        return f' class="{" ".join(words)}"'

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{k}">{self.words(1, 4).rstrip(".?")}</a>' for k in range(self.r.randint(low, high))]
        return self.r.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " ".join(items), "<div>" + " | ".join(items) + "</div>"])

    def paragraph(self) -> str:
        r = self.r
        body = self.words(*r.choice([(1, 3), (3, 15), (20, 90), (20, 90), (60, 200)]))
        if r.random() < 0.2:
            body = f"<b>{body}" + r.choice(["</b>", "<br>", ""])
        if r.random() < 0.15:
            body += f' <a href="/x">{self.words(1, 4)}</a> {self.words(2, 20)}'
        return f"<p>{body}" + r.choice(["</p>", "</p>", "</p>", ""])

    def prose(self) -> str:
        r, out = self.r, []
        if r.random() < 0.7:
            out.append(f"<h1>{self.words(2, 12)}</h1>")
        for _ in range(r.choice([1, 1, 2, 4, 8, 20, 20, 80])):
            kind = r.random()
            if kind < 0.75:
                out.append(self.paragraph())
            elif kind < 0.83:
                out.append(f"<{(h := r.choice(['h2', 'h3']))}>{self.words(1, 6)}</{h}>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.words(1, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote>{self.paragraph()}</blockquote>")
            else:
                out.append(r.choice([f"<pre>{self.words(4, 30)}</pre>", f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>", f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>"]))
            if r.random() < 0.08:
                out.append("</m>" + self.aside_of() + "<m>")
        return "<m>" + "".join(out) + "</m>"

    def advert(self) -> str:
        body = self.r.choice([self.words(3, 25), f"<p>{self.words(3, 25)}</p>", f'<a href="/buy">{self.words(2, 8)}</a>'])
        return f"<div{self.cls('ad', 'ads', 'advert', 'sponsored', 'promo', sure=0.95)}>{body}</div>"

    def aside_of(self) -> str:
        r = self.r
        return r.choice([
            self.advert, self.advert, lambda: f"<aside{self.cls('related', 'sidebar', sure=0.5)}>{r.choice([self.links(), f'<p>{self.words(3, 30)}</p>'])}</aside>",
            lambda: f"<div{self.cls('share', 'social', 'newsletter', 'related', sure=0.95)}>{self.links(2, 5)}</div>",
            lambda: f"<form{self.cls('subscribe', 'search')}><p>{self.words(2, 15)}</p><label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button></form>"])()

    def remarks(self) -> str:
        r = self.r
        one = lambda: f"<{(t := r.choice(['div', 'li', 'article']))}{self.cls('comment', 'reply', sure=0.9)}><p>{self.words(3, 60)}</p></{t}>"
        body = "".join(one() for _ in range(r.randint(1, 6)))
        return f"<{(t := r.choice(['section', 'div']))}{self.cls('comments', 'discussion', 'respond', sure=1)}><h3>{self.words(1, 3)}</h3>{body}</{t}>"

    def page(self) -> str:
        r = self.r
        top = r.sample([
            lambda: f"<nav{self.cls('nav', 'menu', sure=0.4)}>{self.links()}</nav>", lambda: f"<header{self.cls('header', sure=0.4)}><h1>{self.words(1, 5)}</h1>{r.choice([self.links(), '<p>' + self.words(2, 12) + '</p>'])}</header>",
            lambda: f"<div{self.cls('menu', 'header', 'breadcrumbs', 'navbar', sure=0.95)}>{self.links()}</div>", self.advert,
            lambda: f"<div{self.cls('cookie', 'notice', 'banner', 'consent', 'alert', sure=0.95)}>{r.choice(['<p>' + self.words(4, 40) + '</p>', self.words(4, 40)])}<button>{self.words(1, 2)}</button></div>"], r.randint(0, 4))
        low = r.sample([
            lambda: f"<footer{self.cls('footer', sure=0.4)}>{r.choice(['&copy; ' + self.words(2, 25), self.links(), '<p>' + self.words(3, 30) + '</p>'])}</footer>",
            lambda: f"<aside{self.cls('sidebar', 'widget', sure=0.5)}><h3>{self.words(1, 3)}</h3>{r.choice([self.links(), '<p>' + self.words(5, 40) + '</p>'])}</aside>",
            lambda: f"<div{self.cls('footer', 'sidebar', 'related', 'widget', 'copyright', sure=0.95)}>{r.choice([self.links(), self.words(3, 30)])}</div>",
            self.remarks, self.advert, self.aside_of], r.randint(0, 5))
        prose = self.prose()
        inner = r.choice(["", "", "", "</m>" + self.remarks() + "<m>"])
        body = r.choice([
            lambda: f"<article{self.misled('content', 'article', sure=0.3)}>{prose}{inner}</article>", lambda: f"<article>{prose}</article>", lambda: f"<main><article{self.misled('post', 'entry')}>{prose}{inner}</article></main>",
            lambda: f"<div{self.misled('content', 'main', 'post', 'story', 'article', 'body', 'text', 'prose', sure=0.9)}>{prose}{inner}</div>", lambda: f"<main>{prose}</main>",
            lambda: f"<div{self.cls('page', sure=0.5)}><section{self.cls('content', 'text', sure=0.7)}>{prose}</section></div>"])()
        body = body.replace("</m><m>", "")
        wrap = r.choice([("", ""), ("", ""), ("<div>", "</div>"), ('<div id="wrapper">', "</div>")])
        return "<html><body>" + wrap[0] + "".join(f() for f in top) + body + "".join(f() for f in low) + wrap[1] + "</body></html>"


def labelled(seed: int) -> tuple[list[Node], list[int], Features, np.ndarray]:
    """A made page's nodes, parents, features and whether each holds main text."""
    marked = Maker(seed).page()
    # private-use marks survive parsing as text, so runs know where they stand
    on, off = chr(0xE000), chr(0xE001)
    root = parse(marked.replace("<m>", on).replace("</m>", off))
    inside = False
    todo, own = [root], {}
    while todo:
        node = todo.pop()
        if node.tag is None:
            text = "".join(node.parts)
            own[id(node)] = inside
            for c in text:
                inside = c == on if c in (on, off) else inside
                own[id(node)] |= inside and c not in (on, off)
            node.parts = [text.replace(on, "").replace(off, "")]
        todo += reversed(node.children)
    nodes, parents, x = nodes_of(root)
    y = np.array([own.get(id(n), False) for n in nodes], float)
    for k in range(len(nodes) - 1, 0, -1):
        y[parents[k]] = max(y[parents[k]], y[k])
    return nodes, parents, x, y


def fit(pages: int = 1000, seed: int = 1) -> Boosted:
    """Trees fitted on that many made pages."""
    found = [labelled(seed * 1_000_003 + k) for k in range(pages)]
    return Boosted().fit(Features.joined([f[2] for f in found]), np.concatenate([f[3] for f in found]))


@functools.lru_cache(maxsize=1)
def model() -> Boosted:
    """The trees of ``fit()``, as they are kept beside this module."""
    return Boosted.load(os.path.join(os.path.dirname(__file__), "trees.npz"))


# --- operator ---------------------------------------------------------------------------------


def main_texts(pages: list[str | None], trees: Boosted) -> list[str]:
    """The main text of each page."""
    read = [nodes_of(parse(p)) if p else None for p in pages]
    some = [r for r in read if r]
    chance = trees.predict(Features.joined([r[2] for r in some])) if some else np.zeros(0)
    out, at = [], 0
    for r in read:
        if r is None:
            out.append("")
            continue
        nodes, parents, _ = r
        kept = decode(parents, chance[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(n.text for n, k in zip(nodes, kept.tolist(), strict=True) if k and n.tag is None))
    return out


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), trees: Boosted | None = None) -> DataFrame:
    """The columns in ``keep``, ``text`` and ``n_chars`` (its code points)."""
    sent = df.sparkSession.sparkContext.broadcast(trees or model())  # of fixed size
    source = df.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("__html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = schema.fieldNames()

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = main_texts(part.column(part.num_columns - 1).to_pylist(), own)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return source.mapInArrow(run, schema)
