"""Main-text extraction by a linear-chain conditional random field over a page's leaf blocks.

A page is read once: tags keep a stack of open elements, text between block-level tags is a
leaf block. A block has features of its ancestors (tags, words of class, id and role) and of its text
(length, share of link text, signs). A two-label chain, trained by maximum likelihood with
gradients from forward-backward sums, is decoded by Viterbi; blocks labelled article are the text.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .pagegen import labelled_pages

PAGES = 600
EPOCHS = 12
SEED = 1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<", re.S)
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_RAW = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
_ONCE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "aside", "form", "nav", "header", "footer", "blockquote", "select"}
_LIGHT = _INLINE | {"p", "li"}
_INNER = {"article", "main", "aside", "nav", "header", "footer", "form", "section", "button", "label", "select"}
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _signs(tag: str, attrs: str) -> tuple:
    """An element's features: its tag and the words of its class, id and role."""
    out = [tag]
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role", "itemprop"):
                out += [f"{w}" for w in _SPLIT.split(value) if w]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                out.append("*hidden")
    return tuple(out)


class TagEnds:
    """Where tags close: the next ``>`` outside of quotes. Every stop is looked at once, however many tags are left open."""

    def __init__(self, html: str):
        self.html, self.known = html, {}
        self.stops: list[int] | None = None

    def find(self, at: int) -> int:
        """The place of the closing sign for a tag whose attributes begin at ``at``, or -1."""
        if self.stops is None:
            self.stops = [m.start() for m in _STOP.finditer(self.html)]
            self.quotes: dict[str, list[int]] = {q: [i for i in self.stops if self.html[i] == q] for q in "\"'"}
        passed, end = [], -1
        k = bisect_left(self.stops, at)
        while k < len(self.stops):
            if k in self.known:
                end = self.known[k]
                break
            passed.append(k)
            i = self.stops[k]
            if self.html[i] == ">":
                end = i
                break
            same = self.quotes[self.html[i]]
            q = bisect_right(same, i)
            if q == len(same):
                break
            k = bisect_left(self.stops, same[q] + 1)
        self.known.update(dict.fromkeys(passed, end))
        return end


class Open:
    """The open elements, with what they say as features that are kept up to date element by element, so that a deep page costs no more than a flat one."""

    def __init__(self, weight=None):
        self.weight, self.total = weight, 0.0
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.fences: list[int] = []
        self.plain: list[str] = []  # block elements' tags
        self.inner: list[str] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str, signs: tuple) -> None:
        block = tag not in _INLINE
        own = tuple({*("w=" + w for w in signs[1:]), *(("a=" + tag,) if block and tag not in ("html", "body") else ())})
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in _FENCE:
            self.fences.append(len(self.stack))
        if block:
            self.plain.append(tag)
        if tag in _INNER:
            self.inner.append(tag)
        self.stack.append((tag, own))
        for f in own:
            n = self.count.get(f, 0)
            self.count[f] = n + 1
            if not n and self.weight:
                self.total += self.weight(f, 0.0)

    def cut(self, size: int) -> None:
        """Close elements until ``size`` are left."""
        while len(self.stack) > size:
            tag, own = self.stack.pop()
            self.at[tag].pop()
            if tag in _FENCE:
                self.fences.pop()
            if tag not in _INLINE:
                self.plain.pop()
            if tag in _INNER:
                self.inner.pop()
            for f in own:
                n = self.count[f] - 1
                if n:
                    self.count[f] = n
                else:
                    del self.count[f]
                    if self.weight:
                        self.total -= self.weight(f, 0.0)

    def last(self, *tags: str) -> int:
        """The place of the innermost element of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def fence(self) -> int:
        return self.fences[-1] if self.fences else -1

    def places(self) -> list[str]:
        """Features of the nearest elements, in their order."""
        block = self.plain[-1] if self.plain else "html"
        out = ["tag=" + block]
        if not self.inner:
            return out + ["in=-"]
        out.append("in=" + self.inner[-1])
        outer = self.inner[-2] if len(self.inner) > 1 else ""
        if outer:
            out.append("in2=" + self.inner[-1] + ">" + outer)
        if self.inner[-1] == "header":
            out.append("h=" + block + (">" + outer if outer else ""))
        return out

    def features(self) -> tuple[str, ...]:
        return tuple(sorted({*self.count, *self.places()}))

    def score(self) -> float:
        return self.total + sum(self.weight(f, 0.0) for f in self.places())


def leaf_blocks(html: str, weight=None) -> list[tuple]:
    """(what the open elements say, text, characters inside links) of every leaf block with text, in page order: their features, or with ``weight``, a function of feature and default, the sum of their weights."""
    blocks, now, text, linked, pos, n, in_head = [], Open(weight), [], 0, 0, len(html), False
    ends, low = TagEnds(html), None

    def flush():
        nonlocal linked
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                blocks.append((now.score() if weight else now.features(), words, linked))
            text.clear()
            linked = 0

    while pos < n:
        m = _TOKEN.match(html, pos)
        name, t = m.group(2), m.group()
        end = -1
        if name is not None:
            end = ends.find(m.end())
            if end < 0:  # a tag that never closes is text
                name, t = None, "<"
        if name is None:
            pos += len(t)
            if t[0] != "<" or len(t) == 1:
                if not in_head:
                    text.append(t)
                    if now.at.get("a"):
                        linked += len(t)
            continue
        attrs, pos = html[m.end() : end], end + 1
        tag, closing = name.lower(), m.group(1)
        if tag in _RAW or tag == "textarea" or tag == "title":
            if not closing and not attrs.endswith("/"):
                if low is None:
                    low = html.lower()
                    if len(low) != n:  # signs that are longer in lower case
                        low = html.translate(_ASCII_LOWER)
                end = low.find("</" + tag, pos)
                pos = n if end < 0 else end
            if tag in ("script", "style", "title"):
                continue
            flush()
            continue
        if tag == "head":
            in_head = not closing
            continue
        if in_head and tag not in ("meta", "link", "base"):
            in_head = False
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if closing:
            i = now.last(tag)
            if i >= 0 and not (tag in _LIGHT and now.fence() > i):
                now.cut(i)
        else:
            if tag not in _INLINE:
                i = now.last("p", *_ONCE.get(tag, ()))
                if i > now.fence():
                    now.cut(i)
            now.push(tag, _signs(tag, attrs))
    flush()
    return blocks


def text_features(text: str, linked: int) -> tuple[str, ...]:
    words = text.count(" ") + 1
    return ("b", "n=%d" % min(7, words.bit_length()), "l=%d" % min(4, 4 * linked // max(1, len(text))), "e=" + (text[-1] if text[-1] in ".!?:" else "-"), "c=%d" % min(3, text.count(",")), "©" if "©" in text or "copyright" in text[:60].lower() else "-")


class Chain:
    """The weights: features by label, transitions, start and end."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]], ends: list[float]):
        self.weights, self.moves, self.ends = weights, moves, ends

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi."""
        (m00, m01), (m10, m11) = self.moves
        a, b, back = 0.0, 0.0, []
        for k, s in enumerate(scores):
            if k:
                x, y = a + m00, b + m10
                u, v = a + m01, b + m11
                back.append((int(y > x), int(v > u)))
                a, b = max(x, y), max(u, v) + s
            else:
                a, b = self.ends[0], self.ends[1] + s
        if not scores:
            return []
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def extract(self, html: str | None) -> str:
        get = self.weights.get
        blocks = leaf_blocks(html or "", get)
        labels = self.decode([s + sum(get(f, 0.0) for f in text_features(text, linked)) for s, text, linked in blocks])
        return "\n\n".join(b[1] for b, y in zip(blocks, labels) if y)


def train(pages: list[tuple[str, list[tuple[int, str]]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """Maximum likelihood with AdaGrad steps page by page. Pages are (html, [(label, text)]); a block with no label of its own text is none of the article."""
    names: dict[str, int] = {}
    data = []
    for html, truth in pages:
        queue, at, rows, labels = truth, 0, [], []
        for own, text, linked in leaf_blocks(html):
            y = 0
            for k in range(at, len(queue)):
                if queue[k][1] == text:
                    y, at = queue[k][0], k + 1
                    break
            rows.append(np.array([names.setdefault(f, len(names)) for f in (*own, *text_features(text, linked))]))
            labels.append(y)
        if rows:
            data.append((rows, np.array(labels)))
    w, moves, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    gw, gm, gs = np.full(len(names), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
    order = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            rows, y = data[i]
            n = len(rows)
            s = np.zeros((n, 2))
            s[:, 1] = [w[r].sum() for r in rows]
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = start + s[0]
            for k in range(1, n):
                ahead[k] = np.logaddexp(ahead[k - 1, 0] + moves[0], ahead[k - 1, 1] + moves[1]) + s[k]
            for k in range(n - 2, -1, -1):
                t = moves + s[k + 1] + behind[k + 1]
                behind[k] = np.logaddexp(t[:, 0], t[:, 1])
            z = np.logaddexp(*ahead[-1])
            p = np.exp(ahead + behind - z)
            miss = y - p[:, 1]
            d_moves = np.zeros((2, 2))
            if n > 1:
                pair = np.exp(ahead[:-1, :, None] + moves + s[1:, None, :] + behind[1:, None, :] - z)
                d_moves -= pair.sum(axis=0)
                np.add.at(d_moves, (y[:-1], y[1:]), 1)
            d_start = -p[0]
            d_start[y[0]] += 1
            at = np.concatenate(rows)
            g = np.zeros(len(names))
            np.add.at(g, at, np.repeat(miss, [len(r) for r in rows]))
            g -= decay * w
            for x, d, acc in ((w, g, gw), (moves, d_moves, gm), (start, d_start, gs)):
                acc += d * d
                x += rate * d / np.sqrt(acc)
    return Chain({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}, moves.tolist(), start.tolist())


@functools.cache
def default_chain(pages: int = PAGES, seed: int = SEED) -> Chain:
    return train(labelled_pages(pages, seed))


def extract_text(pages: DataFrame, chain: Chain | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All columns of ``pages`` and ``out_col``, the main text: article blocks in page order, joined by an empty line (a column of that name is replaced).

    Null and empty pages and pages without an article have the empty text; nothing is cut, however long; broken markup is read as far as it goes;
    an empty table gives an empty one. The trained weights, a few thousand numbers, go to the executors with the task.
    """
    model = chain or default_chain()
    keep = [c for c in pages.columns if c != out_col]
    out_schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(out_col, T.StringType())])
    names = out_schema.fieldNames()
    weights, moves, ends = model.weights, model.moves, model.ends

    def run(batches):
        chain = Chain(weights, moves, ends)
        for batch in batches:
            text = pa.array([chain.extract(h.as_py()) for h in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], text], names=names)

    own = pages.select(F.col(f"`{html_col}`").cast("string"), *[F.col(f"`{c}`") for c in keep])
    return own.toDF(*[f"c{i}" for i in range(len(keep) + 1)]).mapInArrow(run, out_schema)  # columns are told apart by place
