"""Main-text extraction from HTML by boosted trees over a page's elements.

A page is parsed into block elements and runs of text.  Each is described by
its density of text, links and tags, the words of its class and id, its depth,
its share of the page and its siblings' statistics; gradient-boosted trees give
the log-odds that it holds any main text.  Decoding is hierarchical: of all
labellings in which nothing is kept inside what is dropped, the one with the
largest total log-odds is taken.

Names and words of attributes are hashed into buckets, and each bucket has a
weight, the smoothed log-odds of the elements that have it (:class:`Lexicon`).
Weights and trees are learned here, on pages made by a generator with known main
text (:func:`training_pages`), so no label of the pages at hand is needed.

Result of odd inputs: null and empty pages have empty text; unclosed, misnested
and truncated markup is read leniently; a page with no element left has empty
text; very long pages are read whole; null ids are kept; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready, spread

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br img "
    "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it ends at their end tag, or with the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose content no reader sees as text; one that is never closed is an ordinary element.
HIDDEN = frozenset("template select".split())
#: Elements that may stand within a paragraph and hold markup; of these, foreign ones know self-closing tags.
EMBEDDED = frozenset("object noscript canvas svg".split())
FOREIGN = ("math", "svg")
#: A start tag closes an open element of these names first.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("tr", "thead")}
SCOPE = frozenset("table ul ol dl div section article main body html td th nav aside header footer form blockquote".split()) | EMBEDDED
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: The same for a page of so many tags whose quotes are never closed that each would be sought to the page's end.
_SHORT = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+')*+)>""")
BROKEN = 64
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")

#: Elements that the language defines to hold the main text.
MAIN_TAGS = frozenset(("article", "main"))
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd figcaption".split())


class Page:
    """Nodes of a page in document order: block elements and runs of text.

    tag, parent, end (index after the last descendant) and depth of each node;
    text nodes have tag ``#text`` and their text."""

    __slots__ = ("tag", "parent", "end", "depth", "words", "text", "linked", "controls", "n_tags")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth = ["#root"], [-1], [0]
        self.words: list = [()]
        self.text: dict[int, str] = {}
        self.linked: dict[int, int] = {}
        self.controls: list[int] = [0]
        self.n_tags: list[int] = [0]
        self.end: list[int] = [0]
        self._parse(source)

    def _parse(self, src: str) -> None:
        find, match, broken = src.find, _TAG.match, 0
        stack: list[tuple[str, int]] = [("#root", 0)]  # (name, node); inline elements have their block's node
        pieces: list[str] = []
        links, linked, pos, n = 0, 0, 0, len(src)
        unclosed: set[str] = set()  # hidden elements without an end tag from here on
        tag, parent, depth, end, words, controls, n_tags = self.tag, self.parent, self.depth, self.end, self.words, self.controls, self.n_tags

        def flush() -> None:
            nonlocal linked
            if pieces:
                raw = "".join(pieces)
                text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
                pieces.clear()
                if text:
                    at, node = len(tag), stack[-1][1]
                    tag.append("#text")
                    parent.append(node)
                    depth.append(depth[node] + 1)
                    words.append(())
                    controls.append(0)
                    n_tags.append(0)
                    end.append(at + 1)
                    self.text[at] = text
                    self.linked[at] = min(linked, len(text))
                linked = 0

        def pop_to(k: int) -> None:
            nonlocal links
            while len(stack) > k:
                name, node = stack.pop()
                if name == "a":
                    links -= 1
                if name not in INLINE:
                    end[node] = len(tag)

        def innermost(names) -> int:
            """Place in the stack of the innermost of the names within its scope, or 0."""
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in SCOPE:
                    return 0
            return 0

        while pos < n:
            lt = find("<", pos)
            if lt < 0:
                lt = n
            if lt > pos:
                pieces.append(src[pos:lt])
                if links:
                    linked += lt - pos
                if lt == n:
                    break
            nxt = src[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?":
                stop = find("-->", lt + 4) if src.startswith("<!--", lt) else find(">", lt)
                pos = n if stop < 0 else stop + (3 if src.startswith("<!--", lt) else 1)
                continue
            m = match(src, lt)
            if m is None:
                m, broken = _LOOSE.match(src, lt), broken + 1
                if broken == BROKEN:
                    match = _SHORT.match
            if m is None:
                if nxt.isalpha() or nxt == "/":  # cut off within a tag
                    close = find(">", lt)
                    pos = n if close < 0 else close + 1
                else:
                    pieces.append("<")
                    pos = lt + 1
                continue
            pos, name = m.end(), m[2].lower()
            if m[1]:  # an end tag
                if name in INLINE:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            if name == "a":
                                links -= 1
                            del stack[k]
                            break
                        if stack[k][0] not in INLINE:
                            break
                else:
                    flush()
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            pop_to(k)
                            break
                        if name == "p" and stack[k][0] in SCOPE:
                            break
                continue
            node = stack[-1][1]
            n_tags[node] += 1
            if name in RAW or name in HIDDEN:
                controls[node] += name in ("textarea", "select")
                closed = m[3].endswith("/")
                stop = None if closed or name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(src, pos)
                if stop:
                    pos = stop.end()
                elif name in RAW and not closed:
                    pos = n
                if stop or closed or name in RAW:
                    continue
                unclosed.add(name)
            if name in INLINE:
                if name == "br":
                    pieces.append("\n")
                elif name not in VOID and not (m[3].endswith("/") and (name in FOREIGN or any(x in FOREIGN for x, _ in stack))):
                    stack.append((name, node))
                    links += name == "a"
                continue
            flush()
            if m[3].endswith("/") and (name in FOREIGN or any(x in FOREIGN for x, _ in stack)):
                continue
            if name in VOID:
                controls[node] += name == "input"
                continue
            if (k := innermost(("p",))) and name not in CLOSES and name not in EMBEDDED:
                pop_to(k)
            if name in CLOSES:
                while k := innermost(CLOSES[name]):
                    pop_to(k)
            node, at = stack[-1][1], len(tag)
            tag.append(name)
            parent.append(node)
            depth.append(depth[node] + 1)
            attrs = m[3]
            words.append(tuple(_TOKEN.findall(" ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)).lower())) if "=" in attrs else ())
            controls.append(int(name == "button"))
            n_tags.append(0)
            end.append(at + 1)
            stack.append((name, at))
        flush()
        pop_to(1)
        end[0] = len(tag)


class Lexicon:
    """Weights of hashed words: the smoothed log-odds that an element with a
    word of that bucket holds main text, less those of any element.

    Words are those of attributes, and the element's name together with whether
    it stands inside one that the language defines to hold the main text."""

    BUCKETS, SMOOTHING = 2048, 8.0

    def __init__(self):
        self.weights = [0.0] * self.BUCKETS
        self.known: dict[str, float] = {}

    @classmethod
    def bucket(cls, word: str) -> int:
        return zlib.crc32(word.encode()) % cls.BUCKETS

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            w = self.weights[self.bucket(word)]
            if len(self.known) < 100_000:
                self.known[word] = w
        return w

    def fit(self, pages: list[Page], labels: list) -> Lexicon:
        held, total, n = [[0, 0] for _ in range(self.BUCKETS)], [0, 0], 0
        for p, y in zip(pages, labels):
            inside = _inside(p)
            for i, t in enumerate(p.tag):
                if i and t != "#text":
                    k = int(y[i])
                    total[k] += 1
                    for word in {*p.words[i], tag_word(t, inside[i])}:
                        held[self.bucket(word)][k] += 1
        share = (total[1] + 1) / (total[0] + total[1] + 2)
        a, b = self.SMOOTHING * (1 - share), self.SMOOTHING * share
        self.weights = [math.log((h[1] + b) / (h[0] + a)) - math.log(b / a) for h in held]
        self.known = {}
        return self


def tag_word(tag: str, inside: bool) -> str:
    return f"<{tag} in" if inside else f"<{tag}"


def _inside(p: Page) -> list[bool]:
    """Whether each node stands inside an element that is there for main text."""
    out = [False] * len(p.tag)
    for i in range(1, len(p.tag)):
        j = p.parent[i]
        out[i] = out[j] or p.tag[j] in MAIN_TAGS
    return out


FEATURES = 36


def features(pages: list[Page], lexicon: Lexicon):
    """A row of numbers for each node of each page."""
    import numpy as np

    return np.concatenate([_page_features(p, lexicon) for p in pages]) if pages else np.zeros((0, FEATURES), np.float32)


def _page_features(p: Page, lexicon: Lexicon):
    import numpy as np

    n = len(p.tag)
    parent, end, depth = np.array(p.parent), np.array(p.end), np.array(p.depth, float)
    own = np.zeros((n, 6))  # chars, words, linked chars, stops, text runs, capitals or digits at the start
    for i, t in p.text.items():
        stops = t.count(". ") + t.count(", ") + t.endswith((".", "!", "?", ":", "。"))
        own[i] = (len(t), t.count(" ") + 1, p.linked[i], stops, 1, t[:1].isupper())
    is_tag = np.array([t != "#text" for t in p.tag], float)
    para = np.array([t == "p" for t in p.tag], float)
    item = np.array([t in ("li", "option", "dd", "dt") for t in p.tag], float)
    head = np.array([t[0] == "h" and t[1:].isdigit() for t in p.tag], float)
    texty = np.array([t in TEXT_TAGS for t in p.tag], float)
    # Weights of words: the sum, the worst and the best of an element, and of any element around it.
    inside = _inside(p)
    said = np.zeros((n, 4))  # sum, worst, best, name
    around = np.zeros((n, 3))  # worst, best, worst name
    weight = lexicon.weight
    for i in range(1, n):
        j = p.parent[i]
        around[i] = np.minimum(around[j, 0], said[j, 1]), np.maximum(around[j, 1], said[j, 2]), np.minimum(around[j, 2], said[j, 3])
        if is_tag[i]:
            w = [weight(x) for x in p.words[i]]
            said[i] = sum(w), min(w, default=0.0), max(w, default=0.0), weight(tag_word(p.tag[i], inside[i]))
    against = -np.minimum(said[:, 1], 0) - np.minimum(said[:, 3], 0)
    sums = np.concatenate([own, np.stack([is_tag, para, item, np.array(p.controls, float), np.array(p.n_tags, float), against, head], 1)], 1)
    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0)])
    sub = total[end] - total[np.arange(n)]
    up = np.maximum(parent, 0)
    kids = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
    order = np.arange(n)
    nth = np.zeros(n)
    if n > 1:
        by = np.argsort(parent[1:], kind="stable") + 1
        first = np.r_[True, parent[by][1:] != parent[by][:-1]]
        nth[by] = np.arange(n - 1) - np.maximum.accumulate(np.where(first, np.arange(n - 1), 0))
    chars = sub[:, 0]
    page = max(chars[0], 1.0)
    # Statistics of the siblings: their text, and how many of them are tags of text.
    sib_chars = np.bincount(parent[1:], weights=chars[1:], minlength=n)[up] if n > 1 else np.zeros(n)
    sib_texty = np.bincount(parent[1:], weights=texty[1:], minlength=n)[up] if n > 1 else np.zeros(n)
    sib_max = np.zeros(n)
    if n > 1:
        np.maximum.at(sib_max, parent[1:], chars[1:])
        sib_max = sib_max[up]
    before = total[order, 0] / page
    safe = np.maximum(chars, 1.0)
    return np.stack(
        [
            np.log1p(chars), np.log1p(sub[:, 1]), chars / page, chars / np.maximum(chars[up], 1.0), sub[:, 2] / safe, sub[:, 3] / np.maximum(sub[:, 1], 1.0), sub[:, 6] / safe * 100.0,
            chars / np.maximum(sub[:, 4], 1.0), sub[:, 5] / np.maximum(sub[:, 4], 1.0), np.log1p(sub[:, 7]), np.log1p(sub[:, 8]), sub[:, 9], sub[:, 10] / safe * 100.0, sub[:, 11], sub[:, 12],
            depth, kids, nth, kids[up], nth / np.maximum(kids[up] - 1.0, 1.0), sib_chars - chars, sib_texty, chars / np.maximum(sib_max, 1.0), before, before + chars / page,
            *said.T, *around.T, np.array(inside, float), texty, head, is_tag,
        ],
        1,
    ).astype(np.float32)


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x, y, weight):
        import numpy as np

        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        at = self._bin(x)
        share = (weight * y).sum() / weight.sum()
        self.base = float(np.log(share / (1 - share)))
        score, width = np.full(len(y), self.base), self.bins + 1
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, split = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, 255, np.int64)
            leaf = np.zeros(len(y), np.int64)
            for d in range(self.depth):
                k = 1 << d
                best = np.zeros(k)
                for j in range(x.shape[1]):
                    cell = leaf * width + at[:, j]
                    gs = np.bincount(cell, weights=g, minlength=k * width).reshape(k, width)
                    hs = np.bincount(cell, weights=h, minlength=k * width).reshape(k, width)
                    gl, hl = gs.cumsum(1), hs.cumsum(1)
                    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gl[:, -1:] ** 2 / (hl[:, -1:] + 1)
                    gain[(hl < self.least) | (hr < self.least)] = -1
                    s = gain.argmax(1)
                    win = gain[np.arange(k), s]
                    better = win > best + 1e-9
                    best[better] = win[better]
                    feature[k - 1 : 2 * k - 1][better] = j
                    split[k - 1 : 2 * k - 1][better] = s[better]
                node = leaf + k - 1
                leaf = 2 * leaf + (at[np.arange(len(y)), feature[node]] > split[node])
            gs, hs = np.bincount(leaf, weights=g, minlength=1 << self.depth), np.bincount(leaf, weights=h, minlength=1 << self.depth)
            value = self.rate * gs / (hs + 1)
            self.trees.append((feature, split, value))
            score += value[leaf]
        return self

    def _bin(self, x):
        import numpy as np

        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def log_odds(self, x):
        import numpy as np

        at = np.ascontiguousarray(self._bin(x).T)
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, split, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                node = leaf + (1 << d) - 1
                leaf = 2 * leaf + (at[feature[node], rows] > split[node])
            score += value[leaf]
        return score


def decode(p: Page, odds) -> list[bool]:
    """The labelling with the largest total of log-odds (runs of text weigh by
    their words) in which all that is inside something dropped is dropped."""
    n = len(p.tag)
    gain = odds.tolist()
    for i, t in p.text.items():
        gain[i] *= 1.0 + min(4.0, len(t) / 200.0)
    kept = [0.0] * n  # gain of keeping a node over dropping it, its subtree at its best
    for i in range(n - 1, 0, -1):
        kept[i] += gain[i]
        if kept[i] > 0:
            kept[p.parent[i]] += kept[i]
    out = [False] * n
    out[0] = True
    for i in range(1, n):
        out[i] = out[p.parent[i]] and kept[i] > 0
    return out


Model = tuple[Lexicon, Trees]


def main_text(source: str, model: Model) -> str:
    return main_texts([source], model)[0]


def main_texts(sources: list[str], model: Model) -> list[str]:
    lexicon, trees = model
    pages = [Page(s) for s in sources]
    odds = trees.log_odds(features(pages, lexicon))
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        keep = decode(p, odds[at : at + n])
        at += n
        out.append("\n\n".join(t for i, t in p.text.items() if keep[i]))
    return out


# Training pages --------------------------------------------------------------

_VOWELS, _CONSONANTS = "aeiou", "bcdfghklmnprstvz"
#: Share of elements whose class has words from the names of other kinds of element, and those words.
STRAY = 0.1
WORDS = "ad article banner body comment content cookie entry footer header main menu meta nav notice policy popup post promo related search share sidebar social story text widget".split()


class _Maker:
    """Makes a page as (tag, attributes, children, is_main) trees."""

    def __init__(self, seed: int):
        self.r = r = random.Random(seed)
        parts = [r.choice(_CONSONANTS) + r.choice(_VOWELS) + r.choice(["", "", "n", "r", "s"]) for _ in range(40)]
        self.vocabulary = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(300)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.r.randint(lo, hi)):
            s = self.words(1, 18)
            out.append(s[0].upper() + s[1:].replace(" ", ", " if self.r.random() < 0.1 else " ", 1) + ".")
        return " ".join(out)

    def link(self, lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{self.r.choice(self.vocabulary)}">{self.words(lo, hi)}</a>'

    def attr(self, *names: str, often: float = 0.7, stray: float = 0.0) -> str:
        r = self.r
        if r.random() < max(stray, STRAY):  # a word that says nothing of what the element is
            words = "-".join([r.choice(names), *r.sample(WORDS, r.randint(1, 2))])
            return f' class="{words}"'
        if r.random() > often:
            return r.choice(["", f' class="c{r.randint(1, 99)}"', f' id="{r.choice(self.vocabulary)}"'])
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", "-wrap", " box", "-" + str(r.randint(1, 9))])}"'

    def mark(self, main: bool, text: str) -> str:
        return f"\x01{text}\x02" if main else text

    def paragraph(self, main: bool) -> str:
        r = self.r
        text = self.sentences(1, r.choice([1, 2, 4, 8, 14]))
        if r.random() < 0.15:
            text += " " + self.link(1, 4)
        if r.random() < 0.15:
            text = f"<b>{text}" + ("" if r.random() < 0.5 else "</b>") + ("<br>" if r.random() < 0.6 else "")
        tag = r.choices(["p", "p", "p", "div", "blockquote", "pre", "h2", "h3"], [60, 10, 10, 5, 4, 2, 5, 4])[0]
        if tag in ("h2", "h3"):
            text = self.words(2, 9)
        close = "" if tag == "p" and r.random() < 0.3 else f"</{tag}>"
        return f"<{tag}>{self.mark(main, text)}{close}"

    def article(self) -> str:
        r = self.r
        body = [self.paragraph(True) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 30]))]
        if r.random() < 0.3:
            kind = r.choice(["ul", "ol"])
            body.insert(r.randint(0, len(body)), f"<{kind}>" + "".join(f"<li>{self.mark(True, self.words(3, 25))}</li>" for _ in range(r.randint(2, 6))) + f"</{kind}>")
        if r.random() < 0.15:
            body.insert(r.randint(0, len(body)), "<table>" + "".join("<tr>" + "".join(f"<td>{self.mark(True, self.words(1, 6))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
        if r.random() < 0.15:
            caption = f"<figcaption>{self.mark(True, self.words(3, 20))}</figcaption>"
            body.insert(r.randint(0, len(body)), f'<figure{self.attr("figure", "image", often=0.3)}><img src="x.jpg">{caption}</figure>')
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body.insert(r.randint(0, len(body)), self.boiler(r.choice(["ad", "share", "related", "newsletter"])))
        title = f"<h1>{self.mark(True, self.words(2, 14))}</h1>" if r.random() < 0.85 else ""
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        bare = r.random() < 0.12  # no element around it: a header is the page's then
        if title and not bare and tag in MAIN_TAGS and r.random() < 0.35:
            lead = f"<p>{self.mark(True, self.sentences(1, 2))}</p>" if r.random() < 0.3 else ""
            title = f"<header{self.attr('article-header', 'entry-header', often=0.4)}>{title}{lead}</header>"
        inner = title + "".join(body)
        if r.random() < 0.3:
            inner = f'<div{self.attr("content", "entry-content", "body", "text")}>{inner}</div>'
        names = ("article", "post", "story", "main-content", "entry", "content")
        out = f"<{tag}{self.attr(*names, often=0.2 if tag in ('article', 'main') else 0.75, stray=0.35)}>{inner}</{tag}>"
        if tag == "article" and r.random() < 0.3:
            out = f"<main>{out}</main>"
        return inner if bare else out

    def boiler(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            items = "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 12)))
            return r.choice([f"<nav{self.attr('nav', 'menu', often=0.3)}><ul>{items}</ul></nav>", f"<div{self.attr('nav', 'menu', 'navbar', 'navigation')}><ul>{items}</ul></div>", f"<ul{self.attr('menu', 'nav')}>{items}</ul>", f"<nav>{' | '.join(self.link() for _ in range(r.randint(2, 7)))}</nav>"])
        if kind == "header":
            tag, often = r.choice([("header", 0.4), ("div", 0.7)])
            title = r.choice([f"<h2>{self.words(1, 4)}</h2>", f"<p>{self.words(2, 12)}</p>", self.link(), self.link(1, 1), f"<h1>{self.link(1, 2)}</h1>"])
            close = "" if r.random() < 0.02 else f"</{tag}>"
            names = ("header", "masthead", "site-header") if tag == "header" else ("header", "masthead", "top")
            return f"<{tag}{self.attr(*names, often=often)}>{title}{r.choice(['', self.boiler('nav')])}{close}"
        if kind == "ad":
            tag = r.choice(["div", "div", "aside", "section"])
            return f"<{tag}{self.attr('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo', often=0.97)}>" + r.choice([self.sentences(1, 4), f"<p>{self.sentences(1, 4)}</p>", f"<p>{self.link(2, 6)}</p>"]) + f"</{tag}>"
        if kind == "footer":
            text = r.choice(["&copy; ", "© 2024 ", ""]) + r.choice([f"{self.words(1, 3)}.example.com &middot; ", ""]) + self.sentences(1, 5)
            return r.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p>{self.link()} {self.link()}</footer>", f"<div{self.attr('footer', 'copyright', often=0.95)}>{text} {self.link()}</div>"])
        if kind == "sidebar":
            inner = f"<h3>{self.words(1, 3)}</h3>" + r.choice(["<ul>" + "".join(f"<li>{self.link(2, 8)}</li>" for _ in range(r.randint(2, 8))) + "</ul>", f"<p>{self.sentences(1, 6)}</p>", f"<p>{self.sentences(1, 3)}</p><p>{self.sentences(1, 3)}</p>"])
            return r.choice([f"<aside{self.attr('sidebar', 'widget', often=0.4)}>{inner}</aside>", f"<div{self.attr('sidebar', 'widget', 'side', often=0.95)}>{inner}</div>"])
        if kind == "notice":
            return f"<{(t := r.choice(['div', 'section', 'div', 'dialog']))}{self.attr('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', often=0.97)}><p>{self.sentences(1, 5)}</p>{r.choice(['', '<button>' + self.words(1, 2) + '</button>'])}</{t}>"
        if kind == "form":
            return f"<form{self.attr('search', 'subscribe', 'newsletter', 'signup', 'contact', often=0.4)}>{r.choice([self.words(1, 8), '<p>' + self.sentences(1, 3) + '</p>', '<label>' + self.words(1, 3) + '</label>'])}<input name=q>{r.choice(['', '<button>' + self.words(1, 2) + '</button>', '<select><option>a<option>b</select>', '<textarea>' + self.words(1, 9) + '</textarea>'])}</form>"
        if kind == "newsletter":
            return f"<div{self.attr('newsletter', 'subscribe', 'signup', often=0.97)}><p>{self.sentences(1, 2)}</p><form><input name=e><button>{self.words(1, 2)}</button></form></div>"
        if kind == "share":
            return f"<div{self.attr('share', 'social', 'sharing', often=0.9)}>{' '.join(self.link(1, 1) for _ in range(r.randint(2, 5)))}</div>"
        if kind == "related":
            return f"<{(t := r.choice(['div', 'section', 'aside']))}{self.attr('related', 'recommended', 'trending', 'teaser', often=0.95)}><h3>{self.words(1, 4)}</h3>" + "".join(r.choice([f"<p>{self.link(3, 9)}</p>", f"<div>{self.link(3, 8)}<p>{self.sentences(1, 2)}</p></div>"]) for _ in range(r.randint(2, 5))) + f"</{t}>"
        if kind == "comments":
            one = lambda: r.choice([f"<div{self.attr('comment', 'reply')}><p>{self.sentences(1, 6)}</p></div>", f"<li{self.attr('comment')}><b>{self.words(1, 2)}</b> <p>{self.sentences(1, 5)}</p></li>", f"<p>{self.sentences(1, 6)}</p>", f"<article{self.attr('comment', 'reply', often=0.9)}><p>{self.sentences(1, 5)}</p></article>"])
            return f"<{(t := r.choice(['div', 'section', 'div', 'ol']))}{self.attr('comments', 'discussion', 'replies', 'disqus', 'reader-comments', often=0.98)}>{r.choice(['', f'<h3>{self.words(1, 3)}</h3>'])}{''.join(one() for _ in range(r.randint(1, 8)))}</{t}>"
        if kind == "breadcrumb":
            return f"<div{self.attr('breadcrumb', 'breadcrumbs', often=0.9)}>{' / '.join(self.link() for _ in range(r.randint(2, 4)))}</div>"
        return f"<p{self.attr('copyright', 'meta', 'byline', often=0.95)}>{self.words(2, 10)}</p>"

    def page(self) -> str:
        r = self.r
        before = [self.boiler(k) for k in ("notice", "header", "nav", "breadcrumb", "ad", "form", "sidebar") if r.random() < (0.6 if k in ("nav", "header") else 0.3)]
        after = [self.boiler(k) for k in ("share", "related", "comments", "sidebar", "form", "ad", "notice", "footer", "newsletter") if r.random() < (0.7 if k == "footer" else 0.28)]
        r.shuffle(before)
        middle = self.article()
        if r.random() < 0.25:  # comments and related links inside the article's own element
            cut = middle.rfind("</")
            middle = middle[:cut] + "".join(self.boiler(k) for k in r.sample(["comments", "related", "share", "newsletter", "footer"], r.randint(1, 2))) + middle[cut:]
        if r.random() < 0.06:  # nothing but the article
            return middle
        inner = "".join(before) + middle + "".join(after)
        if r.random() < 0.35:
            inner = f'<div{self.attr("wrapper", "page", "container", "content")}>{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{inner}</body></html>"


def training_pages(n: int, seed: int = 11) -> list[str]:
    """Pages whose main text stands between the characters 1 and 2."""
    return [_Maker(seed * 100_003 + i).page() for i in range(n)]


#: Pages made for training.
TRAINING_PAGES = 1800


def labelled(sources: list[str]) -> tuple[list[Page], list]:
    """Pages of training sources, and which nodes hold any main text."""
    import numpy as np

    made = [Page(s) for s in sources]
    labels = []
    for p in made:
        y = np.zeros(len(p.tag))
        for i, t in p.text.items():
            if "\x01" in t:
                y[i] = 1
                p.text[i] = t.replace("\x01", "").replace("\x02", "").strip()
                j = p.parent[i]
                while j >= 0 and not y[j]:
                    y[j] = 1
                    j = p.parent[j]
            elif "\x02" in t:
                p.text[i] = t.replace("\x02", "").strip()
                y[i] = 1
        labels.append(y)
    return made, labels


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> Model:
    """Words' weights from a third of the pages, so that they are not better on
    the others, from which the trees learn, than on pages to come."""
    import numpy as np

    made, labels = labelled(training_pages(pages, seed))
    half = len(made) // 3
    lexicon = Lexicon().fit(made[:half], labels[:half])
    rest, y = made[half:], np.concatenate(labels[half:])
    weight = np.concatenate([np.array([1.0 + (i in p.text) for i in range(len(p.tag))]) for p in rest])
    return lexicon, Trees().fit(features(rest, lexicon), y, weight)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", trained_model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, keep..., text): the main text of each whole page."""
    ready(pages.sparkSession)
    model = trained_model or trained()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            held, size, start = [], 0, 0
            for i, h in enumerate(b.column(b.num_columns - 1)):
                held.append(h.as_py() or "")
                size += len(held[-1])
                if size >= 1_000_000 or i + 1 == b.num_rows:
                    text = pa.array(main_texts(held, model), pa.string())
                    yield pa.RecordBatch.from_arrays([*(b.column(j).slice(start, len(held)) for j in range(b.num_columns - 1)), text], schema=pa.schema([*(b.schema.field(j) for j in range(b.num_columns - 1)), pa.field("text", pa.string())]))
                    held, size, start = [], 0, i + 1

    rows = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).cast("string").alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return spread(rows).mapInArrow(run, f"{kinds}, text string")
