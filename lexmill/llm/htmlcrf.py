"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: stretches of text that no block-level tag interrupts, each
with its path of open elements.  Features are the ancestors' tags and the known words in
their class, id and role, the block's own tag, and measures of its text.  The field has two
states, main and other; it is trained on labelled pages and decoded by Viterbi.

A labelled page is plain HTML in which ``data-label="main"`` or ``"other"`` on an element
labels all blocks within it (the innermost label counts; none means other).
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import Mapper, map_texts

#: Elements whose content is never text, void elements, inline elements,
#: elements whose start ends an open one of the same kind, elements that may stand in a head.
_RAW = frozenset("script style template noscript iframe svg math textarea select title head object canvas audio video".split())
_CDATA = frozenset("script style textarea title iframe noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_IN_HEAD = frozenset("base basefont bgsound command link meta noframes noscript script style template title".split())
_SCOPE = frozenset("table ul ol dl div article section main body html td th aside nav header footer form".split())

#: Words of class, id and role that the features know.
_MARKS = frozenset(
    "article content post entry story main body text page blog news prose markdown document ad ads advert advertisement adsense banner promo sponsor sponsored "
    "nav navbar navigation menu header masthead footer foot sidebar side aside widget cookie cookies consent gdpr notice alert popup modal overlay share social "
    "related recommended more comment comments reply replies discussion disqus form search login newsletter subscribe signup breadcrumb breadcrumbs pagination "
    "pager tags meta byline author copyright legal toolbar skip title headline caption quote teaser".split()
)

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")
#: A tag that the page ends in: nothing but a name and attributes with values, which a text that
#: happens to hold "<" is not.
_TORN_TAG = re.compile(r"""<(?:[!?][^<]*|/?[A-Za-z][^\s<>/="']*(?:\s+[^\s<>/="']+\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'<>]*))*\s*/?)\Z""")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # features of the open elements, outermost first
    label: int
    linked: int  # characters inside links
    tag: str


@dataclass
class _Element:
    """An open element, with what it and those around it amount to for a block."""

    tag: str
    path: tuple[str, ...]
    label: int
    own: str  # the innermost element that is not inline


def _marks(attributes: str) -> tuple[tuple[str, ...], int | None]:
    found, label = [], None
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role", "itemprop"):
            found += [f"mark:{w}" for w in _WORDS.findall(value.lower()) if w in _MARKS]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _UNSEEN.search(value)):
            found.append("mark:hidden")
        elif name == "data-label":
            label = int(value == "main")
    return tuple(found), label


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, white space collapsed, references decoded.

    A head that is never closed ends where something stands that no head may hold.  Every step
    takes time in proportion to what it reads or closes, however deep elements are nested.
    """
    page = page or ""
    end = page.rfind(">") + 1  # no tag ends behind it
    if (cut := page.find("<!--", end)) >= 0 or ((cut := page.rfind("<", end)) >= 0 and _TORN_TAG.match(page, cut)):
        page = page[:cut]
    blocks: list[Block] = []
    root = _Element("", (), -1, "")
    stack: list[_Element] = []
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    linked = skipping = links = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                top = stack[-1] if stack else root
                blocks.append(Block(text, top.path, max(top.label, 0), linked, top.own))
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal skipping, links
        for e in stack[to:]:
            skipping -= e.tag in _RAW
            links -= e.tag == "a"
            open_tags[e.tag] -= 1
        del stack[to:]

    def leave_head() -> None:
        if stack and stack[-1].tag == "head":
            pop(len(stack) - 1)

    def add(raw: str) -> None:
        nonlocal linked
        if raw and skipping and stack[-1].tag == "head" and not raw.isspace():
            leave_head()
        if raw and not skipping:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                linked += len(text)

    while m := _TOKEN.search(page, at, end):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        block = tag not in _INLINE
        if m[1]:
            if block:
                flush()
            if open_tags[tag]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag not in _IN_HEAD:
            leave_head()
        if tag == "br":
            held.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if block:
            flush()
            closing = {t for t in _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set()) if open_tags[t]}
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in closing:
                        pop(i)
                        break
                    if stack[i].tag in _SCOPE:
                        break
        marks, label = _marks(m[3]) if m[3].strip(" /") else ((), None)
        outer = stack[-1] if stack else root
        fresh = tuple(f for f in dict.fromkeys((f"tag:{tag}", *marks)) if f not in outer.path) if block or marks else ()
        stack.append(_Element(tag, outer.path + fresh if fresh else outer.path, outer.label if label is None else label, tag if block else outer.own))
        open_tags[tag] += 1
        skipping += tag in _RAW
        links += tag == "a"
        if m[3].endswith("/") and tag in ("svg", "math", "object"):
            pop(len(stack) - 1)
        elif tag in _CDATA:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = close.start() if close else len(page)
    add(page[at:])
    flush()
    return blocks


def _bucket(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


def text_features(block: Block, i: int, n: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    return [
        f"own:{block.tag}", f"words:{_bucket(words, (2, 4, 8, 16, 32, 64))}", f"links:{_bucket(block.linked / len(text), (0.05, 0.3, 0.7, 0.95))}",
        f"stop:{text[-1] in '.!?\"'}", f"own:{block.tag}+links:{block.linked * 2 > len(text)}", f"sign:{'©' in text or '(c)' in text[:20].lower()}",
        f"upper:{text.isupper()}", f"first:{i == 0}", f"last:{i == n - 1}", "bias",
    ]


@dataclass
class LinearChain:
    """Weights of a two-state linear-chain field; feature names map to (other, main)."""

    weights: dict[str, tuple[float, float]]
    step: list[list[float]]
    start: list[float]
    end: list[float]
    _paths: dict[tuple[str, ...], tuple[float, float]] = field(default_factory=dict, repr=False)

    def _score(self, names) -> tuple[float, float]:
        a = b = 0.0
        for name in names:
            if w := self.weights.get(name):
                a += w[0]
                b += w[1]
        return a, b

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the best states; ties go to the state "other"."""
        if not blocks:
            return []
        back, best, n = [], None, len(blocks)
        for i, block in enumerate(blocks):
            if (path := self._paths.get(block.path)) is None:
                if len(self._paths) > 20_000:
                    self._paths.clear()
                path = self._paths[block.path] = self._score(block.path)
            text = self._score(text_features(block, i, n))
            e = (path[0] + text[0], path[1] + text[1])
            if best is None:
                best = (self.start[0] + e[0], self.start[1] + e[1])
                continue
            moves = [[best[s] + self.step[s][t] for s in (0, 1)] for t in (0, 1)]
            chosen = [int(m[1] > m[0]) for m in moves]
            back.append(chosen)
            best = (moves[0][chosen[0]] + e[0], moves[1][chosen[1]] + e[1])
        state = int(best[1] + self.end[1] > best[0] + self.end[0])
        states = [state]
        for chosen in reversed(back):
            state = chosen[state]
            states.append(state)
        return states[::-1]


def train(pages: list[str], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> LinearChain:
    """Maximum likelihood by adaptive gradient steps over pages, with forward-backward sums."""
    data, names = [], {}
    for page in pages:
        blocks = leaf_blocks(page)
        if blocks:
            rows = [[names.setdefault(f, len(names)) for f in (*b.path, *text_features(b, i, len(blocks)))] for i, b in enumerate(blocks)]
            data.append((rows, np.array([b.label for b in blocks])))
    w, chain = np.zeros((len(names), 2)), np.zeros((4, 2))  # chain: two rows of steps, start, end
    w2, chain2 = np.full(w.shape, 1e-6), np.full(chain.shape, 1e-6)
    order, shuffled = list(range(len(data))), random.Random(seed)
    for _ in range(epochs):
        shuffled.shuffle(order)
        for k in order:
            rows, labels = data[k]
            n = len(rows)
            e = np.array([w[r].sum(0) for r in rows])
            alpha, beta = np.empty((n, 2)), np.empty((n, 2))
            alpha[0] = chain[2] + e[0]
            for i in range(1, n):
                alpha[i] = np.logaddexp(alpha[i - 1][0] + chain[0], alpha[i - 1][1] + chain[1]) + e[i]
            beta[-1] = chain[3]
            for i in range(n - 2, -1, -1):
                inner = chain[:2] + e[i + 1] + beta[i + 1]
                beta[i] = np.logaddexp(inner[:, 0], inner[:, 1])
            z = np.logaddexp(*(alpha[-1] + chain[3]))
            error = -np.exp(alpha + beta - z)
            error[np.arange(n), labels] += 1
            pairs = np.zeros((2, 2))
            for i in range(1, n):
                pairs[labels[i - 1], labels[i]] += 1
                pairs -= np.exp(alpha[i - 1][:, None] + chain[:2] + e[i] + beta[i] - z)
            own = np.vstack([pairs, error[0], error[-1]])
            chain2 += own**2
            chain += rate * own / np.sqrt(chain2)
            flat = np.concatenate(rows)
            used, slot = np.unique(flat, return_inverse=True)
            g = np.zeros((len(used), 2))
            np.add.at(g, slot, np.repeat(error, [len(r) for r in rows], axis=0))
            g -= decay * w[used]
            w2[used] += g**2
            w[used] += rate * g / np.sqrt(w2[used])
    return LinearChain({f: tuple(w[i].tolist()) for f, i in names.items()}, chain[:2].tolist(), chain[2].tolist(), chain[3].tolist())


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    """Labelled training pages, written by rule: common site layouts with words of no language."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentence() -> str:
        body = words(3, 22)
        return body[0].upper() + body[1:] + r.choice(("", ", " + words(2, 9))) + r.choice("...!?")

    def prose(low: int, high: int) -> str:
        text = " ".join(sentence() for _ in range(r.randint(low, high)))
        return re.sub(r"(\w+) (\w+)$", r"\1 <a href='/x'>\2</a>", text) if r.random() < 0.15 else text

    def menu(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(low, high))) + "</ul>"

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.68:
            return f"<p>{prose(1, 7)}</p>"
        if kind < 0.76:
            return f"<p><b>{prose(1, 4)}<br>"  # unclosed, as found in the wild
        if kind < 0.82:
            return f"<h{r.choice('23')}>{words(1, 8)}</h2>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{prose(1, 3)}</p></blockquote>"
        if kind < 0.95:
            return f"<pre>{words(4, 20)}</pre>"
        return f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 4)}</td></tr></table>"

    def noise() -> str:
        return r.choice((
            lambda: f'<div class="{r.choice(("ad", "ads", "advert banner", "sponsored", "promo"))}">{prose(1, 3)}</div>',
            lambda: f'<aside class="{r.choice(("related", "sidebar", "widget", ""))}"><h3>{words(1, 3)}</h3>{menu(2, 6)}</aside>',
            lambda: f'<div class="{r.choice(("share", "social", "tags", "breadcrumbs"))}">{menu(2, 5)}</div>',
            lambda: f'<form class="newsletter"><label>{words(1, 4)}</label><p>{sentence()}</p><button>{word()}</button></form>',
            lambda: f'<div id="cookie-consent" class="notice"><p>{prose(1, 2)}</p><button>{word()}</button></div>',
            lambda: f'<div {r.choice(("hidden", "style="+chr(34)+"display:none"+chr(34), "aria-hidden=true"))}><p>{prose(1, 3)}</p></div>',
            lambda: f'<section id="comments" class="comments">' + "".join(f'<article class="comment"><p>{prose(1, 4)}</p></article>' for _ in range(r.randint(1, 4))) + "</section>",
            lambda: f'<div class="comments"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{prose(1, 3)}</p></div>' for _ in range(r.randint(1, 4))) + "</div>",
        ))()

    pages = []
    for i in range(n):
        title = r.choice((words(2, 9), sentence(), prose(1, 1)))
        inner = "".join(paragraph() for _ in range(r.randint(1, 12)))
        if r.random() < 0.35:
            at = inner.rfind("<p>") if r.random() < 0.5 else 0
            inner = inner[: max(at, 0)] + f'<div data-label="other">{noise()}</div>' + inner[max(at, 0) :]
        wrap = r.choice(("article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'section class="story"', 'div role="main"', 'div class="article-body"'))
        close = wrap.split()[0]
        head = r.choice((f"<nav>{menu(3, 9)}</nav>", f'<header class="masthead"><h1>{words(1, 3)}</h1>{menu(2, 7)}</header>', f'<div class="menu">{menu(3, 8)}</div>', f'<div id="header"><p>{words(2, 6)}</p></div><div class="navbar">{menu(3, 6)}</div>', ""))
        foot = r.choice((f"<footer>&copy; {words(1, 3)} &middot; {prose(1, 2)}</footer>", f'<div class="footer"><p>&copy; {words(2, 6)}</p>{menu(1, 4)}</div>', f'<div id="foot" class="legal">{sentence()}</div>', ""))
        before = "".join(noise() for _ in range(r.choice((0, 0, 1, 2))))
        after = "".join(noise() for _ in range(r.choice((0, 0, 1, 2))))
        if i % 12 == 0:
            wrap, close = "div", "div"  # no help from the markup
        pages.append(
            f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a="<p>";</script></head><body>{head}<!-- x -->{before}'
            f'<{wrap} data-label="main"><h1>{title}</h1>{inner}</{close}>{after}{foot}</body></html>'
        )
    return pages


@lru_cache(maxsize=1)
def standard_model() -> LinearChain:
    return train(labelled_pages())


def main_text(page: str | None, model: LinearChain) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, state in zip(blocks, model.decode(blocks)) if state)


def extract_text(df: DataFrame, model: LinearChain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per input row.

    A null or empty page and a page without main blocks give an empty text.  Repeated rows
    repeat their result; an empty table gives an empty one; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or standard_model())  # a few hundred weights

    def setup() -> Mapper:
        def mapper(pages: list[str | None]) -> tuple[None, list]:
            texts = [main_text(p, shared.value) for p in pages]
            return None, [texts, [len(t) for t in texts]]

        return mapper

    row = df.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("row"), F.col(html_col).alias("html"))
    out = map_texts(row, "row", "html", setup, "text string, n_chars long")
    return out.select(F.col("row.id").alias(id_col), F.col("row.url").alias(url_col), "text", "n_chars")
