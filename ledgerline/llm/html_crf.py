"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

Parse. One pass over the tags keeps a stack of open elements. Text between two block-level tags
under the same elements is a leaf block; inline tags don't cut it. Scripts, styles, comments and
other unseen elements give no text; character references are decoded; white space becomes one space.
Attributes are read by the states of the HTML standard's tokeniser. An unseen element without an end tag inside its
parent hides nothing but its start tag (a script or a style: the rest of its parent), and <svg/> is empty. Formulas and
what stands in for an object are text like any other. The head needs no end: what it may
hold is unseen by itself, and anything else begins the body.

Features of a block: every ancestor tag; word pieces of ancestors' class, id and role; the
parent tag; buckets of length, link share and closing mark; signs of notices; place on the page. Labels:
1 main text, 0 the rest. Emission and transition weights are fitted by maximum likelihood
(forward-backward, Adam with a ridge) on pages labelled by construction: ``training_pages`` composes
articles with menus, headers, footers, sidebars, notices, adverts, forms, related links and reader
comments in many markups. Decoding is Viterbi. The driver fits once; weights are a few hundred numbers.

Defined cases: null and empty html, and pages without main text, give an empty string; a tag cut off
at the end of the page is markup; unclosed elements close with their parents; all text is kept
whole, however long; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import with_text

# Attributes by the states of the HTML standard's tokeniser: a quote opens a value only right after the equals sign, an unquoted value
# ends at white space or the closing angle, and a quote without its pair opens nothing. Possessive, so that no page makes it go back.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
_TAG = re.compile(rf"""<!--(?>-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_WORD = re.compile(r"[a-z]+")
UNSEEN = frozenset("script style noscript noframes template title svg iframe select textarea button canvas audio video map".split())
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "noframes", "iframe")}
_AFTER_HEAD = re.compile(r"</head\b|<body\b", re.I)
BLOCKS = frozenset("p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption section article header footer nav aside main form fieldset blockquote pre figure figcaption address hr body html details summary center".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Elements that the opening of the key closes, if they are open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FOREIGN = frozenset(("svg",))
_SCOPES = frozenset("ul ol dl table tr body html article section div nav aside main header footer form blockquote td th figure".split())
_P_ENDS = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd", "figcaption", "summary"} | {"p"}

Block = tuple[str, frozenset[str], str, int, int]  # text, ancestor features, parent tag, code points in links, words


@lru_cache(maxsize=4096)
def _own_features(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"in:{tag}"] if tag in BLOCKS else []
    if attributes and any(name in attributes.lower() for name in ("class", "id", "role", "itemprop", "hidden", "style")):
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role", "itemprop"):
                out += [f"is:{w}" for w in _WORD.findall(value)]
            elif name == "hidden" or name == "style" and "none" in value and "display" in value or name == "aria-hidden" and value == "true":
                out.append("is:hidden")
    return tuple(out)


class _Open:
    """The open elements: tag, features of the element and its ancestors, and its innermost block-level tag.

    Places by name, over all and by container, find what an end tag or a start tag closes without a search."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known
        self.stack: list[tuple[str, frozenset[str], str]] = [("", frozenset(), "")]
        self.places: dict[str, list[int]] = {}
        self.containers: list[tuple[str, dict[str, list[int]]]] = [("", {})]

    def push(self, tag: str, attributes: str) -> None:
        _, above, block = self.stack[-1]
        more = _own_features(tag, attributes)
        if self.known is not None:
            more = [f for f in more if f in self.known and f not in above]
        self.places.setdefault(tag, []).append(len(self.stack))
        self.containers[-1][1].setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPES:
            self.containers.append((tag, {}))
        self.stack.append((tag, above.union(more) if more else above, tag if tag in BLOCKS else block))

    def close(self, to: int) -> None:
        """Closes all from place ``to`` on."""
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in _SCOPES:
                self.containers.pop()
            self.containers[-1][1][tag].pop()

    def end(self, tag: str) -> None:
        if places := self.places.get(tag):
            self.close(places[-1])

    def start(self, ends: frozenset[str] | set[str]) -> None:
        """Closes the elements of ``ends`` that are open in the same container; a container among them opens the one above."""
        while True:
            name, here = self.containers[-1]
            first = [here[t][0] for t in ends if here.get(t)]
            if first:
                self.close(min(first))
            if name not in ends:
                return
            self.close(self.places[name][-1])


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page; of ancestor features only those in ``known``, where given."""
    if not page:
        return []
    out: list[Block] = []
    opened = _Open(known)
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, opened.stack[-1][1], opened.stack[-1][2], linked, text.count(" ") + 1))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    unseen: dict[int, int] | None = None
    while at < size:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            opened.end(tag)
            if tag == "a":
                in_link = 0
            continue
        if tag in UNSEEN:
            if unseen is None:
                unseen = _unseen_ends(page)
            at = unseen.get(m.start(), at)
            parts.append(" ") if tag in ("svg", "select", "button") else None
            continue
        if tag == "head":
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush() if tag == "hr" else parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            in_link = 0
        if tag in _P_ENDS or tag in CLOSES:
            opened.start(CLOSES.get(tag, set()) | ({"p"} if tag in _P_ENDS else set()))
        if tag == "a":
            in_link = 1
        if not _slashed(m[3]):
            opened.push(tag, m[3])
    flush()
    return out


def _slashed(attributes: str) -> bool:
    """Whether a start tag ends by a slash that is no part of an attribute's value."""
    if not attributes.endswith("/"):
        return False
    last = 0
    for m in _ATTR.finditer(attributes):
        last = m.end()
    return last < len(attributes)


def _unseen_ends(page: str) -> dict[int, int]:
    """By the start of its tag, the end of each unseen element that ends inside its parent.

    One pass with a stack of containers and unseen elements: an end tag closes what is open above it,
    and unseen elements closed so have no end of their own. Of raw text without an end tag, scripts and
    styles end with their parent or the page, and a title with the head."""
    out: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    counts: dict[str, int] = {}
    endless: set[str] = set()  # raw text elements with no end tag from here on
    foreign = at = 0

    def leave(tag: str) -> int:
        """Closes the innermost ``tag`` and what is open above it; the start of its tag."""
        nonlocal foreign
        while True:
            name, start = open_.pop()
            counts[name] -= 1
            foreign -= name in _FOREIGN
            if name == tag:
                return start

    while m := _TAG.search(page, at):
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in UNSEEN and tag not in _SCOPES:
            continue
        if m[1]:
            if counts.get(tag):
                start = leave(tag)
                if tag in UNSEEN:
                    out[start] = at
            continue
        if (tag in _FOREIGN or foreign) and _slashed(m[3]):
            out[m.start()] = at
            continue
        if tag in _RAW and not (foreign and tag == "title"):
            end = None if tag in endless else _RAW[tag].search(page, at)
            if end:
                at = out[m.start()] = end.end()
                continue
            if tag in ("script", "style"):
                stop = re.compile("|".join((_AFTER_HEAD.pattern, *(rf"</{t}\b" for t, n in counts.items() if n))), re.I).search(page, at)
                out[m.start()] = at = stop.start() if stop else len(page)
            elif tag == "title" and tag not in endless and (stop := _AFTER_HEAD.search(page, at)):
                out[m.start()] = at = stop.start()
            endless.add(tag)
            continue
        open_.append((tag, m.start()))
        counts[tag] = counts.get(tag, 0) + 1
        foreign += tag in _FOREIGN
    return out


_NOTICE = re.compile(r"©|\(c\) |copyright|all rights|cookie|privacy|subscribe|newsletter|sign up|log in|advert|sponsor|share this|read more|related|comments?\b|reply", re.I)


def local_features(found: list[Block], i: int) -> list[str]:
    text, above, inner, linked, words = found[i]
    share = linked / max(1, len(text))
    within = "in:article" in above or "in:main" in above
    return [
        "bias", f"at:{inner}", f"words:{min(7, words.bit_length())}", f"link:{0 if share < 0.05 else 1 if share < 0.5 else 2}",
        f"ends:{text[-1] in '.!?:;…\"”»'}", f"notice:{within}:{bool(words < 40 and _NOTICE.search(text))}", f"first:{i == 0}", f"late:{i * 4 // len(found)}",
    ]


class Crf:
    """Binary labels: ``weights`` score label 1 against 0; ``moves[a][b]`` scores b after a."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]], starts: list[float]):
        self.weights, self.moves, self.starts = weights, moves, starts
        #: Ancestor features that decoding reads.
        self.known = frozenset((*weights, "in:article", "in:main"))
        self.ancestors: dict[frozenset[str], float] = {}

    def decode(self, found: list[Block]) -> list[int]:
        if not found:
            return []
        get, m = self.weights.get, self.moves
        s0, s1, back = self.starts[0], self.starts[1], []
        for i, block in enumerate(found):
            above = self.ancestors.get(block[1])
            if above is None:
                if len(self.ancestors) > 20000:
                    self.ancestors.clear()
                above = self.ancestors[block[1]] = sum(get(f, 0.0) for f in block[1])
            e = above + sum(get(f, 0.0) for f in local_features(found, i))
            if i:
                f0, f1 = s1 + m[1][0] > s0 + m[0][0], s1 + m[1][1] > s0 + m[0][1]
                s0, s1 = (s1 + m[1][0] if f0 else s0 + m[0][0]), (s1 + m[1][1] if f1 else s0 + m[0][1]) + e
                back.append((f0, f1))
            else:
                s1 += e
        label = int(s1 > s0)
        out = [label]
        for f in reversed(back):
            label = int(f[label])
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page, self.known)
        return "\n".join(b[0] for b, y in zip(found, self.decode(found), strict=True) if y)


def training_pages(pages: int = 400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages and their main blocks' texts, composed at random. Each block has a word of its own."""
    r = random.Random(seed)
    syllables = "ta re mi no el an ou sch ción ê ver ing th or is de la pa".split()
    serial, key = iter(range(10**9)), re.compile(r"k(\d+)")

    def words(a: int, b: int) -> str:
        text = " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(a, b)))
        return f"{text[:1].upper()}{text[1:]}k{next(serial)}"

    def sentence() -> str:
        size = r.choice(((0, 2), (3, 12), (12, 60), (60, 200)))
        return words(*size) + r.choice((".", ".", ".", "!", "?", "", ",", "***", "&amp;"))

    def tagged(tag: str, text: str, attributes: str = "") -> str:
        return f"<{tag}{attributes}>{text}</{tag}>"

    def links(n: int, tag: str = "li") -> str:
        inner = "".join(tagged(tag, tagged("a", words(1, 3), ' href="/x"')) for _ in range(n))
        return tagged("ul", inner) if tag == "li" else inner

    def name(*options: str) -> str:
        return f' {r.choice(("class", "class", "id"))}="{r.choice(options)}"'

    def menu() -> str:
        return r.choice((lambda: tagged("nav", links(r.randint(3, 8))), lambda: tagged("div", links(r.randint(3, 8)), name("nav", "menu", "main-menu", "navbar", "breadcrumb", "navigation")), lambda: tagged("header", tagged("p", words(1, 6)) + tagged("nav", links(4, "span")))))()

    def advert() -> str:
        return tagged(r.choice(("div", "aside", "section", "p")), r.choice((lambda: sentence(), lambda: tagged("p", sentence()), lambda: tagged("a", words(2, 9), ' href="/b"')))(), name("ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement"))

    def notice() -> str:
        text = r.choice(("We use cookies. ", "Cookie notice: ", "Privacy: ", "")) + sentence()
        return tagged(r.choice(("div", "section", "aside")), r.choice((text, tagged("p", text))) + r.choice(("", "<button>OK</button>")), name("cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "modal", "privacy"))

    def side() -> str:
        inner = tagged(r.choice(("h2", "h3", "h4")), words(1, 4)) + r.choice((lambda: links(r.randint(2, 7)), lambda: tagged("p", sentence()), lambda: tagged("p", sentence()) + links(3)))()
        return r.choice((lambda: tagged("aside", inner), lambda: tagged("div", inner, name("sidebar", "side", "widget", "related", "recommended", "share", "social", "newsletter", "tags", "author-box"))))()

    def comments() -> str:
        one = lambda: tagged(r.choice(("div", "li", "article")), r.choice(("", tagged("h4", words(1, 2)))) + tagged("p", sentence()), name("comment", "comment-body", "reply"))
        inner = r.choice(("", tagged("h3", words(1, 3)), "<h3>Comments</h3>")) + "".join(one() for _ in range(r.randint(1, 5)))
        return tagged(r.choice(("div", "section", "ol")), inner, name("comments", "comment-list", "discussion", "responses"))

    def form() -> str:
        return tagged("form", tagged("label", words(1, 3)) + '<input name="q">' + r.choice(("", tagged("p", words(2, 10)))) + "<button>Go</button>")

    def footer() -> str:
        text = r.choice(("&copy; site.example &middot; ", "Copyright ", "", "(c) ")) + sentence()
        return r.choice((lambda: tagged("footer", text), lambda: tagged("footer", tagged("p", text) + links(3)), lambda: tagged("div", tagged("p", text), name("footer", "site-footer", "bottom", "copyright"))))()

    def body_block(main: set[str]) -> str:
        def keep(text: str) -> str:
            main.add(key.findall(text)[-1])
            return text

        kind = r.random()
        if kind < 0.08:
            line = r.choice(("All rights reserved.", "Licensed under the terms above.", "Copyright the authors.", "Read more in the annex.", "Share this with care."))
            return tagged("p", keep(f"{line} {words(0, 1)}"))
        if kind < 0.68:
            text = keep(sentence())
            return r.choice((tagged("p", text), tagged("p", text), f"<p>{text}", f"<p><b>{text}<br></p>", f"<p><b>{text}<br>", tagged("p", tagged("em", text)), tagged("div", text)))
        if kind < 0.78:
            return tagged(r.choice(("h2", "h3")), keep(words(0, 9)))
        if kind < 0.88:
            return tagged(r.choice(("ul", "ol")), "".join(tagged("li", keep(sentence())) for _ in range(r.randint(1, 4))))
        if kind < 0.94:
            return tagged("blockquote", tagged("p", keep(sentence())))
        return tagged("table", "".join(tagged("tr", tagged("td", keep(words(0, 5)))) for _ in range(2))) if kind < 0.97 else tagged("pre", keep(sentence()))

    out = []
    for _ in range(pages):
        main: set[str] = set()
        title = words(1, 10)
        main.add(key.findall(title)[-1])
        inner = tagged("h1", title) + "".join(body_block(main) for _ in range(r.choice((1, 1, 2, 4, 8, 16))))
        if r.random() < 0.15:
            inner += r.choice((advert, side, form))()
            inner += "".join(body_block(main) for _ in range(r.randint(0, 3)))
        shape = r.random()
        if shape < 0.5:
            article = tagged("article", inner)
        elif shape < 0.65:
            article = tagged("main", inner)
        elif shape < 0.75:
            article = tagged("main", tagged("article", inner))
        elif shape < 0.93:
            article = tagged(r.choice(("div", "section")), inner, name("content", "post", "entry-content", "article", "article-body", "story", "main", "post-content"))
        else:
            article = tagged("div", inner)
        before = "".join(f() for f in (menu, advert, notice, form) if r.random() < (0.8 if f is menu else 0.35))
        after = "".join(f() for f in (side, comments, advert, notice, footer) if r.random() < (0.85 if f is footer else 0.35))
        if r.random() < 0.1:
            article, after = article.removesuffix(">").rsplit("<", 1)[0], ""
        out.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{before}{article}{after}" + r.choice(("</body></html>", "")), main))
    return out


class Chains:
    """Labelled pages as padded arrays, and the loss of weights over them."""

    def __init__(self, pages: list[tuple[str, set[str]]], least: int):
        key = re.compile(r"k(\d+)")
        rows = []
        for page, main in pages:
            found = blocks(page)
            labels = [int(any(k in main for k in key.findall(b[0]))) for b in found]
            rows.append(([[*b[1], *local_features(found, i)] for i, b in enumerate(found)], labels))
        counts: dict[str, int] = {}
        for features, _ in rows:
            for f in {f for fs in features for f in fs}:
                counts[f] = counts.get(f, 0) + 1
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
        self.n, self.t = len(rows), max(len(r[1]) for r in rows)
        flat = [(p * self.t + i, self.index[f]) for p, (features, _) in enumerate(rows) for i, fs in enumerate(features) for f in set(fs) if f in self.index]
        self.cell, self.feature = (np.array(x) for x in zip(*flat, strict=True))
        y, live = np.zeros((self.n, self.t), int), np.zeros((self.n, self.t), bool)
        for p, (_, labels) in enumerate(rows):
            y[p, : len(labels)], live[p, : len(labels)] = labels, True
        self.y, self.live, self.both = y, live, live[:, 1:]
        self.seen = np.array([(self.both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for a in (0, 1) for b in (0, 1)] + [(live[:, 0] & (y[:, 0] == a)).sum() for a in (0, 1)], float)

    def loss(self, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood with the ridge, and its gradient; ``w`` is emissions, moves 00 01 10 11, starts 0 1."""
        n, t, d, live = self.n, self.t, len(self.index), self.live
        e = np.zeros((n, t, 2))
        e[:, :, 1] = np.bincount(self.cell, w[self.feature], n * t).reshape(n, t)
        move = w[d : d + 4].reshape(2, 2)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = e[:, 0] + w[d + 4 :]
        for i in range(1, t):
            nxt = np.logaddexp(alpha[:, i - 1, :1] + move[0], alpha[:, i - 1, 1:] + move[1]) + e[:, i]
            alpha[:, i] = np.where(live[:, i, None], nxt, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            after = e[:, i + 1] + beta[:, i + 1]
            back = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            beta[:, i] = np.where(live[:, i + 1, None], back, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.where(live, np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - z[:, None])), 0)
        g = np.zeros(d + 6)
        g[:d] = np.bincount(self.feature, (p1 - self.y).ravel()[self.cell], d)
        joint = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        g[d : d + 4] = (np.exp(np.minimum(0, joint)) * self.both[:, :, None, None]).sum((0, 1)).ravel() - self.seen[:4]
        g[d + 4 :] = np.array([(1 - p1[:, 0]).sum(), p1[:, 0].sum()]) - self.seen[4:]
        score = (e[:, :, 1] * self.y).sum() + w[d:] @ self.seen
        return float((z.sum() - score) / n + ridge * (w @ w) / 2), g / n + ridge * w


def fit(pages: list[tuple[str, set[str]]], *, rounds: int = 150, rate: float = 0.1, ridge: float = 2e-3, least: int = 3) -> Crf:
    """Maximum likelihood by forward-backward over all pages at once (padded to the longest)."""
    chains = Chains(pages, least)
    d = len(chains.index)
    w, m, v = np.zeros(d + 6), np.zeros(d + 6), np.zeros(d + 6)
    for step in range(1, rounds + 1):
        _, g = chains.loss(w, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf({f: float(w[i]) for f, i in chains.index.items()}, w[d : d + 4].reshape(2, 2).tolist(), w[d + 4 :].tolist())


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return fit(training_pages())


def extract(pages: DataFrame, *, id_cols: list[str], html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """``id_cols``, ``text`` (main text, "" if none) and ``n_chars`` (its code points)."""
    made = model or default_model()
    parts = (made.weights, made.moves, made.starts)

    kept, at, fields = with_text(pages, id_cols, html_col, ("text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*parts)
        for batch in batches:
            texts = [crf.extract(p.as_py()) for p in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*id_cols, "text", "n_chars"])

    return kept.mapInArrow(run, f"{fields}, text string, n_chars long")
