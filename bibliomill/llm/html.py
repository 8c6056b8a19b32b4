"""Main-text extraction with a recurrent block labeller.

A page is read into blocks: the texts between block-level tags, in page order, each with the
path of open tags and their class and id words.  A bidirectional LSTM in numpy reads the
sequence of blocks (averaged embeddings of hashed path tokens and hashed words, and a few
numbers) and says of each whether it belongs to the article; every decision sees the whole
page, both ways.  Scripts, styles, comments and other raw text never become blocks.

The model is trained when the operator is set up: on practice pages in many layouts whose
labels are known because they are written here, with the words of real pages, and on a
bounded sample of the given pages (``SAMPLE_PAGES``) that mark their article by its tag.

Defined cases: a null or empty page, and one without any text, has the empty text; a page cut
off in the middle keeps what stands before the cut; unknown or unclosed tags are taken as
they come (an unclosed script or style runs to the end of the page, as in browsers; of other
elements without text, such as a select, only the tag itself is left out then); a head ends
with the first tag or text that cannot be in it; repeated rows get equal answers; an empty table gives no rows (and trains on
practice pages only); other columns play no part.  Pages of any length are read as a whole.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliomill.llm.common import worker_state

PATH_BUCKETS = 1024
WORD_BUCKETS = 1024
PATH_SIZE = 16
WORD_SIZE = 6
NUMBERS = 7
HIDDEN = 20
PRACTICE_PAGES = 1500
SAMPLE_PAGES = 200
SAMPLE_CHARS = 40_000
EPOCHS = 5
LONGEST = 80  # blocks of a training sequence
PAGES_AT_ONCE = 256

# Element names of the HTML standard.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "xmp", "noembed", "noframes"}
# What a head may hold; any other tag or text ends it.
IN_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "script", "style", "noscript", "template", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "label",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
# A new one of these ends an open one of the same kind.
CLOSED_BY_NEXT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def _labels(name: str, rest: str) -> tuple[str, ...]:
    out = [name]
    if "=" in rest:
        for kind, *values in NAMES.findall(rest):
            out += [f"{kind[0].lower()}:{part.lower()}" for value in values for part in PARTS.findall(value)]
    return tuple(out)


def _ends(page: str, name: str) -> dict[int, int]:
    """End of each closed element of a name, by the end of its start tag."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(f"<(/?){re.escape(name)}(?=[\\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\\Z))", page, re.I):
        if not m[1]:
            if not m[2].endswith("/>"):
                stack.append(m.end())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    linked = 0
    in_head = False
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            out.append(Block(text, tuple(label for _, labels in stack for label in labels), linked))
        texts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, in_head
        if in_head:
            if raw.isspace():
                return
            in_head = False
        text = entities.unescape(raw) if "&" in raw else raw
        texts.append(text)
        if any(tag == "a" for tag, _ in stack):
            linked += len(text)

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "head":
            in_head = not m[1]
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            if any(tag == name for tag, _ in stack):
                while stack.pop()[0] != name:
                    pass
            elif name == "br":
                texts.append(" ")
            continue
        if name not in IN_HEAD:
            in_head = False
        if name in RAW:
            if name in ("script", "style"):
                end = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else at if m[3].endswith("/>") else len(page)
            elif not m[3].endswith("/>"):
                if name not in ends:
                    ends[name] = _ends(page, name)
                at = ends[name].get(at, at)
            continue
        if name == "br":
            texts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name != "p" and stack and stack[-1][0] == "p":
                stack.pop()
            closes = {"p"} if name == "p" else CLOSED_BY_NEXT.get(name, set())
            open_tags = [tag for tag, _ in stack]
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i] in closes:
                    del stack[i:]
                    break
                if open_tags[i] in ("ul", "ol", "dl", "table", "div", "article", "section", "td"):
                    break
        if name not in VOID and not m[3].endswith("/>"):
            stack.append((name, _labels(name, m[3])))
    flush()
    return out


# ---- features ------------------------------------------------------------------------


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


class Hashes:
    """Buckets of paths and words, kept up to a bound."""

    def __init__(self, limit: int = 200_000):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}
        self.limit = limit

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > self.limit:
                self.paths.clear()
            last = [f"last:{t}" for t in path[-3:]]
            got = self.paths[path] = np.array([_bucket(t, PATH_BUCKETS) for t in {*path, *last}] or [0], np.int64)
        return got

    def text(self, text: str) -> np.ndarray:
        words = text.lower().split()
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > self.limit:
                self.words.clear()
            for w in {w for w, hit in zip(words, found) if hit is None}:
                self.words[w] = _bucket(w, WORD_BUCKETS)
            found = [_bucket(w, WORD_BUCKETS) if hit is None else hit for w, hit in zip(words, found)]
        return np.array(found, np.int64)


def numbers(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), NUMBERS), np.float32)
    for i, b in enumerate(page):
        n = len(b.text)
        ends = b.text[-1] in ".!?…。:;\"”»"
        marks = b.text.count(",") + b.text.count(".")
        out[i] = (np.log1p(n) / 5, b.linked / n if b.linked else 0.0, ends, marks / (n / 40 + 1), i / len(page), 1.0, sum(map(str.isdigit, b.text[:200])) / min(n, 200))
    return out


# ---- the network ---------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one in each direction, and a logistic unit over both states."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + NUMBERS
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {
            "path": draw(PATH_BUCKETS, PATH_SIZE, scale=0.3), "word": draw(WORD_BUCKETS, WORD_SIZE, scale=0.1),
            "out": draw(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.w[f"x{d}"] = draw(size, 4 * HIDDEN, scale=size**-0.5)
            self.w[f"h{d}"] = draw(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5)
            self.w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.hashes = Hashes()

    def inputs(self, pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, list, list]:
        """Padded block vectors, mask, and for each block its place and buckets."""
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), PATH_SIZE + WORD_SIZE + NUMBERS), np.float32)
        mask = np.zeros((steps, len(pages), 1), np.float32)
        at = [(i, k) for k, page in enumerate(pages) for i in range(len(page))]
        row, col = np.array(at).T
        paths = [self.hashes.path(b.path) for page in pages for b in page]
        words = [self.hashes.text(b.text) for page in pages for b in page]
        for table, buckets, lo, power in (("path", paths, 0, 0.5), ("word", words, PATH_SIZE, 1.0)):
            sizes = np.array(list(map(len, buckets)))
            sums = np.add.reduceat(self.w[table][np.concatenate(buckets)], np.cumsum(sizes) - sizes, axis=0)
            x[row, col, lo : lo + sums.shape[1]] = sums / (sizes[:, None] ** power)
        x[row, col, PATH_SIZE + WORD_SIZE :] = np.concatenate([numbers(page) for page in pages])
        mask[row, col] = 1
        return x, mask, list(zip(row, col, paths)), list(zip(row, col, words))

    def run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        steps, pages, _ = x.shape
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        states = np.zeros((steps, pages, HIDDEN), np.float32)
        fed = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        trace = [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = fed[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tan = np.tanh(new)
            trace[t] = (h, c, i, f, o, g, tan)
            # beyond the end of a page nothing has been read yet
            c = new * mask[t]
            h = o * tan * mask[t]
            states[t] = h
        return states, trace

    def scores(self, pages: list[list[Block]]) -> np.ndarray:
        x, mask, _, _ = self.inputs(pages)
        both = np.concatenate([self.run(x, mask, d)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.w["out"] + self.w["bias"])

    def slopes(self, pages: list[list[Block]], gold: list[list[bool]]) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy of all blocks, back through time."""
        x, mask, paths, words = self.inputs(pages)
        target = np.zeros(mask.shape[:2], np.float32)
        for k, labels in enumerate(gold):
            target[: len(labels), k] = labels
        runs = {d: self.run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        wrong = (_sigmoid(both @ self.w["out"] + self.w["bias"]) - target) * mask[:, :, 0] / mask.sum()
        g = {"out": np.einsum("tp,tph->h", wrong, both), "bias": np.array([wrong.sum()], np.float32)}
        dx = np.zeros_like(x)
        for n, d in enumerate("fb"):
            trace = runs[d][1]
            into = wrong[:, :, None] * self.w["out"][n * HIDDEN : (n + 1) * HIDDEN]
            dh = np.zeros(into.shape[1:], np.float32)
            dc = np.zeros_like(dh)
            dz = np.zeros((len(x), into.shape[1], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                h, c, i, f, o, gate, tan = trace[t]
                dh = (dh + into[t]) * mask[t]
                dc = dc * mask[t] + dh * o * (1 - tan * tan)
                dz[t] = np.concatenate([dc * gate * i * (1 - i), dc * c * f * (1 - f), dh * tan * o * (1 - o), dc * i * (1 - gate * gate)], axis=1)
                gh += h.T @ dz[t]
                dh = dz[t] @ self.w[f"h{d}"].T
                dc = dc * f
            g[f"h{d}"] = gh
            g[f"x{d}"] = np.einsum("tpi,tpj->ij", x, dz)
            g[f"c{d}"] = dz.sum(axis=(0, 1))
            dx += dz @ self.w[f"x{d}"].T
        g["path"], g["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for i, k, p in paths:
            g["path"][p] += dx[i, k, :PATH_SIZE] / len(p) ** 0.5
        for i, k, t in words:
            np.add.at(g["word"], t, dx[i, k, PATH_SIZE : PATH_SIZE + WORD_SIZE] / len(t))
        return g

    def fit(self, pages: list[list[Block]], gold: list[list[bool]], epochs: int = EPOCHS, seed: int = 6, rate: float = 0.01) -> None:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        total = epochs * -(-len(pages) // 16)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 16):
                some = order[at : at + 16]
                step += 1
                for k, slope in self.slopes([pages[i] for i in some], [gold[i] for i in some]).items():
                    mean[k] += 0.1 * (slope - mean[k])
                    square[k] += 0.01 * (slope * slope - square[k])
                    self.w[k] -= rate * (1 - step / (total + 1)) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)


# ---- practice pages --------------------------------------------------------------------

# Wrappers of an article by themselves, and words that a class of one is made of.
ARTICLE_WORDS = "content post entry article body story main text page single blog detail news item hentry copy read paper section center primary".split()
LAYOUT_WORDS = "layout container wrapper row col inner outer grid box site app root columns flex holder area block left right view".split()
MAIN = (
    '<article>', '<main>', '<article class="post">', '<div class="content">', '<div id="content">', '<div class="article-body">', '<div class="post-content">',
    '<div class="entry-content">', '<section class="story">', '<div class="main-text">', '<div id="main">', '<main class="page">', '<div role="main">', '<div class="text">', '<div>',
)
# What is not the article, by kind: wrappers it may have.
OTHER = {
    "menu": ('<nav>', '<div class="nav">', '<ul class="menu">', '<div id="navigation">', '<nav class="breadcrumb">', '<div class="navbar">', '<div class="toc">', '<div role="navigation">'),
    "header": ('<header>', '<div class="header">', '<div id="header">', '<header class="site-header">', '<div class="masthead">', '<div class="topbar">', '<div role="banner">'),
    "footer": ('<footer>', '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div class="legal">', '<div role="contentinfo">'),
    "side": ('<aside>', '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="related">', '<section class="related-posts">', '<div class="recommended">', '<div class="share">', '<div role="complementary">'),
    "notice": ('<div class="notice">', '<div class="cookie-banner">', '<div id="consent">', '<div class="alert">', '<div class="newsletter">', '<div class="popup">', '<dialog>', '<section class="cookies">', '<div role="alert">', '<p class="notice">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<aside class="advertisement">', '<div class="sponsored">', '<div id="banner">', '<div class="promo">', '<section class="ad-slot">', '<p class="ad">'),
    "form": ('<form>', '<form class="search">', '<div class="subscribe"><form>', '<form id="login">', '<form class="contact-form">'),
    "comments": ('<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<ol class="comments">', '<div class="reader-comments">', '<section id="discussion">', '<div class="replies">', '<aside class="comments">'),
}
# Words that a class of such a wrapper is made of, alone or with one of place.
NAMES_OF = {
    "menu": "menu nav navbar navigation links breadcrumb breadcrumbs tabs toc".split(),
    "header": "header head masthead topbar banner brand logo".split(),
    "footer": "footer foot bottom copyright legal imprint colophon".split(),
    "side": "sidebar side aside widget related popular recommended share social tags trending".split(),
    "notice": "notice cookie cookies consent alert gdpr newsletter popup modal warning message".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "form": "search login signup subscribe contact form register".split(),
    "comments": "comments comment replies responses discussion respond thread".split(),
}
PLACE_WORDS = "top main site page primary secondary left right bottom global box list area block section wrap".split()
WORDS_OF = {
    "menu": "Home About News Sports Contact Blog Products Services Archive Login Help".split(),
    "header": "Welcome Site Daily Journal Magazine Weekly Menu Search Subscribe".split(),
    "footer": "Copyright Privacy Terms Imprint rights reserved © 2024 Contact".split(),
    "side": "Related Popular Latest More Share Follow Tags Trending Read".split(),
    "notice": "We use cookies to improve your experience. Accept Subscribe to our newsletter Notice".split(),
    "advert": "Buy now Sale Offer Sponsored Advertisement Free shipping Click here Deal".split(),
    "form": "Name Email Password Send Submit Search Your message Sign up".split(),
    "comments": "Reply says wrote Great thanks agree comment ago Like".split(),
}


def _closing(wrapper: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrapper)))


def practice_page(rng: np.random.Generator, words: list[str]) -> tuple[list[Block], list[bool]]:
    """A page in a random layout and the labels of its blocks.  Text of the article is marked
    while the page is read and unmarked before it is learned."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    mark = "\x02"

    def prose(least: int, most: int, sign: str = "") -> str:
        n = int(np.exp(rng.uniform(np.log(least), np.log(most))))
        out, size = [], 0
        while size < n:
            k = int(rng.integers(1, 14))
            sentence = [words[i] for i in rng.integers(0, len(words), k)]
            out.append(" ".join(sentence).capitalize() + ".")
            size += k
        text = sign + " ".join(out)
        return entities.escape(text, quote=False)

    def named(of: list[str]) -> str:
        name = pick(["-", " ", "_"]).join(pick(of) for _ in range(int(rng.integers(1, 3))))
        return f"<{pick(['div', 'div', 'div', 'section', 'article'] if of is ARTICLE_WORDS else ['div'])} {pick(['class', 'class', 'id'])}=\"{name}\">"

    def title(sign: str) -> str:
        return sign + entities.escape(" ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(2, 10)))).capitalize(), quote=False)

    def boilerplate(kind: str) -> str:
        wrapper = pick(OTHER[kind])
        if rng.random() < 0.5:
            name = [pick(NAMES_OF[kind])] + ([pick(PLACE_WORDS)] if rng.random() < 0.5 else [])
            rng.shuffle(name)
            wrapper = f'<{pick(["div", "div", "section", "ul"] if kind == "menu" else ["div", "div", "section"])} {pick(["class", "id"])}="{pick(["-", " ", "_"]).join(name)}">'
        own = WORDS_OF[kind]
        some = lambda: " ".join(pick(own) if rng.random() < 0.6 else pick(words) for _ in range(int(rng.integers(1, 6))))
        if kind == "comments":
            body = "".join(f'<{t}><{pick(["b", "span", "cite"])}>{pick(words)}</b> {pick(own)}<p>{prose(2, 60)}</p></{t.split()[0]}>' for t in [pick(["li", "div", "article", "p", 'div class="comment"', 'li class="reply"'])] * int(rng.integers(1, 7)))
            head = pick(["h2", "h3", "h4", "div"])
            body = f"<{head}>{pick([some(), 'Comments', 'Reader comments', f'{len(body)} comments', 'Discussion'])}</{head}>" * int(rng.random() < 0.7) + body
        elif kind == "form":
            body = "".join(f"<label>{some()}</label><input name=q>" for _ in range(int(rng.integers(1, 4)))) + f"<button>{pick(own)}</button>"
        elif kind in ("notice", "advert"):
            body = pick([prose(3, 40), f"<p>{prose(3, 40)}</p>", f"<p>{some()}</p><a href=#>{some()}</a>", some()])
        elif kind == "footer":
            body = pick([f"&copy; {some()} &middot; {prose(2, 25)}", f"<p>{some()}</p>", "".join(f"<a href=/{i}>{some()}</a> " for i in range(5)), f"<p>{prose(3, 30)}</p>"])
        elif kind == "header":
            body = pick([f"<h1>{some()}</h1>", f"<a href=/>{some()}</a>", f"<p>{some()}</p>", f"<h2>{some()}</h2><p>{prose(3, 15)}</p>"])
        else:
            items = [f'<a href="/{i}">{pick([some(), pick(words), title("")])}</a>' for i in range(int(rng.integers(2, 9)))]
            body = pick(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), "".join(f"<div>{x}</div>" for x in items)])
            if kind == "side":
                body = pick(["", f"<h3>{some()}</h3>"]) + pick([body, f"<p>{prose(3, 50)}</p>"])
        return wrapper + body + _closing(wrapper)

    def article() -> str:
        parts = [pick(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "{}"]).format(title(mark)) if rng.random() < 0.85 else ""]
        for _ in range(int(np.exp(rng.uniform(0, 3)))):
            u = rng.random()
            if u < 0.06:
                parts.append(f"{prose(3, 80, mark)}<br>{prose(3, 80)}" + pick(["", "<br><br>"]))
            elif u < 0.66:
                parts.append(f"<p>{prose(1, 150, mark)}</p>" if rng.random() < 0.8 else f"<p><b>{prose(3, 150, mark)}<br>")
            elif u < 0.72:
                parts.append(f"<h2>{title(mark)}</h2>")
            elif u < 0.79:
                parts.append("<ul>" + "".join(f"<li>{prose(1, 20, mark)}</li>" for _ in range(int(rng.integers(1, 6)))) + "</ul>")
            elif u < 0.84:
                parts.append(f"<blockquote>{prose(2, 60, mark)}</blockquote>")
            elif u < 0.87:
                parts.append(f"<pre>{prose(2, 40, mark)}</pre>")
            elif u < 0.90:
                parts.append("<table>" + "".join(f"<tr><td>{title(mark)}</td><td>{title(mark)}</td></tr>" for _ in range(3)) + "</table>")
            elif u < 0.93:
                parts.append(f'<p>{prose(2, 40, mark)} <a href="/x">{title("")}</a> {prose(1, 20)}</p>')
            else:
                parts.append(boilerplate(pick(["advert", "notice", "side", "form"])))
        wrapper = "" if bare else pick(MAIN) if rng.random() < 0.5 else named(ARTICLE_WORDS)
        inner = pick(["", "", '<div class="inner">', "<div>", "<section>", named(ARTICLE_WORDS), named(LAYOUT_WORDS)])
        return wrapper + inner + "".join(parts) + _closing(inner) + _closing(wrapper)

    bare = rng.random() < 0.12  # an article without any wrapper of its own
    few = pick([0.0, 0.2, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5])
    before = [k for k in ("notice", "header", "menu", "advert", "side", "form") if rng.random() < few]
    after = [k for k in ("advert", "side", "comments", "form", "notice", "menu", "footer") if rng.random() < few]
    rng.shuffle(before)
    # the article may share its own wrapper with what stands around it
    near = int(rng.integers(0, 3)) if rng.random() < 0.5 else 0
    middle = article() + "".join(map(boilerplate, after[:near]))
    shared = pick(["", "<main>", named(LAYOUT_WORDS), named(LAYOUT_WORDS)]) if near or rng.random() < 0.3 else ""
    body = "".join(map(boilerplate, before)) + shared + middle + _closing(shared) + "".join(map(boilerplate, after[near:]))
    outer = pick(["", "", '<div class="wrapper">', '<div id="page">', "<div>", named(LAYOUT_WORDS)])
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{outer}{body}{_closing(outer)}</body></html>"
    found = blocks(page[: int(rng.integers(len(page) // 2, len(page)))] if rng.random() < 0.1 else page)
    gold = [mark in b.text for b in found]
    for b in found:
        b.text = b.text.replace(mark, "") or "x"
    return found[:LONGEST], gold[:LONGEST]


NOT_ARTICLE = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "label"}
NOT_ARTICLE_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "comment", "comments", "cookie", "menu", "nav", "notice", "promo", "sidebar", "sponsored", "footer", "header", "related"}


def marked_page(page: str) -> tuple[list[Block], list[bool]] | None:
    """Blocks and labels of a page that says itself where its article is."""
    found = blocks(page)
    inside = [any(t in ("article", "main") for t in b.path) for b in found]
    if not any(inside) or all(inside):
        return None
    other = [any(t in NOT_ARTICLE or t[2:] in NOT_ARTICLE_WORDS for t in b.path) for b in found]
    return found[:LONGEST], [i and not o for i, o in zip(inside, other)][:LONGEST]


def train(sample: list[str], practice: int = PRACTICE_PAGES, seed: int = 4) -> Labeller:
    rng = np.random.default_rng(seed)
    known = [m for m in map(marked_page, sample) if m]
    words = sorted({w for found, _ in known for b in found for w in b.text.lower().split()[:200] if len(w) < 20})
    if len(words) < 200:
        syllables = "ka lo mi ren tus ve dor pa ni sel qua tor um es in".split()
        words += ["".join(syllables[int(i)] for i in rng.integers(0, len(syllables), int(rng.integers(1, 4)))) for _ in range(600)]
    pages = [p for p in (practice_page(rng, words) for _ in range(practice)) if p[0]] + known
    labeller = Labeller()
    labeller.fit([p for p, _ in pages], [g for _, g in pages])
    return labeller


# ---- pages -----------------------------------------------------------------------------


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    read = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, p in enumerate(read) if p), key=lambda i: len(read[i]))
    at = 0
    while at < len(order):
        # long pages go through in smaller groups, so the padded states stay bounded
        size = max(1, min(PAGES_AT_ONCE, 20_000 // len(read[order[min(at + PAGES_AT_ONCE, len(order)) - 1]])))
        some = order[at : at + size]
        scores = labeller.scores([read[i] for i in some])
        for k, i in enumerate(some):
            out[i] = "\n\n".join(b.text for b, s in zip(read[i], scores[:, k]) if s >= 0.5)
        at += size
    return out


def extract(html: Column, labeller: Labeller, spark) -> Column:
    """Main text of an html column."""
    shared = spark.sparkContext.broadcast(labeller.w)
    key = ("html", zlib.crc32(labeller.w["xf"].tobytes()))

    def ready() -> Labeller:
        made = Labeller()
        made.w = shared.value
        return made

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = worker_state(key, ready)
        for batch in batches:
            yield pd.Series(main_texts(list(batch), own), dtype=object)

    return extracted(html)


def sample_pages(pages: DataFrame, count: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """Pages with the smallest hashes, at most so many characters of each."""
    few = pages.select(F.xxhash64("page_id", F.lit(3)).alias("h"), F.substring("html", 1, chars).alias("part")).where("part IS NOT NULL")
    return [r.part for r in few.orderBy("h", F.xxhash64("part")).limit(count).collect()]


def extraction_report(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    labeller = train(sample_pages(pages))
    text = extract(F.col("html"), labeller, pages.sparkSession)
    return pages.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
