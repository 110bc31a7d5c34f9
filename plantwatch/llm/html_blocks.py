"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is read as a vector
of its tag path (tags, classes, ids and roles of its ancestors, hashed), of its
hashed words and of a few counts; a bidirectional LSTM in numpy labels every
block as main text or not, seeing all blocks of the page on both sides.

The given pages have no labels, so the labeller is fitted on pages whose labels
are known because they are laid out here: the texts of a bounded sample of real
pages are set in many layouts, with the names that pages use for their parts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.utf8 import LOWER_AZ, slices, span_hashes, text_bytes, words

#: Most pages whose texts the labeller is fitted with: those with the smallest hashes of their ids, of the pages up to so many characters.
TRAIN_PAGES, TRAIN_PAGE_CHARS = 160, 1 << 16
#: Layouts that are made of the texts of these pages.
TRAIN_LAYOUTS = 4500
#: Share of blocks whose words are hidden while fitting, so that paths and neighbours decide where words are new.
HIDDEN_WORDS = 0.8
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, COUNTS, HIDDEN = 2048, 4096, 20, 8, 8, 20
#: Steps of a page whose inputs are made together.
STEPS_AT_ONCE = 2048

#: A tag without quotes; the start of any tag; what may end one.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)([^>"']*)>""")
_TAG_START = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_TAG_STOP = re.compile(r"""[>"']""")
#: Elements that are open at once; deeper ones count as their parents' content, as browsers have it.
MOST_OPEN = 512
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements that run inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag.
RAW = frozenset("script style template title textarea noscript iframe object svg canvas select option button datalist audio video math head".split())
#: Raw elements whose content isn't parsed as markup.
UNPARSED = frozenset("script style title textarea iframe".split())
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in UNPARSED}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: start tag -> open elements that it ends, within the given scopes
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SPACE = re.compile(r"\s+")


class _Tokens:
    """The markup of a page from left to right; each character is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`: at the first ">" outside of quotes, or at any if quotes aren't closed."""
        first = at
        while self.quotes:
            m = _TAG_STOP.search(self.page, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.quotes = False  # some quote isn't closed: from here on quotes are plain characters
        return self.page.find(">", first)

    def next(self, at: int) -> tuple[int, int, str, bool, str, str]:
        """(start, end, tag, whether it's an end tag, attributes, text) of the next piece of markup; no tag for a comment and the like, text for what is to be read as text."""
        page, n = self.page, len(self.page)
        while True:
            start = page.find("<", at)
            if start < 0:
                return n, n, "", False, "", ""
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, (n if end < 0 else end + 3), "", False, "", ""
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start + 9)
                return start, (n if end < 0 else end + 3), "", False, "", page[start + 9 : n if end < 0 else end]
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                return start, (n if end < 0 else end + 1), "", False, "", ""
            if start < self.last:
                m = _TAG.match(page, start)
                if m:
                    return start, m.end(), m[2].lower(), bool(m[1]), m[3], ""
                m = _TAG_START.match(page, start)
                if m:
                    end = self._end(m.end())
                    return start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end], ""
            at = start + 1


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of the leaf blocks in page order.

    The path has the words of all open block elements, outermost first, each
    element's tag as "<tag>". Markup that isn't well formed never fails: an end
    tag without its start is skipped, what is left open ends with the page.
    Time grows in proportion to the page.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    opened: Counter[str] = Counter()
    linked = raw_depth = in_link = beyond = 0
    path: tuple[str, ...] | None = None

    def flush() -> None:
        nonlocal linked, path
        if text:
            # the reference is decoded once, here, so that text pieces join first
            words = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if words:
                if path is None:
                    path = tuple(dict.fromkeys(w for _, own in stack for w in own))
                out.append((path, words, linked))
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal raw_depth, in_link, path
        for tag, _ in stack[k:]:
            raw_depth -= tag in RAW
            in_link -= tag == "a"
            opened[tag] -= 1
        del stack[k:]
        path = None

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not raw_depth:
            piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece)

    tokens, at, n = _Tokens(page), 0, len(page)
    while at < n:
        start, end_at, tag, end, attributes, plain = tokens.next(at)
        add(page[at:start])
        at = end_at
        if not tag:
            if plain:
                add(html.escape(plain, quote=False))
            continue
        if end:
            if tag == "br" and not raw_depth:
                text.append(" ")
            if tag not in INLINE:
                flush()
            if beyond and tag not in RAW:
                beyond -= 1
                continue
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():  # without one open there is nothing to look for
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag doesn't end blocks
            continue
        if tag in INLINE:
            if tag == "br" and not raw_depth:
                text.append(" ")
        else:
            flush()
            if tag == "body" and raw_depth:
                k = next((i for i, (t, _) in enumerate(stack) if t == "head"), None)
                if k is not None:
                    pop_to(k)
            if tag in _CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in _SIBLINGS:
                ends, scope = _SIBLINGS[tag]
                last = None
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in scope or stack[k][0] in RAW:
                        break  # what is in a raw element ends nothing around it
                    if stack[k][0] in ends:
                        last = k
                if last is not None:
                    pop_to(last)
        if tag in VOID or attributes.endswith("/") and tag not in UNPARSED and tag not in INLINE and tag not in _CLOSES_P:
            continue
        if tag in UNPARSED:
            e = _ENDS[tag].search(page, at)
            at = e.end() if e else n
            continue
        if len(stack) >= MOST_OPEN and tag not in RAW:
            beyond += 1
            continue
        names = [p.lower() for a in _NAMES.findall(attributes) for p in _PARTS.findall(next(filter(None, a), "")) if not p.isdigit()] if attributes else []
        stack.append((tag, (f"<{tag}>", *names) if tag not in INLINE else tuple(names)))
        opened[tag] += 1
        path = None
        raw_depth += tag in RAW
        in_link += tag == "a"
    flush()
    return out


def _bucket(word: str, n: int) -> int:
    h = 0
    for c in word.encode():
        h = (h * 131 + c + 1) & 0xFFFFFFFF
    return (h ^ h >> 15) * 2654435761 % (1 << 32) % n


class _Hashed(dict):
    """Buckets of words, each computed once and kept while they are few."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = b = _bucket(word, self.n)
        return b


_PATHS = _Hashed(PATH_BUCKETS)


class Words(NamedTuple):
    """Buckets of the words of all blocks of a page, end to end, and the number of words of each block."""

    buckets: np.ndarray
    sizes: np.ndarray


def features(page_blocks: list[tuple[tuple[str, ...], str, int]]) -> tuple[list[list[int]], Words, np.ndarray]:
    """Path buckets, word buckets and counts of each block; all words are read."""
    n = len(page_blocks)
    paths = [[_PATHS[w] for w in p] for p, _, _ in page_blocks]
    data, offs = text_bytes(pa.array([t for _, t, _ in page_blocks], pa.large_string()))
    data = LOWER_AZ[data]
    starts, ends, of = words(data, offs)
    read = Words((span_hashes(data, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int32), np.bincount(of, minlength=n))
    c = np.zeros((n, COUNTS))
    for i, (p, t, linked) in enumerate(page_blocks):
        size = len(t)
        c[i] = (np.log1p(size) / 6, np.log1p(t.count(" ")) / 5, linked / size, min(1.0, (t.count(".") + t.count(",")) * 10 / size), min(len(p), 20) / 10, i / n, 1.0 if i == 0 else 0.0, float(any(len(w) == 4 and w[1] == "h" and w[2].isdigit() for w in p[-3:])))
    return paths, read, c


class Labeller:
    """Bidirectional LSTM with hashed embeddings; forward and backward passes over a padded batch of pages."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + COUNTS, HIDDEN
        self.p = {"path": r.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": r.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "out": r.normal(0, 0.2, (2 * h + d, 1)), "bias": np.zeros(1)}
        for side in "fb":
            self.p[f"x{side}"] = r.normal(0, 0.2, (d, 4 * h))
            self.p[f"h{side}"] = r.normal(0, 0.2, (h, 4 * h))
            b = np.zeros(4 * h)
            b[h : 2 * h] = 1.0  # at first the cells forget little
            self.p[f"b{side}"] = b

    def _inputs(self, pages: list, kind: type = float) -> tuple[np.ndarray, np.ndarray, list]:
        t, b = max(len(c) for _, _, c in pages), len(pages)
        x, mask = np.zeros((t, b, PATH_DIM + WORD_DIM + COUNTS), kind), np.zeros((t, b), kind)
        used = []
        for name, at, dim in (("path", 0, PATH_DIM), ("word", PATH_DIM, WORD_DIM)):
            if name == "path":
                ids = np.array([i for page in pages for own in page[0] for i in own], np.int64)
                sizes = np.array([len(own) for page in pages for own in page[0]], np.int64)
            else:
                ids, sizes = np.concatenate([page[1].buckets for page in pages]), np.concatenate([page[1].sizes for page in pages])
            row = np.repeat(np.arange(len(sizes)), sizes)
            scale = 1 / np.sqrt(np.maximum(sizes, 1)) if name == "path" else 1 / np.maximum(sizes, 1)
            sums = np.empty((len(sizes), dim), kind)
            for k in range(dim):  # one component at a time, so that memory doesn't grow with words times components
                sums[:, k] = np.bincount(row, self.p[name][ids, k], minlength=len(sizes)) * scale
            used.append((name, ids, row, scale, at, dim))
            first = 0
            for j, page in enumerate(pages):
                m = len(page[2])
                x[:m, j, at : at + dim] = sums[first : first + m]
                first += m
        for j, page in enumerate(pages):
            m = len(page[2])
            x[:m, j, PATH_DIM + WORD_DIM :] = page[2]
            mask[:m, j] = 1
        return x, mask, used

    def _lstm(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """Outputs and, for the gradient, what each step had; without `keep` nothing but the outputs is kept."""
        h = HIDDEN
        t, b, _ = x.shape
        steps = range(t) if side == "f" else range(t - 1, -1, -1)
        w, u, bias = (self.p[f"{k}{side}"].astype(x.dtype) for k in "xhb")
        out, state, cell, kept = np.zeros((t, b, h), x.dtype), np.zeros((b, h), x.dtype), np.zeros((b, h), x.dtype), [None] * t if keep else []
        lo = hi = 0
        for i in steps:
            if not lo <= i < hi:  # the inputs of STEPS_AT_ONCE steps
                lo = i if side == "f" else max(0, i + 1 - STEPS_AT_ONCE)
                hi = min(t, lo + STEPS_AT_ONCE) if side == "f" else i + 1
                z = x[lo:hi] @ w + bias
            a = z[i - lo] + state @ u
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * h], -40, 40)))
            new = np.tanh(a[:, 3 * h :])
            c = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            m = mask[i][:, None]
            c = m * c + (1 - m) * cell
            th = np.tanh(c)
            s = m * gates[:, 2 * h :] * th + (1 - m) * state
            if keep:
                kept[i] = (gates, new, cell, th, state)
            state, cell = s, c
            out[i] = s
        return out, kept

    def scores(self, pages: list, kind: type = np.float32) -> list[np.ndarray]:
        """Probability of main text for every block of every page, computed in numbers of `kind`."""
        x, mask, _ = self._inputs(pages, kind)
        h, w = HIDDEN, self.p["out"].astype(kind)
        z = self._lstm(x, mask, "f", False)[0] @ w[:h] + self._lstm(x, mask, "b", False)[0] @ w[h : 2 * h] + x @ w[2 * h :]
        p = 1 / (1 + np.exp(-np.clip(z[:, :, 0] + self.p["bias"], -40, 40)))
        return [p[: len(page[2]), j] for j, page in enumerate(pages)]

    def gradients(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask, used = self._inputs(pages)
        outs = {s: self._lstm(x, mask, s) for s in "fb"}
        whole = np.concatenate([outs["f"][0], outs["b"][0], x], axis=2)
        z = (whole @ self.p["out"])[:, :, 0] + self.p["bias"]
        y = np.zeros_like(z)
        for j, own in enumerate(labels):
            y[: len(own), j] = own
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * mask / mask.sum()
        g = {"out": np.einsum("tbk,tb->k", whole, dz)[:, None], "bias": np.array([dz.sum()])}
        dwhole = dz[:, :, None] * self.p["out"][:, 0]
        h = HIDDEN
        dx = dwhole[:, :, 2 * h :].copy()
        for k, side in enumerate("fb"):
            dout, kept = dwhole[:, :, k * h : (k + 1) * h], outs[side][1]
            steps = range(len(x) - 1, -1, -1) if side == "f" else range(len(x))
            dh, dc, da = np.zeros(x.shape[1:2] + (h,)), np.zeros(x.shape[1:2] + (h,)), np.zeros(x.shape[:2] + (4 * h,))
            gh = np.zeros_like(self.p[f"h{side}"])
            for i in steps:
                gates, new, cell, th, state = kept[i]
                m = mask[i][:, None]
                dh = dh + dout[i]
                ds = m * dh
                dcell = dc * m + ds * gates[:, 2 * h :] * (1 - th * th)
                a = np.concatenate([dcell * new, dcell * cell, ds * th], axis=1) * gates * (1 - gates)
                a = np.concatenate([a, dcell * gates[:, :h] * (1 - new * new)], axis=1)
                da[i] = a
                gh += state.T @ a
                dh = (1 - m) * dh + a @ self.p[f"h{side}"].T
                dc = (1 - m) * dc + dcell * gates[:, h : 2 * h]
            g[f"h{side}"] = gh
            g[f"x{side}"] = np.einsum("tbi,tbj->ij", x, da)
            g[f"b{side}"] = da.sum(axis=(0, 1))
            dx += da @ self.p[f"x{side}"].T
        for name, ids, row, scale, at, dim in used:
            flat = np.concatenate([dx[: len(page[2]), j, at : at + dim] for j, page in enumerate(pages)]) * scale[:, None]
            g[name] = np.stack([np.bincount(ids, flat[row, k], minlength=len(self.p[name])) for k in range(dim)], axis=1)
        return g

    def fit(self, pages: list, labels: list[np.ndarray], rounds: int = 3, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Labeller:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t = 0
        by_size = np.argsort([len(c) for _, _, c in pages], kind="stable")
        steps = rounds * -(-len(pages) // batch) + 1
        for _ in range(rounds):
            starts = np.arange(0, len(pages), batch)
            for at in r.permutation(starts):
                own = by_size[at : at + batch]
                t += 1
                g = self.gradients([pages[i] for i in own], [labels[i] for i in own])
                norm = np.sqrt(sum((x * x).sum() for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= rate * (1 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


#: Names that pages give to the parts around their main text, by part; fixed words.
PART_NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs submenu sitemap skip links language toc pager pagination next prev",
    "header": "header masthead top topbar site branding logo banner hero tagline",
    "footer": "footer foot bottom copyright legal colophon credits",
    "sidebar": "sidebar aside side widget related recommended popular trending recent archive tags categories rail secondary complementary more also read",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay privacy banner warning message dialog toast announcement",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense banner dfp outbrain taboola partner",
    "form": "form search login signup subscribe newsletter register contact input field",
    "comments": "comments comment disqus replies reply respond discussion thread feedback responses reader",
    "share": "share social sharing follow byline toolbar buttons meta author print",
}
#: Names of containers of main text; fixed words.
MAIN_NAMES = "article content main post entry story body text page primary single blog news hentry markdown prose detail copy container wrapper"
_LABELS = "Home|About us|Contact|News|Sports|Products|Log in|Sign up|Next page|Previous|Search|Share this|Follow us|Read more|All rights reserved|Privacy policy|Terms of use|Accept all cookies|We use cookies to improve your experience.|Subscribe to our newsletter|Advertisement|Sponsored content|Related articles|Most popular|Leave a reply|Posted by a reader|Reply|Comments|Report|Enter your email|Sitemap|Back to top|This site is archived.|Published|Tags|Copyright".split("|")


_ANY_TAG = re.compile(r"<[^>]*>")


class _Layouts:
    """Labelled pages: real texts in made layouts."""

    def __init__(self, texts: list[list[str]], seed: int = 11) -> None:
        self.texts, self.r = texts, np.random.default_rng(seed)

    def pick(self, words: str | list[str]) -> str:
        words = words.split() if isinstance(words, str) else words
        return words[int(self.r.integers(len(words)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def mix(self, items: list[str]) -> list[str]:
        return [items[i] for i in self.r.permutation(len(items))]

    def sentence(self) -> str:
        t = self.pick([x for x in self.texts[int(self.r.integers(len(self.texts)))]] or ["Text."])
        if self.chance(0.5):
            at = int(self.r.integers(max(1, len(t) - 60)))
            t = t[at : at + int(self.r.integers(20, 200))]
        return html.escape(t)

    def odd(self) -> str:
        """A name that says nothing."""
        return "".join(self.pick(list("abcdefghijklmnopqrstuvwxyz")) for _ in range(int(self.r.integers(1, 8))))

    def name(self, part: str) -> str:
        own = self.pick(PART_NAMES[part])
        return self.pick([own, f"{own}-{self.pick('list box inner wrap area section block item unit 1')}", f"{self.pick('site page main post global left right')}-{own}", own.capitalize() + "Box"])

    def part(self, part: str) -> str:
        tag = self.pick({"menu": "nav nav div ul menu", "header": "header header div", "footer": "footer footer div", "sidebar": "aside aside div section", "form": "form form div", "comments": "section div div ol", "notice": "div div section dialog", "advert": "div div aside section ins", "share": "div ul p"}[part])
        semantic = tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog")
        attr = "" if semantic and self.chance(0.5) else f' {self.pick("class id class role")}="{self.name(part)}"'
        n = int(self.r.integers(1, 7))
        if part == "menu":
            items = [f"<a href=/x>{self.pick([self.pick(_LABELS), html.escape(self.pick(self.sentence().split() or ['x']))])}</a>" for _ in range(n + 1)]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else " ".join(items)
        elif part == "comments":
            inner = "".join(self.pick([f'<div class="{self.name("comments")}"><p>{self.sentence()}</p></div>', f"<p>{self.sentence()}</p>", f"<li><b>{self.pick(_LABELS)}</b> {self.sentence()}</li>"]) for _ in range(n))
        elif part == "form":
            inner = f"<label>{self.pick(_LABELS)}</label><input name=q><p>{self.pick(_LABELS)}</p>" + (f"<p>{self.sentence()}</p>" if self.chance(0.3) else "")
        elif part in ("sidebar", "footer", "header"):
            inner = "".join(self.pick([f"<h{int(self.r.integers(1, 5))}>{self.pick([self.pick(_LABELS), self.odd(), self.sentence()[:40]])}</h4>", f"<p>{self.sentence()}</p>", f"<ul><li><a href=/y>{self.sentence()}</a></li></ul>", f"<a href=/z>{self.pick(_LABELS)}</a>"]) for _ in range(n))
            inner = self.sentence() if self.chance(0.35) else inner
        else:
            inner = self.pick([self.sentence(), f"<p>{self.sentence()}</p>", f"<a href=/ad>{self.sentence()}</a>", self.pick(_LABELS), f"<p>{self.pick(_LABELS)}</p><p>{self.sentence()}</p>"])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def page(self) -> str:
        paragraphs = self.texts[int(self.r.integers(len(self.texts)))]
        if self.chance(0.06):  # one line, many times
            paragraphs = [paragraphs[0], *[self.pick(paragraphs)[: int(self.r.integers(3, 40))]] * int(self.r.integers(10, 150))]
        body = []
        head = self.pick(["h1", "h1", "h2"])
        short = [self.pick(_LABELS) for _ in range(2) if self.chance(0.3)]  # words of the parts around are no sign by themselves
        for i, t in enumerate([*paragraphs[:1], *self.mix([*paragraphs[1:], *short])]):
            t = html.escape(t)
            if i == 0 and self.chance(0.8):
                body.append(f"<{head}>{t}</{head}>")
            elif self.chance(0.08):
                body.append(f"<h{int(self.r.integers(2, 5))}>{t[:80]}</h2>")
            else:
                body.append(self.pick([f"<p>{t}</p>"] * 12 + [f"<p><b>{t}<br>", f"<p>{t}", f"<ul><li>{t}</li></ul>", f"<blockquote>{t}</blockquote>", f"<div>{t}</div>", f"<table><tr><td>{t}</td></tr></table>", f"<p>{t[: len(t) // 2]}<a href=/l>{t[len(t) // 2 :]}</a></p>"]))
            if self.chance(0.05):
                body.append(f"<!--out-->{self.part(self.pick('advert share sidebar notice form'))}<!--in-->")
        if self.chance(0.4):
            body.append(f"<!--out-->{self.part(self.pick('comments comments share sidebar form'))}<!--in-->")
        bare = self.chance(0.15)  # no container
        if bare and self.chance(0.2):
            body = [x if x.startswith("<!--") else f"{_ANY_TAG.sub('', x)}<br><br>" for x in body]
        tag = self.pick("article article article main main div div div section td")
        named = self.pick([*MAIN_NAMES.split(), *(self.odd() for _ in range(8))])
        attr = f' {self.pick("class id")}="{named}{self.pick([""] * 3 + ["-" + self.pick(MAIN_NAMES)])}"' if tag in ("div", "section", "td") and self.chance(0.85) or self.chance(0.3) else ""
        main = f"<!--in-->{''.join(body)}<!--out-->" if bare else f"<{tag}{attr}><!--in-->{''.join(body)}<!--out--></{tag}>"
        if tag == "td" and not bare:
            main = f"<table><tr>{main}</tr></table>"
        if self.chance(0.3) and not bare:
            main = f"<main>{main}</main>" if tag != "main" else f'<div class="{self.pick(MAIN_NAMES)}">{main}</div>'
        around = self.pick([0.1, 0.45]) if bare else 0.45
        before = [self.part(x) for x in ("header", "menu", "notice", "advert", "form", "sidebar") if self.chance(around)]
        after = [self.part(x) for x in ("comments", "share", "sidebar", "advert", "form", "notice", "footer") if self.chance(around)]
        whole = "".join(before) + main + "".join(after)
        if self.chance(0.4):
            whole = f'<div {self.pick("class id")}="{self.pick("wrapper page container site layout root app outer")}">{whole}</div>'
        return whole if bare and self.chance(0.4) else f"<html><head><title>x</title></head><body>{whole}</body></html>"

    def labelled(self) -> tuple[list, np.ndarray]:
        """Blocks and labels of one page: the marks in comments become marks in the texts, which are taken out again."""
        page = self.page().replace("<!--in-->", "\x02").replace("<!--out-->", "\x03")
        inside, labels, kept = 0.0, [], []
        for path, text, linked in blocks(page):
            marks = [c for c in text if c in "\x02\x03"]
            clean = text.replace("\x02", "").replace("\x03", "").strip()
            if clean:
                early = text[0] in "\x02\x03"
                if early:
                    inside = float(text[0] == "\x02")
                kept.append((path, clean, min(linked, len(clean))))
                labels.append(inside)
            if marks:
                inside = float(marks[-1] == "\x02")
        return kept, np.array(labels)


def train(pages: DataFrame, page_id: str = "page_id", markup: str = "html", most: int = TRAIN_PAGES, layouts: int = TRAIN_LAYOUTS) -> Labeller:
    """A labeller fitted with the texts of at most `most` pages; with no pages, with none but the fixed labels."""
    own = pages.where(F.length(markup) <= TRAIN_PAGE_CHARS).select(F.col(page_id).alias("id"), F.col(markup).alias("html"))
    chosen = own.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)  # ids alone are ordered; the pages follow by a join
    sample = sorted(own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("html").alias("html")).collect(), key=lambda r: str(r["id"]))
    texts = [own for r in sample if (own := [t for p, t, linked in blocks(r["html"]) if "<p>" in p or "<h1>" in p if linked * 2 < len(t)])]
    made = _Layouts(texts or [["Some words of a text.", "More of them, in a row."]])
    data = [x for x in (made.labelled() for _ in range(layouts)) if x[0]]
    r = np.random.default_rng(3)
    read = []
    for paths, own, counts in (features(b) for b, _ in data):
        shown = r.random(len(own.sizes)) >= HIDDEN_WORDS
        read.append((paths, Words(own.buckets[np.repeat(shown, own.sizes)], own.sizes * shown), counts))
    return Labeller().fit(read, [y for _, y in data])


def _extract(labeller: Labeller) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            found = [blocks(x) if x else [] for x in batch.column("html").to_pylist()]
            order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
            kept: list[list[tuple[str, float]]] = [[] for _ in found]
            at = 0
            while at < len(order):  # pages of like lengths together, about 20 000 blocks at a time
                size = 1
                while at + size < len(order) and size < 256 and (size + 1) * len(found[order[at + size]]) <= 20_000:
                    size += 1
                own = order[at : at + size]
                for i, p in zip(own, labeller.scores([features(found[i]) for i in own]), strict=True):
                    kept[i] = [(t, float(x)) for (_, t, _), x in zip(found[i], p, strict=True)]
                at += size
            texts = [" ".join(t for t, x in own if x >= 0.5) for own in kept]
            counts = [sum(x >= 0.5 for _, x in own) for own in kept]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array([len(x) for x in found], pa.int64())], ["id", "text", "n_kept", "n_blocks"])

    return run


def main_text(pages: DataFrame, labeller: Labeller, page_id: str = "page_id", markup: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_kept, n_blocks): one row for each row of `pages`.

    text joins the blocks that are labelled main text by one space, in page
    order; white space inside a block is one space, character references are
    decoded. Null and empty pages, and pages without main text, give an empty
    text. Rows that repeat an id give rows of their own; other columns are
    ignored.
    """
    own = pages.select(F.struct(F.col(page_id).alias("id"), *(F.col(c).alias(c) for c in keep)).alias("id"), F.col(markup).alias("html"))
    kind = own.schema["id"].dataType.simpleString()
    out = own.mapInArrow(_extract(labeller), f"id {kind}, text string, n_kept long, n_blocks long")
    return out.select("id.*", "text", "n_kept", "n_blocks")
