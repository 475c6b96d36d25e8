"""A bidirectional LSTM in numpy that labels each block of a page as main text or not, and the pages it learns from.

A block is a vector: tags and words of classes, ids and roles of its path in hashed cells (nearer ones weigh more), hashed words, and a few measures (length, share
of link text, punctuation, place, how close its neighbours stand in the tree). The network reads a page's blocks in both directions, so that each decision sees the whole page.

Only tags and words that training pages hold (KNOWN) have cells: a name that nobody has seen (css-1x2y, col-md-8) says nothing, instead of what another name of its cell does.

It is trained here, on pages made by `page`: layouts with menus, headers, notices, adverts, side bars, forms, comments and footers under many
names around articles, in invented words, so that it learns structure and not vocabulary. On a part of the pages names are generated ones or missing, and the article is found by
what it looks like and by what stands around it. Seeds are fixed: training always gives the same weights.
"""

from __future__ import annotations

import functools
import random
import re
import zlib

import numpy as np

from .html_blocks import ATTRIBUTE, Block, Place, blocks
from .shingles import word_hashes

PATH, WORDS, MEASURES = 128, 16, 13
INPUT, HIDDEN = PATH + WORDS + MEASURES, 24
LABEL_CACHE = 20_000
#: A line of a page's owner: a sign more than a word.
RIGHTS = re.compile(r"©|\(c\)|\bcopyright\b|\u2117", re.I)
TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
DECAY = 0.9
_labels: dict[str, np.ndarray] = {}


def parts_of(mark: str) -> list[str]:
    """A tag as it is; of key=value the words of the value, marked as words."""
    key, _, value = mark.rpartition("=")
    return [f"={x}" for x in re.split(r"[^a-z]+", value) if len(x) > 1] if key else [mark]


@functools.cache
def known_parts() -> frozenset[str]:
    """What has cells: HTML's tags, and the words of the names that training pages use."""
    openings = [*MAIN, *NAV, *HEADER, *FOOTER, *ADS, *NOTICE, *SIDE, *COMMENTS, *WRAP, *TITLE]
    names = {f"={x}" for o in openings for a in ATTRIBUTE.findall(o) for v in a[1:] for x in re.split(r"[^a-z]+", v.lower()) if len(x) > 1}
    return frozenset(names | TAGS | {"hidden", "aria-hidden"})


def _label_vector(label: str) -> np.ndarray:
    known = _labels.get(label)
    if known is None:
        known = np.zeros(PATH, np.float32)
        for part in {x for mark in label.split() for x in parts_of(mark)} & known_parts():
            h = zlib.crc32(part.encode("utf-8", "surrogatepass"))
            known[h % PATH] += 1 if h >> 20 & 1 else -1
        if len(_labels) > LABEL_CACHE:
            _labels.clear()
        _labels[label] = known
    return known


def _path_vector(place: Place | None) -> np.ndarray:
    """Labels of all elements around, each counting DECAY times the one inside it; computed once for each element."""
    known = np.zeros(PATH, np.float32)
    fresh = []
    while place is not None:
        if place.vector is not None:
            known = place.vector
            break
        fresh.append(place)
        place = place.up
    for p in reversed(fresh):
        known = p.vector = _label_vector(p.label) + DECAY * known
    return known


NEAR = 8


def _above(place: Place | None) -> list[Place]:
    """A place and those around it, NEAR at most."""
    out = []
    while place is not None and len(out) < NEAR:
        out.append(place)
        place = place.up
    return out


def steps_up(page: list[Block]) -> np.ndarray:
    """For each block how far one must go up to an element that also holds the block before it, and the one after it: 1 for what stands side by side, 0 at NEAR or more."""
    out = np.zeros((len(page), 2), np.float32)
    above = [_above(b.place) for b in page]
    for i in range(1, len(page)):
        before, own = ({id(p): k for k, p in enumerate(above[j])} for j in (i - 1, i))
        out[i, 0] = next((1 / max(k, 1) for k, p in enumerate(above[i]) if id(p) in before), 0)
        out[i - 1, 1] = next((1 / max(k, 1) for k, p in enumerate(above[i - 1]) if id(p) in own), 0)
    return out


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), INPUT), np.float32)
    if not page:
        return out
    hashes, owner = word_hashes([b.text.encode("utf-8", "surrogatepass") for b in page])
    np.add.at(out, (owner, PATH + (hashes % np.uint64(WORDS)).astype(np.int64)), np.where(hashes >> np.uint64(40) & np.uint64(1), 1, -1).astype(np.float32))
    n = np.bincount(owner, minlength=len(page)).astype(np.float32)
    out[:, PATH : PATH + WORDS] /= np.sqrt(n + 1)[:, None] * 4
    last, up = max(len(page) - 1, 1), steps_up(page)
    for i, b in enumerate(page):
        out[i, :PATH] = _path_vector(b.place)
        size = len(b.text)
        out[i, PATH + WORDS :] = (
            np.log1p(size) / 6, b.linked / size, min(sum(map(b.text.count, ".!?,;")) / (n[i] + 1), 1.0), float(b.text[-1] in ".!?:\"'"),
            i / last, np.log1p(n[i]) / 4, min(b.place.depth if b.place else 0, 12) / 12, 1.0, float(bool(RIGHTS.search(b.text[:200]))), *up[i], *(up[i] == 1),
        )
    return out


class Labeller:
    """Parameters by name; forward and backward passes over a batch of pages (batch, steps, INPUT) with a mask (batch, steps)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{k}{d}": make(a, 4 * HIDDEN) for d in "fb" for k, a in (("x", INPUT), ("h", HIDDEN))}
        self.p |= {f"c{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32) for d in "fb"}
        self.p |= {"o": make(2 * HIDDEN, 1), "q": make(INPUT, 1), "z": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((len(x), HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        wx = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in steps:
            a = wx[:, t] + h @ self.p[f"h{d}"]
            gate = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h, m))
            h, c = h2, c2
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = []
        for d in "fb":
            trace: list | None = None if keep is None else keep.setdefault(d, [])
            both.append(self._run(x, mask, d, trace))
        top = np.concatenate(both, axis=2)
        if keep is not None:
            keep["top"] = top
        return (top @ self.p["o"] + x @ self.p["q"] + self.p["z"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        z = self.logits(x, mask, keep)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = max(mask.sum(), 1)
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        dz = (mask * (p - y) / total)[:, :, None].astype(np.float32)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g = {"o": flat(keep["top"]).T @ flat(dz), "q": flat(x).T @ flat(dz), "z": dz.sum(axis=(0, 1))}
        dtop = dz @ self.p["o"].T
        for n, d in enumerate("fb"):
            dout = dtop[:, :, n * HIDDEN : (n + 1) * HIDDEN]
            da_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, gg, c, tc, h, m in reversed(keep[d]):
                dh = dh + dout[:, t]
                dm = dh * m
                dc2 = dc + dm * o * (1 - tc * tc)
                da = np.concatenate([dc2 * gg * i * (1 - i), dc2 * c * f * (1 - f), dm * tc * o * (1 - o), dc2 * i * (1 - gg * gg)], axis=1) * m
                da_all[:, t] = da
                gh += h.T @ da
                dh = dh * (1 - m) + da @ self.p[f"h{d}"].T
                dc = m * dc2 * f + (1 - m) * dc
            g |= {f"x{d}": flat(x).T @ flat(da_all), f"h{d}": gh, f"c{d}": da_all.sum(axis=(0, 1))}
        return loss, g

    def labels(self, pages: list[np.ndarray], cells: int = 1 << 16) -> list[np.ndarray]:
        """True for each block of main text. Pages run together in batches of like length and at most so many blocks."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        while order:
            longest, batch = 0, []
            while order and (not batch or (len(batch) + 1) * len(pages[order[0]]) <= cells // 8):
                batch.append(order.pop(0))
                longest = len(pages[batch[-1]])
            x, mask = padded([pages[i] for i in batch], longest)
            z = self.logits(x, mask)
            for i, row in zip(batch, z, strict=True):
                out[i] = row[: len(pages[i])] > 0
        return out


def padded(pages: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(pages), longest, INPUT), np.float32), np.zeros((len(pages), longest), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# --- pages to learn from -----------------------------------------------------------------------------------------

MAIN = ["<article>", "<main>", '<main><article class="post">', '<div class="content">', '<div id="content">', '<div class="post-body">', '<div class="article-body">', '<div class="entry-content">', '<section class="story">', '<div role="main">', '<div id="main">', '<article itemprop="articleBody">', '<div class="main"><div class="text">', '<div class="page"><article>', '<div class="mw-body" role="main"><div class="mw-parser-output">', '<div id="mw-content-text">', '<div class="field-item">', '<div class="node-content"><div class="field-body">', '<div class="text">', '<div class="markdown-body">', '<div class="prose">', '<div class="story-body">', '<div class="article-text">', '<div class="blog-post hentry">', '<div id="article">', '<div class="document">', '<section class="single-content">', '<div id="bodyContent">', '<div class="entry">', '<div class="article__body">', '<div class="richtext">']
NAV = ["<nav>", '<ul class="menu">', '<div class="navbar">', '<div id="nav">', '<nav class="breadcrumbs">', '<div class="breadcrumb">', '<div role="navigation">', '<div class="top-menu">', '<div class="pagination">', '<div id="p-navigation">', '<div class="toc">', '<div id="toc">', '<div class="mw-panel">', '<ul class="nav">', '<div class="links">', '<div class="navigation-menu">']
HEADER = ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header">', '<div role="banner">', '<header class="top">', '<div id="siteSub">', '<div class="page-header">', '<div class="logo">', '<div class="branding">']
FOOTER = ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="site-footer">', '<div role="contentinfo">', '<footer class="bottom">', '<div class="copyright">', '<div id="catlinks">', '<ul id="footer-info">', '<div class="legal">', '<div id="bottom">', '<div class="colophon">']
ADS = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="ad-1">', '<div class="sponsored">', '<aside class="promo">', '<div class="advertisement">', '<section class="ad">', '<div class="banner-ad">']
NOTICE = ['<div class="cookie-banner">', '<div id="cookie-notice">', '<div class="notice">', '<div class="consent">', '<div class="alert">', '<div class="gdpr">', '<div class="popup">', '<div class="newsletter">', '<div role="alert">', '<div class="subscribe">', '<div class="modal">', '<div class="overlay">', '<div id="siteNotice">', '<div class="message">', '<dialog>', '<div role="dialog">', '<div class="banner">']
SIDE = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">', '<aside class="related-posts">', '<div role="complementary">', '<div class="recommended">', '<section class="trending">', '<div class="share">', '<div class="social">', '<div class="tags">', '<div class="author-bio">', '<div class="navbox">', '<div class="infobox">', '<div class="see-also">', '<div class="most-read">', '<div class="right-column">', '<div class="meta">']
COMMENTS = ['<section class="comments">', '<div id="comments">', '<ol class="commentlist">', '<div class="comment-thread">', '<section id="discussion">', '<div class="reader-comments">', '<div class="replies">', '<div id="disqus_thread">', '<ul class="responses">', '<div class="forum-replies">', '<div class="feedback">', '<div id="respond">', '<section class="user-comments">']
WRAP = ["", "", '<div class="wrapper">', '<div id="page">', '<div class="container">', '<div id="root">', '<div class="row">', '<div class="top">', '<div class="site">', '<div class="body-wrapper">', '<div class="layout">']
TITLE = ["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", '<h1 class="title">{}</h1>', "<header><h1>{}</h1></header>", '<h1 id="firstHeading" class="firstHeading">{}</h1>', '<h1 class="headline">{}</h1>', '<div class="title">{}</div>']
#: Tags that say by themselves what is in them; names of others may be generated ones where the text shows it.
TELLING = ("<nav", "<header", "<footer", "<aside", "<ul", "<dialog")


def _close(opening: str) -> str:
    names = [p.split()[0].strip("<>") for p in opening.split("<")[1:]]
    return "".join(f"</{n}>" for n in reversed(names))


class _Writer:
    def __init__(self, r: random.Random):
        self.r = r
        self.named = r.random() >= 0.3  # else names are generated ones or missing
        self.syllables = [r.choice("bcdfghklmnprstvz") + r.choice("aeiouäéöü") + r.choice(["", "n", "r", "st", "l"]) for _ in range(40)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def dressed(self, opening: str) -> str:
        """An opening with other names in it, or with none."""
        code = lambda: "".join(self.r.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(self.r.randint(4, 8)))
        made = self.r.choice(["", "", f' class="css-{code()}"', f' class="{code()} {code()}"', f' class="sc-{code()} {code()}"', f' class="col-md-{self.r.randint(1, 12)}"', f' id="{code()}"', f' data-{code()}="{code()}"'])
        return re.sub(r"\s(?:class|id|role|itemprop)=\"[^\"]*\"", "", opening).replace(">", f"{made}>")

    def phrase(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        s = self.phrase(3, 18).capitalize()
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s + self.r.choice("....?!") + self.r.choice(["", "", "", "&amp;"])

    def odd(self) -> str:
        """Main text that doesn't look like prose: lists with bars, repeated words, symbols, capitals, a word or two."""
        kind = self.r.randrange(5)
        words = [self.word() for _ in range(self.r.randint(1, 40))]
        if kind == 0:
            return " | ".join(words)
        if kind == 1:
            return " ".join([words[0]] * self.r.randint(3, 60))
        if kind == 2:
            return " ".join(x + self.r.choice(["###", "$$$", "%%%", "&amp;&amp;", "***"]) for x in words)
        if kind == 3:
            return " ".join(x.upper() + "!!" for x in words)
        return " ".join(words[: self.r.randint(1, 2)]).capitalize() + self.r.choice([".", ""])

    def prose(self, a: int, b: int) -> str:
        s = " ".join(self.sentence() for _ in range(self.r.randint(a, b)))
        if self.r.random() < 0.3:
            s = s.replace(" ", f" <a href='/{self.word()}'>{self.word()}</a> ", 1)
        if self.r.random() < 0.2:
            s = f"<b>{s}" + self.r.choice(["</b>", "", "<br>"])
        return s

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(1, 3)}{self.r.choice(["", ".", ","])}</a>' for _ in range(self.r.randint(a, b))]
        form = self.r.choice(["<ul>{}</ul>", "{}", "<div>{}</div>"])
        return form.format("".join(f"<li>{x}</li>" for x in items) if "ul" in form or self.r.random() < 0.4 else self.r.choice([" | ", " ", "<br>"]).join(items))


def page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it is main text."""
    w, parts, truth = _Writer(r), [], []

    def add(html: str, main: bool) -> None:
        truth.extend([main] * len(blocks(html)))
        parts.append(html)

    def around(opening: str, inner: str, shown: bool = False) -> None:
        """Noise; shown: its text shows it, so that the names don't have to."""
        if not w.named and (shown or opening.startswith(TELLING)):
            opening = w.dressed(opening)
        add(f"{opening}{inner}{_close(opening)}", False)

    def form() -> str:
        return f"<form><label>{w.phrase(1, 3)}</label><input><button>{w.word()}</button><p>{w.sentence()}</p></form>"

    noise = {
        "nav": lambda: around(r.choice(NAV), w.links(2, 9), True),
        "header": lambda: around(r.choice(HEADER), r.choice([f"<h1>{w.phrase(1, 4)}</h1>", f"<p>{w.phrase(2, 6)}</p>", f"<a href='/'>{w.word()}</a>"]) + (w.links(2, 5) if r.random() < 0.5 else "")),
        "ad": lambda: around(r.choice(ADS), r.choice([w.prose(1, 3), f"<p>{w.prose(1, 3)}</p>", w.phrase(2, 9), w.links(1, 2)])),
        "notice": lambda: around(r.choice(NOTICE), f"<p>{w.prose(1, 3)}</p>" + (f"<button>{w.word()}</button>" if r.random() < 0.6 else "") + (form() if r.random() < 0.2 else "")),
        "side": lambda: around(r.choice(SIDE), (f"<h3>{w.phrase(1, 3)}</h3>" if r.random() < 0.6 else "") + r.choice([w.links(2, 6), f"<p>{w.prose(1, 3)}</p>", w.prose(1, 2)])),
        "form": lambda: add(form(), False),
    }

    def comments() -> None:
        each = r.choice(["<p>{}</p>", "<li><p>{}</p></li>", '<div class="comment">{}</div>', '<div class="comment-body"><p>{}</p></div>', "<article><p>{}</p></article>"])
        inner = "".join(each.format(w.prose(1, 5)) for _ in range(r.randint(1, 6)))
        around(r.choice(COMMENTS), (f"<h2>{w.phrase(1, 3)}</h2>" if r.random() < 0.6 else "") + inner + (form() if r.random() < 0.3 else ""))

    def body() -> None:
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.72:
                text = w.prose(1, 8) if r.random() < 0.8 else w.odd()
                add(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>"]), True)
            elif kind < 0.82:
                add(f"<h2>{w.phrase(1, 7)}</h2>", True)
            elif kind < 0.88:
                add("<ul>" + "".join(f"<li>{r.choice([w.sentence(), w.phrase(1, 5)])}</li>" for _ in range(r.randint(2, 6))) + "</ul>", True)
            elif kind < 0.93:
                add(f"<blockquote><p>{w.prose(1, 3)}</p></blockquote>", True)
            elif kind < 0.95:
                add("<table>" + "".join(f"<tr><td>{w.word()}</td><td>{w.phrase(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>", True)
            elif kind < 0.97:
                add(f"<pre>{w.phrase(3, 12)}</pre>", True)
            else:
                noise[r.choice(["ad", "side", "notice", "form"])]()

    parts.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
    wrap = r.choice(WRAP)
    parts.append(wrap)
    before = [k for k, chance in (("notice", 0.3), ("header", 0.6), ("nav", 0.75), ("ad", 0.45), ("side", 0.2), ("form", 0.1)) if r.random() < chance]
    if r.random() < 0.3:
        r.shuffle(before)
    for k in before:
        noise[k]()
    opening = r.choice(MAIN) if w.named or r.random() < 0.2 else w.dressed(r.choice(["<div>", "<div>", "<section>", "<div><div>", "<table><tr><td>"]))
    main = "<div>" * (r.randint(1, 24) if r.random() < 0.15 else 0) + opening + "<div>" * (r.randint(1, 24) if r.random() < 0.15 else 0)  # some deep pages
    parts.append(main)
    if r.random() < 0.85:
        add(r.choice(TITLE).format(r.choice([w.phrase(2, 10), w.sentence(), w.phrase(1, 2)])), True)
    body()
    if r.random() < 0.12:
        comments()
    parts.append(_close(main))
    for k, chance in (("side", 0.4), ("ad", 0.3), ("form", 0.15)):
        if r.random() < chance:
            noise[k]()
    if r.random() < 0.35:
        comments()
    if r.random() < 0.2:
        noise["nav"]()
    if r.random() < 0.8:
        rights = f"{r.choice(['&copy;', 'Copyright', '(c)'])} {r.randint(1995, 2025)} {w.phrase(1, 4)}. {w.sentence()}"
        bare = r.random() < 0.2  # no more than a line at the end
        if bare:
            add(r.choice(["<p>{}</p>", "<center>{}</center>", "<hr>{}", "<div>{}</div>"]).format(rights), False)
        else:
            around(r.choice(FOOTER), r.choice([rights, f"&copy; {w.phrase(1, 4)}", f"<p>{w.prose(1, 2)}</p>", f"&copy; {w.word()}.example &middot; {w.prose(1, 2)}", w.links(2, 6)]))
    parts.append(_close(wrap) if wrap else "")
    parts.append("</body></html>")
    html = "".join(parts)
    if len(blocks(html)) != len(truth):  # an unclosed paragraph that ran into what follows: close them all
        return page(r)
    return html, truth


@functools.lru_cache(maxsize=2)
def trained(pages: int = 2500, epochs: int = 8, seed: int = 20240229, batch: int = 32) -> Labeller:
    """The labeller, trained on so many made pages with Adam."""
    r = random.Random(seed)
    made = sorted((page(r) for _ in range(pages)), key=lambda p: len(p[1]))
    data = [(vectors(blocks(h)), np.asarray(t, np.float32)) for h, t in made]
    net = Labeller()
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    step = 0
    for epoch in range(epochs):
        r.shuffle(groups)
        for group in groups:
            longest = max(len(y) for _, y in group)
            x, mask = padded([v for v, _ in group], longest)
            y = np.zeros(mask.shape, np.float32)
            for i, (_, t) in enumerate(group):
                y[i, : len(t)] = t
            _, g = net.gradients(x, mask, y)
            step += 1
            rate = 0.01 * (0.5 ** (epoch / 3))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net
