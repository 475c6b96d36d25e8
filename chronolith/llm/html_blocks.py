"""HTML to leaf blocks: runs of text between block-level tags, each with the place in the tree of tags it stands in.

One pass over the page, whatever it holds: tags that are never closed, closed twice or nested a hundred thousand deep. A block refers to its place, and a
place to the one around it, so that deep pages cost no more than flat ones.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Tags and comments; quoted attribute values may hold ">".
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
SPACES = re.compile(r"\s+")
#: Their content is not text of the page: of the first ones up to their end tag or the end of the page, of the others if they have an end tag.
RAW_TEXT = frozenset("script style textarea iframe title".split())
RAW = RAW_TEXT | frozenset("template svg select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: They stand in a line of text and don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br "
                   "math mi mn mo mrow ms msub msup msubsup mfrac msqrt mroot mstyle mtext mspace mover munder munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html div section article aside nav header footer main form td th blockquote".split())


class Place:
    """An open element: its label, the place around it, and how deep it is. `vector` is for who reads the blocks."""

    __slots__ = ("label", "up", "depth", "vector")

    def __init__(self, label: str, up: Place | None):
        self.label, self.up, self.depth, self.vector = label, up, up.depth + 1 if up else 1, None


class Block:
    __slots__ = ("place", "text", "linked")

    def __init__(self, place: Place | None, text: str, linked: int):
        self.place, self.text, self.linked = place, text, linked


def _label(name: str, attributes: str) -> str:
    if not attributes or len(attributes) < 4:
        return name
    marks = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        key = key.lower()
        marks += [f"{key}={x}" for x in value.split()] if value else [key]
    return " ".join([name, *marks])


def blocks(html: str | None) -> list[Block]:
    """The page's blocks in order. Character references are decoded, white space inside a block is one space; empty blocks are left out."""
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []  # open elements that are not inline
    opened: Counter[str] = Counter()  # how many of each tag are among them
    endless: set[str] = set()  # tags of which no end tag follows
    parts: list[str] = []
    html = html or ""
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(stack[-1][1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def leave(to: int) -> None:
        for n, _ in stack[to:]:
            opened[n] -= 1
        del stack[to:]

    at, end = 0, len(html)
    while at < end:
        m = MARKUP.search(html, at)
        start = m.start() if m else end
        if start > at:
            parts.append(html[at:start])
            if links:
                linked += start - at
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                continue
            flush()
            if opened[name]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name == "a":
            links += 1
        if name in INLINE:
            continue
        flush()
        if name in RAW:
            if not m[3].rstrip().endswith("/") and name not in endless:
                close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                if close:
                    at = close.end()
                elif name in RAW_TEXT:
                    at = end
                else:
                    endless.add(name)
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            leave(len(stack) - 1)
        if name in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SIBLINGS[name]:
                    leave(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        links = 0 if name in SCOPE else links
        stack.append((name, Place(_label(name, m[3]), stack[-1][1] if stack else None)))
        opened[name] += 1
    flush()
    return out
