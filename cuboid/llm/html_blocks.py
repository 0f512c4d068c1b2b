"""HTML as the sequence of its leaf blocks: text, path of open elements, share of linked characters.

A small reader, linear in the page: raw-text elements and comments are skipped, unclosed paragraphs,
items and cells end where the next one starts, stray end tags are ignored, ``>`` in quotes is kept.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; what they hold is no text of the page.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes svg math xmp".split())
#: An element ends one of these that is open, unless one of its bounds stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_MARKUP = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|/[^>]*+>)""", re.S)
_NAMES = re.compile(r"""(?i)(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    text: str
    path: tuple  # of (tag, names)
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    """Lower-case parts of the class, id and role."""
    if "=" not in attributes:
        return ()
    out = []
    for m in _NAMES.finditer(attributes):
        out += [x.lower() for x in _PARTS.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(out))


def blocks(page: str) -> list[Block]:
    """The blocks that have text, in page order; white space in them is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = anchors = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if anchors:
            linked += len(text)

    find = _MARKUP.search
    while m := find(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), (m[1] or m[4]), (m[3] or m[6] or "")
        if closing:
            if tag not in INLINE:
                if tag in HEADINGS:  # ends whatever heading is open
                    tag = next((x[0] for x in reversed(stack) if x[0] in HEADINGS), tag)
                if any(x[0] == tag for x in stack):
                    flush()
                    while stack.pop()[0] != tag:
                        pass
                    anchors = sum(x[0] == "a" for x in stack)
                elif tag in ("p", "br"):
                    flush()
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i]
                        anchors -= tag == "a"
                        break
                    if stack[i][0] not in INLINE:
                        break
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                parts.append(" ")
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag in INLINE:
            if not attributes.endswith("/"):
                stack.append((tag, ()))
                anchors += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDS:
            kinds, bounds = ENDS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in kinds:
                    del stack[i:]
                    break
        elif tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
            stack.pop()
        elif any(x[0] == "p" for x in stack):
            i = max(i for i, x in enumerate(stack) if x[0] == "p")
            if all(x[0] in INLINE for x in stack[i + 1 :]):
                del stack[i:]
        anchors = sum(x[0] == "a" for x in stack)
        if not attributes.endswith("/"):
            stack.append((tag, _names(attributes)))
    if at < len(page):
        add(page[at:])
    flush()
    return out
