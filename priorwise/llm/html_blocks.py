"""Leaf blocks of an HTML page: text between the boundaries of block-level elements, with its ancestors.

A tolerant single pass: quotes open a value only after an equals sign; comments, declarations, scripts, styles and other raw elements go; end tags close the
nearest open element of their name and all inside it; paragraphs, list items and table cells
end where the standard lets them end; cut-off pages are read as far as they go.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# fixed values: element names of the HTML standard
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template svg iframe title textarea annotation annotation-xml".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
              "small span strike strong sub sup time tt u var wbr br img input button select option output meter progress object "
              "math semantics maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
              "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
_ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
              "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# an element that opens ends an open one of these, up to the given limits
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"})}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    tags: tuple[str, ...]  # ancestors from the root
    names: tuple[str, ...]  # lower-case words of their classes, ids and roles
    text: str
    linked: int  # characters of the text inside links


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order; null and empty pages have none."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if not text:
            return
        whole = " ".join(html.unescape("".join([t for t, _ in text])).split())
        if whole:
            linked = sum(len("".join(t.split())) for t, inside in text if inside)
            path = [(t, n) for t, n in stack if t not in _INLINE]
            out.append(Block(tuple(t for t, _ in path), tuple(w for _, n in path for w in n), whole, linked))
        text.clear()

    def close(to: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[to:])
        del stack[to:]

    def end_open(names: set[str], limits: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return close(i)
            if stack[i][0] in limits or stack[i][0] in _ENDS_P - {"p"}:
                return None

    at = 0
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            text.append((page[at:m.start()], links > 0))
        at = m.end()
        ending, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if not m[4]:
            break  # cut off inside a tag
        if tag in _RAW:
            if not ending and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append((" ", False))
            continue
        if tag not in _INLINE:
            flush()
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS:
            end_open(*_ENDS[tag])
        elif tag in _ENDS_P:
            end_open({"p"}, {"table", "td", "th", "button"})
        names = tuple(w for a in _ATTR.finditer(m[3]) for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower()))
        stack.append((tag, names))
        links += tag == "a"
    else:
        text.append((page[at:], links > 0))
    flush()
    return out
