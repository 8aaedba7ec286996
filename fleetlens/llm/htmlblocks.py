"""Leaf blocks of an HTML page, with the path of tags above each of them."""

from __future__ import annotations

import html
import re
import sys

from pyspark import cloudpickle

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# a comment, a declaration, or a tag; quoted values may hold ">", a quote left open ends at the next ">"
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset({"script", "style", "template", "textarea", "title", "iframe", "select", "option", "button", "noframes", "xmp"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "basefont", "frame"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "input", "nobr", "embed", "area", "picture", "source", "param", "track", "svg", "math", "object", "audio", "video", "canvas"})
# everything inside these belongs to the line they stand in
FOREIGN = frozenset({"svg", "math"})
# unless they are left open: these tags end them
LEAVES = frozenset({"p", "div", "ul", "ol", "li", "dl", "dt", "dd", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "body"})
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset({"ul", "ol", "table", "dl", "div", "article", "section", "body", "main", "aside", "nav", "footer", "header", "form", "blockquote"})
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


def features(tag: str, attributes: str) -> tuple[str, ...]:
    """What a tag on the path says: its name, and the words of its class, id and role."""
    out = [tag]
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role", "itemprop"):
            for word in re.split(r"[^a-z]+", value):
                if word:
                    out += [f"{tag}.{word}", f".{word}"]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            out.append(".hidden")
    return tuple(out)


def blocks(page: str) -> list[tuple[str, tuple[tuple[str, ...], ...], int]]:
    """(text, path, characters inside links) of every block that has text, in page order.

    A block is the text between two block tags; references are decoded and white space
    becomes one space.  Formulas, drawings and what stands in for media are text of their
    block; text for readers without scripts is a block like any other.
    """
    out: list[tuple[str, tuple, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    seen: dict[tuple[str, str], tuple[str, ...]] = {}
    parts: list[str] = []
    path: tuple = ()
    linked = links = at = foreign = 0

    def close(i: int) -> None:
        nonlocal foreign
        foreign -= sum(t in FOREIGN for t, _ in stack[i:]) if foreign else 0
        del stack[i:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, path, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal path, linked
        if not parts:
            if text.isspace():
                return
            path = tuple(f for _, f in stack)
        parts.append(text)
        if links:
            linked += len(text)

    while True:
        m = TAG.search(page, at)
        if m is None:
            if at < len(page):
                add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if foreign and tag in LEAVES:
            close(next(i for i, (t, _) in enumerate(stack) if t in FOREIGN))
        if m[1]:
            inside = foreign > 0
            if tag not in INLINE and not inside:
                flush()
            elif tag == "a" and links:
                links -= 1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in INLINE and not inside and any(t not in INLINE for t, _ in stack[i:]):
                        break  # an inline end tag does not close blocks
                    close(i)
                    break
                if inside and tag not in FOREIGN and stack[i][0] in FOREIGN:
                    break  # nor does one inside a formula close what is around it
            continue
        if tag in RAW:
            if tag not in INLINE and not foreign:
                flush()
            end = RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif not m[3].endswith("/") and tag in ("script", "style"):
                at = len(page)
            continue
        if tag in INLINE or foreign:
            if tag == "br":
                parts.append(" ") if parts else None
            empty = m[3].endswith("/") and (foreign or tag in FOREIGN)
            if tag not in VOID and not empty:
                if tag == "a":
                    links += 1
                foreign += tag in FOREIGN
                stack.append((tag, (tag,)))
            continue
        flush()
        links = 0
        closing = CLOSES_ITSELF.get(tag, {"p"})
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closing or (stack[i][0] == "p"):
                close(i)
                if not (closing - {"p"}):
                    break
            elif stack[i][0] in SCOPE:
                break
        if tag not in VOID:
            key = (tag, m[3])
            if key not in seen:
                seen[key] = features(tag, m[3])
            stack.append((tag, seen[key]))
    flush()
    return out
