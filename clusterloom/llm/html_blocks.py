"""Pages as leaf blocks: runs of text between block-level tags, each with the tags above it."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: contents that are no text of the page
SKIPPED = frozenset("script style noscript template svg math iframe object head title select button textarea datalist audio video canvas".split())
#: skipped contents that hold raw text: only their own end tag closes them
RAW = frozenset("script style title textarea iframe noscript".split())
#: what may stand in a head; any other tag, and text, closes one that is open
_HEAD = frozenset("head base basefont bgsound link meta noscript script style template title".split())
#: skipped contents that can't hold themselves: a second start tag closes the first
_SINGLE = frozenset("button select datalist audio video".split())
#: tags at which skipped contents end if their own end tag is missing
_FLOW = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: tags that stay within a block
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label link map mark meter output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr input meta".split()
)
#: what an opening tag closes if it is open, up to the bounds given
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P_BOUND = frozenset(["button", "table", "td", "th", "body", "html", "object"])
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: open tags that a path spells out; with more, it has their marks once each
DEEP = 400
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    link_chars: int


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id, role and the like, as path features."""
    marks = [name]
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component"):
                marks += [f".{x.lower()}" for x in _NAMES.findall(value)]
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                marks.append(".hidden")
    return tuple(marks)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in page order; null and empty pages have none.

    Character references are decoded, and white space within a block is one space.  Unclosed and
    misplaced tags are put right as far as block bounds go: an opening block tag closes an open
    paragraph, items and cells close the ones before, an end tag closes what is open inside it, and an
    end tag without a start is ignored.  An open head ends at the first text or tag that can't stand in
    one.  Other skipped contents that turn out to have no end tag of their own are read again, and end
    at the first block tag; raw text without an end tag goes on to the end of the page.
    """
    if not page:
        return []
    out: list[Block] = []
    # Name, marks and, for tags beyond DEEP, the marks of all open tags.
    stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []
    opened: Counter = Counter()
    held: list[str] = []
    linked, in_link, skipping = 0, 0, 0
    outer: tuple | None = None  # a skipped tag that should have an end tag: its place in the stack, and what to go back to
    back = False
    inner: list[tuple[int, int]] = []  # place and position of the skipped tags open in that one
    unclosed: set[int] = set()  # positions of those that were open when it was gone back to
    loose: list[int] = []  # places in the stack of skipped tags without an end tag
    last: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip(" ")
            if text:
                deep = stack[-1][2] if stack else ()
                out.append(Block(text, (*deep, stack[-1][0]) if deep else tuple(m for _, marks, _ in stack for m in marks), linked))
            held.clear()
        linked = 0

    def pop(to: int, own: bool = False) -> None:
        """Close the tags from place `to` on; `own`: for the end tag of the one there."""
        nonlocal in_link, skipping, outer, back
        if outer and to <= outer[0]:
            back = not (own and to == outer[0])
            if back:
                return
            outer = None
        while loose and loose[-1] >= to:
            loose.pop()
        while inner and inner[-1][0] >= to:
            inner.pop()
        if any(name not in INLINE for name, _, _ in stack[to:]):
            flush()
        for name, _, _ in stack[to:]:
            opened[name] -= 1
            in_link -= name == "a"
            skipping -= name in SKIPPED
        del stack[to:]

    def close(names: frozenset, bound: frozenset) -> None:
        for k in range(len(stack) - 1 if any(opened[x] for x in names) else -1, -1, -1):
            if stack[k][0] in names:
                pop(k)
                return
            if stack[k][0] in bound:
                return

    def has_end(name: str, at: int) -> bool:
        if name not in last:
            last[name] = max((m.start() for m in re.finditer(rf"</{name}", page, re.IGNORECASE)), default=-1)
        return last[name] >= at

    at, end = 0, len(page)
    while at < end or outer:
        if back or at >= end:
            place, at, kept, in_link, skipping = outer
            stack[:] = kept
            opened = Counter(x for x, _, _ in stack)
            held.clear()
            loose.append(place)
            unclosed.update(x for _, x in inner)
            inner.clear()
            outer, linked, back = None, 0, False
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stack and stack[-1][0] == "head" and page[at:stop].strip():
            pop(len(stack) - 1)
        if stop > at and not skipping:
            held.append(page[at:stop])
            linked += (stop - at) * (in_link > 0)
        if not m:
            at = end
            continue
        at = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for k in range(len(stack) - 1 if opened[name] else -1, -1, -1):
                if stack[k][0] == name:
                    pop(k, own=True)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if stack and stack[-1][0] == "head" and name not in _HEAD:
            pop(len(stack) - 1)
        if name == "br":
            held.append(" ")
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name in _FLOW and loose and not outer:
            pop(loose[0])
            if stack and stack[-1][0] == "head":
                pop(len(stack) - 1)
        if name in _SINGLE:
            close(frozenset([name]), _P_BOUND)
        if name not in INLINE and name not in ("html", "body"):
            close(frozenset(["p"]), _P_BOUND)
        if name in _CLOSES:
            close(*_CLOSES[name])
        if name == "a":
            close(frozenset(["a"]), _P_BOUND)
        if m[3] and m[3].endswith("/") and name in ("svg", "math"):
            continue
        if name not in INLINE:
            flush()
        marks, deep = _marks(name, m[3]), ()
        if len(stack) >= DEEP:
            deep = stack[-1][2] or tuple(dict.fromkeys(x for _, above, _ in stack for x in above))
            deep += tuple(x for x in dict.fromkeys(marks) if x not in deep)
        stack.append((name, marks, deep))
        opened[name] += 1
        in_link += name == "a"
        skipping += name in SKIPPED
        if name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            pop(len(stack) - 1)
            at = closing.end() if closing else end
        elif name in SKIPPED and name != "head":
            if outer:
                inner.append((len(stack) - 1, at))
            elif at not in unclosed and has_end(name, at):
                outer = (len(stack) - 1, at, list(stack), in_link, skipping)
            else:
                loose.append(len(stack) - 1)
    flush()
    return out
