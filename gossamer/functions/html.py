"""A linear tokenizer of HTML: start tags with attributes, end tags, script text, doctype."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_NEXT = re.compile(r"<(?:!--|!|\?|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_RAW_END = {n: re.compile(rf"(?i)</{n}(?=[\s/>]|$)") for n in ("script", "style", "textarea", "title", "xmp", "noembed")}
VOID = frozenset("area base br col embed frame hr img input isindex link meta param source track wbr".split())


def tokens(text: str) -> Iterator[tuple]:
    """("start", name, attributes, closed), ("end", name), ("raw", name, text), ("decl", text), ("data", text).

    The first of repeated attributes counts; values are decoded.  An unclosed comment or
    raw element runs to the end; an unclosed tag is dropped.
    """
    i, n = 0, len(text)
    while i < n:
        m = _NEXT.search(text, i)
        if not m:
            yield ("data", text[i:])
            return
        if m.start() > i:
            yield ("data", text[i : m.start()])
        at, head = m.start(), m[0]
        if head == "<!--":
            end = text.find("-->", at + 4)
            i = n if end < 0 else end + 3
        elif head in ("<!", "<?"):
            end = text.find(">", at)
            if end < 0:
                return
            yield ("decl", text[at + 2 : end])
            i = end + 1
        elif head[1] == "/":
            end = text.find(">", at)
            if end < 0:
                return
            yield ("end", _NAME.match(text, at + 2)[0].lower())
            i = end + 1
        else:
            name = _NAME.match(text, at + 1)
            j, attrs = name.end(), {}
            while True:
                while j < n and (text[j].isspace() or text[j] == "/"):
                    j += 1
                if j >= n:
                    return
                if text[j] == ">":
                    break
                a = _ATTR.match(text, j)
                if not a or a.end() == j:
                    j += 1
                    continue
                value = next((g for g in a.groups()[1:] if g is not None), "")
                attrs.setdefault(a[1].lower(), unescape(value) if "&" in value else value)
                j = a.end()
            low = name[0].lower()
            closed = text[j - 1] == "/" and not (attrs and list(attrs.values())[-1].endswith("/"))
            yield ("start", low, attrs, closed)
            i = j + 1
            if low in _RAW_END and not closed:
                end = _RAW_END[low].search(text, i)
                stop = end.start() if end else n
                yield ("raw", low, text[i:stop])
                i = stop
