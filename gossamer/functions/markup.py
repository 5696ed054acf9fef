"""Page text and its visible lines, in one linear pass per page.

A line is visible when text is left after comments and the elements head,
script and style are dropped, tags are replaced by a blank, entities are
decoded and white space is collapsed.  Unclosed comments and elements run to
the end of the text; a tag that is never closed by '>' is text.  Line numbers count from
1 in the original text.

Every scan moves forward only: no search for a closing '>' starts behind the last one,
and a closing tag that was not found once is not looked for again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from html import unescape

TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
FIRST_EMPTY = re.compile(r"(?:\A|\n)\r?\n")
SITE = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#\s@]*@)?([^/?#\s:]+)")
HIDDEN = ("head", "script", "style")


def _keep_breaks(m: re.Match | str) -> str:
    return "\n" * (m if isinstance(m, str) else m[0]).count("\n")


def _blank_tag(m: re.Match) -> str:
    s = m[0]
    return " " if "\n" not in s else " " + "\n" * s.count("\n")


def sub_tags(put: str | Callable[[re.Match], str], text: str, tag: re.Pattern = TAG) -> str:
    """``tag.sub`` over the part of the text in which tags can end."""
    last = text.rfind(">") + 1
    return tag.sub(put, text[:last]) + text[last:] if last else text


@lru_cache
def _opening(names: tuple[str, ...], comments: bool) -> re.Pattern:
    return re.compile(rf"(?i){'<!--|' if comments else ''}<({'|'.join(names)})(?=[\s>/])")


@lru_cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"(?i)</{name}\s*>")


def sub_elements(put: Callable[[str, str, str], str], text: str, names: tuple[str, ...], comments: bool = False, to_end: bool = True) -> str:
    """Each outermost element of these names replaced by ``put(name, whole, inner)``; comments have the name ''.

    An element ends at its first closing tag.  One without a closing tag runs to the end of the text,
    or stays as it is where ``to_end`` is off.
    """
    out, at, here, last = [], 0, 0, text.rfind(">")
    gone: set[str] = set()
    opening = _opening(names, comments)
    while m := opening.search(text, here):
        if m[1] is None:
            name, inner = "", m.end()
            end = stop = text.find("-->", inner)
            end = len(text) if end < 0 else end + 3
            stop = len(text) if stop < 0 else stop
        else:
            name, inner = m[1].lower(), text.find(">", m.end()) + 1 if m.end() <= last else 0
            if not inner:
                here = m.end()
                continue
            close = None if name in gone else _closing(name).search(text, inner)
            if close is None:
                gone.add(name)
                if not to_end:
                    here = inner
                    continue
            stop, end = (close.start(), close.end()) if close else (len(text), len(text))
        out += (text[at : m.start()], put(name, text[m.start() : end], text[inner:stop]))
        at = here = end
    return "".join(out) + text[at:] if out else text


def page_text(body: str | None, raw: str | None) -> str | None:
    """The body, or what follows the first empty line of raw; None where there is neither."""
    if body:
        return body
    if raw:
        m = FIRST_EMPTY.search(raw)
        if m:
            return raw[m.end() :] or None
    return None


def without_hidden(text: str) -> str:
    """The text without comments, head, script and style; its line breaks stay."""
    return sub_elements(lambda _, whole, __: _keep_breaks(whole), text, HIDDEN, comments=True) if "<" in text else text


def collapse(s: str) -> str:
    """Entities decoded, white space of any kind collapsed and trimmed."""
    if "&" in s:
        s = unescape(s)
    return " ".join(s.split())


def visible_lines(text: str) -> list[tuple[int, str]]:
    """(line number, visible text) of each line that has any."""
    if "<" in text:
        text = sub_tags(_blank_tag, without_hidden(text))
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        s = collapse(line)
        if s:
            out.append((no, s))
    return out


def visible_text(text: str) -> str:
    """The visible text of a whole page as one string."""
    if "<" in text:
        text = sub_tags(" ", sub_elements(lambda *_: "", text, HIDDEN, comments=True))
    return collapse(text)


def site_of(endpoint: str | None) -> str | None:
    """Host of an endpoint, lower-cased and without a final dot; None where there is none."""
    m = SITE.match(endpoint) if endpoint else None
    host = m[1].lower().rstrip(".") if m else ""
    return host or None
