"""Endpoints in scripts by the call they stand in: a scan over string literals, not a parse.

Types: fetch, xhr (open calls), jquery (get, post, ajax, load, getJSON), location
(assignments and calls), import, url (other literals that are paths or URLs).  Comments are
passed over; templates count with their holes as EXPR.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def _scan(quotes: str) -> re.Pattern:
    """Comments and literals in the given quotes; ``open`` is set on a literal that never ends."""
    return re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<q>[{quotes}])(?P<s>(?:\\.|(?!(?P=q))[^\\])*+)(?:(?P=q)|(?P<open>))", re.S)


# what stands before a literal, white space cut off
_KINDS = (
    ("fetch", re.compile(r"\bfetch\s*\($")),
    ("xhr", re.compile(r"\.open\s*\(\s*[\"'`][A-Za-z]+[\"'`]\s*,$")),
    ("jquery", re.compile(r"\$\.(?:get|post|ajax|getJSON|load)\s*\($")),
    ("location", re.compile(r"\blocation(?:\.href)?\s*=$|\blocation\.(?:assign|replace)\s*\($|\bwindow\.open\s*\($")),
    ("import", re.compile(r"\bimport\s*\(?$|\bfrom$|\bimportScripts\s*\($")),
)
_SETTINGS, _URL_KEY = re.compile(r"\$\.(?:get|post|ajax|getJSON|load)\s*\(\s*\{"), re.compile(r"(?:^|[{,\s])[\"']?url[\"']?\s*:$")
_PATH = re.compile(r"^(?:https?:)?//[\w.\-]+|^\.{0,2}/[\w%\-./]+|^[\w\-./]+\.(?:php|aspx?|jsp|do|action|json|html?)(?:[?#]|$)|^[\w\-]+(?:/[\w\-]+)+/?\??")
#: Characters of a call that are looked at, white space and comments between its parts not counted.
_CALL = 120
_LAST = frozenset("(,=")


def _skeleton(text: str) -> Iterator[tuple[str, str, str]]:
    """(quote, literal, code before it) of each literal; comments are left out and white space runs are one blank."""
    quotes, at, code = "\"'`", 0, ""

    def more(code: str, part: str) -> str:
        if part.isalnum() or not part:
            return (code + part)[-2 * _CALL :]
        if len(part) > 4 * _CALL:
            part = part[-4 * _CALL :] if not part[-4 * _CALL :].isspace() else part.rstrip()[-4 * _CALL :] + " "
        return (code + " ".join((part + "\0").split())[:-1])[-2 * _CALL :]

    while quotes and (m := _scan(quotes).search(text, at)):
        if m["open"] is not None:  # no such quote ends a literal from here on; without it the scan stays linear
            quotes = quotes.replace(m["q"], "")
            code, at = more(code, text[at : m.start() + 1]), m.start() + 1
            continue
        code, at = more(code, text[at : m.start()]), m.end()
        if m["q"] is None:
            continue
        yield m["q"], m["s"], code.rstrip()
        code = (code + m["q"] + m["s"][-_CALL:] + m["q"])[-2 * _CALL :]


def script_calls(text: str) -> list[tuple[str, str]]:
    """(endpoint, type) in order, each once; lines, literals and gaps of any length."""
    out: dict[tuple[str, str], None] = {}
    settings = False  # whether the latest braces opened are those of a request's settings
    for quote, s, before in _skeleton(text):
        if not s:
            continue
        if quote == "`":
            s = re.sub(r"\$\{[^}]*\}", "EXPR", s)
        last = before[-1:]
        kind = next((k for k, p in _KINDS if p.search(before[-_CALL:])), None) if last in _LAST or before.endswith(("import", "from")) else None
        opened = None
        if "$." in before:
            for opened in _SETTINGS.finditer(before):
                settings = True
        if settings and "})" in before[opened.end() if opened else 0 :]:
            settings = False
        if kind is None and settings and last == ":" and _URL_KEY.search(before):
            kind = "jquery"
        if kind is None and not (_PATH.match(s) and " " not in s):
            continue
        out[s, kind or "url"] = None
    return list(out)


def calls(text: Column) -> Column:
    """ARRAY<STRUCT<endpoint, type>> of script text; empty for null."""
    kind = pa.list_(pa.struct([("endpoint", pa.string()), ("type", pa.string())]))

    @F.arrow_udf("array<struct<endpoint:string,type:string>>")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([[{"endpoint": e, "type": t} for e, t in script_calls(s)] if s else [] for s in a.to_pylist()], kind)

    return run(text)
