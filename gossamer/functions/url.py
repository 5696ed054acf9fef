"""URL functions as Column expressions; a Python resolver only where references meet a base."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer.functions import psl

_HEAD = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(u), _HEAD, 1))


def hostname(u: Column | str) -> Column:
    """Host without port, as written; '' where there is none."""
    return F.coalesce(F.regexp_extract(_c(u), _HEAD, 2), F.lit(""))


def port(u: Column | str) -> Column:
    return F.regexp_extract(_c(u), _HEAD, 3)


def raw_path(u: Column | str) -> Column:
    return F.regexp_extract(_c(u), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def path(u: Column | str) -> Column:
    """Decoded path; a plus sign stays one, a broken escape stays as it is."""
    p = F.regexp_replace(F.replace(raw_path(u), F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(p)


def query(u: Column | str) -> Column:
    return F.regexp_extract(_c(u), r"^[^?#]*\?([^#]*)", 1)


def root_url(u: Column | str) -> Column:
    """scheme://host[:port]"""
    return F.concat(scheme(u), F.lit("://"), hostname(u), F.when(port(u) != "", F.concat(F.lit(":"), port(u))).otherwise(""))


def is_url(u: Column | str) -> Column:
    """A scheme and a host are there, and nothing that cannot stand in a URL's host."""
    return F.coalesce((hostname(u) != "") & ~hostname(u).rlike(r"[\s<>\"\\^`{|}]"), F.lit(False))


def query_pairs(u: Column | str) -> Column:
    """ARRAY<STRUCT<k, v>> of the query in its order, decoded; empty keys are left out."""
    fix = lambda s: F.coalesce(F.try_url_decode(F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25")), s)
    parts = F.filter(F.split(query(u), "&"), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(fix(F.substring_index(x, "=", 1)).alias("k"), F.when(F.contains(x, F.lit("=")), fix(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("v")))
    return F.filter(pairs, lambda p: p["k"] != "")


def last_part(u: Column | str) -> Column:
    return F.regexp_extract(path(u), r"([^/]*)/*\z", 1)


def _some(value: Column, when: Column | None = None) -> Column:
    """An array of the one value, or an empty one."""
    ok = (value != "") if when is None else when
    return F.when(F.coalesce(ok, F.lit(False)), F.array(value)).otherwise(F.array().cast("array<string>"))


FIELDS = ["url", "path", "fqdn", "rdn", "rurl", "qurl", "qpath", "file", "ufile", "key", "value", "kv", "dir", "udir"]


def field(name: str, u: Column | str = "url", custom: Column | None = None) -> Column:
    """ARRAY<STRING>: the values a URL has for a field, none where it has none.

    Fields: url, path, fqdn, rdn, rurl (root), qurl and qpath (only with query keys),
    file and ufile (last part, if it has a dot), key, value, kv (one per pair, keys distinct),
    dir (path through its last slash) and udir.  Any other name is a custom field,
    looked up in ``custom`` (a map of arrays); without that it is an error.
    """
    u = _c(u)
    pairs = query_pairs(u)
    has_keys = F.size(pairs) > 0
    folder = F.regexp_extract(path(u), r"(?s)^(/.*/)[^/]*\z", 1)
    is_file = last_part(u).contains(".")
    whole = {
        "url": lambda: _some(u, u.isNotNull()),
        "path": lambda: _some(path(u)),
        "fqdn": lambda: _some(hostname(u)),
        "rdn": lambda: _some(psl.rdn(hostname(u))),
        "rurl": lambda: _some(root_url(u), is_url(u)),
        "qurl": lambda: _some(u, has_keys),
        "qpath": lambda: _some(F.concat(path(u), F.lit("?"), query(u)), has_keys),
        "file": lambda: _some(last_part(u), is_file),
        "ufile": lambda: _some(u, is_file),
        "key": lambda: F.coalesce(F.array_distinct(F.transform(pairs, lambda p: p["k"])), F.array().cast("array<string>")),
        "value": lambda: F.coalesce(F.transform(pairs, lambda p: p["v"]), F.array().cast("array<string>")),
        "kv": lambda: F.coalesce(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), F.array().cast("array<string>")),
        "dir": lambda: _some(folder),
        "udir": lambda: _some(F.concat(root_url(u), folder), folder != ""),
    }
    if name in whole:
        return whole[name]()
    if custom is None:
        raise ValueError(f"unknown field {name!r}")
    return F.coalesce(custom[name], F.array().cast("array<string>"))


def validate_fields(names: str, custom: list[str] | None = None) -> list[str]:
    """The comma-separated names as a list; an unknown or empty one is an error."""
    out = [n for n in names.split(",")]
    for n in out:
        if n not in FIELDS and n not in (custom or []):
            raise ValueError(f"unknown field {n!r}")
    return out


def parent_paths(u: Column | str) -> Column:
    """ARRAY<STRING> of parent folders as URLs, deepest first, without the root and the page itself."""
    parts = F.filter(F.split(raw_path(u), "/"), lambda x: x != "")
    n = F.size(parts)
    up = F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.concat(root_url(u), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(n > 1, up).otherwise(F.array().cast("array<string>"))


def blank_query(u: Column | str) -> Column:
    """Every query value emptied, keys kept in their order; the fragment goes."""
    u = _c(u)
    keys = F.transform(F.filter(F.split(query(u), "&"), lambda x: x != ""), lambda x: F.concat(F.substring_index(x, "=", 1), F.lit("=")))
    head = F.regexp_extract(u, r"^([^?#]*)", 1)
    return F.when(F.size(keys) > 0, F.concat(head, F.lit("?"), F.array_join(keys, "&"))).otherwise(head)


def request_key(method: Column | str, u: Column | str, body: Column | str) -> Column:
    """What makes a request unique: the URL; for POST with its body; for others with the method."""
    m = F.coalesce(F.upper(_c(method)), F.lit("GET"))
    return F.when(m == "GET", _c(u)).when(m == "POST", F.concat_ws(":", _c(u), _c(body))).otherwise(F.concat_ws(":", m, _c(u)))


def store_path(u: Column | str) -> Column:
    """<host>/<sha1 of the URL>.txt"""
    h = F.replace(F.concat(hostname(u), F.when(port(u) != "", F.concat(F.lit(":"), port(u))).otherwise("")), F.lit(":"), F.lit("_"))
    return F.concat(h, F.lit("/"), F.sha1(_c(u)), F.lit(".txt"))


def with_scheme(u: Column | str) -> Column:
    """Trimmed, a missing scheme added: http on the ports 80 and 8080, else https."""
    s = F.regexp_replace(F.regexp_replace(_c(u), r"^[\s\x{a0}]+", ""), r"[\s\x{a0}]+$", "")
    p = F.regexp_extract(s, r"^[^/?#]*:(\d+)", 1)
    return F.when(s.startswith("http://") | s.startswith("https://"), s).when(p.isin("80", "8080"), F.concat(F.lit("http://"), s)).otherwise(F.concat(F.lit("https://"), s))


LONGEST, LEAST_SEQUENCE, MOST_REPEATS = 2_097_152, 10, 10
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)


def back_to_back(text: str, least: int, most: int) -> bool:
    """Whether a stretch longer than ``least``, of any length, stands ``most`` times or more in a row.

    A run of ``most`` stretches of length p covers most - 1 whole blocks that start at multiples of p, all equal.
    Blocks are compared by polynomial hashes, runs that are found are compared as text.
    """
    n = len(text)
    if n <= least * most:
        return False
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    power = _powers(n)
    # hash of text[i:j] times base^(n-j): sums of code x base^(n-1-k), so equal blocks differ by a power of the base
    sums = np.r_[np.uint64(0), np.cumsum(codes * power[n - 1 :: -1][:n], dtype=np.uint64)]
    for p in range(least + 1, n // most + 1):
        at = np.arange(0, n - p + 1, p)
        block = (sums[at + p] - sums[at]) * power[at]
        same = block[1:] == block[:-1]
        if same.sum() < most - 2:
            continue
        run = 0
        for k, x in enumerate(same.tolist()):
            run = run + 1 if x else 0
            if run >= most - 2:
                i = int(at[k + 1]) - run * p
                j = int(at[k + 1]) + p
                if text[i : j - p] != text[i + p : j]:  # only the hashes were equal
                    continue
                while i > 0 and text[i - 1] == text[i - 1 + p]:
                    i -= 1
                while j < n and text[j] == text[j - p]:
                    j += 1
                if j - i >= most * p:
                    return True
    return False


def repeats(text: str, least: int = LEAST_SEQUENCE, most: int = MOST_REPEATS) -> bool:
    """Whether a stretch longer than ``least`` comes ``most`` times or more, without overlap.

    Candidates are the segments between slashes and runs of them, and any stretch
    repeated back to back.
    """
    if len(text) <= least * most:
        return False
    if back_to_back(text, least, most):
        return True
    parts = text.split("/")
    for k in (1, 2, 3):
        seen: dict[str, int] = {}
        for i in range(len(parts) - k + 1):
            s = "/".join(parts[i : i + k])
            if len(s) > least:
                seen[s] = seen.get(s, 0) + 1
        if seen and max(seen.values()) >= most and any(n >= most and text.count(s) >= most for s, n in seen.items()):
            return True
    return False


def is_cycle(u: Column | str) -> Column:
    """Over-long URLs and URLs with one long stretch repeated; the Python check only sees long ones."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: repeats(x) if isinstance(x, str) else False).astype(bool)

    n = F.length(_c(u))
    return F.when(n > LONGEST, F.lit(True)).when(n <= LEAST_SEQUENCE * MOST_REPEATS, F.lit(False)).otherwise(run(F.when(n > LEAST_SEQUENCE * MOST_REPEATS, _c(u))))


_UNSAFE = re.compile(r"[^\x21-\x7e]|[\"<>\\^`{|}]")


def resolve(base: str | None, ref: str | None) -> str:
    """Absolute URL of a reference on a page; '' for fragments and what cannot be parsed."""
    if not ref or not base or ref.startswith("#"):
        return ""
    try:
        s = urlsplit(urljoin(base, ref.strip()))
        p = quote(s.path, safe="/%:@!$&'()*+,;=~-._[]") if _UNSAFE.search(s.path) else s.path
        q = quote(s.query, safe="/%:@!$&'()*+,;=~-._?[]") if _UNSAFE.search(s.query) else s.query
        return urlunsplit((s.scheme, s.netloc, p, q, ""))
    except ValueError:
        return ""


def abs_url(base: Column | str, ref: Column | str) -> Column:
    """``resolve`` over columns."""

    @F.pandas_udf("string")
    def run(b: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([resolve(x, y) for x, y in zip(b, r)], dtype=object)

    return run(_c(base), _c(ref))
