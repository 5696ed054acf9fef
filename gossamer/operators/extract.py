"""Links of a response: headers, markup, scripts; one pass over each page."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import text as tx
from gossamer.functions.html import VOID, tokens
from gossamer.functions.url import resolve

LINK = "struct<ref:string,tag:string,attribute:string,method:string,body:string>"

# tag -> attributes that hold a link; the label of the tag is its name
FLAT = {
    "a": ("href", "ping"), "link": ("href",), "body": ("background",), "audio": ("src",), "applet": ("archive", "codebase"), "video": ("src", "poster"), "button": ("formaction",),
    "blockquote": ("cite",), "frame": ("src",), "area": ("ping",), "base": ("href",), "import": ("implementation",), "embed": ("src",), "iframe": ("src",), "isindex": ("action",),
    "script": ("src",), "html": ("manifest",), "table": ("background",),
}
# (ancestor, tag) -> (attribute, label of tag, label of attribute)
NESTED = {
    ("audio", "source"): (("src", "audio", "source"),),
    ("object", "param"): (("value", "src", "param-value"),),
    ("svg", "image"): (("href", "svg", "image-href"), ("xlink:href", "svg", "image-href")),
    ("svg", "script"): (("href", "svg", "script-href"), ("xlink:href", "svg", "script-href")),
    ("table", "td"): (("background", "table", "td-background"),),
    ("video", "track"): (("src", "video", "track-src"),),
}
#: Ancestors that ``NESTED`` and the rules below ask for.
OVER = ("audio", "object", "svg", "table", "video")
#: Elements that a sibling of their kind closes.
IMPLIED = frozenset("li p td tr th option dt dd".split())
HTMX = ("hx-get", "hx-post", "hx-put", "hx-patch")


@dataclass(frozen=True)
class Flags:
    """Which optional extractors run."""

    scripts: bool = False  # endpoints in script text, script files and the whole body
    redirects: bool = True  # the Location header
    fill_forms: bool = False


class Later(str):
    """Text whose endpoints are still to be found; a batch's texts are searched by one call."""


def settled(pages: list[list[tuple]]) -> list[list[tuple]]:
    """The links of several pages, each text of endpoints replaced by its endpoints, in place."""
    texts = [x[0] for p in pages for x in p if isinstance(x[0], Later)]
    if not texts:
        return pages
    found = iter(tx.endpoints_of(texts))
    return [[y for x in p for y in ([(u, *x[1:]) for u in next(found)] if isinstance(x[0], Later) else (x,))] for p in pages]


def markup_links(html: str, flags: Flags = Flags(), extra: Callable | None = None) -> list[tuple]:
    """(ref, tag, attribute, method, body) of a page's markup, in page order.

    Empty attributes give nothing.  A data: image is passed over together with its
    srcset; base is a link but resolves nothing; htmx attributes give one link each.
    """
    return settled([_markup_links(html, flags, extra)])[0]


def _markup_links(html: str, flags: Flags, extra: Callable | None = None) -> list[tuple]:
    out: list[tuple] = []
    add = lambda ref, tag, attr, method="GET": out.append((ref, tag, attr, method, None)) if ref else None
    stack: list[str] = []  # of open elements, and how many of each there are
    open_: dict[str, int] = {}
    first = True
    for t in tokens(html):
        kind = t[0]
        if kind == "decl":
            words = t[1].split('"')
            if first and t[1].lower().startswith("doctype") and words[0].lower().split()[-1:] == ["system"] and len(words) > 1:
                add(words[1], "html", "doctype")
            first = False
        elif kind == "start":
            first = False
            name, a, closed = t[1], t[2], t[3]
            for attr in FLAT.get(name, ()):
                if name == "script" and open_.get("svg"):
                    continue
                add(a.get(attr), name, attr)
            if name == "img":
                for attr in ("dynsrc", "longdesc", "lowsrc"):
                    add(a.get(attr), "img", attr)
                src = a.get("src", "")
                if not src.startswith("data:"):
                    if src != "#":
                        add(src, "img", "src")
                    for u in tx.srcset(a.get("srcset", "")):
                        add(u, "img", "srcset")
            elif name == "object":
                add(a.get("data"), "src", "data")
                add(a.get("codebase"), "src", "codebase")
            elif name == "input" and a.get("type", "").lower() == "image":
                add(a.get("src"), "input-image", "src")
            elif name == "iframe" and a.get("srcdoc"):
                add(Later(a["srcdoc"]), "iframe", "srcdoc")
            elif name == "meta" and a.get("content"):
                add(Later(a["content"]), "meta", "refresh")
            elif name == "source" and open_.get("audio"):
                for u in tx.srcset(a.get("srcset", "")):
                    add(u, "audio", "sourcesrcset")
            for over in OVER:
                if open_.get(over):
                    for attr, tag, label in NESTED.get((over, name), ()):
                        add(a.get(attr), tag, label)
            if a.keys() & set(HTMX):
                for attr in HTMX:
                    add(a.get(attr), "htmx", attr, attr[3:].upper())
            if name not in VOID and not closed:
                if name in IMPLIED and stack and stack[-1] == name:
                    continue
                stack.append(name)
                open_[name] = open_.get(name, 0) + 1
        elif kind == "end":
            if open_.get(t[1]):
                while (gone := stack.pop()) != t[1]:
                    open_[gone] -= 1
                open_[gone] -= 1
        elif kind == "raw":
            if t[1] == "script" and flags.scripts and t[2].strip():
                add(Later(t[2]), "script", "text")
    if extra is not None:
        out += extra(html)
    return out


def header_links(headers: Column, redirects: bool = True) -> Column:
    """Links of the response headers; names in any case."""
    h = tx.lower_keys(headers)

    def link(ref: Column, attr: str) -> Column:
        return F.struct(ref.alias("ref"), F.lit("header").alias("tag"), F.lit(attr).alias("attribute"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"))

    none = F.array().cast(f"array<{LINK}>")
    one = lambda ref, attr: F.when(F.coalesce(ref, F.lit("")) != "", F.array(link(ref, attr))).otherwise(none)
    parts = [one(h["content-location"], "content-location"), F.coalesce(F.transform(tx.link_header(h["link"]), lambda x: link(x, "link")), none), one(tx.refresh_header(h["refresh"]), "refresh")]
    if redirects:
        parts.insert(2, one(h["location"], "location"))
    return F.coalesce(F.concat(*parts), none)


def _script_file(url: str | None, content_type: str | None) -> bool:
    path = (url or "").split("?", 1)[0].split("#", 1)[0]
    return path.endswith((".js", ".css")) or "/javascript" in (content_type or "")


def _page_links(flags: Flags, extra: Callable | None, fill: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gossamer.operators.forms import filled_forms

        for b in batches:
            pages: list[tuple[str, list[tuple]]] = []
            bodies: list[str] = []
            for url, kind, body in zip(*(c.to_pylist() for c in b.columns)):
                if not url or not body:
                    continue
                found = _markup_links(body, flags, extra)
                if flags.fill_forms:
                    found += filled_forms(body, url, fill)
                if flags.scripts:
                    if _script_file(url, kind):
                        found.append((Later(body), "js", "regex", "GET", None))
                    bodies.append(body)
                pages.append((url, found))
            links = settled([p for _, p in pages])
            if bodies:
                for p, more in zip(links, tx.distinct_each(tx.find_all(bodies, tx.BODY_ENDPOINT, 1))):
                    p += [(u, "html", "regex", "GET", None) for u in more]
            rows = [(url, resolve(url, ref), ref, tag, attr, method, text, k) for (url, _), p in zip(pages, links) for k, (ref, tag, attr, method, text) in enumerate(p)]
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string()] * 7 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["source", "url", "ref", "tag", "attribute", "method", "body", "position"])

    return run


def page_links(pages: DataFrame, flags: Flags = Flags(), extra: Callable | None = None, fill: object = None) -> DataFrame:
    """(source, url, ref, tag, attribute, method, body, position) of every link of (url, headers, body) pages.

    ``extra`` is an extractor of your own that is run with the built-in ones: markup -> [(ref, tag, attribute, method,
    body)]; ``fill`` holds the values put into forms (``forms.FormFill``).

    ``url`` is '' for references that give none (fragments, broken ones).  Null urls and
    empty bodies give no markup links; null headers no header links.
    """
    kind = tx.lower_keys(F.col("headers"))["content-type"]
    markup = pages.select("url", kind.alias("kind"), "body").mapInArrow(_page_links(flags, extra, fill), "source string, url string, ref string, tag string, attribute string, method string, body string, position int")
    h = pages.select(F.col("url").alias("source"), F.posexplode(header_links(F.col("headers"), flags.redirects)).alias("p", "l"))
    from gossamer.functions.url import abs_url

    heads = h.select("source", abs_url("source", F.col("l.ref")).alias("url"), F.col("l.ref").alias("ref"), "l.tag", "l.attribute", "l.method", "l.body", (F.col("p") - 1000).cast("int").alias("position"))
    return heads.unionByName(markup)


def user_links(pages: DataFrame, extractor: Callable[[str, str], list[tuple]]) -> DataFrame:
    """(source, url, ref, tag, attribute) of a user's extractor: (url, body) -> [(ref, tag, attribute)]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, resolve(u, r), r, t, a) for u, body in zip(*(c.to_pylist() for c in b.columns)) if u and body for r, t, a in extractor(u, body)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["source", "url", "ref", "tag", "attribute"])

    return pages.select("url", "body").mapInArrow(run, "source string, url string, ref string, tag string, attribute string")


def script_links(pages: DataFrame) -> DataFrame:
    """(source, url, ref, tag, attribute): endpoints of script files and script elements by the call they stand in.

    Files that name themselves as a published library are passed over (``text.is_common_library``).
    """
    from gossamer.functions.scripts import script_calls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, kind, library, body in zip(*(c.to_pylist() for c in b.columns)):
                if not url or not body:
                    continue
                if _script_file(url, kind):
                    found = [] if library else [("js", e, t) for e, t in script_calls(body)]
                else:
                    found = [("script", e, t) for x in tokens(body) if x[0] == "raw" and x[1] == "script" for e, t in script_calls(x[2])]
                rows += [(url, resolve(url, e), e, tag, "call-" + t) for tag, e, t in found]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["source", "url", "ref", "tag", "attribute"])

    kind = tx.lower_keys(F.col("headers"))["content-type"]
    return pages.select("url", kind.alias("kind"), tx.is_common_library(F.col("body")).alias("library"), "body").mapInArrow(run, "source string, url string, ref string, tag string, attribute string")


def rendered_links(pages: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """Links of (url, headers, body, shadow, dom): raw page, shadow tree and rendered tree (JSON), each link once."""
    from gossamer.functions.dom import dom_html

    three = pages.select("url", "headers", F.explode(F.array(F.col("body"), dom_html(F.col("shadow")), dom_html(F.col("dom")))).alias("body"))
    return page_links(three, flags).drop("position").distinct()
