"""Forms of a page: their shape, and requests with suggested values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields, replace
from urllib.parse import quote_plus, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.html import tokens
from gossamer.functions.url import resolve

URLENCODED = "application/x-www-form-urlencoded"


@dataclass(frozen=True)
class FormFill:
    """Values put into forms; set your own."""

    email: str = "visitor@example.org"
    color: str = "#2f6f4f"
    password: str = "Thread-and-needle-7"
    phone: str = "+10005550123"
    placeholder: str = "gossamer"


def load_fill(path: str, base: FormFill = FormFill()) -> FormFill:
    """Values of a YAML file over the given ones; an unknown name, or a value that is no text or number, is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f) or {}
    if not isinstance(given, dict) or (unknown := set(given) - {x.name for x in fields(FormFill)}):
        raise ValueError(f"unknown form values {sorted(unknown) if isinstance(given, dict) else given!r}")
    if bad := [k for k, v in given.items() if not isinstance(v, (str, int, float))]:
        raise ValueError(f"form values {bad} are no text")
    return replace(base, **{k: str(v) for k, v in given.items()})


def save_fill(path: str, fill: FormFill = FormFill()) -> None:
    """Writes the values as a YAML file to start from."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(asdict(fill), f)


@dataclass
class Form:
    attributes: dict
    fields: list = field(default_factory=list)  # (kind, attributes, options)


def parse(html: str) -> list[Form]:
    """Forms in page order with their input, textarea and select elements."""
    out, current, select = [], None, None
    for t in tokens(html):
        if t[0] == "start":
            name, a = t[1], t[2]
            if name == "form" and current is None:
                current = Form(a)
                out.append(current)
            elif current is not None and name in ("input", "textarea", "select"):
                select = (name, a, [])
                current.fields.append(select)
            elif name == "option" and select is not None and select[0] == "select":
                select[2].append(a)
        elif t[0] == "end":
            if t[1] == "form":
                current = select = None
            elif t[1] == "select":
                select = None
    return out


def action_url(action: str, page: str) -> str:
    """Absolute, scheme-relative and backslash actions stay; '/x' hangs on the root; 'x' on the page's path."""
    try:
        if urlsplit(action).scheme or action.startswith(("//", "\\")):
            return action
        base = urlsplit(page)
    except ValueError:
        return page
    if action.startswith("/"):
        return urljoin(f"{base.scheme}://{base.netloc}", action)
    path = base.path.rstrip("/") + "/" + action if action else base.path
    return urlunsplit((base.scheme, base.netloc, path, base.query, ""))


def shape(form: Form, page: str) -> dict:
    """method (upper case, GET if none), action, enctype (by default set for other methods), names of the fields."""
    a = form.attributes
    method = a.get("method") or "GET"
    enctype = a.get("enctype") or ("" if method == "GET" else URLENCODED)
    return {"method": method.upper(), "action": action_url(a.get("action", ""), page), "enctype": enctype, "parameters": [f[1]["name"] for f in form.fields if "name" in f[1]]}


def _number(s: str | None, default: float) -> float:
    try:
        return float(s) if s else default
    except ValueError:
        return default


def suggestion(kind: str, a: dict, options: list[dict], fill: FormFill) -> str:
    """The value an element gets; the type is compared as written."""
    if kind == "select":
        chosen = next((o for o in options if "selected" in o), options[0] if options else {})
        return chosen.get("value", "")
    if kind == "textarea":
        return fill.placeholder
    t = a.get("type", "")
    if t in ("radio", "checkbox") or a.get("value"):
        return a.get("value", "")
    if a.get("placeholder"):
        return a["placeholder"]
    if t in ("number", "range"):
        low, high, step = _number(a.get("min"), 1), _number(a.get("max"), 10), _number(a.get("step"), 1)
        v = low + step
        v = high - step if v > high else v
        return str(int(v)) if v == int(v) else str(v)
    return {"email": fill.email, "color": fill.color, "password": fill.password, "tel": fill.password}.get(t, fill.placeholder)


def suggestions(form: Form, fill: FormFill = FormFill()) -> dict[str, str]:
    """Name to value in the order inputs, selects, textareas first appear; a later element of the same name wins."""
    out: dict[str, str] = {}
    for kind, a, options in form.fields:
        name = a.get("name") or a.get("id") or ""
        if name:
            out[name] = suggestion(kind, a, options, fill)
    return out


def encoded(values: dict[str, str]) -> str:
    return "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in values.items())


def filled_forms(html: str, page: str, fill: FormFill | None = None) -> list[tuple]:
    """(ref, tag, attribute, method, body) of each form sent with suggested values."""
    fill, out = fill or FormFill(), []
    for f in parse(html):
        target = resolve(page, f.attributes.get("action") or page)
        method = (f.attributes.get("method") or "GET").upper()
        if not target:
            continue
        values = suggestions(f, fill)
        body = None
        if method == "GET" and values:
            target += ("&" if "?" in target else "?") + encoded(values)
        elif method == "POST":
            multipart = (f.attributes.get("enctype") or "").startswith("multipart/")
            body = "".join(f'--form\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n' for k, v in values.items()) + "--form--\r\n" if multipart else encoded(values)
        out.append((target, "form", "action", method, body))
    return out


FORM = "array<struct<method:string,action:string,enctype:string,parameters:array<string>>>"
_ARROW = pa.list_(pa.struct([("method", pa.string()), ("action", pa.string()), ("enctype", pa.string()), ("parameters", pa.list_(pa.string()))]))


def page_forms(pages: DataFrame) -> DataFrame:
    """(url, forms) of (url, body) pages; an empty list for pages without forms and null bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(0).to_pylist()
            forms = [[shape(f, u or "") for f in parse(x)] if x else [] for u, x in zip(urls, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(forms, _ARROW)], ["url", "forms"])

    return pages.select("url", "body").mapInArrow(run, f"url string, forms {FORM}")
