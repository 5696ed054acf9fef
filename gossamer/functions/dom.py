"""Rendered documents given as JSON trees, flattened to markup the extractors can read.

A node is {"name", "attributes": [k, v, ...], "children", "shadowRoots", "template",
"document" (of a frame), "pseudo"}; the markup holds every element with its attributes, wherever
in those parts it stands.
"""

from __future__ import annotations

import json
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("template", "document")
LISTS = ("children", "shadowRoots", "pseudo")


def flatten(tree: dict) -> str:
    """Markup of all elements, depth first; text nodes and broken entries are left out."""
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if not isinstance(n, dict):
            continue
        name = str(n.get("name") or "").lower()
        if name and not name.startswith("#"):
            a = n.get("attributes") or []
            out.append("<" + name + "".join(f' {k}="{escape(str(v))}"' for k, v in zip(a[::2], a[1::2])) + ">")
            todo.append(f"</{name}>")
        below = [n[p] for p in PARTS if n.get(p)] + [c for p in LISTS for c in n.get(p) or ()]
        todo += reversed(below)
    return "".join(out)


def dom_html(tree: Column) -> Column:
    """Markup of a column of JSON trees; '' for null and what is no JSON."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str:
            try:
                return flatten(json.loads(x)) if x else ""
            except ValueError:
                return ""

        return s.map(one)

    return run(tree)
