"""Registrable domains by the public-suffix list beside this file, the one of httpclient 4.5.14 (Mozilla Public License 2.0)."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIST = Path(__file__).with_name("public_suffix_list.txt")


@lru_cache(1)
def load_rules() -> frozenset[str]:
    """All rules of the list, read once on the driver; a missing list is an error, as every registrable domain would change."""
    lines = LIST.read_text("utf-8").splitlines()
    return frozenset(x.strip().split()[0] for x in lines if x.strip() and not x.startswith("//"))


def registrable(host: str | None, rules: frozenset[str]) -> str:
    """The public suffix and one label more; '' where the host has no such part."""
    labels = (host or "").lower().strip(".").split(".")
    if len(labels) < 2 or "" in labels or all(x.isdigit() for x in labels):
        return ""
    size = 1
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        if "!" + tail in rules:
            size = len(labels) - i - 1
            break
        if tail in rules or i + 1 < len(labels) and "*." + ".".join(labels[i + 1 :]) in rules:
            size = len(labels) - i
            break
    return ".".join(labels[-size - 1 :]) if len(labels) > size else ""


def rdn(host: Column) -> Column:
    """Registrable domain of a host column; the rules (about ten thousand short strings) travel with the function."""
    rules = load_rules()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {h: registrable(h, rules) for h in s.dropna().unique()}
        return s.map(known).fillna("")

    return run(host)


def dn(host: Column) -> Column:
    """The label of the registrable domain: its first part."""
    return F.substring_index(rdn(host), ".", 1)
