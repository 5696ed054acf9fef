"""User-defined columns: all matches of patterns over the body, the headers or both."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions import text as tx
from gossamer.functions.url import FIELDS


@dataclass(frozen=True)
class CustomField:
    name: str
    regex: tuple[str, ...]
    part: str = "response"  # body, header or response
    group: int = 0


DEFAULT = (CustomField("email", (tx.EMAIL,)),)


def validate(fields: tuple[CustomField, ...]) -> tuple[CustomField, ...]:
    """Names are words of letters, digits, _ and -, unique and not built in; patterns and parts are known."""
    seen: set[str] = set()
    for f in fields:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", f.name):
            raise ValueError(f"bad field name {f.name!r}")
        if f.name in FIELDS or f.name in seen:
            raise ValueError(f"field name {f.name!r} is taken")
        if f.part not in ("body", "header", "response"):
            raise ValueError(f"unknown part {f.part!r}")
        for p in f.regex:
            tx.check_pattern(p)
        seen.add(f.name)
    return fields


def load(path: str) -> tuple[CustomField, ...]:
    """Fields of a YAML file, read on the driver."""
    import yaml

    with open(path) as f:
        rows = yaml.safe_load(f) or []
    return validate(tuple(CustomField(r["name"], tuple(r.get("regex") or ()), r.get("part") or "response", int(r.get("group") or 0)) for r in rows))


def evaluate(pages: DataFrame, fields: tuple[CustomField, ...] = DEFAULT, key: str = "url") -> DataFrame:
    """(key, custom_fields): a map from field to all its matches, not deduplicated; fields without a match are absent.

    Null bodies and headers count as empty.
    """
    fields = validate(tuple(fields))
    columns = pages.columns
    head = tx.header_text(tx.lower_keys(F.col("headers"))) if "headers" in columns else F.lit("")
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col("body"), F.lit("")).alias("body"), F.coalesce(head, F.lit("")).alias("head"))
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, head = b.column(1).to_pylist(), b.column(2).to_pylist()
            maps: list[dict] = [{} for _ in body]
            for f in fields:
                texts = body if f.part == "body" else head if f.part == "header" else [f"{h}\n{x}" if h else x for h, x in zip(head, body)]
                for p in f.regex:
                    for m, found in zip(maps, tx.find_all(texts, p, f.group)):
                        if found:
                            m.setdefault(f.name, []).extend(found)
            out = pa.array([list(m.items()) for m in maps], pa.map_(pa.string(), pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["key", "custom_fields"])

    return rows.mapInArrow(run, f"key {kind}, custom_fields map<string,array<string>>").withColumnRenamed("key", key)
