"""Conditions over result rows, as Catalyst expressions.

``status_code == 200 && contains(to_lower(body), 'ok')``: comparisons, &&, ||, !,
parentheses, strings, numbers, and a few string functions over the flattened view of a row.  An
unknown function or a broken condition is an error; an unknown name is null, and null is false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.functions import text as tx

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|&&|\|\||=~|[<>!(),+\-]))")


def _text(c: Column) -> Column:
    return c.cast("string")


def _regex(pattern: Column, text: Column) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


FUNCTIONS = {
    "contains": (2, lambda a, b: F.contains(_text(a), _text(b))),
    "icontains": (2, lambda a, b: F.contains(F.lower(_text(a)), F.lower(_text(b)))),
    "starts_with": (2, lambda a, b: F.startswith(_text(a), _text(b))),
    "ends_with": (2, lambda a, b: F.endswith(_text(a), _text(b))),
    "to_lower": (1, lambda a: F.lower(_text(a))),
    "tolower": (1, lambda a: F.lower(_text(a))),
    "to_upper": (1, lambda a: F.upper(_text(a))),
    "toupper": (1, lambda a: F.upper(_text(a))),
    "trim_space": (1, lambda a: F.trim(_text(a))),
    "len": (1, lambda a: F.length(_text(a))),
    "md5": (1, lambda a: F.md5(F.encode(_text(a), "utf-8"))),
    "sha1": (1, lambda a: F.sha1(F.encode(_text(a), "utf-8"))),
    "sha256": (1, lambda a: F.sha2(F.encode(_text(a), "utf-8"), 256)),
    "concat": (2, lambda a, b: F.concat(_text(a), _text(b))),
    "replace": (3, lambda a, b, c: F.replace(_text(a), _text(b), _text(c))),
}


class _Parser:
    def __init__(self, text: str, names: dict[str, Column]):
        self.names, self.tokens, at = names, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the condition at {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            return self.tokens[self.at][1]
        return None

    def take(self, *ops: str) -> str | None:
        op = self.peek(*ops)
        self.at += op is not None
        return op

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ValueError(f"expected {op!r} in the condition")

    def either(self) -> Column:
        left = self.both()
        while self.take("||"):
            left = F.coalesce(left, F.lit(False)) | F.coalesce(self.both(), F.lit(False))
        return left

    def both(self) -> Column:
        left = self.compare()
        while self.take("&&"):
            left = F.coalesce(left, F.lit(False)) & F.coalesce(self.compare(), F.lit(False))
        return left

    def compare(self) -> Column:
        left = self.single()
        op = self.take("==", "!=", "<=", ">=", "<", ">", "=~")
        if op is None:
            return left
        right = self.single()
        return {"==": lambda: left == right, "!=": lambda: left != right, "<=": lambda: left <= right, ">=": lambda: left >= right, "<": lambda: left < right, ">": lambda: left > right, "=~": lambda: _regex(right, left)}[op]()

    def single(self) -> Column:
        if self.take("!"):
            return ~F.coalesce(self.single(), F.lit(False))
        if self.take("-"):
            return -self.single()
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        if self.at >= len(self.tokens):
            raise ValueError("the condition ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return F.lit(float(value) if "." in value else int(value))
        if kind == "str":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "op":
            raise ValueError(f"{value!r} is out of place in the condition")
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.either())
                if not self.peek(")"):
                    self.need(",")
            if value not in FUNCTIONS:
                raise ValueError(f"unknown function {value!r}")
            n, make = FUNCTIONS[value]
            if len(args) != n:
                raise ValueError(f"{value} takes {n} arguments")
            return make(*args)
        if value in ("true", "false"):
            return F.lit(value == "true")
        return self.names.get(value, F.lit(None).cast("string"))


def view(df: DataFrame) -> dict[str, Column]:
    """Names a condition can use: the row's columns, those of request, and over them those of response.

    Lists are joined with commas; ``url`` is the endpoint.  A name that none of them has is a header: those of the response,
    then those of the request, in any case and with ``_`` for ``-`` (see ``header``).
    """
    names: dict[str, Column] = {}

    def put(prefix: str, fields: list) -> None:
        for f in fields:
            c = F.col(prefix + f.name)
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
                c = F.array_join(c, ",")
            elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
                continue
            names[f.name.lower()] = c

    schema = df.schema
    put("", schema.fields)
    for part in ("request", "response"):
        if part in schema.fieldNames() and isinstance(schema[part].dataType, T.StructType):
            put(part + ".", schema[part].dataType.fields)
    if "endpoint" in names:
        names.setdefault("url", names["endpoint"])
    return names


def header(df: DataFrame, name: str) -> Column | None:
    """The header of that snake_case name: the response's, else the request's, else that of the row's own ``headers``; None where rows have no headers."""
    maps = [F.col(f"{p}.headers") for p in ("response", "request") if p in df.columns and isinstance(df.schema[p].dataType, T.StructType) and "headers" in df.schema[p].dataType.names]
    maps += [F.col("headers")] if "headers" in df.columns and isinstance(df.schema["headers"].dataType, T.MapType) else []
    named = lambda m: F.filter(F.map_entries(m), lambda e: F.replace(F.lower(e["key"]), F.lit("-"), F.lit("_")) == name.lower())
    return F.coalesce(*(F.when(F.size(named(m)) > 0, F.element_at(named(m), -1)["value"]) for m in maps)) if maps else None


class _Names(dict):
    """The names of a view; any other one is a header."""

    def __init__(self, df: DataFrame):
        super().__init__(view(df))
        self.df = df

    def get(self, name: str, default: Column | None = None) -> Column | None:
        if name in self:
            return self[name]
        h = header(self.df, name)
        return default if h is None else h


def condition(df: DataFrame, text: str) -> Column:
    """The condition as a Column over ``df``; null counts as false."""
    p = _Parser(text, _Names(df))
    out = p.either()
    if p.at != len(p.tokens):
        raise ValueError("the condition goes on after its end")
    return F.coalesce(out.cast("boolean"), F.lit(False))


def chosen(df: DataFrame, match: list[str] = [], match_dsl: str | None = None, drop: list[str] = [], drop_dsl: str | None = None, subject: Column | None = None) -> DataFrame:  # noqa: B006
    """Rows that any match pattern or the match condition takes (all rows when neither is set), less what the drop rules take."""
    subject = subject if subject is not None else F.col("request.endpoint")
    if match or match_dsl:
        keep = F.lit(False)
        if match:
            keep = keep | tx.search(subject, "|".join(f"(?:{p})" for p in match))
        if match_dsl:
            keep = keep | condition(df, match_dsl)
        df = df.filter(F.coalesce(keep, F.lit(False)))
    if drop or drop_dsl:
        out = F.lit(False)
        if drop:
            out = out | tx.search(subject, "|".join(f"(?:{p})" for p in drop))
        if drop_dsl:
            out = out | condition(df, drop_dsl)
        df = df.filter(~F.coalesce(out, F.lit(False)))
    return df
