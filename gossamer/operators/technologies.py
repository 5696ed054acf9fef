"""Technologies of a response, from a table of rules over headers and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import text as tx

#: name, part (a header's name or body), pattern
RULES = (
    ("nginx", "server", r"(?i)\bnginx"),
    ("Apache", "server", r"(?i)\bapache"),
    ("PHP", "x-powered-by", r"(?i)\bphp"),
    ("Express", "x-powered-by", r"(?i)\bexpress"),
    ("WordPress", "body", r"(?i)/wp-(?:content|includes)/"),
    ("jQuery", "body", r"(?i)<script[^>]+jquery[.\-\w]*\.js"),
)


def technologies(headers: Column, body: Column, rules: tuple = RULES) -> Column:
    """Sorted distinct names of the rules that hold."""
    h = tx.lower_keys(headers)
    hits = [F.when(F.coalesce((body if part == "body" else h[part]).rlike(pattern), F.lit(False)), F.lit(name)) for name, part, pattern in rules]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def detect(pages: DataFrame, key: str, rules: tuple = RULES) -> DataFrame:
    """(key, technology), one row each."""
    return pages.select(key, F.explode(technologies(F.col("headers"), F.col("body"), rules)).alias("technology")).distinct()
