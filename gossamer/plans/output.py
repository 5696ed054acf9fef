"""Result rows as lines, files and tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.functions import text as tx
from gossamer.functions import url as ur
from gossamer.operators import dsl, gates


def without(df: DataFrame, raw: bool = False, body: bool = False) -> DataFrame:
    """Raw texts or bodies blanked."""
    r = F.col("response")
    if raw:
        r = r.withField("raw", F.lit(None).cast("string"))
        df = df.withColumn("request", F.when(F.col("request").isNotNull(), F.col("request").withField("raw", F.lit(None).cast("string"))))
    if body:
        r = r.withField("body", F.lit(None).cast("string"))
    return df.withColumn("response", F.when(F.col("response").isNotNull(), r)) if raw or body else df


def exclude_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns and fields of request and response by their names; a struct left empty goes."""
    for part in ("request", "response"):
        if part in df.columns and isinstance(df.schema[part].dataType, T.StructType):
            inner = df.schema[part].dataType.fieldNames()
            gone = [n for n in inner if n in names]
            if len(gone) == len(inner):
                df = df.drop(part)
            elif gone:
                df = df.withColumn(part, F.when(F.col(part).isNotNull(), F.col(part).dropFields(*gone)))
    return df.drop(*[n for n in names if n in df.columns])


def json_lines(df: DataFrame) -> DataFrame:
    """(value): a JSON object per row without its null fields; header names in lower case."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def screen_lines(df: DataFrame, verbose: bool = False) -> DataFrame:
    """(value): the endpoint; verbose adds [tag], [method] and [body] where they are there."""
    q = F.col("request")
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("["), c, F.lit("] "))).otherwise("")
    tail = F.when(F.coalesce(q["body"], F.lit("")) != "", F.concat(F.lit(" ["), q["body"], F.lit("]"))).otherwise("")
    value = F.concat(part(q["tag"]), part(q["method"]), q["endpoint"], tail) if verbose else q["endpoint"]
    return df.select(value.alias("value")).filter("value is not null and value <> ''")


def _named(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))


def field_lines(df: DataFrame, names: str, custom: list[str] | None = None) -> DataFrame:
    """(field, value): one row per field value of each row; rows without a value give none."""
    u, own = F.col("request.endpoint"), F.col("request.custom_fields")
    parts = [_named(n, ur.field(n, u, own)) for n in ur.validate_fields(names, custom)]
    return df.select(F.explode(F.concat(*parts)).alias("x")).select("x.field", "x.value").filter("value is not null")


def template_lines(df: DataFrame, template: str) -> DataFrame:
    """(value): the template with {{field}} filled in; the last value of a field counts, a missing one drops the row."""
    u, own = F.col("request.endpoint"), F.col("request.custom_fields")
    cols: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\s*([\w\-]+)\s*\}\}", template):
        cols.append(F.lit(template[at : m.start()]))
        v = ur.field(m[1], u, own)
        cols.append(F.when(F.size(v) > 0, F.element_at(v, -1)))
        at = m.end()
    cols.append(F.lit(template[at:]))
    return df.select(F.concat(*cols).alias("value")).filter("value is not null")


def stored_fields(df: DataFrame, names: str, custom: list[str] | None = None) -> DataFrame:
    """(scheme, host, field, value): distinct values per site, for ``write_partitioned``; taken before any filter."""
    u, own = F.col("request.endpoint"), F.col("request.custom_fields")
    parts = [_named(n, ur.field(n, u, own)) for n in ur.validate_fields(names, custom)]
    rows = df.filter(ur.is_url(u)).select(ur.scheme(u).alias("scheme"), ur.hostname(u).alias("host"), F.explode(F.concat(*parts)).alias("x"))
    return rows.select("scheme", "host", "x.field", "x.value").distinct()


def stored_responses(df: DataFrame) -> DataFrame:
    """(path, content) of each row with a response: url, raw request and raw response; of several contents of a url the smallest."""
    u = F.col("request.endpoint")
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(u, F.lit("\n\n\n"), blank(F.col("request.raw")), F.lit("\n\n"), blank(F.coalesce("response.raw", "response.body")))
    return df.filter("response is not null and request.endpoint is not null").select(ur.store_path(u).alias("path"), text.alias("content")).groupBy("path").agg(F.min("content").alias("content"))


def response_index(df: DataFrame) -> DataFrame:
    """(value): 'path url (status)' per stored response."""
    u = F.col("request.endpoint")
    line = F.concat(ur.store_path(u), F.lit(" "), u, F.lit(" ("), F.coalesce(F.col("response.status_code").cast("string"), F.lit("")), F.lit(")"))
    return df.filter("response is not null and request.endpoint is not null").select(line.alias("value")).distinct()


def errors(df: DataFrame) -> DataFrame:
    """(timestamp, endpoint, source, error) of the rows that failed."""
    return df.filter("error is not null and error <> ''").select("timestamp", "request.endpoint", "request.source", "error")


def write_lines(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """One line per row, in as many files as there are partitions; without ``overwrite`` an existing path is an error."""
    df.select("value").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], overwrite: bool = True) -> None:
    df.repartition(*by).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def free_path(path: str, taken: list[str]) -> str:
    """The path, or the path with the next numeric suffix that is free."""
    if path not in taken:
        return path
    k = 1
    while f"{path}{k}" in taken:
        k += 1
    return f"{path}{k}"


def list_fields(df: DataFrame) -> list[str]:
    """Names a result can be projected to or pruned of."""
    out = list(df.columns)
    for part in ("request", "response"):
        if part in df.columns and isinstance(df.schema[part].dataType, T.StructType):
            out += df.schema[part].dataType.fieldNames()
    return sorted(dict.fromkeys(out))


def recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(expected, matched, percent): how many expected paths are among the found ones; percent is cut to a whole number."""
    j = expected.select("path").distinct().join(found.select("path").distinct().withColumn("hit", F.lit(1)), "path", "left")
    g = j.agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("matched"))
    return g.withColumn("percent", F.when(F.col("expected") > 0, F.floor(F.col("matched") * 100 / F.col("expected"))).otherwise(0).cast("bigint"))


@dataclass(frozen=True)
class OutputConfig:
    """What is written; checked on construction."""

    format: str = "json"  # json, screen, verbose, fields or template
    fields: str = ""
    template: str = ""
    store_fields: str = ""
    custom: tuple[str, ...] = ()
    store_responses: bool = False
    omit_raw: bool = False
    omit_body: bool = False
    exclude: tuple[str, ...] = ()
    extension_match: tuple[str, ...] = ()
    extension_deny: tuple[str, ...] = ()
    extension_defaults: bool = False
    match: tuple[str, ...] = ()
    match_dsl: str | None = None
    drop: tuple[str, ...] = ()
    drop_dsl: str | None = None

    def __post_init__(self) -> None:
        if self.format not in ("json", "screen", "verbose", "fields", "template"):
            raise ValueError(f"unknown format {self.format!r}")
        if self.format == "fields" and not self.fields or self.format == "template" and not self.template:
            raise ValueError(f"the format {self.format!r} needs its {self.format}")
        for names in (self.fields, self.store_fields):
            if names:
                ur.validate_fields(names, list(self.custom))
        for name in re.findall(r"\{\{\s*([\w\-]+)\s*\}\}", self.template):
            ur.validate_fields(name, list(self.custom))
        for p in (*self.match, *self.drop):
            tx.check_pattern(p)


@dataclass(frozen=True)
class Output:
    """results: the rows that pass; lines (value): their lines; fields, responses, index, errors: the other files, None where not asked for."""

    results: DataFrame
    lines: DataFrame
    fields: DataFrame | None
    responses: DataFrame | None
    index: DataFrame | None
    errors: DataFrame


def pipeline(df: DataFrame, config: OutputConfig = OutputConfig()) -> Output:
    """Result rows through all steps of writing, in their order.

    Field values are stored first, of all rows; then extensions, match and filter decide; of the rows left, responses are stored,
    raw texts and bodies omitted and lines made.  Rows whose line is empty give none.  Failed rows are listed whatever decides.
    """
    u = F.col("request.endpoint")
    stored = stored_fields(df, config.store_fields, list(config.custom)) if config.store_fields else None
    rows = df.filter(gates.extension_allowed(u, config.extension_match, config.extension_deny, config.extension_defaults))
    rows = dsl.chosen(rows, list(config.match), config.match_dsl, list(config.drop), config.drop_dsl)
    responses, index = (stored_responses(rows), response_index(rows)) if config.store_responses else (None, None)
    out = without(rows, config.omit_raw, config.omit_body)
    make = {
        "json": lambda d: json_lines(exclude_fields(d, list(config.exclude))), "screen": screen_lines, "verbose": lambda d: screen_lines(d, True),
        "fields": lambda d: field_lines(d, config.fields, list(config.custom)).select("value"), "template": lambda d: template_lines(d, config.template),
    }
    return Output(out, make[config.format](out).filter("value <> ''"), stored, responses, index, errors(df))


def write(out: Output, folder: str, overwrite: bool = False) -> str:
    """Writes all parts below a folder and returns it; without ``overwrite`` a folder that is taken gets the next free number."""
    spark = out.lines.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not overwrite:
        parent = path.getParent()
        taken = [f"{folder.rsplit('/', 1)[0]}/{x.getPath().getName()}" for x in fs.listStatus(parent)] if parent and fs.exists(parent) else []
        folder = free_path(folder, taken)
    write_lines(out.lines, f"{folder}/lines", overwrite)
    out.errors.write.mode("overwrite" if overwrite else "errorifexists").json(f"{folder}/errors")
    if out.fields is not None:
        write_partitioned(out.fields, f"{folder}/fields", ["scheme", "host", "field"], overwrite)
    if out.responses is not None:
        out.responses.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/responses")
        write_lines(out.index, f"{folder}/index", overwrite)
    return folder
