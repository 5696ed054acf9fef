"""Nested records to related flat tables, by way of one adjacency table.

Every value below a record becomes a node (node, parent, label, ordinal,
scalar): the node id is its path, objects and arrays have no scalar, ordinals
count from 1 in the original array, null elements are counted but get no node,
map entries are objects with a key and a value.  An entity table is the join of
its object nodes with their scalar children, pivoted by label.

Defined results: null and empty collections have no nodes; empty strings are
values; a null scalar has no node, so its column is null; a record delivered
twice is one record; columns of the input that are not asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.plans.staging import stage

NODE = "struct<node:string,parent:string,label:string,ordinal:int,kind:string,scalar:string>"


def _node(path: Column, parent: Column, label: str, ordinal: Column, kind: str, scalar: Column) -> Column:
    return F.struct(path.alias("node"), parent.alias("parent"), F.lit(label).alias("label"), ordinal.cast("int").alias("ordinal"), F.lit(kind).alias("kind"), scalar.cast("string").alias("scalar"))


def _walk(value: Column, kind: T.DataType, path: Column, parent: Column, label: str, ordinal: Column, skip: frozenset[str]) -> Column:
    """ARRAY of the nodes at and below ``value``; no nodes for null."""
    none = F.array().cast(f"array<{NODE}>")
    here = lambda k: F.array(_node(path, parent, label, ordinal, k, F.lit(None)))
    below = lambda name: F.concat(path, F.lit("/" + name))
    if isinstance(kind, T.StructType):
        parts = [_walk(value[f.name], f.dataType, below(f.name), path, f.name, F.lit(0), skip) for f in kind.fields if f.name not in skip]
        return F.when(value.isNotNull(), F.concat(here("object"), *parts)).otherwise(none)
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: _walk(x, kind.elementType, F.concat(path, F.lit("/"), (i + 1).cast("string")), path, label + "[]", i + 1, skip))
        return F.when(value.isNotNull(), F.concat(here("array"), F.flatten(each))).otherwise(none)
    if isinstance(kind, T.MapType):
        def entry(e: Column) -> Column:
            at = F.concat(path, F.lit("/"), F.hex(F.encode(e["key"].cast("string"), "utf-8")))
            key = F.array(_node(at, path, label + "{}", F.lit(0), "object", F.lit(None)), _node(F.concat(at, F.lit("/key")), at, "key", F.lit(0), "scalar", e["key"]))
            return F.concat(key, _walk(e["value"], kind.valueType, F.concat(at, F.lit("/value")), at, "value", F.lit(0), skip))

        return F.when(value.isNotNull(), F.concat(here("map"), F.flatten(F.transform(F.map_entries(value), entry)))).otherwise(none)
    return F.when(value.isNotNull(), F.array(_node(path, parent, label, ordinal, "scalar", value))).otherwise(none)


def adjacency(df: DataFrame, key: str, roots: list[str], skip: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """(key, node, parent, label, ordinal, kind, scalar) of everything below the root columns.

    Rows whose key is null are left out.  ``skip`` names fields that are not wanted,
    such as page bodies; they are not read from the file.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    walks = [_walk(F.col(r), fields[r], F.lit(r), F.lit(""), r, F.lit(0), frozenset(skip)) for r in roots]
    once = df.filter(F.col(key).isNotNull()).select(key, *roots).dropDuplicates([key])
    return once.select(key, F.inline(F.concat(*walks)))


def staged_nodes(df: DataFrame, key: str, roots: list[str]) -> DataFrame:
    """The adjacency table, walked once: objects and scalars are read from it, not from the records again."""
    return stage(adjacency(df, key, roots), "nodes")


def entity(nodes: DataFrame, key: str, label: str, columns: list[str], parent_label: str | None = None) -> DataFrame:
    """(key, node, parent, pos, columns...): objects of a label joined with their scalar children, pivoted.

    Objects without scalar children stay, with null columns.
    """
    objects = nodes.filter((F.col("label") == label) & (F.col("kind") == "object"))
    objects = objects.select(key, "node", F.col("parent").alias("parent_node"), F.col("ordinal").alias("pos"))
    kids = nodes.filter((F.col("kind") == "scalar") & F.col("label").isin(columns)).select(key, F.col("parent").alias("node"), "label", "scalar")
    joined = objects.join(kids, [key, "node"], "left")
    return joined.groupBy(key, "node", "parent_node", "pos").pivot("label", columns).agg(F.first("scalar", ignorenulls=True))


def _part(node: Column, i: int) -> Column:
    return F.split(node, "/")[i]


def children(results: DataFrame) -> DataFrame:
    """(result_id, entity, parent_pos, pos, name): one row per child record of a result.

    Entities and positions: technology, form, xhr_request (pos in the array); form_parameter
    (position of its form, pos); xhr_header (position of its request, 0, key);
    request_custom_field and xhr_custom_field (position of the request or 0, pos in the values, key).
    """
    return _child_rows(staged_nodes(_collections(results), "result_id", ["request", "response"]))


def _collections(results: DataFrame) -> DataFrame:
    """Only the nested collections, so neither pages nor scalars are read."""
    xhr = F.transform("response.xhr_requests", lambda x: F.when(x.isNotNull(), F.struct(x["headers"].alias("headers"), x["custom_fields"].alias("custom_fields"))))
    return results.select(
        "result_id",
        F.struct(F.col("request.custom_fields").alias("custom_fields")).alias("request"),
        F.struct(F.col("response.technologies").alias("technologies"), F.transform("response.forms", lambda f: F.when(f.isNotNull(), F.struct(f["parameters"].alias("parameters")))).alias("forms"), xhr.alias("xhr_requests")).alias("response"),
    )


def _child_rows(nodes: DataFrame) -> DataFrame:
    label, kind, node = F.col("label"), F.col("kind"), F.col("node")
    labels = ["forms[]", "xhr_requests[]", "headers{}", "custom_fields{}"]
    # object nodes joined with their scalar children, pivoted: the key of map entries, nothing for forms and requests
    objects = nodes.filter(label.isin(labels) & (kind == "object")).select("result_id", "node", "label", F.col("ordinal").alias("pos"))
    keys = nodes.filter((label == "key") & (kind == "scalar")).select("result_id", F.col("parent").alias("node"), F.col("label").alias("child"), "scalar")
    wide = objects.join(keys, ["result_id", "node"], "left").groupBy("result_id", "node", "label", "pos").pivot("child", ["key"]).agg(F.first("scalar", ignorenulls=True))
    in_xhr = node.startswith("response/xhr_requests/")
    at = F.when(in_xhr, _part(node, 2).cast("int")).otherwise(0)
    of_objects = wide.filter((label != "custom_fields{}") & ((label != "headers{}") | in_xhr)).select(
        "result_id",
        F.when(label == "forms[]", "form").when(label == "xhr_requests[]", "xhr_request").otherwise("xhr_header").alias("entity"),
        F.when(label == "headers{}", at).otherwise(0).alias("parent_pos"),
        F.when(label == "headers{}", 0).otherwise(F.col("pos")).alias("pos"),
        F.coalesce("key", F.lit("")).alias("name"),
    )
    values = nodes.filter((label == "value[]") & (kind == "scalar")).select("result_id", F.regexp_replace("parent", "/value$", "").alias("node"), F.col("ordinal").alias("vpos"))
    of_values = values.join(wide.filter("label = 'custom_fields{}'").select("result_id", "node", "key"), ["result_id", "node"]).select("result_id", F.when(in_xhr, "xhr_custom_field").otherwise("request_custom_field").alias("entity"), at.alias("parent_pos"), F.col("vpos").alias("pos"), F.col("key").alias("name"))
    of_scalars = nodes.filter(label.isin("technologies[]", "parameters[]") & (kind == "scalar")).select("result_id", F.when(label == "technologies[]", "technology").otherwise("form_parameter").alias("entity"), F.when(label == "parameters[]", _part(node, 2).cast("int")).otherwise(0).alias("parent_pos"), F.col("ordinal").alias("pos"), F.lit("").alias("name"))
    return of_objects.unionByName(of_values).unionByName(of_scalars)


REQUEST_COLUMNS = ["method", "endpoint", "body", "tag", "attribute", "source", "raw"]


def requests(results: DataFrame) -> DataFrame:
    """(result_id, method, endpoint, body, tag, attribute, source, raw): the request entity."""
    nodes = staged_nodes(results.select("result_id", F.when(F.col("request").isNotNull(), F.struct(*[F.col(f"request.{c}").alias(c) for c in REQUEST_COLUMNS])).alias("request")), "result_id", ["request"])
    return entity(nodes, "result_id", "request", REQUEST_COLUMNS).select("result_id", *REQUEST_COLUMNS)


def forms(results: DataFrame) -> DataFrame:
    """(result_id, pos, method, action, enctype): the form entity, keyed to its record and place."""
    r = results.select("result_id", F.struct(F.transform("response.forms", lambda f: F.when(f.isNotNull(), F.struct(f["method"].alias("method"), f["action"].alias("action"), f["enctype"].alias("enctype")))).alias("forms")).alias("response"))
    return entity(staged_nodes(r, "result_id", ["response"]), "result_id", "forms[]", ["method", "action", "enctype"]).select("result_id", "pos", "method", "action", "enctype")


def xhr_requests(results: DataFrame) -> DataFrame:
    """(result_id, pos, method, endpoint, body, tag, attribute, source, raw): the sub-request entity."""
    r = results.select("result_id", F.struct(F.transform("response.xhr_requests", lambda x: F.when(x.isNotNull(), F.struct(*[x[c].alias(c) for c in REQUEST_COLUMNS]))).alias("xhr_requests")).alias("response"))
    return entity(staged_nodes(r, "result_id", ["response"]), "result_id", "xhr_requests[]", REQUEST_COLUMNS).select("result_id", "pos", *REQUEST_COLUMNS)


RESPONSE_COLUMNS = {"status_code": "int", "content_length": "bigint", "body": "string", "raw": "string", "stored_response_path": "string"}


def responses(results: DataFrame) -> DataFrame:
    """(result_id, parent_pos, pos, status_code, content_length, body, raw, stored_response_path): the response entity."""
    has = set(results.schema["response"].dataType.names)
    r = results.select("result_id", F.when(F.col("response").isNotNull(), F.struct(*[(F.col(f"response.{c}") if c in has else F.lit(None).cast(k)).alias(c) for c, k in RESPONSE_COLUMNS.items()])).alias("response"))
    e = entity(staged_nodes(r, "result_id", ["response"]), "result_id", "response", list(RESPONSE_COLUMNS))
    return e.select("result_id", F.lit(0).alias("parent_pos"), "pos", *[F.col(c).cast(k).alias(c) for c, k in RESPONSE_COLUMNS.items()])


def records(results: DataFrame) -> DataFrame:
    """(result_id, timestamp, received_at, error): the record itself; of several deliveries the first."""
    kinds = dict(results.dtypes)
    cols = [(F.col(c) if c in kinds else F.lit(None).cast(k)).alias(c) for c, k in (("timestamp", "timestamp"), ("received_at", "timestamp"), ("error", "string"))]
    return results.filter("result_id is not null").select("result_id", *cols).groupBy("result_id").agg(*(F.min(c).alias(c) for c in ("timestamp", "received_at", "error")))


def _elements(results: DataFrame, label: str) -> DataFrame:
    """Nodes that are the scalar elements of an array."""
    return adjacency(_collections(results), "result_id", ["request", "response"]).filter((F.col("label") == label) & (F.col("kind") == "scalar"))


def technologies(results: DataFrame) -> DataFrame:
    """(result_id, parent_pos, pos, value): the technologies of a response."""
    return _elements(results, "technologies[]").select("result_id", F.lit(0).alias("parent_pos"), F.col("ordinal").alias("pos"), F.col("scalar").alias("value"))


def form_parameters(results: DataFrame) -> DataFrame:
    """(result_id, parent_pos, pos, value): the parameters of forms; parent_pos is the form's place."""
    return _elements(results, "parameters[]").select("result_id", _part(F.col("node"), 2).cast("int").alias("parent_pos"), F.col("ordinal").alias("pos"), F.col("scalar").alias("value"))


def _owner(node: Column) -> Column:
    return F.when(node.startswith("response/xhr_requests/"), "xhr_request").when(node.startswith("request/"), "request").otherwise("response")


def _place(node: Column) -> Column:
    return F.when(node.startswith("response/xhr_requests/"), _part(node, 2).cast("int")).otherwise(0)


def headers(results: DataFrame) -> DataFrame:
    """(result_id, owner, parent_pos, pos, name, value): headers of request, response and xhr_request (at parent_pos).

    Entries of a map have no order, so pos is 0; a null value is a null.
    """
    has = set(results.schema["response"].dataType.names)
    own = F.struct(F.col("request.headers").alias("headers")).alias("request")
    xhr = F.transform("response.xhr_requests", lambda x: F.when(x.isNotNull(), F.struct(x["headers"].alias("headers")))).alias("xhr_requests")
    parts = [F.col("response.headers").alias("headers")] if "headers" in has else []
    nodes = staged_nodes(results.select("result_id", own, F.struct(*parts, xhr).alias("response")), "result_id", ["request", "response"])
    e = entity(nodes, "result_id", "headers{}", ["key", "value"])
    return e.select("result_id", _owner(F.col("node")).alias("owner"), _place(F.col("node")).alias("parent_pos"), "pos", F.col("key").alias("name"), "value")


def custom_fields(results: DataFrame) -> DataFrame:
    """(result_id, owner, parent_pos, pos, name, value): the values of the custom fields of request and xhr_request (at parent_pos).

    A field without values has one row with neither pos nor value.
    """
    nodes = staged_nodes(_collections(results), "result_id", ["request", "response"])
    names = entity(nodes, "result_id", "custom_fields{}", ["key"])
    values = nodes.filter((F.col("label") == "value[]") & (F.col("kind") == "scalar")).select("result_id", F.regexp_replace("parent", "/value$", "").alias("node"), F.col("ordinal").alias("at"), F.col("scalar").alias("value"))
    node = F.col("node")
    return names.join(values, ["result_id", "node"], "left").select("result_id", _owner(node).alias("owner"), _place(node).alias("parent_pos"), F.col("at").alias("pos"), F.col("key").alias("name"), "value")
