from pyspark.sql import functions as F

from gossamer.operators import shred
from gossamer.queries import general

REQ = "struct<method:string,endpoint:string,body:string,headers:map<string,string>,tag:string,attribute:string,source:string,custom_fields:map<string,array<string>>,raw:string>"
FORM = "struct<method:string,action:string,enctype:string,parameters:array<string>>"
SCHEMA = f"result_id long, received_at int, request {REQ}, response struct<status_code:int,body:string,technologies:array<string>,forms:array<{FORM}>,xhr_requests:array<{REQ}>>, error string"


def req(**k):
    return tuple(k.get(n) for n in "method endpoint body headers tag attribute source custom_fields raw".split())


def data(spark):
    full = (200, "b", ["x", None, ""], [None, ("GET", "/a", None, ["p", None, ""]), ("POST", None, None, None)], [req(endpoint="e1", headers={"h": None, "": "v"}, custom_fields={"f/g": ["1", None, "2"], "none": None}), None, req()])
    rows = [(1, 1, req(method="GET", custom_fields={"ü": ["a", ""]}), full, None), (1, 2, req(method="GET", custom_fields={"ü": ["a", ""]}), full, None), (2, 1, None, None, "x"), (3, 1, req(), (None, None, [], [], None), None), (None, 1, req(), full, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_children(spark):
    got = sorted(tuple(r) for r in shred.children(data(spark)).collect())
    assert got == sorted(
        [
            (1, "technology", 0, 1, ""), (1, "technology", 0, 3, ""), (1, "form", 0, 2, ""), (1, "form", 0, 3, ""), (1, "form_parameter", 2, 1, ""), (1, "form_parameter", 2, 3, ""),
            (1, "xhr_request", 0, 1, ""), (1, "xhr_request", 0, 3, ""), (1, "xhr_header", 1, 0, "h"), (1, "xhr_header", 1, 0, ""),
            (1, "xhr_custom_field", 1, 1, "f/g"), (1, "xhr_custom_field", 1, 3, "f/g"), (1, "request_custom_field", 0, 1, "ü"), (1, "request_custom_field", 0, 2, "ü"),
        ]
    )


def test_entities(spark):
    df = data(spark)
    assert sorted(map(tuple, shred.forms(df).collect()), key=str) == [(1, 2, "GET", "/a", None), (1, 3, "POST", None, None)]
    assert {(r.result_id, r.pos, r.endpoint) for r in shred.xhr_requests(df).collect()} == {(1, 1, "e1"), (1, 3, None)}
    assert {(r.result_id, r.method) for r in shred.requests(df).collect()} == {(1, "GET"), (3, None)}


def test_rebuilt_from_the_adjacency_table(spark):
    nodes = shred.adjacency(data(spark).select("result_id", "response"), "result_id", ["response"]).filter("result_id = 1").collect()
    by = {n.node: n for n in nodes}
    assert len(by) == len(nodes)
    assert all(n.parent == "" or n.parent in by for n in nodes)
    assert by["response/forms/2/parameters/1"].scalar == "p" and by["response/forms/2/parameters/1"].ordinal == 1
    assert "response/forms/1" not in by and by["response/technologies/3"].scalar == ""


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert shred.children(df).count() == 0 and shred.forms(df).count() == 0


def test_values_of_all_parts(spark):
    df = data(spark)
    rows = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert rows(shred.responses(df)) == [(1, 0, 0, 200, None, "b", None, None), (3, 0, 0, None, None, None, None, None)]
    assert [(r.result_id, r.error) for r in shred.records(df).orderBy("result_id").collect()] == [(1, None), (2, "x"), (3, None)]
    assert rows(shred.technologies(df)) == [(1, 0, 1, "x"), (1, 0, 3, "")]
    assert rows(shred.form_parameters(df)) == [(1, 2, 1, "p"), (1, 2, 3, "")]
    assert rows(shred.headers(df)) == [(1, "xhr_request", 1, 0, "", "v"), (1, "xhr_request", 1, 0, "h", None)]
    both = df.filter("result_id = 3").withColumn("request", F.col("request").withField("headers", F.expr("map('a', 'b')"))).withColumn("response", F.col("response").withField("headers", F.expr("map('c', 'd')")))
    assert rows(shred.headers(both)) == [(3, "request", 0, 0, "a", "b"), (3, "response", 0, 0, "c", "d")]
    fields = [(1, "request", 0, 1, "ü", "a"), (1, "request", 0, 2, "ü", ""), (1, "xhr_request", 1, 1, "f/g", "1"), (1, "xhr_request", 1, 3, "f/g", "2"), (1, "xhr_request", 1, None, "none", None)]
    assert rows(shred.custom_fields(df)) == sorted(fields, key=str)


def test_tables_of_all_parts_are_registered():
    assert {f"p6_{n}" for n in "records responses technologies form_parameters headers custom_fields".split()} <= general.QUERIES.keys()
