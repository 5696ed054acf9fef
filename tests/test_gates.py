import pytest
from pyspark.sql import functions as F

from gossamer.operators import dsl, gates, technologies
from gossamer.operators.gates import Scope


def ask(spark, rows, scope):
    df = spark.createDataFrame(rows, "url string, root string")
    return [r[0] for r in df.select(gates.in_scope(F.col("url"), F.col("root"), scope)).collect()]


def test_scope(spark):
    rows = [("https://test.example.com/x", "example.com"), ("https://other.org", "example.com"), ("http://127.0.0.1/", "127.0.0.1"), ("http://127.0.0.2/", "127.0.0.1"), (None, "example.com")]
    assert ask(spark, rows, Scope()) == [True, False, True, False, False]
    assert ask(spark, rows, Scope(field="fqdn")) == [False, False, True, False, False]
    assert ask(spark, [("https://testexample.org", "example.com"), ("http://localhost/", "localhost")], Scope(field="dn")) == [True, True]
    assert ask(spark, [("https://notexample.com", "example.com")], Scope()) == [True]  # a suffix, no dot needed
    assert ask(spark, [("https://api.b.org", "example.com"), ("https://b.org", "example.com")], Scope(field=r"^api\.")) == [True, False]
    assert ask(spark, rows, Scope(off=True)) == [True] * 5
    urls = [("https://example.com/index.php?a=1", "example.com"), ("https://example.com/logout.php", "example.com"), ("https://example.com/x", "example.com")]
    assert ask(spark, urls, Scope(include=(r"\.php",), exclude=("logout",))) == [True, False, False]
    with pytest.raises(Exception):
        Scope(include=("(",))


def test_extensions(spark):
    df = spark.createDataFrame([(u,) for u in ("main.php", "https://a.com/main.js", "https://a.com/x.PNG?q", "https://a.com", "https://a.com/dir/", None)], "u string")
    ask = lambda *a: [r[0] for r in df.select(gates.extension_allowed(F.col("u"), *a)).collect()]
    assert ask((".js",), (), True) == [False, True, False, False, False, False]
    assert ask((), (), True)[:4] == [True, True, False, True]
    assert ask((), ("php",), True)[0] is False
    assert ask((), (), False)[2] is True


def test_hosts(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("8.8.8.8",), ("a.example",), (None,)], "h string")
    ask = lambda *r: [x[0] for x in df.select(gates.excluded_host(F.col("h"), r)).collect()]
    assert ask("private-ips") == [True, False, False, False]
    assert ask("8.8.0.0/16", "cdn") == [False, True, False, False]
    assert ask(r"^a\.")[:3] == [False, False, True]
    assert gates.expand_network("10.0.0.0/30") == ["10.0.0.0", "10.0.0.1", "10.0.0.2", "10.0.0.3"]


def test_content_and_size(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "é" * 10)], "response_id long, body string")
    assert {r.response_id: r.is_first for r in gates.first_content(df).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert {r[0]: r[1] for r in df.select("response_id", gates.capped(F.col("body"), 5)).collect()} == {1: "a", 2: "a", 3: None, 4: None, 5: "éé"}


RESULT = "request struct<method:string,endpoint:string>, response struct<status_code:int,body:string,technologies:array<string>>, error string"


def rows(spark):
    data = [(("GET", "https://a.example/x"), (200, "It is OK", ["nginx", "PHP"]), None), (("GET", "https://a.example/y"), (404, None, None), "gone"), (("POST", "https://b.example"), None, None)]
    return spark.createDataFrame(data, RESULT)


@pytest.mark.parametrize(
    "text,want",
    [
        ("status_code == 200 && contains(to_lower(body), 'ok')", ["x"]),
        ("status_code != 200", ["y"]),
        ("!(status_code == 200)", ["y", "m"]),
        ("contains(technologies, 'PHP') || method == \"POST\"", ["x", "m"]),
        ("status_code >= 400 && status_code < 500", ["y"]),
        ("nothing == 1", []),
        ("len(body) > 3", ["x"]),
        ("starts_with(endpoint, 'https://b')", ["m"]),
    ],
)
def test_conditions(spark, text, want):
    df = rows(spark)
    got = sorted(r[0][-1] for r in df.filter(dsl.condition(df, text)).select("request.endpoint").collect())
    assert got == sorted(x if x != "m" else "e" for x in want)


def test_bad_conditions(spark):
    df = rows(spark)
    for bad in ("nofunction(body)", "status_code ==", "(status_code", "contains(body)", "status_code == 200 200", "a ~ b"):
        with pytest.raises(ValueError):
            dsl.condition(df, bad)


def test_match_and_filter(spark):
    df = rows(spark)
    n = lambda **k: dsl.chosen(df, **k).count()
    assert n() == 3 and n(match=["/x$"], match_dsl="status_code == 404") == 2
    assert n(drop=["a\\.example"]) == 1 and n(drop_dsl="status_code == 200") == 2 and n(match=["nothing"]) == 0


def test_technologies(spark):
    df = spark.createDataFrame([(1, {"Server": "nginx/1", "X-Powered-By": "PHP/8"}, '<script src="/jquery.min.js">'), (2, None, None)], "id long, headers map<string,string>, body string")
    assert sorted((r.id, r.technology) for r in technologies.detect(df, "id").collect()) == [(1, "PHP"), (1, "jQuery"), (1, "nginx")]
