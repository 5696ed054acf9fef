"""Writing results, the live loop, and settings."""

import json

import pytest
from pyspark.sql import functions as F

from gossamer.config import CrawlConfig
from gossamer.functions import text as tx
from gossamer.operators import dsl, forms, gates
from gossamer.operators.gates import Scope
from gossamer.plans import crawl, output
from gossamer.sources import fetch as ft
from gossamer.sources.seeds import normal_seeds

ROW = "timestamp timestamp, request struct<method:string,endpoint:string,body:string,tag:string,source:string,raw:string,headers:map<string,string>,custom_fields:map<string,array<string>>>, response struct<status_code:int,headers:map<string,string>,body:string,raw:string>, error string"


def rows(spark):
    req = lambda u, own=None: ("GET", u, None, "a", None, "GET " + u, {"X-Own": "q"}, own)
    return spark.createDataFrame(
        [
            (None, req("https://a.example/x.php?p=1", {"code": ["c1", "c2"]}), (200, {"Content-Type": "text/html"}, "hello", "R"), None),
            (None, req("https://a.example/y.png"), (200, {}, "img", None), None),
            (None, req("https://b.example/z"), (404, None, "gone", "R2"), None),
            (None, req("https://b.example/w"), None, "refused"),
            (None, None, None, "no request"),
        ],
        ROW,
    )


def test_steps_in_their_order(spark):
    c = output.OutputConfig(format="json", store_fields="fqdn,code", custom=("code",), store_responses=True, omit_raw=True, omit_body=True, extension_defaults=True, match_dsl="status_code < 500", drop=("zzz",), exclude=("headers",))
    out = output.pipeline(rows(spark), c)
    assert {(r.field, r.value) for r in out.fields.collect()} == {("fqdn", "a.example"), ("fqdn", "b.example"), ("code", "c1"), ("code", "c2")}  # of all rows, before any gate
    lines = [json.loads(r.value) for r in out.lines.collect()]
    assert sorted(x["request"]["endpoint"] for x in lines) == ["https://a.example/x.php?p=1", "https://b.example/z"]
    assert all("body" not in x["response"] and "raw" not in x["response"] and "headers" not in x["response"] for x in lines)
    assert out.responses.count() == 2 and out.index.count() == 2 and "hello" not in str(out.lines.collect()) and "R" in out.responses.orderBy("path").first().content
    assert {r.error for r in out.errors.collect()} == {"refused", "no request"}


@pytest.mark.parametrize("form,want", [("screen", {"https://a.example/x.php?p=1"}), ("verbose", {"[a] [GET] https://a.example/x.php?p=1"}), ("fields", {"c1", "c2", "a.example"}), ("template", {"a.example c2"})])
def test_formats(spark, form, want):
    c = output.OutputConfig(format=form, fields="fqdn,code", template="{{fqdn}} {{code}}", custom=("code",), match=(r"\.php",))
    assert {r.value for r in output.pipeline(rows(spark), c).lines.collect()} == want


@pytest.mark.parametrize("bad", [{"format": "xml"}, {"format": "fields"}, {"format": "template"}, {"store_fields": "fqdn,nope"}, {"format": "template", "template": "{{nope}}"}, {"match": ("(",)}])
def test_settings_are_checked(bad):
    with pytest.raises(Exception):
        output.OutputConfig(**bad)


def test_written_folders_keep_clear_of_each_other(spark, tmp_path):
    out = output.pipeline(rows(spark), output.OutputConfig(store_fields="fqdn", store_responses=True))
    one = output.write(out, f"{tmp_path}/run")
    two = output.write(out, f"{tmp_path}/run")
    assert one == f"{tmp_path}/run" and two == f"{tmp_path}/run1" and spark.read.text(two + "/lines").count() == 5
    assert output.write(out, f"{tmp_path}/run", overwrite=True) == one and spark.read.parquet(one + "/fields").count() == 2
    assert output.pipeline(rows(spark).limit(0)).lines.count() == 0


def test_headers_are_names_of_conditions(spark):
    df = rows(spark)
    take = lambda t: [r.request.endpoint for r in dsl.chosen(df, match_dsl=t).collect()]
    assert take("content_type == 'text/html'") == ["https://a.example/x.php?p=1"] and len(take("x_own == 'q'")) == 4 and take("no_such == 'q'") == []


def web():
    def get(method, url, body, limits):
        if url == "https://a.example/":
            return 200, {"content-type": "text/html"}, '<a href="/b">b</a><a href="/b">b</a><a href="https://c.example/">c</a><a href="/r">r</a>', None, None
        if url == "https://a.example/r":
            return 302, {"location": "/end"}, None, "/end", None
        return (200, {}, '<a href="/">up</a>', None, None) if url.endswith(("/b", "/end")) else (None, {}, None, None, "refused")

    return get


@pytest.mark.parametrize("follow", [True, False])
def test_live_crawl(spark, follow):
    seeds = spark.createDataFrame([("a.example/",), ("https://down.example/",)], "url string")
    r = crawl.live(seeds, CrawlConfig(max_depth=3, scope=Scope(field="fqdn"), follow_redirects=follow), ft.Limits(per_second=1e6, retries=0), web(), 3)
    got = {x.request.endpoint: (x.depth, x.error) for x in r.results.collect()}
    want = {"https://a.example/": (0, None), "https://down.example/": (0, "refused"), "https://a.example/b": (1, None), "https://a.example/r": (1, None)}
    assert got == (want | {"https://a.example/end": (2, None)} if follow else want)
    assert {x.ref for x in r.skipped.collect()} == {"https://down.example/"}


def test_rate_is_shared_by_the_tasks():
    now, slept = [0.0], []
    b = ft.Bucket(ft.Limits(per_second=10), lambda: now[0], lambda s: slept.append(s), share=1 / 4)
    b.take()
    b.take()
    assert slept == [pytest.approx(0.4)]


def test_a_user_agent_is_always_sent():
    assert ft.request_headers(ft.Limits())["User-Agent"] == ft.USER_AGENT and ft.request_headers(ft.Limits(headers={"user-agent": "mine"})) == {"user-agent": "mine"}


def test_form_values_from_yaml(tmp_path):
    path = str(tmp_path / "fill.yaml")
    forms.save_fill(path)
    assert forms.load_fill(path) == forms.FormFill()
    (tmp_path / "own.yaml").write_text("email: me@here.example\nphone: 12345\n")
    f = forms.load_fill(str(tmp_path / "own.yaml"))
    assert (f.email, f.phone, f.color) == ("me@here.example", "12345", forms.FormFill().color)
    for bad in ("mail: x", "- a", "email: [a]"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            forms.load_fill(str(tmp_path / "bad.yaml"))


def test_excluded_urls(spark):
    asn = spark.createDataFrame([("64500", "203.0.113.0/24"), ("64501", "198.51.100.0/24")], "asn string, network string")
    urls = ["http://10.1.1.1/", "http://203.0.113.9/", "http://198.51.100.1/", "http://a.example:8080/", "http://docs.example/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url for r in df.filter(gates.excluded_url(F.col("url"), ("private-ips", ":8080", "as64500", "^docs"), asn)).collect()}
    assert got == {urls[0], urls[1], urls[3], urls[4]}
    assert normal_seeds(df, (":8080",)).count() == 4
    with pytest.raises(ValueError):
        gates.excluded_url(F.col("url"), ("AS1",))


def test_found_lines(spark):
    df = spark.createDataFrame([("a.found\nb\n\nc.found",), ("x.found",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.found_lines(F.col("t"))).collect()] == [["a.found"], ["x.found"], [], None]


def test_one_page_each(spark):
    schema = "url string, status_code int, headers map<string,string>, body string, redirect_to string"
    df = spark.createDataFrame([("u", 200, None, "x", None), ("u", 200, None, "x", None), ("u", None, None, "x", None), ("v", 200, None, None, None), (None, 1, None, "n", None)], schema).repartition(3)
    got = {r.url: (r.status_code, r.body) for r in crawl.one_page_each(df, 100).collect()}
    assert got == {"u": (None, "x"), "v": (200, None)} and crawl.one_page_each(df.limit(0), 100).count() == 0
