import pytest
from pyspark.sql import functions as F

from gossamer import config
from gossamer.config import CrawlConfig
from gossamer.operators.custom_fields import CustomField
from gossamer.operators.gates import Scope
from gossamer.plans import components, crawl, output, staging
from gossamer.sources import known_files, seeds

PAGES = "url string, status_code int, headers map<string,string>, body string, redirect_to string"
SITE = [
    ("https://a.example", 200, None, '<a href="/1"><a href="/2"><a href="https://a.example"><a href="#x"><a href="javascript:x()">', None),
    ("https://a.example/1", 200, None, '<a href="/3"><a href="/1"><a href="/p.png"><a href="https://nota.example/y"><a href="https://b.org/z">', None),
    ("https://a.example/2", 200, None, '<a href="/3">', None),
    ("https://a.example/3", 200, None, '<a href="/d/e/f">', None),
    ("https://a.example/d/e/f", 200, None, '<a href="/deep">', None),
    ("https://a.example/deep", 200, None, "same", None),
    ("https://a.example/go", 302, {"Location": "/1"}, '<a href="/hidden">', "https://a.example/1"),
]


def site(spark, extra=()):
    return spark.createDataFrame([*SITE, *extra], PAGES)


def seed(spark, *urls):
    return seeds.list_seeds(spark, list(urls or ("https://a.example",)))


def depths(r):
    return {x.u.removeprefix("https://a.example"): x.depth for x in r.select(F.col("request.endpoint").alias("u"), "depth").collect()}


def test_levels_and_gates(spark):
    r = crawl.crawl(site(spark), seed(spark), CrawlConfig(max_depth=2))
    assert depths(r.results) == {"": 0, "/1": 1, "/2": 1, "/3": 2, "https://nota.example/y": 2}  # a suffix without a dot
    assert r.results.filter("response is null").count() == 1
    r = crawl.crawl(site(spark), seed(spark), CrawlConfig(max_depth=4, scope=Scope(field="fqdn")))
    assert depths(r.results) == {"": 0, "/1": 1, "/2": 1, "/3": 2, "/d/e/f": 3, "/deep": 4}
    assert {x.ref for x in r.skipped.collect()} == {"#x", "javascript:x()"}
    assert ("https://a.example", "https://a.example/1") in {(e.source, e.target) for e in r.edges.collect()}
    first = r.results.filter("request.endpoint = 'https://a.example/3'").first()
    assert first.request.source == "https://a.example/1" and first.request.tag == "a"


def test_out_of_scope_rows(spark):
    r = crawl.crawl(site(spark), seed(spark), CrawlConfig(max_depth=1, show_out_of_scope=True)).results
    assert [x.request.endpoint for x in r.filter("error = 'out of scope'").collect()] == ["https://b.org/z"]


def test_path_climb(spark):
    r = crawl.crawl(site(spark), seed(spark, "https://a.example/d/e/f"), CrawlConfig(max_depth=1, path_climb=True))
    assert depths(r.results) == {"/d/e/f": 0, "/deep": 1, "/d/e": 0, "/d": 0}


def test_folders_climbed_from_the_deepest_level_are_expanded(spark):
    pages = [("https://a.example", 200, None, '<a href="/1">', None), ("https://a.example/1", 200, None, '<a href="/x/y">', None), ("https://a.example/x", 200, None, '<a href="/late">', None)]
    r = crawl.crawl(spark.createDataFrame(pages, PAGES), seed(spark), CrawlConfig(max_depth=2, path_climb=True))
    assert depths(r.results) == {"": 0, "/1": 1, "/x/y": 2, "/x": 1, "/late": 2}


def test_redirects(spark):
    assert depths(crawl.crawl(site(spark), seed(spark, "https://a.example/go"), CrawlConfig(max_depth=1)).results) == {"/go": 0, "/1": 1, "/hidden": 1}
    assert depths(crawl.crawl(site(spark), seed(spark, "https://a.example/go"), CrawlConfig(max_depth=1, follow_redirects=False)).results) == {"/go": 0}
    pages = spark.createDataFrame([("https://a.example/1", "/2"), ("https://a.example/2", "/3"), ("https://a.example/x", "/x"), ("https://a.example/3", None)], "url string, redirect_to string")
    got = {r.url[-1]: (r.final_url[-1], r.hops) for r in crawl.redirect_chains(pages).collect()}
    assert got == {"1": ("3", 2), "2": ("3", 1), "3": ("3", 0), "x": ("x", 10)}


def test_repeated_content_keeps_a_row_without_response(spark):
    extra = [("https://a.example/q?x=1", 404, None, "none", None), ("https://a.example/q?x=2", 404, None, "none", None)]
    s = seed(spark, "https://a.example/q?x=1", "https://a.example/q?x=2")
    assert crawl.crawl(site(spark, extra), s).results.filter("response is not null").count() == 1
    assert crawl.crawl(site(spark, extra), s, CrawlConfig(unique_content=False)).results.filter("response.status_code = 404").count() == 2
    assert crawl.crawl(site(spark, extra), s, CrawlConfig(ignore_query=True)).results.count() == 1


def test_known_files_and_custom_fields(spark):
    files = spark.createDataFrame([("https://a.example", "robots.txt", "User-agent: *\nDisallow: /2\n# Allow: /no\nAllow:/no\nSitemap: x"), ("https://a.example", "sitemap.xml", "<urlset><url><loc> https://a.example/3\n</loc></url><url><loc>"), ("https://c.example", "robots.txt", None)], "root string, kind string, content string")
    assert {(r.url, r.attribute) for r in known_files.known_links(files).collect()} == {("https://a.example/2", "robotstxt"), ("https://a.example/3", "sitemapxml")}
    c = CrawlConfig(max_depth=1, known_files="all", custom_fields=(CustomField("word", ("sa(me)",), "body", 1),))
    assert c.max_depth == 3
    r = crawl.crawl(site(spark), seed(spark, "https://a.example/deep"), c, files).results
    assert depths(r) == {"/deep": 0, "/2": 2, "/3": 2, "/d/e/f": 3}
    assert r.filter("request.endpoint = 'https://a.example/deep'").first().request.custom_fields == {"word": ["me"]}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], PAGES)
    assert crawl.crawl(none, seed(spark)).results.count() == 1
    assert crawl.crawl(none, spark.createDataFrame([], "url string")).results.count() == 0


def test_config(tmp_path):
    for bad in ({"strategy": "depth-first"}, {"strategy": "x"}, {"max_depth": -1}, {"known_files": "x"}):
        with pytest.raises(ValueError):
            CrawlConfig(**bad)
    f = tmp_path / "c.yaml"
    f.write_text("max_depth: 5\nscope: {field: fqdn, exclude: [logout]}\nflags: {scripts: true}\n")
    c = config.load(str(f))
    assert c.max_depth == 5 and c.scope.exclude == ("logout",) and c.flags.scripts
    f.write_text("nothing: 1\n")
    with pytest.raises(ValueError):
        config.load(str(f))
    assert config.headers(["A: b:c", "bad"]) == {"A": "b:c"}


def test_seeds(spark):
    df = spark.createDataFrame([(" a.example ",), ("https://a.example",), ("",), (None,), ("10.0.0.1:8080",)], "url string")
    assert {tuple(r) for r in seeds.normal_seeds(df).collect()} == {("https://a.example", "a.example"), ("http://10.0.0.1:8080", "10.0.0.1")}
    assert seeds.normal_seeds(df, ("private-ips",)).count() == 1


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), (1, 2)] + [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**dict.fromkeys((1, 2, 3, 8, 9), 1), **dict.fromkeys((4, 5), 4), **dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(500, 560), 500)}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_join_keeps_all_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    j = staging.salted_join(rows, side, "k", "n", heavy=500)
    assert j.count() == 3000 and j.select("id").distinct().count() == 3000


REQUEST = "struct<method:string,endpoint:string,body:string,tag:string,attribute:string,source:string,raw:string,custom_fields:map<string,array<string>>>"


def results(spark):
    rows = [
        (("GET", "https://a.example/d/f.php?k=1&k=2", None, "a", "href", "s", "R", {"mail": ["x", "y"]}), (200, "B", "RAW"), None),
        (("POST", "https://b.example:81", "q=1", None, None, None, None, None), None, "timeout"),
        ((None, None, None, None, None, None, None, None), None, None),
    ]
    return spark.createDataFrame(rows, f"request {REQUEST}, response struct<status_code:int,body:string,raw:string>, error string")


def test_lines(spark, tmp_path):
    r = results(spark)
    v = lambda d: [x.value for x in d.collect()]
    assert v(output.screen_lines(r)) == ["https://a.example/d/f.php?k=1&k=2", "https://b.example:81"]
    assert v(output.screen_lines(r, True)) == ["[a] [GET] https://a.example/d/f.php?k=1&k=2", "[POST] https://b.example:81 [q=1]"]
    assert v(output.field_lines(r, "value,mail", ["mail"])) == ["1", "2", "x", "y"]
    assert v(output.template_lines(r, "<{{fqdn}}> {{ value }} {{mail}}!")) == ["<a.example> 2 y!"]
    assert len(v(output.template_lines(r, "{{fqdn}}"))) == 2
    j = v(output.json_lines(output.exclude_fields(output.without(r, raw=True, body=True), ["tag", "status_code", "body", "raw"])))
    assert "status_code" not in j[0] and '"raw"' not in j[0] and '"endpoint":"https://a.example' in j[0] and '"error":"timeout"' in j[1]
    assert v(output.response_index(r))[0].endswith("https://a.example/d/f.php?k=1&k=2 (200)")
    assert output.stored_responses(r).first().content.endswith("R\n\nRAW")
    assert {(x.scheme, x.host, x.field, x.value) for x in output.stored_fields(r, "dir,fqdn").collect()} == {("https", "a.example", "dir", "/d/"), ("https", "a.example", "fqdn", "a.example"), ("https", "b.example", "fqdn", "b.example")}
    assert [x.error for x in output.errors(r.withColumn("timestamp", F.current_timestamp())).collect()] == ["timeout"]
    output.write_lines(output.screen_lines(r), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    output.write_partitioned(output.stored_fields(r, "fqdn"), str(tmp_path / "f"), ["scheme", "host", "field"])
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    assert output.free_path("x", ["x", "x1"]) == "x2" and "endpoint" in output.list_fields(r)


def test_recall(spark):
    e = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    assert tuple(output.recall(e, e.limit(2)).first()) == (3, 2, 66)
    assert tuple(output.recall(e.limit(0), e).first()) == (0, 0, 0)
