import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from gossamer.config import CrawlConfig
from gossamer.functions import dom, scripts
from gossamer.queries import crawling
from gossamer.operators import extract
from gossamer.plans import crawl
from gossamer.sources import fetch, seeds


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/go":
            self.send_response(302)
            self.send_header("Location", "/x")
            self.end_headers()
            return
        self.send_response(200 if self.path == "/x" else 404)
        self.send_header("X-One", "1")
        self.end_headers()
        self.wfile.write(b"<a href=/y>")

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(spark, server):
    df = spark.createDataFrame([(server + "/x", "GET", None), (server + "/go", None, None), (server + "/no", "GET", None), ("http://127.0.0.1:1/", "GET", None), (None, "GET", None)], "url string, method string, body string")
    got = {r.url: r for r in fetch.fetch(df, fetch.Limits(timeout=3, retries=0)).collect()}
    assert got[server + "/x"].status_code == 200 and got[server + "/x"].headers["x-one"] == "1" and "href" in got[server + "/x"].body
    assert got[server + "/go"].redirect_to == "/x" and got[server + "/no"].status_code == 404
    assert got["http://127.0.0.1:1/"].error and got[None].error == "no url"


def test_bucket():
    now, slept = [0.0], []
    b = fetch.Bucket(fetch.Limits(per_second=2), lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        b.take()
    assert sum(slept) == pytest.approx(1.5)


JS = """// fetch('/comment')
fetch('/api/a', {}); x.open("POST", "/api/b"); $.get("c/d.php"); $.ajax({type: 'GET', url: '/api/e'});
window.location.href = "/next"; location.assign(`/user/${id}`); import x from './m.js'; var s = "just words", t = '/static/img', u = 'https://h.example/p?q=1';"""


def test_script_calls_of_minified_bundles():
    long = "/" + "a" * 3000
    text = "var a=1;" * 20_000 + f"fetch('/api/one');x.open('GET','{long}');" + "b=2;" * 1000
    assert scripts.script_calls(text) == [("/api/one", "fetch"), (long, "xhr")]
    assert scripts.script_calls("/* " + "x" * 200_000 + "\n' */ fetch('/two')") == [("/two", "fetch")]


def test_scripts_without_a_source_are_read(spark, tmp_path):
    rows = [(1, None, "script", "fetch('/a')"), (2, "b.example", "script", "fetch('/b')")]
    spark.createDataFrame(rows, "doc_id long, source string, kind string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.ref) for r in crawling.QUERIES["links_scripts"](spark, str(tmp_path)).collect()}
    assert got == {("https://unknown.invalid/1.js", "/a"), ("https://b.example/2.js", "/b")}


def test_script_calls(spark):
    assert scripts.script_calls(JS) == [
        ("/api/a", "fetch"), ("/api/b", "xhr"), ("c/d.php", "jquery"), ("/api/e", "jquery"), ("/next", "location"), ("/user/EXPR", "location"), ("./m.js", "import"), ("/static/img", "url"), ("https://h.example/p?q=1", "url"),
    ]
    pages = spark.createDataFrame([("https://a.example/app.js", None, JS), ("https://a.example/jquery.min.js", None, "/*! jQuery v3.7.1 | (c) someone */" + JS), ("https://a.example/", None, "<script>fetch('/in')</script>"), (None, None, None)], "url string, headers map<string,string>, body string")
    got = extract.script_links(pages).collect()
    assert len(got) == 10 and ("https://a.example/", "https://a.example/in", "script", "call-fetch") in {(r.source, r.url, r.tag, r.attribute) for r in got}
    assert spark.createDataFrame([(JS,), (None,)], "t string").select(F.size(scripts.calls(F.col("t")))).collect()[1][0] == 0


def test_rendered_trees(spark):
    tree = {"name": "HTML", "children": [{"name": "A", "attributes": ["href", "/a?x=1&y"]}, {"name": "#text"}, {"name": "div", "shadowRoots": [{"name": "#fragment", "children": [{"name": "img", "attributes": ["src", "/s"]}]}]}, {"name": "iframe", "document": {"name": "#document", "children": [{"name": "a", "attributes": ["href", "/f"]}]}}, {"name": "template", "template": {"name": "a", "attributes": ["href", "/t"]}}, 7]}
    assert dom.flatten(tree).startswith('<html><a href="/a?x=1&amp;y"></a><div><img src="/s">')
    pages = spark.createDataFrame([("https://a.example/", None, "<a href=/raw>", json.dumps(tree), "broken"), ("https://b.example/", None, None, None, None)], "url string, headers map<string,string>, body string, shadow string, dom string")
    assert {r.ref for r in extract.rendered_links(pages).collect()} == {"/raw", "/a?x=1&y", "/s", "/f", "/t"}


def test_a_saved_traversal_goes_on(spark, tmp_path):
    links = spark.createDataFrame([(f"https://a.example/{i}", f"https://a.example/{i + 1}", "a", "href", "GET", None, 0) for i in range(6)], "source string, url string, tag string, attribute string, method string, body string, position int")
    s = seeds.normal_seeds(seeds.list_seeds(spark, ["https://a.example/0"]))
    half, _ = crawl.traverse(s, links, CrawlConfig(max_depth=2))
    crawl.save(half, str(tmp_path / "state"))
    rest, _ = crawl.traverse(s, links, CrawlConfig(max_depth=5), resume=str(tmp_path / "state"))
    assert {(r.url[-1], r.depth) for r in rest.collect()} == {(str(i), i) for i in range(6)}
