import sys
import time

import pytest

from gossamer.functions import markup as mk
from gossamer.functions.html import tokens
from gossamer.operators import extract
from gossamer.streaming import links


def test_unique_requests_over_a_stream(spark, tmp_path):
    schema = "url string, method string, body string"
    rows = [("https://a.example", "GET", None), ("https://a.example", "GET", "x"), ("bad", "GET", None), ("https://a.example", "POST", "x")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = links.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    got = links.run_to_end(links.unique_requests(stream).select("key"), "t")
    assert sorted(r.key for r in got.collect()) == ["https://a.example", "https://a.example:x"]


def test_page_text():
    assert mk.page_text("b", "x\n\nr") == "b"
    assert mk.page_text("", "H: 1\r\n\r\nbody\n\nmore") == "body\n\nmore"
    assert mk.page_text(None, "H: 1\nno end") is None and mk.page_text(None, None) is None and mk.page_text("", "H\n\n") is None


def test_visible_lines():
    html = "<html><head>\n<title>t</title>\n</head><!-- a\nb --><p>one&nbsp; two\n<script>x\n</script><a\nhref=x>three</a>\n \n&lt;b&gt; <style>\n</style><header>four</header>"
    assert mk.visible_lines(html) == [(4, "one two"), (7, "three"), (9, "<b>"), (10, "four")]
    assert mk.visible_lines("a < b\n\n c") == [(1, "a < b"), (3, "c")]
    assert mk.visible_lines("x<!-- open\ny") == [(1, "x")]
    assert mk.visible_text("<p>a</p>\n<p>b&amp;c") == "a b&c"


def test_sites():
    assert mk.site_of(" HTTPS://u@WWW.A.example.:80/x?y") == "www.a.example"
    assert mk.site_of("//a") is None and mk.site_of(None) is None and mk.site_of("") is None


def test_tokens_of_long_and_odd_markup():
    assert list(tokens("<" * 50_000))[-1][0] == "data"
    assert [t[0] for t in tokens("<a b='" + "x" * 100_000)] == []
    assert ("start", "a", {"b": "1", "c": "", "d": "2"}, False) in list(tokens("<a b=1 c d='2' b=3>"))


def test_nothing_else_imports_the_llm_folder():
    import subprocess

    code = "import sys, gossamer.queries.crawling, gossamer.queries.general; sys.exit(any(m.startswith('gossamer.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_entry_has_a_query_for_each_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("part", ["a <b ", "<script ", "<script>", "<!--", "</script ", "<p>x", "<li>", "<a b=\"", "<td x='y' "])
def test_markup_passes_are_linear(part):
    page = part * (4 * 2**20 // len(part))
    began = time.monotonic()
    mk.visible_lines(page)
    assert time.monotonic() - began < 4
    began = time.monotonic()
    extract.markup_links(part * (2**19 // len(part)))
    assert time.monotonic() - began < 8


def test_elements_are_cut_at_their_first_end():
    cut = lambda t, **k: mk.sub_elements(lambda name, whole, inner: f"[{name}:{inner}]", t, ("nav", "pre"), **k)
    assert cut("a<nav x>b<pre>c</nav>d</pre>") == "a[nav:b<pre>c]d</pre>" and cut("<pre>x", to_end=False) == "<pre>x" and cut("<pre>x") == "[pre:x]"
    assert cut("<nav <pre>y</pre>") == "[nav:y</pre>]" and cut("<nav", comments=True) == "<nav" and cut("<!--z", comments=True) == "[:z]"
