import pyspark
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gossamer.functions import psl

HOSTS = ["a.b.weavers.co.uk", "Docs.Acme.example", "x.city.kawasaki.jp", "a.b.c.kawasaki.jp", "co.uk", "10.0.0.1", None]


@pytest.fixture
def without_jars(monkeypatch, tmp_path):
    """A Spark whose Python package holds no jars, as where they lie in another folder."""
    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "__init__.py"))
    psl.load_rules.cache_clear()
    yield
    psl.load_rules.cache_clear()


def test_registrable_domains_need_no_jar(spark, without_jars):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    got = [r.v for r in rows.select(psl.rdn(F.col("host")).alias("v")).collect()]
    assert got == ["weavers.co.uk", "acme.example", "city.kawasaki.jp", "b.c.kawasaki.jp", "", "", ""]


@pytest.mark.parametrize("name", ["field_rdn", "scope_rdn", "scope_dn"])
def test_frontier_queries_need_no_jar(spark, without_jars, tmp_path, name):
    rows = [(1, "https://docs.acme.example/a", "acme.example"), (2, "https://other.example/", "acme.example")]
    spark.createDataFrame(rows, "edge_id long, url string, root_host string").write.parquet(str(tmp_path / "frontier.parquet"))
    got = {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    if name == "field_rdn":
        assert got == {("https://docs.acme.example/a", "acme.example"), ("https://other.example/", "other.example")}
    else:
        assert got == {(1, True), (2, False)}


@pytest.mark.parametrize("name, rows", [("crawl_extension_match", 2), ("path_climb", 4), ("live_crawl", 5)])
def test_crawls_need_no_jar(spark, without_jars, tmp_path, name, rows):
    spark.createDataFrame([(1, "https://a.example/")], "edge_id long, url string").write.parquet(str(tmp_path / "frontier.parquet"))
    assert entry.queries()[name](spark, str(tmp_path)).count() == rows


def test_snapshot_needs_no_jar(spark, without_jars):
    assert entry.queries()["crawl_snapshot"](spark, "/root/testdata/sf0.001").count() > 0
