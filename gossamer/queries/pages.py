"""Queries of the extractors over pages that are made from the frontier's urls, one per operator, with their SQL.

The crawl tables hold few kinds of links, so each distinct url becomes a page that holds one operator's markup; ``{k}`` in it
is the url's smallest edge_id.  The SQL states the links that such a page has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.config import CrawlConfig
from gossamer.functions import text as tx
from gossamer.functions import url as ur
from gossamer.operators import custom_fields, dsl, extract, forms, gates
from gossamer.operators.gates import Scope
from gossamer.plans import crawl, output
from gossamer.queries.crawling import _E, _ONE, _PAIRS, _host, _one, _port, _query, _raw_path, _root
from gossamer.sources.fetch import Limits
from gossamer.sources.tables import table
from gossamer.streaming import links as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}

# operator -> (markup, links as (ref, tag, attribute[, method]))
MARKUP = {
    "tag_a": ('<a href="/a/{k}" ping="/ping/{k}">x</a><a href="">y</a><a>z</a>', [("/a/{k}", "a", "href"), ("/ping/{k}", "a", "ping")]),
    "tag_link": ('<LINK rel=next HREF=/link/{k}>', [("/link/{k}", "link", "href")]),
    "tag_body": ("<body background='/bg/{k}'>x", [("/bg/{k}", "body", "background")]),
    "tag_audio": (
        '<audio src="/au/{k}"><source src="/s/{k}" srcset="/s1/{k} 1x, /s2/{k} 2x"></audio><source src="/no/{k}">',
        [("/au/{k}", "audio", "src"), ("/s/{k}", "audio", "source"), ("/s1/{k}", "audio", "sourcesrcset"), ("/s2/{k}", "audio", "sourcesrcset")],
    ),
    "tag_applet": ('<applet archive="/ar/{k}" codebase="/cb/{k}"></applet>', [("/ar/{k}", "applet", "archive"), ("/cb/{k}", "applet", "codebase")]),
    "tag_img": (
        '<img src="/i/{k}" dynsrc="/d/{k}" longdesc="/l/{k}" lowsrc="/w/{k}" srcset="/x/{k} 480w, /y/{k} 2x"><img src="data:x" srcset="/no/{k} 1x"><img src="#">',
        [("/i/{k}", "img", "src"), ("/d/{k}", "img", "dynsrc"), ("/l/{k}", "img", "longdesc"), ("/w/{k}", "img", "lowsrc"), ("/x/{k}", "img", "srcset"), ("/y/{k}", "img", "srcset")],
    ),
    "tag_object": ('<object data="/o/{k}" codebase="/c/{k}"><param name=movie value="/p/{k}"></object><param value="/no/{k}">', [("/o/{k}", "src", "data"), ("/c/{k}", "src", "codebase"), ("/p/{k}", "src", "param-value")]),
    "tag_svg": (
        '<svg><image href="/i/{k}" xlink:href="/ix/{k}"/><script href="/s/{k}" xlink:href="/sx/{k}"></script></svg><image href="/no/{k}">',
        [("/i/{k}", "svg", "image-href"), ("/ix/{k}", "svg", "image-href"), ("/s/{k}", "svg", "script-href"), ("/sx/{k}", "svg", "script-href")],
    ),
    "tag_table": ('<table background="/t/{k}"><tr><td background="/td/{k}">x</td></tr></table><td background="/no/{k}">', [("/t/{k}", "table", "background"), ("/td/{k}", "table", "td-background")]),
    "tag_video": ('<video src="/v/{k}" poster="/p/{k}"><track src="/tr/{k}"></video>', [("/v/{k}", "video", "src"), ("/p/{k}", "video", "poster"), ("/tr/{k}", "video", "track-src")]),
    "tag_button": ('<button formaction="/f/{k}">x</button>', [("/f/{k}", "button", "formaction")]),
    "tag_blockquote": ('<blockquote cite="/q/{k}">x</blockquote>', [("/q/{k}", "blockquote", "cite")]),
    "tag_frame": ('<frameset><frame src="/fr/{k}"><frame src="/fr2/{k}"></frameset>', [("/fr/{k}", "frame", "src"), ("/fr2/{k}", "frame", "src")]),
    "tag_area": ('<map><area ping="/ar/{k}" href="/x"></map>', [("/ar/{k}", "area", "ping")]),
    "tag_base": ('<base href="/base/{k}/"><a href="/x/{k}">y</a>', [("/base/{k}/", "base", "href"), ("/x/{k}", "a", "href")]),
    "tag_import": ('<import implementation="/im/{k}">', [("/im/{k}", "import", "implementation")]),
    "tag_embed": ('<embed src="/em/{k}">', [("/em/{k}", "embed", "src")]),
    "tag_iframe": ("""<iframe src="/if/{k}" srcdoc="<a href='/sub/{k}/page.html'>"></iframe>""", [("/if/{k}", "iframe", "src"), ("/sub/{k}/page.html", "iframe", "srcdoc")]),
    "tag_input_image": ('<input type="IMAGE" src="/in/{k}"><input type=text src="/no/{k}">', [("/in/{k}", "input-image", "src")]),
    "tag_isindex": ('<isindex action="/is/{k}">', [("/is/{k}", "isindex", "action")]),
    "tag_script": ('<script src="/sc/{k}">var a="/no/{k}/x.php";</script>', [("/sc/{k}", "script", "src")]),
    "tag_meta": ("""<meta http-equiv=refresh content="5; url= '/me/{k}/next.html' x">""", [("/me/{k}/next.html", "meta", "refresh")]),
    "tag_html": ('<html manifest="/mf/{k}"><head></head></html>', [("/mf/{k}", "html", "manifest")]),
    "tag_doctype": ('<!DOCTYPE html SYSTEM "/dt/{k}"><p>x', [("/dt/{k}", "html", "doctype")]),
    "tag_htmx": (
        '<b hx-get="/g/{k}" hx-post="/po/{k}"></b><i hx-put="/pu/{k}"></i><u hx-patch="/pa/{k}"></u>',
        [("/g/{k}", "htmx", "hx-get", "GET"), ("/po/{k}", "htmx", "hx-post", "POST"), ("/pu/{k}", "htmx", "hx-put", "PUT"), ("/pa/{k}", "htmx", "hx-patch", "PATCH")],
    ),
}
# the optional extractors: script text, script files, whole bodies
SCRIPTED = {
    "script_text": ("", '<script>load("/sc/{k}/x.php");</script><style>a("/no/{k}/y.php")</style>', [("/sc/{k}/x.php", "script", "text")]),
    "script_file": ("/app.js", 'load("/js/{k}/x.php"); go(\'/js2/{k}/y.aspx\')', [("/js/{k}/x.php", "js", "regex"), ("/js2/{k}/y.aspx", "js", "regex")]),
    "body_regex": ("", "<p>see ../up/{k} and /down/{k}.html here</p>", [("../up/{k}", "html", "regex"), ("/down/{k}.html", "html", "regex")]),
}
HEADERS = {
    "header_content_location": ("Content-Location", "/cl/{k}", ["/cl/{k}"], "content-location"),
    "header_link": ("LINK", '</l1/{k}>; rel="next", </l2/{k}>; rel="last"', ["/l1/{k}", "/l2/{k}"], "link"),
    "header_location": ("Location", "/lo/{k}", ["/lo/{k}"], "location"),
    "header_refresh": ("refresh", "999; url=/re/{k}", ["/re/{k}"], "refresh"),
}

_BASE = "(select url, min(edge_id) as k from frontier where url is not null group by url)"


def _base(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "frontier").filter("url is not null").groupBy("url").agg(F.min("edge_id").alias("k"))


def _with_k(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), F.col("k").cast("string"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _k(template: str) -> str:
    return f"replace({_quoted(template)}, '{{k}}', cast(k as varchar))"


def _links_sql(links: list, base: str = _BASE, source: str = "url") -> str:
    rows = ", ".join(f"({_quoted(x[0])}, {_quoted(x[1])}, {_quoted(x[2])}, {_quoted(x[3] if len(x) > 3 else 'GET')})" for x in links)
    return f"select {source} as source, replace(t, '{{k}}', cast(k as varchar)) as ref, tag, attribute, method from {base}, (values {rows}) as v(t, tag, attribute, method)"


def _none() -> Column:
    return F.lit(None).cast("map<string,string>")


LINK = ("source", "ref", "tag", "attribute", "method")

for _n, (_html, _refs) in MARKUP.items():
    QUERIES[_n] = lambda s, d, h=_html: extract.page_links(_base(s, d).select("url", _none().alias("headers"), _with_k(h).alias("body"))).select(*LINK)
    SQL[_n] = _links_sql(_refs)

for _n, (_tail, _body, _refs) in SCRIPTED.items():
    def _scripted(s, d, tail=_tail, body=_body, only={x[1:3] for x in _refs}):
        pages = _base(s, d).select(F.concat("url", F.lit(tail)).alias("url"), _none().alias("headers"), _with_k(body).alias("body")).filter(~F.contains("url", F.lit("?")) & ~F.contains("url", F.lit("#")))
        links = extract.page_links(pages, extract.Flags(scripts=True)).select(*LINK)
        return links.filter(F.struct("tag", "attribute").isin([F.struct(F.lit(t), F.lit(a)) for t, a in sorted(only)]))

    QUERIES[_n] = _scripted
    SQL[_n] = _links_sql(_refs, f"(select * from {_BASE} where not contains(url, '?') and not contains(url, '#'))", f"url || '{_tail}'")

for _n, (_name, _value, _refs, _attr) in HEADERS.items():
    QUERIES[_n] = lambda s, d, n=_name, v=_value: extract.page_links(_base(s, d).select("url", F.create_map(F.lit(n), _with_k(v)).alias("headers"), F.lit(None).cast("string").alias("body"))).select("source", "url", *LINK[1:])
    SQL[_n] = f"with x as ({_links_sql([(r, 'header', _attr) for r in _refs])}) select source, {_root('source')} || ref as url, ref, tag, attribute, method from x where {_host('source')} <> ''"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# links of scripts by the call they stand in
_JS = """fetch("/f/{k}"); x.open('GET', "/x/{k}"); $.ajax({type: 'POST', url: "/j/{k}"}); location.href = "/l/{k}"; import m from './m{k}.js'; var z = "/u/{k}/v"; // "/no"
t(`/t/${a}/{k}`);"""
_CALLS = [("/f/{k}", "fetch"), ("/x/{k}", "xhr"), ("/j/{k}", "jquery"), ("/l/{k}", "location"), ("./m{k}.js", "import"), ("/u/{k}/v", "url"), ("/t/EXPR/{k}", "url")]
_PLAIN = f"(select * from {_BASE} where not contains(url, '?') and not contains(url, '#'))"


def _script_pages(s, d, tail: str, body: str) -> DataFrame:
    plain = ~F.contains("url", F.lit("?")) & ~F.contains("url", F.lit("#"))
    return _base(s, d).filter(plain).select(F.concat("url", F.lit(tail)).alias("url"), _none().alias("headers"), _with_k(body).alias("body"))


@query("script_calls_file", _links_sql([(r, "js", "call-" + t) for r, t in _CALLS], _PLAIN, "url || '/app.js'").replace(", method from", " from"))
def _calls_file(s, d):
    return extract.script_links(_script_pages(s, d, "/app.js", _JS)).select(*LINK[:4])


@query("script_calls_element", _links_sql([(r, "script", "call-" + t) for r, t in _CALLS], _PLAIN).replace(", method from", " from"))
def _calls_element(s, d):
    return extract.script_links(_script_pages(s, d, "", f"<p>x</p><script>{_JS}</script>")).select(*LINK[:4])


_HOSTS = "(select 'https://' || root_host as url, min(edge_id) as k from frontier where root_host is not null group by root_host)"


@query("script_calls_minified", _links_sql([(r, "js", "call-" + t) for r, t in _CALLS], _HOSTS, "url || '/min.js'").replace(", method from", " from"))
def _calls_minified(s, d):
    """One file a website, whose calls stand at the end of one line of 150,000 characters."""
    b = table(s, d, "frontier").filter("root_host is not null").groupBy(F.concat(F.lit("https://"), "root_host").alias("url")).agg(F.min("edge_id").alias("k"))
    return extract.script_links(b.select(F.concat("url", F.lit("/min.js")).alias("url"), _none().alias("headers"), _with_k("/* c */" + "var q=1;" * 19_000 + _JS).alias("body"))).select(*LINK[:4])


@query("script_libraries", f"select url || '/lib.js' as source, '/x/' || k as ref from {_PLAIN} where k % 2 = 0")
def _libraries(s, d):
    """Files that name themselves as a library and its version give nothing."""
    pages = _script_pages(s, d, "/lib.js", "fetch('/x/{k}')")
    k = F.regexp_extract("body", r"(\d+)'\)", 1).cast("long")
    lead = F.when(k % 2 == 1, F.lit("/*! toolbox v3.1.4 | MIT */ ")).otherwise(F.lit("/* our own */ "))
    return extract.script_links(pages.withColumn("body", F.concat(lead, "body"))).select("source", "ref")


# forms
_FORMS = """<form action="/s/{k}" method=post><input name=q><select name=o><option value=1></select><textarea name=t></textarea><input type=submit></form>
<form action="https://other.example/{k}" enctype="multipart/form-data"><input name=f></form><form action="//cdn.example/{k}" method="PUT"></form><form action="" method="GET"><input id=x></form><form action="next{k}"></form>"""


@query("forms_extracted", f"""select url, pos, method, case a when '/s/' then {_root('url')} || '/s/' || k when 'abs' then 'https://other.example/' || k when 'cdn' then '//cdn.example/' || k
when '' then regexp_extract(url, '^([^?#]*)', 1) || case when {_query('url')} <> '' then '?' || {_query('url')} else '' end
else {_root('url')} || rtrim({_raw_path('url')}, '/') || '/next' || k || case when {_query('url')} <> '' then '?' || {_query('url')} else '' end end as action, enctype, parameters
from {_BASE}, (values (1, 'POST', '/s/', 'application/x-www-form-urlencoded', 'q,o,t'), (2, 'GET', 'abs', 'multipart/form-data', 'f'), (3, 'PUT', 'cdn', 'application/x-www-form-urlencoded', ''), (4, 'GET', '', '', ''), (5, 'GET', 'rel', '', '')) as v(pos, method, a, enctype, parameters)
where {_host('url')} <> ''""")
def _forms_extracted(s, d):
    got = forms.page_forms(_base(s, d).filter(ur.is_url("url")).select("url", _with_k(_FORMS).alias("body")))
    return got.select("url", F.posexplode("forms").alias("p", "f")).select("url", (F.col("p") + 1).cast("int").alias("pos"), "f.method", "f.action", "f.enctype", F.array_join("f.parameters", ",").alias("parameters"))


_FILLED = """<form action="/send/{k}" method=post><input name=mail type=email><input name=pw type=password><input name=c type=color><input name=tel type=tel><input name=n type=number min=5 step=2><input name=r type=range min=1 max=3 step=9>
<input type=radio name=g value=a><input type=radio name=g value=b><input type=checkbox name=ok value=yes><input name=h type=hidden value="{k}"><input name=p placeholder="your town"><input id=byid><input type=submit>
<select name=s1><option value=x><option value=y selected></select><select name=s2><option value=z></select><textarea name=ta></textarea></form><form action="/find/{k}?a=1"><input name=q></form>"""
_FILL = forms.FormFill()
_BODY = "mail=visitor%40example.org&pw=Thread-and-needle-7&c=%232f6f4f&tel=Thread-and-needle-7&n=7&r=-6&g=b&ok=yes&h={k}&p=your+town&byid=gossamer&s1=y&s2=z&ta=gossamer"


@query("forms_filled", f"""select url as source, method, case when method = 'POST' then {_root('url')} || '/send/' || k else {_root('url')} || '/find/' || k || '?a=1&q=gossamer' end as target, case when method = 'POST' then {_k(_BODY)} end as body
from {_BASE}, (values ('POST'), ('GET')) as v(method) where {_host('url')} <> ''""")
def _forms_filled(s, d):
    pages = _base(s, d).filter(ur.is_url("url")).select("url", _none().alias("headers"), _with_k(_FILLED).alias("body"))
    return extract.page_links(pages, extract.Flags(fill_forms=True), fill=_FILL).filter("tag = 'form'").select("source", "method", F.col("ref").alias("target"), "body")


@query("form_values", f"""select url, name, value from {_BASE}, (values {', '.join('(' + ', '.join(_quoted(y) for y in x.split('=')) + ')' for x in _BODY.replace('{k}', 'h0').replace('%40', '@').replace('%23', '#').replace('+', ' ').split('&'))}) as v(name, value)""")
def _form_values(s, d):
    """What each element is filled with, read back from the request's body."""
    pages = _base(s, d).select("url", _none().alias("headers"), F.lit(_FILLED.replace("{k}", "h0")).alias("body"))
    pair = extract.page_links(pages, extract.Flags(fill_forms=True), fill=_FILL).filter("tag = 'form' and method = 'POST'").select(F.col("source").alias("url"), F.explode(F.split("body", "&")).alias("x"))
    return pair.select("url", F.substring_index("x", "=", 1).alias("name"), F.url_decode(F.substring_index("x", "=", -1)).alias("value"))


# rendered trees
_TREE = '{"name": "html", "children": [{"name": "a", "attributes": ["href", "/dom/{k}"]}, {"name": "x-card", "shadowRoots": [{"name": "img", "attributes": ["src", "/sh/{k}"]}]}, {"name": "template", "template": {"name": "a", "attributes": ["href", "/te/{k}"]}}, {"name": "iframe", "document": {"name": "a", "attributes": ["href", "/do/{k}"]}}, {"name": "#text"}, null]}'


@query("rendered_links", _links_sql([("/raw/{k}", "a", "href"), ("/both/{k}", "a", "href"), ("/dom/{k}", "a", "href"), ("/sh/{k}", "img", "src"), ("/te/{k}", "a", "href"), ("/do/{k}", "a", "href"), ("/shadow/{k}", "a", "href")]))
def _rendered(s, d):
    shadow = '{"name": "div", "children": [{"name": "a", "attributes": ["href", "/shadow/{k}"]}, {"name": "a", "attributes": ["href", "/both/{k}"]}]}'
    p = _base(s, d).select("url", _none().alias("headers"), _with_k('<a href="/raw/{k}">x</a><a href="/both/{k}">y</a>').alias("body"), _with_k(shadow).alias("shadow"), _with_k(_TREE).alias("dom"))
    return extract.rendered_links(p).select(*LINK)


@query("own_extractor", _links_sql([("/a/{k}", "a", "href"), ("/own/{k}", "own", "data-next")]))
def _own(s, d):
    import re

    find = re.compile(r'data-next="([^"]*)"').findall
    pages = _base(s, d).select("url", _none().alias("headers"), _with_k('<a href="/a/{k}" data-next="/own/{k}">x</a>').alias("body"))
    return extract.page_links(pages, extra=lambda html: [(x, "own", "data-next", "GET", None) for x in find(html)]).select(*LINK)


# header values, custom fields, text
@query("flat_headers", f"select url, 'a;b' || k as value from {_BASE}")
def _flat(s, d):
    h = F.create_map(F.lit("set-cookie"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("k").cast("string"))))
    return _base(s, d).select("url", tx.flat_headers(h)["set-cookie"].alias("value"))


@query("plain_of_ansi", f"select url, 'found ' || url || ' [' || k || ']' as value from {_BASE}")
def _ansi(s, d):
    return _base(s, d).select("url", tx.strip_ansi(F.concat(F.lit("\x1b[1;31mfound\x1b[0m "), "url", F.lit(" [\x1b[32m"), F.col("k").cast("string"), F.lit("\x1b[0m]"))).alias("value"))


@query("custom_field_header", f"select url, field, value || k as value from {_BASE}, (values ('token', 'h'), ('token', 'b'), ('mail', 'm')) as v(field, value)".replace("value || k", "case field when 'mail' then 'm' || k || '@a.example' else value || k end"))
def _field_header(s, d):
    p = _base(s, d).select("url", F.create_map(F.lit("X-Token"), F.concat(F.lit("tok=h"), F.col("k").cast("string"))).alias("headers"), F.concat(F.lit("tok=b"), F.col("k").cast("string"), F.lit(" to m"), F.col("k").cast("string"), F.lit("@a.example ")).alias("body"))
    own = (custom_fields.CustomField("token", (r"tok=(\w+)",), "response", 1), custom_fields.CustomField("mail", (tx.EMAIL,), "body", 1))
    return custom_fields.evaluate(p, own, "url").select("url", F.explode("custom_fields").alias("field", "v")).select("url", "field", F.explode("v").alias("value"))


@query("found_lines", f"select url, url || '/a.found' as path from {_BASE}")
def _found_lines(s, d):
    t = F.concat("url", F.lit("/a.found\n"), "url", F.lit("/b.html\r\n \n"), "url", F.lit("/late.found\n"))
    return _base(s, d).select("url", F.explode(tx.found_lines(t)).alias("path"))


# gates
@query("cycle_urls", f"select url || tail as url, n >= 10 as cycle from {_BASE}, (values ('', 0), (repeat('/abcdefghijk', 12), 12), (repeat('/abcdefghijk', 7), 7), ('?' || repeat('xyzxyzxyz' || repeat('q', 300), 10), 10)) as v(tail, n)")
def _cycles(s, d):
    """Urls as they are, and with a folder or a stretch of 309 characters repeated."""
    tails = F.array(F.lit(""), F.repeat(F.lit("/abcdefghijk"), 12), F.repeat(F.lit("/abcdefghijk"), 7), F.concat(F.lit("?"), F.repeat(F.lit("xyzxyzxyz" + "q" * 300), 10)))
    return _base(s, d).select("url", F.explode(tails).alias("tail")).select(F.concat("url", "tail").alias("url")).select("url", ur.is_cycle("url").alias("cycle"))


_RULES = ("private-ips", "cdn", "^docs", "8.8.0.0/17", ":8080", "AS64500")


@query("host_exclusion", f"""with u as (select k, case k % 5 when 0 then url when 1 then 'http://10.1.2.' || (k % 256) || '/' when 2 then 'http://8.8.' || (k % 256) || '.1/' when 3 then 'http://a.example:' || (8079 + k % 3) || '/x' else 'http://203.0.' || (112 + k % 3) || '.9/' end as url from {_BASE})
select k, url, case k % 5 when 0 then regexp_matches({_host('url')}, '^docs') or {_port('url')} = '8080' when 1 then true when 2 then k % 256 < 128 when 3 then k % 3 = 1 else k % 3 = 1 end as excluded from u""")
def _exclusion(s, d):
    """Patterns, private and own networks, ports and an autonomous system."""
    k = F.col("k")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    u = F.when(k % 5 == 0, F.col("url")).when(k % 5 == 1, text("http://10.1.2.", k % 256, "/")).when(k % 5 == 2, text("http://8.8.", k % 256, ".1/")).when(k % 5 == 3, text("http://a.example:", k % 3 + 8079, "/x")).otherwise(text("http://203.0.", k % 3 + 112, ".9/"))
    asn = s.createDataFrame([("64500", "203.0.113.0/24"), ("64501", "203.0.112.0/24")], "asn string, network string")
    return _base(s, d).select("k", u.alias("url")).select("k", "url", gates.excluded_url(F.col("url"), _RULES, asn).alias("excluded"))


@query("dsl_headers", f"select result_id from {_ONE} where contains(lower(coalesce(response.headers['content-type'][1], response.headers['Content-Type'][1], response.headers['Content-type'][1], request.headers['content-type'][1], '')), 'html')".replace("[1]", ""))
def _dsl_headers(s, d):
    return dsl.chosen(_one(s, d), match_dsl="contains(to_lower(content_type), 'html')").select("result_id")


@query("recall_found", "select count(distinct p) as expected, count(distinct case when x % 3 = 0 then p end) as matched, cast(floor(count(distinct case when x % 3 = 0 then p end) * 100 / count(distinct p)) as bigint) as percent from (select min(k) as x, p from (select k, '/' || k as p from " + _BASE + ") group by p)")
def _recall_found(s, d):
    b = _base(s, d).select("k", F.concat(F.lit("/"), F.col("k").cast("string")).alias("path"))
    return output.recall(b, b.filter("k % 3 = 0"))


@query("two_roots", f"""with b as (select url, k from {_BASE}) select 'https://t' || k || '.example/x' as url, 't' || k || '.example' as root_host from b""")
def _two_roots(s, d):
    """Each target is linked from an out-of-scope root whose url is smaller, and from its own: the second link counts."""
    b = _base(s, d).select(F.col("k").cast("string").alias("k"))
    seeds = b.select(F.explode(F.array(F.concat(F.lit("https://a"), "k", F.lit(".example/")), F.concat(F.lit("https://t"), "k", F.lit(".example/")))).alias("url"))
    links = b.select(F.explode(F.array(F.concat(F.lit("https://a"), "k", F.lit(".example/")), F.concat(F.lit("https://t"), "k", F.lit(".example/")))).alias("source"), F.concat(F.lit("https://t"), "k", F.lit(".example/x")).alias("url"))
    links = links.select("source", "url", F.lit("a").alias("tag"), F.lit("href").alias("attribute"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"), F.lit(0).alias("position"))
    seen, _ = crawl.traverse(seeds.select("url", F.lower(ur.hostname("url")).alias("root_host")), links, CrawlConfig(max_depth=1, scope=Scope(field="fqdn")))
    return seen.filter("depth = 1").select("url", "root_host")


@query("crawl_extension_match", f"""select 'https://m.example/' || k || '.' || e as url from {_BASE}, (values ('php'), ('html')) as v(e)""")
def _extension_match(s, d):
    b = _base(s, d).select(F.col("k").cast("string").alias("k"))
    links = b.select(F.explode(F.transform(F.array(*map(F.lit, ("php", "html", "css", "zip"))), lambda e: F.concat(F.lit("https://m.example/"), "k", F.lit("."), e))).alias("url"))
    links = links.select(F.lit("https://m.example/").alias("source"), "url", F.lit("a").alias("tag"), F.lit("href").alias("attribute"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"), F.lit(0).alias("position"))
    seeds = s.createDataFrame([("https://m.example/", "m.example")], "url string, root_host string")
    seen, _ = crawl.traverse(seeds, links, CrawlConfig(max_depth=1, extension_match=("php", ".html")))
    return seen.filter("depth = 1").select("url")


@query("path_climb", f"select 'https://c.example/' || p as url, depth from (select 'a' || k || t as p, d as depth from {_BASE}, (values ('/b/c.html', 1), ('/b', 0), ('', 0)) as v(t, d)) union all select 'https://c.example/', 0")
def _climb(s, d):
    """Each page leads up to the folders above it, one level nearer to the root."""
    u = F.concat(F.lit("https://c.example/a"), F.col("k").cast("string"), F.lit("/b/c.html"))
    links = _base(s, d).select(F.lit("https://c.example/").alias("source"), u.alias("url"), F.lit("a").alias("tag"), F.lit("href").alias("attribute"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"), F.lit(0).alias("position"))
    seeds = s.createDataFrame([("https://c.example/", "c.example")], "url string, root_host string")
    seen, _ = crawl.traverse(seeds, links, CrawlConfig(max_depth=2, path_climb=True))
    return seen.select("url", "depth")


_REFS_AT = [("../x{k}", "https://h.example/d1/x{k}"), ("y{k}?a=b c", "https://h.example/d1/d2/y{k}?a=b%20c"), ("//cdn.example/{k}", "https://cdn.example/{k}"), ("?q={k}", "https://h.example/d1/d2/p.html?q={k}"), ("#f{k}", ""), ("http://o.example/{k}#f", "http://o.example/{k}"), (" /r{k} ", "https://h.example/r{k}"), ("mailto:m{k}@a.example", "mailto:m{k}@a.example"), ("./././z{k}/", "https://h.example/d1/d2/z{k}/")]


@query("resolved_refs", f"select replace(r, '{{k}}', cast(k as varchar)) as ref, replace(t, '{{k}}', cast(k as varchar)) as url from {_BASE}, (values {', '.join(f'({_quoted(r)}, {_quoted(t)})' for r, t in _REFS_AT)}) as v(r, t)")
def _resolved_refs(s, d):
    ref = F.explode(F.array(*(_with_k(r) for r, _ in _REFS_AT))).alias("ref")
    return _base(s, d).select(ref).select("ref", ur.abs_url(F.lit("https://h.example/d1/d2/p.html"), "ref").alias("url"))


@query("has_response", f"select result_id, response is not null and response.raw is not null as ok from {_ONE}")
def _has_response(s, d):
    r = _one(s, d)
    return r.select("result_id", gates.has_response(r).alias("ok"))


@query("stream_unique_within", f"select distinct case when coalesce(upper(m), 'GET') = 'GET' then url when upper(m) = 'POST' then concat_ws(':', url, body) else concat_ws(':', upper(m), url) end as key from (select request.endpoint as url, request.method as m, request.body as body from results where timestamp is not null) where {_host('url')} <> ''")
def _unique_within(s, d):
    """Requests once within the watermark; what is older leaves the state."""
    import os

    name = f"{d}/results.parquet"
    source = name if not os.path.isfile(name) else f"{d}/results[.]parquet"
    rows = streams.read(s, source, table(s, d, "results").schema).filter("timestamp is not null").select("timestamp", F.col("request.endpoint").alias("url"), "request.method", "request.body")
    return streams.run_to_end(streams.unique_within(rows, "timestamp", "3650 days").select("key"), "within")


_SITE = "'https://s' || g || '.example/'"


def _answer(method: str, url: str, body: str | None, limits: Limits):
    """A site of one page, its two children, and one that fails."""
    if url.endswith("/"):
        return 200, {"content-type": "text/html", "link": "</h>; rel=next"}, f'<a href="/one">1</a><a href="/two?x=1">2</a><a href="https://elsewhere.example/">3</a>{limits.headers.get("x", "")}', None, None
    if url.endswith("/one"):
        return 200, {}, '<a href="/deep">d</a>', None, None
    return (None, {}, None, None, "refused") if url.endswith("/h") else (404, {}, "no", None, None)


@query("live_crawl", f"""with g as (select distinct k % 50 as g from {_BASE}) select {_SITE} || p as url, depth, fetched, status_code from g, (values ('', 0, true, 200), ('one', 1, true, 200), ('two?x=1', 1, true, 404), ('h', 1, false, null), ('deep', 2, true, 404)) as v(p, depth, fetched, status_code)""")
def _live(s, d):
    """The live loop over a made-up web of fifty sites."""
    seeds = _base(s, d).select(F.concat(F.lit("https://s"), (F.col("k") % 50).cast("string"), F.lit(".example/")).alias("url")).distinct()
    r = crawl.live(seeds, CrawlConfig(max_depth=2), Limits(per_second=1e6, retries=0), _answer, 4).results
    return r.select("request.endpoint", "depth", F.col("response").isNotNull().alias("fetched"), "response.status_code").withColumnRenamed("endpoint", "url")


# writing
_PIPE = output.OutputConfig(format="template", template="{{fqdn}} {{path}}", store_fields="fqdn,key", match_dsl="status_code == 200", drop=("/shop/",), store_responses=True, omit_raw=True, omit_body=True)
_KEPT = f"(select * from {_ONE} where response.status_code = 200 and not contains(request.endpoint, '/shop/') and request.endpoint is not null)"
_STORED = f"(select distinct {_host('url')} as h, sha1(url) as f, url from (select request.endpoint as url from {_KEPT}))"


@query("write_pipeline", f"""with e as (select request.endpoint as url from {_ONE}),
lines as (select 'line' as part, {_host('url')} || ' ' || url_decode({_raw_path('url')}) as value from (select request.endpoint as url from {_KEPT}) where {_host('url')} <> '' and {_raw_path('url')} <> ''),
pairs as (select url, unnest(list_filter(string_split({_query('url')}, '&'), lambda x: x <> '' and not starts_with(x, '='))) as p from e),
fields as (select distinct 'field' as part, v as value from (select 'fqdn ' || {_host('url')} as v from e where {_host('url')} <> '' and regexp_matches(url, '^[a-zA-Z]') union all select 'key ' || url_decode(replace(split_part(p, '=', 1), '+', ' ')) from pairs where {_host('url')} <> '' and regexp_matches(url, '^[a-zA-Z]'))),
stored as (select 'stored' as part, replace(h || case when {_port('url')} <> '' then ':' || {_port('url')} else '' end, ':', '_') || '/' || f || '.txt' as value from {_STORED})
select * from lines union all select * from fields union all select * from stored""")
def _pipeline(s, d):
    out = output.pipeline(_one(s, d), _PIPE)
    part = lambda df, name, c: df.select(F.lit(name).alias("part"), c.alias("value"))
    fields = out.fields.select(F.concat_ws(" ", "field", "value").alias("value")).distinct()
    return part(out.lines, "line", F.col("value")).unionByName(part(fields, "field", F.col("value"))).unionByName(part(out.responses, "stored", F.col("path")))


@query("stored_fields_all", f"""with p as (select distinct url, p from {_PAIRS.replace('frontier', '(select request.endpoint as url from ' + _ONE + ') q')}),
e as (select distinct url from {_E} where {_host('url')} <> '' and regexp_matches(url, '^[a-zA-Z]'))
select distinct 'rurl' as field, {_root('url')} as value from e union select distinct 'path', url_decode({_raw_path('url')}) from e where {_raw_path('url')} <> '' union select distinct 'own', v from (select unnest(request.custom_fields['price']) as v, request.endpoint as url from {_ONE}) where v is not null and {_host('url')} <> ''""")
def _stored_all(s, d):
    r = _one(s, d)
    got = output.stored_fields(r, "rurl,path,price", ["price"])
    return got.select(F.when(F.col("field") == "price", "own").otherwise(F.col("field")).alias("field"), "value").distinct()


@query("json_fields", f"select result_id, request.endpoint as endpoint, response.status_code as status_code, response.body is not null as has_body from {_ONE}")
def _json_fields(s, d):
    """The JSON lines read back: what was excluded or blanked is gone, the rest is there."""
    lines = output.json_lines(output.exclude_fields(output.without(_one(s, d), raw=True), ["headers", "technologies"]))
    g = lambda p: F.get_json_object("value", p)
    rows = lines.filter(~F.contains("value", F.lit('"technologies":[')))
    return rows.select(g("$.result_id").cast("long").alias("result_id"), g("$.request.endpoint").alias("endpoint"), g("$.response.status_code").cast("int").alias("status_code"), g("$.response.body").isNotNull().alias("has_body"))
