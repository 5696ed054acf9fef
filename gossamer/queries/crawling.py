"""Queries of the crawl operators over the crawl tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.config import CrawlConfig
from gossamer.functions import text as tx
from gossamer.functions import url as ur
from gossamer.operators import custom_fields, dsl, extract, forms, gates, technologies
from gossamer.operators.gates import Scope
from gossamer.plans import crawl, output
from gossamer.plans.staging import stage
from gossamer.sources.known_files import known_links
from gossamer.sources.seeds import normal_seeds
from gossamer.sources.tables import has_table, table
from gossamer.streaming import links as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "responses").select("response_id", "url", "status_code", "headers", "body", "redirect_to")


# SQL pieces: parts of a URL
def _host(u: str) -> str:
    return rf"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"


def _port(u: str) -> str:
    return rf"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#:]*:(\d+)', 1)"


def _raw_path(u: str) -> str:
    return rf"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"


def _path(u: str) -> str:
    return f"url_decode({_raw_path(u)})"


def _root(u: str) -> str:
    return f"lower(split_part({u}, '://', 1)) || '://' || {_host(u)} || case when {_port(u)} <> '' then ':' || {_port(u)} else '' end"


def _query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


_PAIRS = f"(select url, unnest(list_filter(string_split({_query('url')}, '&'), lambda x: x <> '' and not starts_with(x, '='))) as p from (select distinct url from frontier))"
_K = "url_decode(replace(split_part(p, '=', 1), '+', ' '))"
_V = "url_decode(replace(case when contains(p, '=') then substr(p, instr(p, '=') + 1) else '' end, '+', ' '))"
_DIR = rf"regexp_extract({_path('url')}, '(?s)^(/.*/)[^/]*$', 1)"
_FILE = rf"regexp_extract({_path('url')}, '([^/]*)/*$', 1)"
_HAS = f"len(list_filter(string_split({_query('url')}, '&'), lambda x: x <> '' and not starts_with(x, '='))) > 0"
_U = "(select distinct url from frontier where url is not null)"
_EU = "(select distinct trim(request.endpoint, ' ') as url from results where trim(request.endpoint, ' ') <> '')"
_RDN = "array_to_string(list_slice(string_split(lower(h), '.'), greatest(len(string_split(h, '.')) - 1, 1), len(string_split(h, '.'))), '.')"

FIELD_SQL = {
    "url": f"select url, url as value from {_U}",
    "path": f"select url, {_path('url')} as value from {_U} where {_path('url')} <> ''",
    "fqdn": f"select url, {_host('url')} as value from {_U} where {_host('url')} <> ''",
    "rdn": f"select url, {_RDN} as value from (select url, {_host('url')} as h from {_U}) where h <> ''",
    "rurl": f"select url, {_root('url')} as value from {_U} where {_host('url')} <> ''",
    "qurl": f"select url, url as value from {_U} where {_HAS}",
    "qpath": f"select url, {_path('url')} || '?' || {_query('url')} as value from {_U} where {_HAS}",
    "file": f"select url, {_FILE} as value from {_EU} where contains({_FILE}, '.')",
    "ufile": f"select url, url as value from {_EU} where contains({_FILE}, '.')",
    "key": f"select distinct url, {_K} as value from {_PAIRS}",
    "value": f"select distinct url, {_V} as value from {_PAIRS}",
    "kv": f"select distinct url, {_K} || '=' || {_V} as value from {_PAIRS}",
    "dir": f"select url, {_DIR} as value from {_U} where {_DIR} <> ''",
    "udir": f"select url, {_root('url')} || {_DIR} as value from {_U} where {_DIR} <> ''",
}


def _urls(s: SparkSession, d: str, name: str) -> DataFrame:
    """Frontier urls have no file names; those fields are taken from the results' endpoints."""
    u = table(s, d, "results").select(F.trim("request.endpoint").alias("url")).filter("url <> ''") if name in ("file", "ufile") else table(s, d, "frontier").select("url").filter("url is not null")
    return u.distinct()


for _n in ur.FIELDS:
    QUERIES[f"field_{_n}"] = lambda s, d, n=_n: _urls(s, d, n).select("url", F.explode(ur.field(n)).alias("value")).distinct()
    SQL[f"field_{_n}"] = FIELD_SQL[_n]


@query("seeds_normal", r"""with t as (select regexp_replace(regexp_replace(url, '^[\s\x{a0}]+', ''), '[\s\x{a0}]+$', '') as u from seeds),
n as (select distinct case when starts_with(u, 'http://') or starts_with(u, 'https://') then u when regexp_extract(u, '^[^/?#]*:(\d+)', 1) in ('80', '8080') then 'http://' || u else 'https://' || u end as url from t where u <> '')
select url, lower(""" + _host("url") + ") as root_host from n")
def _seeds(s, d):
    return normal_seeds(table(s, d, "seeds"))


@query("is_url", f"select edge_id, {_host('url')} <> '' as ok from (select distinct edge_id, url from frontier where url is not null)")
def _is_url(s, d):
    return table(s, d, "frontier").filter("url is not null").select("edge_id", ur.is_url("url").alias("ok")).distinct()


@query("parent_paths", f"""with u as (select distinct url, {_root('url')} as r, list_filter(string_split({_raw_path('url')}, '/'), lambda x: x <> '') as p from frontier where url is not null)
select url, r || '/' || array_to_string(list_slice(p, 1, i), '/') as parent from (select url, r, p, unnest(generate_series(1, len(p) - 1)) as i from u where len(p) > 1)""")
def _parents(s, d):
    return table(s, d, "frontier").filter("url is not null").select("url").distinct().select("url", F.explode(ur.parent_paths("url")).alias("parent"))


@query("blank_query", f"""select distinct url, regexp_extract(url, '^([^?#]*)', 1) || case when len(k) > 0 then '?' || array_to_string(list_transform(k, lambda x: split_part(x, '=', 1) || '='), '&') else '' end as blanked
from (select url, list_filter(string_split({_query('url')}, '&'), lambda x: x <> '') as k from frontier where url is not null)""")
def _blank(s, d):
    return table(s, d, "frontier").filter("url is not null").select("url", ur.blank_query("url").alias("blanked")).distinct()


_KEY_SQL = "case when coalesce(upper(method), 'GET') = 'GET' then url when upper(method) = 'POST' then concat_ws(':', url, body) else concat_ws(':', upper(method), url) end"


@query("request_unique", f"select {_KEY_SQL} as key, min(edge_id) as edge_id from frontier where {_host('url')} <> '' group by 1")
def _unique(s, d):
    f = table(s, d, "frontier").filter(ur.is_url("url"))
    return f.groupBy(ur.request_key("method", "url", "body").alias("key")).agg(F.min("edge_id").alias("edge_id"))


@query("request_unique_ignoring_query", f"""with b as (select edge_id, method, body, regexp_extract(url, '^([^?#]*)', 1) || case when len(k) > 0 then '?' || array_to_string(list_transform(k, lambda x: split_part(x, '=', 1) || '='), '&') else '' end as url
from (select *, list_filter(string_split({_query('url')}, '&'), lambda x: x <> '') as k from frontier where {_host('url')} <> ''))
select {_KEY_SQL} as key, min(edge_id) as edge_id from b group by 1""")
def _unique_blank(s, d):
    f = table(s, d, "frontier").filter(ur.is_url("url"))
    return f.groupBy(ur.request_key("method", ur.blank_query("url"), "body").alias("key")).agg(F.min("edge_id").alias("edge_id"))


@query("store_path", f"select distinct url, replace({_host('url')} || case when {_port('url')} <> '' then ':' || {_port('url')} else '' end, ':', '_') || '/' || sha1(url) || '.txt' as path from frontier where url is not null")
def _store(s, d):
    return table(s, d, "frontier").filter("url is not null").select("url", ur.store_path("url").alias("path")).distinct()


# scope
_HOSTS = f"(select distinct edge_id, url, lower({_host('url')}) as h, lower(root_host) as r from frontier where url is not null and root_host is not null)"
_RDN_R = _RDN.replace("lower(h)", "r").replace("string_split(h, '.')", "string_split(r, '.')")
_SCOPES = {
    "scope_rdn": (Scope(), f"ends_with(h, {_RDN_R})"),
    "scope_dn": (Scope(field="dn"), f"contains(h, split_part({_RDN_R}, '.', 1))"),
    "scope_fqdn": (Scope(field="fqdn"), "h = r"),
    "scope_pattern": (Scope(field=r"^(docs|blog)\."), r"regexp_matches(h, '^(docs|blog)\.')"),
    "scope_url_rules": (Scope(include=("/notes/", "/help/"), exclude=(r"id=\d*7",), field="fqdn"), r"h = r and not regexp_matches(url, 'id=\d*7') and regexp_matches(url, '/notes/|/help/')"),
}
for _n, (_scope, _sql) in _SCOPES.items():
    QUERIES[_n] = lambda s, d, c=_scope: table(s, d, "frontier").filter("url is not null and root_host is not null").select("edge_id", gates.in_scope(F.col("url"), F.col("root_host"), c).alias("ok")).distinct()
    SQL[_n] = f"select edge_id, {_sql} as ok from {_HOSTS}"

# extensions
_EXT = rf"lower(regexp_extract(case when {_raw_path('url')} = '' then regexp_replace(url, '(?s)[?#].*$', '') else {_raw_path('url')} end, '(\.[^./]*)$', 1))"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_EXTS = {
    "extension_default": ((), (), True, f"{_EXT} not in {_LIST(gates.DENIED)}"),
    "extension_match": (("php", ".HTML"), (), True, f"{_EXT} in ('.php', '.html')"),
    "extension_deny": ((), ("html",), False, f"{_EXT} not in ('.html')"),
}
for _n, (_m, _d, _on, _sql) in _EXTS.items():
    QUERIES[_n] = lambda s, d, m=_m, x=_d, on=_on: table(s, d, "results").select(F.trim("request.endpoint").alias("url")).filter("url <> ''").distinct().select("url", gates.extension_allowed(F.col("url"), m, x, on).alias("ok"))
    SQL[_n] = f"select url, {_sql} as ok from (select distinct trim(request.endpoint, ' ') as url from results) where url <> ''"


@query("content_first", """with r as (select distinct response_id, body from responses)
select response_id, md5(body) as content_hash, body is null or response_id = min(response_id) over (partition by body) as is_first from r""")
def _content(s, d):
    return gates.first_content(_pages(s, d).select("response_id", "body").distinct()).select("response_id", "content_hash", "is_first")


_REFS = """select distinct url as source, unnest(regexp_extract_all(body, '<a href="([^"]*)"', 1)) as ref from responses where url is not null and body is not null"""


@query("links_markup", f"select source, ref, 'a' as tag, 'href' as attribute from ({_REFS}) where ref <> ''")
def _links(s, d):
    return extract.page_links(_pages(s, d).withColumn("headers", F.lit(None).cast("map<string,string>"))).select("source", "ref", "tag", "attribute").distinct()


@query("links_resolved", f"select distinct source, {_root('source')} || ref as url from ({_REFS}) where starts_with(ref, '/')")
def _resolved(s, d):
    return extract.page_links(_pages(s, d).withColumn("headers", F.lit(None).cast("map<string,string>"))).filter("url <> ''").select("source", "url").distinct()


_H = "(select distinct url, map_from_entries(list_transform(map_entries(headers), lambda e: {'k': lower(e.key), 'v': e.value})) as h from responses where headers is not null and url is not null)"


@query("links_headers", "select distinct url, redirect_to as ref, 'header' as tag, 'location' as attribute from responses where url is not null and redirect_to <> ''")
def _headers(s, d):
    """The table keeps a redirect's target apart; here it is a header again."""
    own = F.when(F.col("redirect_to").isNotNull(), F.create_map(F.lit("Location"), "redirect_to"))
    p = _pages(s, d).filter("url is not null").withColumn("headers", F.when(F.col("headers").isNull(), own).when(own.isNull(), F.col("headers")).otherwise(F.map_concat("headers", own)))
    return p.select("url", F.explode(extract.header_links(F.col("headers"))).alias("l")).select("url", "l.ref", "l.tag", "l.attribute").distinct()


@query("links_scripts")
def _scripts(s, d):
    """Script documents as files of their source, and the script elements of all fetched pages, where the folder has any."""
    docs = table(s, d, "documents").filter("kind = 'script'").select(F.concat(F.lit("https://"), F.coalesce("source", F.lit("unknown.invalid")), F.lit("/"), "doc_id", F.lit(".js")).alias("url"), F.lit(None).cast("map<string,string>").alias("headers"), F.col("text").alias("body"))
    pages = _pages(s, d).select("url", "headers", "body") if has_table(s, d, "responses") else docs.limit(0)
    return extract.script_links(docs.unionByName(pages)).distinct()


@query("header_text", """select distinct response_id, array_to_string(list_transform(list_sort(map_entries(headers)), lambda e: lower(e.key) || ': ' || coalesce(e.value, '')), chr(10)) as head from responses where headers is not null""")
def _head(s, d):
    return table(s, d, "responses").filter("headers is not null").select("response_id", tx.header_text(tx.lower_keys(F.col("headers"))).alias("head")).distinct()


@query("known_robots", """with l as (select root, unnest(string_split(replace(content, chr(13), ''), chr(10))) as line from known_files where kind = 'robots.txt' and content is not null),
r as (select root, trim(substr(line, instr(line, ': ') + 2)) as ref, lower(split_part(line, ': ', 1)) as name from l where contains(line, ': '))
select distinct root as source, case when starts_with(ref, '/') then regexp_replace(root, '/+$', '') || ref else ref end as url from r where (starts_with(name, 'allow') or name = 'disallow') and ref <> ''""")
def _robots(s, d):
    return known_links(table(s, d, "known_files"), "robotstxt").select("source", "url").distinct()


@query("known_sitemaps", """with e as (select root, unnest(regexp_extract_all(content, '(?s)<loc>(.*?)</loc>', 1)) as loc from known_files where kind = 'sitemap.xml' and content is not null)
select distinct root as source, regexp_replace(regexp_replace(loc, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '&amp;', '&', 'g') as url from e where trim(loc) <> ''""")
def _sitemaps(s, d):
    return known_links(table(s, d, "known_files"), "sitemapxml").select("source", "url").distinct()


@query("custom_field_email", f"select doc_id, unnest(regexp_extract_all(text || ' write to desk' || doc_id || '@' || coalesce(source, 'a.example') || ' today', '{tx.EMAIL}', 1)) as value from documents where text is not null")
def _email(s, d):
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", F.concat("text", F.lit(" write to desk"), F.col("doc_id").cast("string"), F.lit("@"), F.coalesce("source", F.lit("a.example")), F.lit(" today")).alias("body"))
    return custom_fields.evaluate(docs, custom_fields.DEFAULT, "doc_id").select("doc_id", F.explode(F.col("custom_fields")["email"]).alias("value"))


@query("custom_field_codes", r"""select response_id, unnest(regexp_extract_all(body, '([a-z]+)-[0-9a-f]{4,5}\b', 1)) as value from (select distinct response_id, body from responses where body is not null)""")
def _codes(s, d):
    r = table(s, d, "responses").select("response_id", "body", "headers").dropDuplicates(["response_id"])
    own = (custom_fields.CustomField("codes", (r"([a-z]+)-[0-9a-f]{4,5}\b",), "body", 1),)
    return custom_fields.evaluate(r, own, "response_id").select("response_id", F.explode(F.col("custom_fields")["codes"]).alias("value"))


@query("custom_field_values", """with c as (select distinct on (result_id) result_id, request.custom_fields as m from results)
select result_id, e.key as field, unnest(e.value) as value from (select result_id, unnest(map_entries(m)) as e from c where m is not null)""")
def _custom(s, d):
    r = table(s, d, "results").select("result_id", F.col("request.custom_fields").alias("m")).dropDuplicates(["result_id"])
    return r.select("result_id", F.explode("m").alias("field", "v")).select("result_id", "field", F.explode("v").alias("value"))


def _sql_text(p: str) -> str:
    return p.replace("'", "''")


@query("body_endpoints", f"select doc_id, unnest(list_distinct(regexp_extract_all(text, '{_sql_text(tx.BODY_ENDPOINT)}', 1))) as endpoint from documents where text is not null")
def _body_endpoints(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.explode(tx.body_endpoints(F.col("text"))).alias("endpoint"))


@query("script_endpoints", f"select doc_id, unnest(list_distinct(regexp_extract_all(text, '{_sql_text(tx.SCRIPT_ENDPOINT)}', 1))) as endpoint from documents where text is not null")
def _script_endpoints(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.explode(tx.script_endpoints(F.col("text"))).alias("endpoint"))


_DSL = "status_code == 200 && contains(to_lower(body), 'javascript') || !(status_code < 500)"
_DSL_SQL = "coalesce((status_code = 200 and contains(lower(body), 'javascript')) or (not coalesce(status_code < 500, false)), false)"


@query("dsl_match", f"select distinct response_id from responses where {_DSL_SQL}")
def _match(s, d):
    r = table(s, d, "responses")
    return dsl.chosen(r, match_dsl=_DSL, subject=F.col("url")).select("response_id").distinct()


@query("dsl_filter", f"select distinct response_id from responses where not ({_DSL_SQL})")
def _filter(s, d):
    r = table(s, d, "responses")
    return dsl.chosen(r, drop_dsl=_DSL, subject=F.col("url")).select("response_id").distinct()


@query("regex_match", "select distinct response_id from responses where regexp_matches(url, '/notes/|-1\\d$') and not regexp_matches(url, 'shop')")
def _regex(s, d):
    return dsl.chosen(table(s, d, "responses"), match=["/notes/", r"-1\d$"], drop=["shop"], subject=F.col("url")).select("response_id").distinct()


@query("redirects", "select distinct response_id, coalesce(status_code between 300 and 399, false) as redirect from responses")
def _redirect(s, d):
    return table(s, d, "responses").select("response_id", gates.is_redirect(F.col("status_code")).alias("redirect")).distinct()


_NEXT = f"(select url, min(case when regexp_matches(redirect_to, '^[a-zA-Z]+:') then regexp_replace(redirect_to, '#.*$', '') else {_root('url')} || redirect_to end) as next from responses where url is not null and redirect_to is not null group by url)"


@query("redirect_chains", f"""with recursive h as {_NEXT}, c as (select distinct url, url as final_url, 0 as hops from responses where url is not null
union all select c.url, h.next, c.hops + 1 from c join h on h.url = c.final_url where c.hops < 10) select url, arg_max(final_url, hops) as final_url, cast(max(hops) as int) as hops from c group by url""")
def _chains(s, d):
    return crawl.redirect_chains(_pages(s, d))


_SEEDS = SQL["seeds_normal"]
_GOOD = f"{_EXT} not in {_LIST(gates.DENIED)}"


@query("crawl_levels", f"""with recursive s as ({_SEEDS}),
l as (select distinct regexp_replace(regexp_replace(split_part(source, '#', 1), '^\\s+', ''), '\\s+$', '') as source, url from frontier where url is not null and coalesce(upper(method), 'GET') = 'GET' and {_host('url')} <> '' and {_GOOD}),
b as (select url, 0 as depth from s union select l.url, b.depth + 1 from b join l on l.source = b.url where b.depth < 4)
select url, cast(min(depth) as int) as depth from b group by url""")
def _levels(s, d):
    f = table(s, d, "frontier").filter("url is not null and coalesce(upper(method), 'GET') = 'GET'")
    source = F.regexp_replace(F.regexp_replace(F.substring_index("source", "#", 1), r"^\s+", ""), r"\s+$", "")
    links = f.select(source.alias("source"), "url", "tag", "attribute", F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"), F.lit(0).alias("position")).distinct()
    links = stage(links, "links")
    seen, _ = crawl.traverse(normal_seeds(table(s, d, "seeds")), links, CrawlConfig(max_depth=4, scope=Scope(off=True)))
    return seen.select("url", "depth")


@query("crawl_snapshot")
def _snapshot(s, d):
    c = CrawlConfig(max_depth=3, known_files="all", path_climb=True)
    return crawl.crawl(_pages(s, d), table(s, d, "seeds"), c, table(s, d, "known_files")).results.select("request.endpoint", "request.tag", "depth", F.col("response").isNotNull().alias("fetched"))


@query("page_forms", "select distinct request.endpoint as url, 0::int as forms from results where response.body is null or not regexp_matches(response.body, '(?i)<form')")
def _forms(s, d):
    """Pages without forms; those of pages that have them are checked by forms_extracted."""
    r = table(s, d, "results").filter("response.body is null or not lower(response.body) like '%<form%'").select(F.col("request.endpoint").alias("url"), F.col("response.body").alias("body"))
    return forms.page_forms(r).select("url", F.size("forms").alias("forms")).distinct()


_ONE = "(select distinct on (result_id) * from results)"


def _one(s, d):
    return table(s, d, "results").drop("received_at").dropDuplicates(["result_id"])


@query("screen_lines", f"select request.endpoint as value from {_ONE} where request.endpoint <> ''")
def _screen(s, d):
    return output.screen_lines(_one(s, d))


@query("screen_verbose", f"""select concat_ws('', case when request.tag <> '' then '[' || request.tag || '] ' end, case when request.method <> '' then '[' || request.method || '] ' end, request.endpoint, case when request.body <> '' then ' [' || request.body || ']' end) as value
from {_ONE} where request.endpoint is not null""")
def _verbose(s, d):
    return output.screen_lines(_one(s, d), True)


_E = f"(select request.endpoint as url from {_ONE})"


@query("field_lines", f"select 'fqdn' as field, {_host('url')} as value from {_E} where {_host('url')} <> '' union all select 'file', {_FILE} from {_E} where contains({_FILE}, '.')")
def _field_lines(s, d):
    return output.field_lines(_one(s, d), "fqdn,file")


@query("template_lines", f"select 'host=' || {_host('url')} || ' dir=' || {_DIR} as value from {_E} where {_host('url')} <> '' and {_DIR} <> ''")
def _template(s, d):
    return output.template_lines(_one(s, d), "host={{fqdn}} dir={{dir}}")


@query("json_lines")
def _json(s, d):
    return output.json_lines(output.exclude_fields(output.without(_one(s, d), raw=True, body=True), ["headers", "technologies"]))


@query("stored_fields", f"select distinct lower(split_part(url, '://', 1)) as scheme, {_host('url')} as host, 'fqdn' as field, {_host('url')} as value from {_E} where {_host('url')} <> '' and regexp_matches(url, '^[a-zA-Z]')")
def _stored_fields(s, d):
    return output.stored_fields(_one(s, d), "fqdn")


@query("stored_responses", f"""select replace({_host('url')} || case when {_port('url')} <> '' then ':' || {_port('url')} else '' end, ':', '_') || '/' || sha1(url) || '.txt' as path, sha1(min(url || repeat(chr(10), 3) || coalesce(qraw, '') || repeat(chr(10), 2) || coalesce(rraw, body, ''))) as digest
from (select request.endpoint as url, request.raw as qraw, response.raw as rraw, response.body as body from {_ONE} where response is not null and request.endpoint is not null) group by url""")
def _stored(s, d):
    return output.stored_responses(_one(s, d)).select("path", F.sha1("content").alias("digest"))


@query("response_index", f"""select distinct replace({_host('url')} || case when {_port('url')} <> '' then ':' || {_port('url')} else '' end, ':', '_') || '/' || sha1(url) || '.txt' || ' ' || url || ' (' || coalesce(cast(st as varchar), '') || ')' as value
from (select request.endpoint as url, response.status_code as st from {_ONE} where response is not null and request.endpoint is not null)""")
def _index(s, d):
    return output.response_index(_one(s, d))


@query("error_lines", f"select cast(epoch_us(timestamp) as varchar) as at_us, request.endpoint as endpoint, request.source as source, error from {_ONE} where error <> ''")
def _errors(s, d):
    return output.errors(_one(s, d)).select(F.unix_micros("timestamp").cast("string").alias("at_us"), "endpoint", "source", "error")


@query("technologies", """with r as (select distinct on (response_id) response_id, headers as h, body from responses)
select response_id, t as technology from (select response_id, unnest(list_filter([
case when regexp_matches(h['server'], '(?i)\\bnginx') then 'nginx' end, case when regexp_matches(h['server'], '(?i)\\bapache') then 'Apache' end,
case when regexp_matches(h['x-powered-by'], '(?i)\\bphp') then 'PHP' end, case when regexp_matches(h['x-powered-by'], '(?i)\\bexpress') then 'Express' end,
case when regexp_matches(body, '(?i)/wp-(?:content|includes)/') then 'WordPress' end, case when regexp_matches(body, '(?i)<script[^>]+jquery[.\\-\\w]*\\.js') then 'jQuery' end], lambda x: x is not null)) as t from r)""")
def _technologies(s, d):
    return technologies.detect(table(s, d, "responses").dropDuplicates(["response_id"]), "response_id")


@query("recall", f"""with e as (select distinct {_path('url')} as path from frontier where url is not null), f as (select distinct {_path('url')} as path from (select request.endpoint as url from results))
select count(*) as expected, count(f.path) as matched, cast(floor(count(f.path) * 100 / count(*)) as bigint) as percent from e left join f using (path)""")
def _recall(s, d):
    e = table(s, d, "frontier").filter("url is not null").select(ur.path("url").alias("path"))
    return output.recall(e, table(s, d, "results").select(ur.path("request.endpoint").alias("path")))


@query("capped_bodies", """with r as (select distinct response_id, body from responses) select response_id, cast(case when body is null then null when strlen(body) <= 1000 then strlen(body)
else list_max(list_filter(list_transform(range(240, 1001), lambda n: strlen(left(body, n))), lambda b: b <= 1000)) end as int) as bytes from r""")
def _capped(s, d):
    return table(s, d, "responses").select("response_id", F.octet_length(gates.capped(F.col("body"), 1000)).alias("bytes")).distinct()


@query("stream_unique", f"select distinct {_KEY_SQL} as key from frontier where {_host('url')} <> ''")
def _stream(s, d):
    import os

    name = f"{d}/frontier.parquet"
    schema = table(s, d, "frontier").schema
    source = name if not os.path.isfile(name) else f"{d}/frontier[.]parquet"
    return streams.run_to_end(streams.unique_requests(streams.read(s, source, schema)).select("key"), "unique")


@query("stream_windows", f"""select epoch_us(timestamp) // 3600000000 * 3600 as window_start, lower({_host('request.endpoint')}) as host, count(*) as pages from results where timestamp is not null and request.endpoint is not null group by 1, 2""")
def _windows(s, d):
    import os

    name = f"{d}/results.parquet"
    schema = table(s, d, "results").schema
    source = name if not os.path.isfile(name) else f"{d}/results[.]parquet"
    rows = streams.read(s, source, schema).filter("request.endpoint is not null")
    done = streams.run_to_end(streams.pages_per_window(rows), "windows", "complete")
    return done.select(F.unix_seconds("window_start").alias("window_start"), "host", "pages")
