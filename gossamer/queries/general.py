"""Queries of hierarchies (problem 5) and nested records (problem 6), with their SQL."""

from __future__ import annotations

from gossamer.operators import hierarchy, shred
from gossamer.sources.tables import table

QUERIES = {
    "p5_found": lambda s, d: hierarchy.found(table(s, d, "frontier")),
    "p5_paths": lambda s, d: hierarchy.paths(table(s, d, "frontier")),
    "p5_descendants": lambda s, d: hierarchy.descendants(table(s, d, "frontier")),
    "p6_found": lambda s, d: shred.children(table(s, d, "results")),
    "p6_requests": lambda s, d: shred.requests(table(s, d, "results")),
    "p6_forms": lambda s, d: shred.forms(table(s, d, "results")),
    "p6_xhr_requests": lambda s, d: shred.xhr_requests(table(s, d, "results")),
    "p6_records": lambda s, d: shred.records(table(s, d, "results")),
    "p6_responses": lambda s, d: shred.responses(table(s, d, "results")),
    "p6_technologies": lambda s, d: shred.technologies(table(s, d, "results")),
    "p6_form_parameters": lambda s, d: shred.form_parameters(table(s, d, "results")),
    "p6_headers": lambda s, d: shred.headers(table(s, d, "results")),
    "p6_custom_fields": lambda s, d: shred.custom_fields(table(s, d, "results")),
}

_LINKS = r"""
with recursive first as (
  select url, arg_min(struct_pack(s := source), edge_id).s as source from frontier where url is not null group by url),
p as (select url, nullif(regexp_replace(split_part(regexp_replace(source, '^[\s ]+', ''), '#', 1), '[\s ]+$', ''), '') as parent from first),
l as (select p.url, q.url as parent from p left join p q on p.parent = q.url),
t as (select url, url as root_url, 0 as depth, [url] as path from l where parent is null
  union all select l.url, t.root_url, t.depth + 1, list_append(t.path, l.url) from l join t on l.parent = t.url)
"""

_RECORDS = "with r as (select distinct on (result_id) result_id, request, response from results where result_id is not null)"
_XHR = ", x as (select result_id, unnest(response.xhr_requests) v, generate_subscripts(response.xhr_requests, 1) i from r)"

SQL = {
    "p5_found": _LINKS + "select l.url, coalesce(t.root_url, '') as root_url, cast(coalesce(t.depth, -1) as int) as depth from l left join t on l.url = t.url",
    "p5_paths": _LINKS + "select l.url, coalesce(t.root_url, '') as root_url, cast(coalesce(t.depth, -1) as int) as depth, t.path as path from l left join t on l.url = t.url",
    "p5_descendants": _LINKS + "select a as url, url as descendant, cast(depth + 1 - i as int) as distance from (select url, depth, unnest(path) as a, generate_subscripts(path, 1) as i from t) where i <= depth",
    "p6_found": """
with r as (select distinct on (result_id) result_id, request, response from results where result_id is not null),
te as (select result_id, unnest(response.technologies) v, generate_subscripts(response.technologies, 1) i from r),
fo as (select result_id, unnest(response.forms) v, generate_subscripts(response.forms, 1) i from r),
fp as (select result_id, i as pi, unnest(v.parameters) v, generate_subscripts(v.parameters, 1) i from fo where v is not null),
xr as (select result_id, unnest(response.xhr_requests) v, generate_subscripts(response.xhr_requests, 1) i from r),
xh as (select result_id, i as pi, unnest(map_keys(v.headers)) k from xr where v is not null),
xc as (select result_id, i as pi, unnest(map_entries(v.custom_fields)) e from xr where v is not null),
xv as (select result_id, pi, e.key k, unnest(e.value) v, generate_subscripts(e.value, 1) i from xc),
rc as (select result_id, unnest(map_entries(request.custom_fields)) e from r),
rv as (select result_id, e.key k, unnest(e.value) v, generate_subscripts(e.value, 1) i from rc)
select result_id, 'technology' as entity, 0::int as parent_pos, i::int as pos, '' as name from te where v is not null
union all select result_id, 'form', 0, i::int, '' from fo where v is not null
union all select result_id, 'form_parameter', pi::int, i::int, '' from fp where v is not null
union all select result_id, 'xhr_request', 0, i::int, '' from xr where v is not null
union all select result_id, 'xhr_header', pi::int, 0, k from xh
union all select result_id, 'xhr_custom_field', pi::int, i::int, k from xv where v is not null
union all select result_id, 'request_custom_field', 0, i::int, k from rv where v is not null""",
    "p6_records": "select result_id, min(timestamp) at time zone 'UTC' as timestamp, min(received_at) at time zone 'UTC' as received_at, min(error) as error from results where result_id is not null group by 1",
    "p6_responses": """select distinct on (result_id) result_id, 0::int as parent_pos, 0::int as pos, response.status_code as status_code, response.content_length as content_length, response.body as body, response.raw as raw,
response.stored_response_path as stored_response_path from results where result_id is not null and response is not null""",
    "p6_technologies": _RECORDS + ", x as (select result_id, unnest(response.technologies) v, generate_subscripts(response.technologies, 1) i from r) select result_id, 0::int as parent_pos, i::int as pos, v as value from x where v is not null",
    "p6_form_parameters": _RECORDS + """, f as (select result_id, unnest(response.forms) v, generate_subscripts(response.forms, 1) i from r),
x as (select result_id, i as pi, unnest(v.parameters) v, generate_subscripts(v.parameters, 1) i from f where v is not null) select result_id, pi::int as parent_pos, i::int as pos, v as value from x where v is not null""",
    "p6_headers": _RECORDS + _XHR + """, e as (select result_id, 'request' as owner, 0 as p, unnest(map_entries(request.headers)) e from r union all select result_id, 'response', 0, unnest(map_entries(response.headers)) from r
union all select result_id, 'xhr_request', i, unnest(map_entries(v.headers)) from x where v is not null) select result_id, owner, p::int as parent_pos, 0::int as pos, e.key as name, e.value as value from e""",
    "p6_custom_fields": _RECORDS + _XHR + """, e as (select result_id, 'request' as owner, 0 as p, unnest(map_entries(request.custom_fields)) e from r union all select result_id, 'xhr_request', i, unnest(map_entries(v.custom_fields)) from x where v is not null),
y as (select result_id, owner, p, e.key as name, list_filter(list_zip(e.value, range(1, len(e.value) + 1)), lambda z: z[1] is not null) as vs from e),
z as (select result_id, owner, p, name, unnest(case when len(vs) > 0 then vs else [null] end) as v from y) select result_id, owner, p::int as parent_pos, v[2]::int as pos, name, v[1] as value from z""",
    "p6_requests": """select distinct on (result_id) result_id, request.method as method, request.endpoint as endpoint, request.body as body, request.tag as tag, request.attribute as attribute, request.source as source, request.raw as raw
from results where result_id is not null and request is not null""",
    "p6_forms": """with r as (select distinct on (result_id) result_id, response.forms f from results where result_id is not null),
x as (select result_id, unnest(f) v, generate_subscripts(f, 1) i from r)
select result_id, i::int as pos, v.method as method, v.action as action, v.enctype as enctype from x where v is not null""",
    "p6_xhr_requests": """with r as (select distinct on (result_id) result_id, response.xhr_requests f from results where result_id is not null),
x as (select result_id, unnest(f) v, generate_subscripts(f, 1) i from r)
select result_id, i::int as pos, v.method as method, v.endpoint as endpoint, v.body as body, v.tag as tag, v.attribute as attribute, v.source as source, v.raw as raw from x where v is not null""",
}
