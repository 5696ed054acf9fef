"""Queries of the training-data operators, with their SQL."""

from __future__ import annotations

from gossamer.llm import abuse, endpoint_copies, main_content, near_copies, packing, repeated_lines, residue, tokens
from gossamer.sources.tables import table

QUERIES = {
    "p1_found": lambda s, d: repeated_lines.repeated_lines(table(s, d, "results")),
    "p1_pages": lambda s, d: repeated_lines.pages_without_repeats(table(s, d, "results")),
    "p2_found": lambda s, d: main_content.found(table(s, d, "results")),
    "p2_bodies": lambda s, d: main_content.main_bodies(table(s, d, "results")),
    "p3_found": lambda s, d: endpoint_copies.found(table(s, d, "results")),
    "p3_collapsed": lambda s, d: endpoint_copies.collapsed(table(s, d, "results")),
    "p4_found": lambda s, d: residue.found(table(s, d, "responses")),
    "p4_scores": lambda s, d: residue.judged(table(s, d, "responses")),
    "p7_found": lambda s, d: near_copies.found(table(s, d, "responses")),
    "p7_trees": lambda s, d: near_copies.tree_figures(table(s, d, "responses")),
    "p7_groups": lambda s, d: near_copies.near_groups(table(s, d, "responses")),
    "p8_ids": lambda s, d: tokens.encode(table(s, d, "documents")),
    "p10_found": lambda s, d: abuse.found(table(s, d, "documents"), table(s, d, "abuse_examples")),
    "p10_scores": lambda s, d: abuse.scores(table(s, d, "documents"), table(s, d, "abuse_examples")),
    "p10_rates": lambda s, d: abuse.rates(table(s, d, "documents"), table(s, d, "abuse_examples")),
    "p9_generations": lambda s, d: packing.generations(table(s, d, "documents")),
    "p9_pack": lambda s, d: packing.pack(table(s, d, "documents")),
}

_ENDPOINTS = r"""
with e as (select distinct result_id, request.endpoint as e from results where result_id is not null and trim(request.endpoint, E' \\t\\n\\r\\u00a0') <> ''),
s as (select result_id, split_part(e, '?', 1) as head, case when contains(e, '?') then substr(e, instr(e, '?') + 1) else '' end as tail from e),
k as (select result_id, regexp_replace(lower(url_decode(head)), '[^\p{L}\p{N}]+', '', 'g') as path,
  list_sort(list_filter([regexp_replace(lower(url_decode(f)), '[^\p{L}\p{N}]+', '', 'g') for f in string_split(tail, '&')], lambda f: f <> '')) as fields from s)
"""

# visible lines in SQL: hidden elements and tags are cut out, their line breaks stay; the named entities of the test tables are decoded
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{n}(?:[\s/][^>]*)?>.*?(?:</{n}\s*>|\z)" for n in ("head", "script", "style"))
_TAG = r"</?[a-zA-Z!?][^>]*>"
_ENTITIES = {"nbsp": " ", "middot": "·", "copy": "©", "mdash": "—", "ndash": "–", "raquo": "»", "laquo": "«", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "quot": '"', "#39": "''", "lt": "<", "gt": ">", "amp": "&"}


def _cut(column: str, pattern: str, put: str) -> str:
    breaks = "repeat(chr(10), cast(len(x[2]) - len(replace(x[2], chr(10), '')) as int))"
    return f"array_to_string(list_transform(list_zip(string_split_regex({column}, '{pattern}'), regexp_extract_all({column}, '{pattern}')), lambda x: coalesce(x[1], '') || case when x[2] is null then '' else '{put}' || {breaks} end), '')"


def _decoded(column: str) -> str:
    for name, c in _ENTITIES.items():
        column = f"replace({column}, '&{name};', '{c}')"
    return column


_LINES = rf"""with r as (select distinct result_id, lower(rtrim(regexp_extract(request.endpoint, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#\s@]*@)?([^/?#\s:]+)', 1), '.')) as site,
  case when response.body <> '' then response.body else nullif(array_to_string(string_split_regex(response.raw, '(?:\A|\n)\r?\n')[2:], chr(10) || chr(10)), '') end as text from results where result_id is not null),
h as (select result_id, site, {_cut("text", _HIDDEN, "")} as t from r where site <> '' and text is not null),
g as (select result_id, site, {_cut("t", _TAG, " ")} as t from h),
l as (select result_id, site, unnest(string_split(t, chr(10))) as s, generate_subscripts(string_split(t, chr(10)), 1) as line_no from g),
v as (select result_id, site, cast(line_no as int) as line_no, regexp_replace(regexp_replace(lower({_decoded("s")}), '[\s\x{{a0}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', ' ', 'g'), '\d+', '0', 'g') as s from l),
w as (select result_id, site, line_no, trim(s) as s from v where trim(s) <> ''),
k as (select site, s from w group by 1, 2 having count(distinct result_id) >= 8)
"""

SQL = {
    "p1_found": _LINES + "select distinct result_id, line_no from w semi join k using (site, s)",
    "p1_pages": _LINES + """, f as (select result_id, list(distinct line_no) as nos from w semi join k using (site, s) group by 1)
select r.result_id, case when nos is null then text else array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when list_contains(nos, i) then '' else x end), chr(10)) end as text,
  cast(coalesce(len(nos), 0) as int) as lines_removed from (select result_id, max(text) as text from r group by 1) r left join f using (result_id)""",
    "p3_found": _ENDPOINTS + "select m as result_id, result_id as copy_id from (select result_id, min(result_id) over (partition by path, fields) as m from k) where m < result_id",
    "p3_collapsed": _ENDPOINTS + ", g as (select min(result_id) as result_id, count(*) as copies from k group by path, fields), o as (select result_id, min(request.endpoint) as endpoint from results where result_id is not null group by 1) select o.result_id, o.endpoint, coalesce(g.copies, 1) as copies from o left join g using (result_id) where g.result_id is not null or o.result_id not in (select result_id from k)",
}
