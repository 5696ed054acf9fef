"""Level-synchronous traversal of a snapshot: a fixpoint over DataFrames.

The links of all pages are extracted once.  Each level joins the frontier with the
pages (lookup) and with the links (expansion), passes the candidates through the gates
(URL, uniqueness, cycle, scope, depth, extension) and anti-joins them with what was
visited.  Every level is a table in the shared folder, so lineage stays short and a lost
executor costs one level's tasks.  Within a level the first sighting is the one of the smallest
(source, position).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.config import CrawlConfig
from gossamer.functions import url as ur
from gossamer.operators import gates
from gossamer.operators.custom_fields import evaluate
from gossamer.operators.extract import page_links
from gossamer.plans.staging import maybe_broadcast, stage
from gossamer.sources.fetch import Getter, Limits, fetch, http_get
from gossamer.sources.known_files import known_links
from gossamer.sources.seeds import normal_seeds

FRONTIER = ["key", "url", "method", "body", "depth", "root_host", "source", "tag", "attribute"]


@dataclass(frozen=True)
class Crawled:
    """results: one row per visited request; skipped: references that are no URL; edges: the discovered link graph."""

    results: DataFrame
    skipped: DataFrame
    edges: DataFrame
    levels: int


def _key(config: CrawlConfig, u: str = "url"):
    shown = ur.blank_query(F.col(u)) if config.ignore_query else F.col(u)
    return ur.request_key("method", shown, "body")


def traverse(seeds: DataFrame, links: DataFrame | Callable[[DataFrame], DataFrame], config: CrawlConfig = CrawlConfig(), known: DataFrame | None = None, resume: str | None = None) -> tuple[DataFrame, int]:
    """(visited requests, levels) over a link table (source, url, tag, attribute, method, body, position).

    ``resume`` is a folder that ``save`` wrote; the traversal goes on from its deepest level.
    """
    if resume is not None:
        visited = seeds.sparkSession.read.parquet(resume)
        deepest = visited.agg(F.max("depth")).first()[0]
        return _levels(visited, visited.filter(F.col("depth") == deepest), links, config)
    start = seeds.select("url", F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"), F.lit(0).alias("depth"), "root_host", F.lit(None).cast("string").alias("source"), F.lit("seed").alias("tag"), F.lit(None).cast("string").alias("attribute"))
    level = gates.unique_by(start.withColumn("key", _key(config)).select(*FRONTIER), "key", ["root_host", "url"])
    if known is not None:  # known files hang on the seeds' hosts, at their own depth
        k = known.withColumns({"method": F.lit("GET"), "body": F.lit(None).cast("string"), "root_host": F.lower(ur.hostname("source"))}).withColumn("key", _key(config))
        k = k.join(start.select("root_host").distinct(), "root_host", "left_semi")
        k = k.filter(ur.is_url("url") & gates.in_scope(F.col("url"), F.col("root_host"), config.scope) & (F.col("depth") <= config.max_depth))
        k = gates.unique_by(k.select(*FRONTIER), "key", ["source", "attribute", "url"]).join(level.select("key"), "key", "left_anti")
        level = level.unionByName(k)
    first = stage(level, "level0")
    return _levels(first, first, links, config)


def save(visited: DataFrame, folder: str) -> None:
    """The state of a traversal that was ended by its time limit."""
    visited.select(*FRONTIER).write.mode("overwrite").parquet(folder)


def _levels(visited: DataFrame, frontier: DataFrame, links: DataFrame | Callable[[DataFrame], DataFrame], config: CrawlConfig) -> tuple[DataFrame, int]:
    """Level after level until the frontier is empty; ``links`` is a link table, or gives the links of a frontier's pages.

    Whatever no gate lets through is dropped before the first sighting of a request is picked, so a sighting that is
    out of one root's scope never hides one that is in another's.
    """
    began, n = time.monotonic(), 1
    expand = links if callable(links) else lambda _: links
    while not frontier.isEmpty():  # climbing goes up again, so the depth of a level does not bound the rounds; uniqueness does
        if config.max_seconds and time.monotonic() - began > config.max_seconds:
            break
        inner = frontier.filter(F.col("depth") < config.max_depth)
        out = inner.select(F.col("url").alias("source"), "depth", "root_host").dropDuplicates(["source", "root_host"]).join(expand(inner), "source")
        cand = out.select("url", "method", F.col("body"), (F.col("depth") + 1).cast("int").alias("depth"), "root_host", "source", "tag", "attribute", "position")
        if config.path_climb:
            up = frontier.select(F.explode(ur.parent_paths("url")).alias("url"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"), F.greatest(F.col("depth") - 1, F.lit(0)).cast("int").alias("depth"), "root_host", F.col("url").alias("source"), F.lit("path-climb").alias("tag"), F.lit(None).cast("string").alias("attribute"), F.lit(1_000_000).alias("position"))
            cand = cand.unionByName(up)
        cand = cand.filter(ur.is_url("url")).filter(gates.extension_allowed(F.col("url"), config.extension_match, config.extension_deny, config.extension_defaults))
        cand = cand.withColumn("key", _key(config)).join(visited.select("key"), "key", "left_anti")
        cand = cand.filter(gates.in_scope(F.col("url"), F.col("root_host"), config.scope)).filter(~ur.is_cycle("key"))
        first = gates.unique_by(cand.select(*FRONTIER, "position"), "key", ["depth", "source", "position", "url", "root_host"])
        frontier = stage(first.select(*FRONTIER), f"level{n}")
        visited = visited.unionByName(frontier)
        n += 1
    return visited, n


def one_page_each(pages: DataFrame, max_body: int) -> DataFrame:
    """One row of each url, that of the smallest body hash and status; only keys are grouped and only rows that go are looked up."""
    rows = pages.filter("url is not null").select("url", F.col("status_code").cast("int").alias("status_code"), "headers", gates.capped(F.col("body"), max_body).alias("body"), "redirect_to")
    rows = stage(rows.withColumns({"__row": F.monotonically_increasing_id(), "__h": F.md5(F.encode(F.coalesce("body", F.lit("")), "utf-8"))}), "pages")
    order = F.struct("__h", F.coalesce("status_code", F.lit(-1)).alias("c"), "__row")
    kept = rows.groupBy("url").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("url", F.col("k.__row").alias("keep"))
    gone = stage(rows.select("url", "__row").join(maybe_broadcast(stage(kept, "kept")), "url").filter("__row <> keep").select("__row"), "gone")
    return rows.join(maybe_broadcast(gone), "__row", "left_anti").drop("__row", "__h")


def live(seeds: DataFrame, config: CrawlConfig = CrawlConfig(), limits: Limits = Limits(), get: Getter = http_get, tasks: int = 1) -> Crawled:
    """Fetch, extract and go on, level by level, until the frontier is empty.

    Each level's requests are fetched once, in ``tasks`` parallel tasks that share the limits' rate, and staged; their
    links pass the same gates as those of a snapshot.  ``results`` has the fetched rows, failed ones with their error.
    """
    fetched: list[DataFrame] = []

    def links_of(frontier: DataFrame) -> DataFrame:
        got = stage(fetch(frontier, limits, get, tasks), f"fetched{len(fetched)}")
        fetched.append(got)
        pages = got if config.follow_redirects else got.filter(~gates.is_redirect(F.coalesce("status_code", F.lit(0))))
        found = page_links(pages.select("url", "headers", gates.capped(F.col("body"), config.max_body).alias("body")), config.flags)
        return stage(found.filter("url <> ''"), f"links{len(fetched)}")

    s = normal_seeds(seeds)
    visited, n = traverse(s, links_of, config)
    last = visited.select("url", "method", "body").join(_all(fetched, "url").distinct(), "url", "left_anti") if fetched else visited.select("url", "method", "body")
    if not last.isEmpty():  # the deepest level is fetched, too; its links are not followed
        fetched.append(stage(fetch(last, limits, get, tasks), "fetched-last"))
    pages = fetched[0] if len(fetched) == 1 else _all(fetched)
    request = F.struct("method", F.col("url").alias("endpoint"), "body", "tag", "attribute", "source")
    response = F.when(F.col("error").isNull(), F.struct("status_code", "headers", F.col("page").alias("body"), F.octet_length("page").cast("bigint").alias("content_length")))
    rows = visited.join(pages.withColumnRenamed("body", "page").dropDuplicates(["url"]), "url", "left")
    results = rows.select(request.alias("request"), response.alias("response"), "depth", "root_host", "error")
    edges = visited.filter("source is not null").select("source", F.col("url").alias("target"), "tag", "attribute", "depth").distinct()
    return Crawled(results, results.filter("error is not null").select("request.source", F.col("request.endpoint").alias("ref"), "request.tag", "request.attribute"), edges, n)


def _all(parts: list[DataFrame], *columns: str) -> DataFrame:
    out = parts[0].select(*columns) if columns else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns) if columns else p)
    return out


def crawl(pages: DataFrame, seeds: DataFrame, config: CrawlConfig = CrawlConfig(), files: DataFrame | None = None) -> Crawled:
    """Traverse a snapshot of (url, status_code, headers, body, redirect_to) pages from the seeds.

    Each result row has request, response (null where the snapshot has no page, or where
    the content came before and ``unique_content`` is set) and error.  With
    ``follow_redirects`` a page's redirect target is one of its links; without it, the links of a
    redirecting page are not followed.
    """
    one = one_page_each(pages, config.max_body)
    parsed = one if config.follow_redirects else one.filter(~gates.is_redirect(F.col("status_code")))
    links = page_links(parsed, config.flags)
    if config.follow_redirects:
        hop = one.filter("redirect_to is not null").select(F.col("url").alias("source"), ur.abs_url("url", "redirect_to").alias("url"), F.col("redirect_to").alias("ref"), F.lit("redirect").alias("tag"), F.lit("location").alias("attribute"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("body"), F.lit(-2000).alias("position"))
        links = links.unionByName(hop)
    links = stage(links, "links")
    s = normal_seeds(seeds)
    known = known_links(files, config.known_files) if files is not None and config.known_files else None
    visited, n = traverse(s, links.filter("url <> ''"), config, known)
    joined = visited.join(one.withColumnRenamed("body", "page"), "url", "left")
    if config.unique_content:
        hashed = joined.withColumn("h", F.md5(F.encode("page", "utf-8")))
        lead = hashed.filter("h is not null").groupBy("h").agg(F.min(F.struct("depth", "key")).alias("lead"))
        joined = hashed.join(lead, "h", "left").withColumn("page", F.when(F.col("lead.key") == F.col("key"), F.col("page")))
        joined = joined.withColumn("status_code", F.when(F.col("h").isNull() | F.col("page").isNotNull(), F.col("status_code"))).drop("h", "lead")
    fields = evaluate(joined.select("key", F.col("page").alias("body"), "headers"), config.custom_fields, "key") if config.custom_fields else None
    if fields is not None:
        joined = joined.join(fields, "key", "left")
    custom = F.col("custom_fields") if fields is not None else F.lit(None).cast("map<string,array<string>>")
    request = F.struct("method", F.col("url").alias("endpoint"), "body", "tag", "attribute", "source", custom.alias("custom_fields"))
    response = F.when(F.col("page").isNotNull(), F.struct("status_code", "headers", F.col("page").alias("body"), F.octet_length("page").cast("bigint").alias("content_length")))
    results = joined.select(request.alias("request"), response.alias("response"), "depth", "root_host", F.lit(None).cast("string").alias("error"))
    if config.show_out_of_scope:
        away = links.filter(ur.is_url("url")).join(visited.select(F.col("url").alias("source"), "root_host", "depth"), "source")
        away = away.filter(~gates.in_scope(F.col("url"), F.col("root_host"), config.scope)).dropDuplicates(["url"])
        r = F.struct("method", F.col("url").alias("endpoint"), "body", "tag", "attribute", "source", F.lit(None).cast("map<string,array<string>>").alias("custom_fields"))
        results = results.unionByName(away.select(r.alias("request"), F.lit(None).cast(results.schema["response"].dataType).alias("response"), (F.col("depth") + 1).cast("int").alias("depth"), "root_host", F.lit("out of scope").alias("error")))
    skipped = links.filter(~ur.is_url("url")).select("source", "ref", "tag", "attribute").distinct()
    edges = links.join(visited.select(F.col("url").alias("source"), "depth"), "source").select("source", F.col("url").alias("target"), "tag", "attribute", "depth").distinct()
    return Crawled(results, skipped, edges, n)


def redirect_chains(pages: DataFrame, most: int = 10) -> DataFrame:
    """(url, final_url, hops): where each url leads over at most ``most`` redirects; a loop ends at the bound."""
    hop = stage(pages.filter("url is not null and redirect_to is not null").groupBy("url").agg(F.min(ur.abs_url("url", "redirect_to")).alias("next")).filter("next <> ''"), "hops")
    at = pages.filter("url is not null").select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops")).distinct()
    for _ in range(most):
        j = at.join(hop.select(F.col("url").alias("final_url"), "next"), "final_url", "left")
        nxt = stage(j.select("url", F.coalesce("next", "final_url").alias("final_url"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops")), "chain")
        moved = nxt.filter(F.col("hops") > _).isEmpty()
        at = nxt
        if moved:
            break
    return at
