"""Parent-child links to full hierarchies: root, depth, path, descendants and cycles.

Weighted disjoint-set forests: a task joins the links it holds and gives every
node its terminal (the nearest ancestor whose own link lies elsewhere) and the
distance to it.  Terminals that are nodes themselves form a contracted link
table, whose weights are distances; it goes through the same step with fewer,
larger parts, and so on until none is left.  Results then flow back down: distance to
the root is the sum of the offsets.  A level that hardly shrinks (long chains cut
by the partitioning) is settled by pointer doubling, whose rounds are logarithmic
in the number of nodes; what still has no root then lies on or below a cycle.

Paths are materialised afterwards by traversal of an index of parents: every node holds its nearest
2^k ancestors and a pointer to the next one, and each round appends what the pointer's node holds, so
a path of any length takes a logarithmic number of joins.

No tree, host or component is ever gathered in one task: parts are bounded by
rows; a host too large for a part is split by leading folders, and a folder too large for one by
the hash of its urls, whose cut links the contraction joins again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.plans.staging import maybe_broadcast, release, stage

#: Links that a task holds at a time.
PART_ROWS = 50_000
ROOT, OPEN, CYCLE = 0, 1, 2
SCHEMA = "node string, terminal string, offset int, state int"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the links of each part; parts arrive one after the other, as they are sorted by ``part``."""

    def flush(links: dict) -> pa.RecordBatch | None:
        if not links:
            return None
        done: dict = {}  # node -> (terminal, offset, state)
        for start in links:
            trail, at, on = [], start, set()
            while at in links and at not in done and at not in on:
                on.add(at)
                trail.append(at)
                at = links[at][0]
            if at in on:  # came round
                done.update(dict.fromkeys(trail, (None, 0, CYCLE)))
                continue
            for n in reversed(trail):
                up, w, root = links[n]
                if root:
                    done[n] = (n, 0, ROOT)
                elif up in done:
                    t, o, s = done[up]
                    done[n] = (None, 0, CYCLE) if s == CYCLE else (t, o + w, s)
                else:
                    done[n] = (up, w, OPEN)
        n = list(links)
        cols = list(zip(*(done[x] for x in n)))
        return pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["node", "terminal", "offset", "state"])

    links, part = {}, None
    for b in batches:
        for p, n, up, w, root in zip(*(c.to_pylist() for c in b.columns)):
            if p != part:
                if (out := flush(links)) is not None:
                    yield out
                links, part = {}, p
            links[n] = (up, w, root)
    if (out := flush(links)) is not None:
        yield out


def _local(links: DataFrame, parts: int) -> DataFrame:
    laid = links.select("part", "node", "up", "w", "root").repartition(parts, "part").sortWithinPartitions("part")
    return laid.mapInArrow(_forest, SCHEMA)


def _heavy(nodes: DataFrame, key: str, most: int) -> DataFrame:
    """(key) of the keys with more rows than that: at most rows / most of them, counted before they are broadcast."""
    return maybe_broadcast(nodes.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(key, F.lit(True).alias(f"{key}_heavy")))


def _parted(nodes: DataFrame, n: int, part_rows: int, near: Column | None) -> tuple[DataFrame, int]:
    """Adds part: by host where a host fits a part, else by leading folders where those do, else by the hash of the node."""
    parts = max(1, math.ceil(n / part_rows))
    if parts == 1:
        return nodes.withColumn("part", F.lit(0)), 1
    spread = F.xxhash64("node")
    if near is None:
        return nodes.withColumn("part", F.pmod(spread, F.lit(parts)).cast("int")), parts
    lead = F.substring_index(F.regexp_replace("node", r"^[a-zA-Z][\w+.\-]*://", ""), "/", 3)
    nodes = nodes.withColumns({"__near": near, "__lead": lead})
    most = max(1, part_rows // 4)
    j = nodes.join(_heavy(nodes, "__near", most), "__near", "left").join(_heavy(nodes, "__lead", most), "__lead", "left")
    key = F.when(F.col("__near_heavy").isNull(), F.xxhash64("__near")).when(F.col("__lead_heavy").isNull(), F.xxhash64("__lead")).otherwise(spread)
    return j.withColumn("part", F.pmod(key, F.lit(parts)).cast("int")).drop("__near", "__lead", "__near_heavy", "__lead_heavy"), parts


def _doubled(open_: DataFrame, n: int) -> DataFrame:
    """Pointer doubling over (node, terminal, offset, state); what is open after log2(n)+1 rounds is in a cycle."""
    at = open_
    for _ in range(max(1, math.ceil(math.log2(max(n, 2)))) + 1):
        todo = at.filter(F.col("state") == OPEN)
        if todo.isEmpty():
            break
        nxt = at.select(F.col("node").alias("terminal"), F.col("terminal").alias("t2"), F.col("offset").alias("o2"), F.col("state").alias("s2"))
        moved = todo.join(nxt, "terminal").select("node", F.col("t2").alias("terminal"), F.when(F.col("s2") == CYCLE, 0).otherwise(F.col("offset") + F.col("o2")).cast("int").alias("offset"), F.col("s2").alias("state"))
        at = stage(at.filter(F.col("state") != OPEN).unionByName(moved), "doubled")
    return at.withColumns({"terminal": F.when(F.col("state") == ROOT, F.col("terminal")), "offset": F.when(F.col("state") == ROOT, F.col("offset")).otherwise(0), "state": F.when(F.col("state") == ROOT, ROOT).otherwise(CYCLE)})


def resolve(parents: DataFrame, near: Column | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, root, depth) from (node, parent), one row per node, parent null for a root.

    A parent that is no node itself makes its node a root.  On or below a cycle: root '', depth -1.
    """
    known = parents.select(F.col("node").alias("parent"))
    links = parents.filter("parent is not null").join(known, "parent", "left_semi")
    flagged = parents.select("node").join(links.select("node", F.col("parent").alias("up")), "node", "left")
    todo = stage(flagged.select("node", "up", F.lit(1).alias("w"), F.col("up").isNull().alias("root")), "links")
    n = todo.count()
    levels: list[tuple[DataFrame, DataFrame | None]] = []
    aside: DataFrame | None = None
    while True:
        laid, parts = _parted(todo, n, part_rows, None if levels else near)
        got = stage(_local(laid, parts), "level")
        levels.append((got, aside))
        top = None
        if parts == 1:
            break
        ends = got.filter(F.col("state") == OPEN).select(F.col("terminal").alias("node")).distinct()
        sub = stage(got.join(ends, "node", "left_semi"), "ends")
        m = sub.count()
        if m > n // 2:
            top = _doubled(sub, m)
            break
        if m == 0:
            break
        # what is settled already stands in as a root on the next level; its own result is kept aside
        aside = sub.filter(F.col("state") != OPEN)
        todo = sub.select("node", F.when(F.col("state") == OPEN, F.col("terminal")).alias("up"), F.col("offset").alias("w"), (F.col("state") != OPEN).alias("root"))
        n = m
    for got, aside in reversed(levels):
        top = got if top is None else _follow(got, top, F.col("state") == OPEN)
        if aside is not None:
            top = _follow(top, aside, F.col("state") == ROOT)
    root = F.when(F.col("state") == ROOT, F.col("terminal")).otherwise("")
    depth = F.when(F.col("state") == ROOT, F.col("offset")).otherwise(-1).cast("int")
    return top.select("node", root.alias("root"), depth.alias("depth"))


def _follow(rows: DataFrame, by: DataFrame, which: Column) -> DataFrame:
    """The chosen rows take over their terminal's result, where ``by`` has one."""
    t = by.select(F.col("node").alias("terminal"), F.col("terminal").alias("t2"), F.col("offset").alias("o2"), F.col("state").alias("s2"))
    j = rows.join(t, "terminal", "left")
    go = which & F.col("s2").isNotNull()
    return j.select(
        "node",
        F.when(go, F.col("t2")).otherwise(F.col("terminal")).alias("terminal"),
        F.when(go & (F.col("s2") == CYCLE), 0).when(go, F.col("offset") + F.col("o2")).otherwise(F.col("offset")).cast("int").alias("offset"),
        F.when(go, F.col("s2")).otherwise(F.col("state")).alias("state"),
    )


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, up): the ancestors of each node of (node, parent, depth), nearest first; depth 0 ends the traversal.

    Nodes whose ancestors are complete leave the rounds; the others follow their pointer through the index of all nodes.
    """
    parent = F.when(F.col("depth") > 0, F.col("parent"))
    at = stage(tree.select("node", parent.alias("next"), F.when(parent.isNull(), F.array().cast("array<string>")).otherwise(F.array(parent)).alias("up")), "up")
    while not (todo := at.filter("next is not null")).isEmpty():
        index = at.select(F.col("node").alias("next"), F.col("next").alias("n2"), F.col("up").alias("u2"))
        moved = todo.join(index, "next").select("node", F.col("n2").alias("next"), F.concat("up", "u2").alias("up"))
        further = stage(at.filter("next is null").unionByName(moved), "up")
        release(at)
        at = further
    return at.select("node", "up")


def frontier_parents(frontier: DataFrame) -> DataFrame:
    """(node, parent) of each distinct url: the source in its row of smallest edge_id, trimmed and cut before '#'.

    Null urls have no row; rows delivered twice count once; null and blank sources give a null parent.
    """
    f = frontier.select("edge_id", "url", "source").filter("url is not null")
    cut = F.regexp_replace(F.substring_index(F.regexp_replace("source", r"^[\s\x{a0}]+", ""), "#", 1), r"[\s\x{a0}]+$", "")
    first = f.groupBy("url").agg(F.min_by(F.struct("source"), F.coalesce("edge_id", F.lit((1 << 63) - 1))).alias("s"))
    one = first.select(F.col("url").alias("node"), F.col("s.source").alias("source"))
    return one.select("node", F.when(cut != "", cut).alias("parent"))


def host(url: str = "node") -> Column:
    return F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)


def found(frontier: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(url, root_url, depth) of each distinct url; '' and -1 on or below a cycle."""
    r = resolve(frontier_parents(frontier), host(), part_rows)
    return r.select(F.col("node").alias("url"), F.col("root").alias("root_url"), "depth")


def paths(frontier: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(url, root_url, depth, path): the urls from the root to each url; null path on or below a cycle."""
    parents = stage(frontier_parents(frontier), "parents")
    r = stage(resolve(parents, host(), part_rows), "resolved")
    up = ancestors(r.filter("depth >= 0").join(parents, "node"))
    path = F.concat(F.reverse("up"), F.array("node"))
    return r.join(up, "node", "left").select(F.col("node").alias("url"), F.col("root").alias("root_url"), "depth", F.when(F.col("up").isNotNull(), path).alias("path"))


def descendants(frontier: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(url, descendant, distance): all urls below each url that is on no cycle and below none."""
    p = paths(frontier, part_rows).filter("depth > 0")
    up = p.select(F.col("url").alias("descendant"), "depth", F.posexplode("path").alias("pos", "url")).filter("pos < depth")
    return up.select("url", "descendant", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
