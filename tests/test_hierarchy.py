import random

import pytest

from gossamer.operators import hierarchy as h


def brute(parents):
    out = {}
    for n in parents:
        path, at, seen = [n], n, {n}
        while parents.get(at) is not None and parents[at] in parents:
            at = parents[at]
            if at in seen:
                path = None
                break
            seen.add(at)
            path.append(at)
        out[n] = ("", -1, None) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def solve(spark, parents, **k):
    df = spark.createDataFrame(list(parents.items()), "node string, parent string")
    r = h.resolve(df, h.host(), **k)
    up = {x.node: x.up for x in h.ancestors(r.filter("depth >= 0").join(df, "node")).collect()}
    return {x.node: (x.root, x.depth, [*reversed(up[x.node]), x.node] if x.node in up else None) for x in r.collect()}


SMALL = {"a": None, "b": "a", "c": "b", "x": "y", "y": "x", "z": "x", "s": "s", "t": "s", "o": "nowhere", "p": "o"}


@pytest.mark.parametrize("part_rows", [200_000, 3, 1])
def test_small(spark, part_rows):
    assert solve(spark, SMALL, part_rows=part_rows) == brute(SMALL)


@pytest.mark.parametrize("part_rows", [10_000, 150, 40])
def test_random_forest_with_cycles(spark, part_rows):
    rng = random.Random(part_rows)
    url = lambda i: f"https://h{i % 3}.example/{i % 7}/{i}"
    parents = {url(i): url(rng.randrange(max(1, i - 30), i)) if i > 3 else None for i in range(600)}
    for i in (100, 250, 400):
        parents[url(i)] = url(i + rng.randrange(1, 60))
    assert solve(spark, parents, part_rows=part_rows) == brute(parents)


def test_long_chain_across_parts(spark):
    parents = {f"n{i}": f"n{i - 1}" if i else None for i in range(300)}
    assert solve(spark, parents, part_rows=20) == brute(parents)


def test_a_folder_with_all_urls_is_split(spark):
    """One host, one folder: no part holds more than a few times the rows it should."""
    parents = {f"https://h.example/a/b/{i}": f"https://h.example/a/b/{i // 2}" if i else None for i in range(800)}
    df = spark.createDataFrame(list(parents.items()), "node string, parent string")
    laid, parts = h._parted(df, 800, 40, h.host())
    sizes = [r["count"] for r in laid.groupBy("part").count().collect()]
    assert parts == 20 and max(sizes) < 120 and len(sizes) > 12
    assert solve(spark, parents, part_rows=40) == brute(parents)


def test_frontier(spark):
    rows = [(2, "u", "other", 1), (1, "u", " root#x ", 1), (1, "u", " root#x ", 1), (3, "root", None, 9), (4, "w", "  ", 0), (5, None, "root", 0), (6, "v", "#only", 0), (None, "q", "u", 0)]
    df = spark.createDataFrame(rows, "edge_id long, url string, source string, depth int")
    assert {tuple(r) for r in h.found(df).collect()} == {("u", "root", 1), ("root", "root", 0), ("w", "w", 0), ("v", "v", 0), ("q", "root", 2)}
    assert {tuple(r) for r in h.descendants(df).collect()} == {("root", "u", 1), ("root", "q", 2), ("u", "q", 1)}
    assert {r.url: r.path for r in h.paths(df).collect()}["q"] == ["root", "u", "q"]


def test_empty(spark):
    df = spark.createDataFrame([], "edge_id long, url string, source string")
    assert h.found(df).count() == 0 and h.paths(df).count() == 0 and h.descendants(df).count() == 0
