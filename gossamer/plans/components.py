"""Connected components of an undirected link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.plans.staging import release, stage


def _digest(links: DataFrame) -> tuple:
    """What two tables of distinct links have in common only if they are the same."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 32))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(id, component) for every id in ``links``; the component is its smallest id.

    Each round hangs all larger neighbours of a node under its smallest
    neighbour (large star), then all smaller ones (small star).  The number of
    links never grows, nothing is collected, and each round is a table in the shared
    folder.  Self links and repeated links are ignored; an empty table gives no rows.
    The minimum of a node's neighbours is an aggregate with map-side combine; its links meet that minimum in a join whose
    hot keys AQE splits, as the other side has one row a node.  Rounds end when the links stay the same, judged by their number and two sums
    over 64-bit hashes; a graph that does not settle within ``max_rounds`` (they grow with the logarithm of its size) is an error.
    """
    e = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = _digest(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = stage(small, "links")
        now = _digest(new)
        same, last = now == last, now
        release(e)
        e = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
