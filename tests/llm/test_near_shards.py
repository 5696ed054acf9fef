import random

import pytest

from gossamer.llm import near_copies

KEYS = [(b, i) for b in range(40) for i in range(b % 7 + 1)] + [(1000, i) for i in range(500)] + [(1001, 3), (1001, 3)]


def shards(spark, heavy, texts=500):
    rows = spark.createDataFrame(KEYS, "band long, id long").repartition(5)
    return sorted(map(tuple, near_copies._shared(rows, texts, "shards", heavy).select("band", "id", "n", "low").collect()))


def test_heavy_shards_are_the_same_rows(spark):
    """A shard that has a row twice is one of two rows but one member: it is left out."""
    want = sorted((b, i, n, 0) for b, i in KEYS if (n := sum(x == b for x, _ in KEYS)) > 1 and b != 1001)
    assert shards(spark, 1_000_000) == want
    assert shards(spark, 100) == want
    assert shards(spark, 3) == want


def responses(spark):
    r = random.Random(5)
    rows = []
    for g in range(8):
        words = [f"w{r.randrange(3000)}" for _ in range(120)]
        for k in range(6):
            own = list(words)
            own[r.randrange(120)] = f"x{g}{k}"
            rows.append((10 * g + k, " ".join(own)))
    return spark.createDataFrame(rows, "response_id long, body string")


@pytest.mark.parametrize("heavy", [2, 1_000_000])
def test_groups_with_heavy_shards(spark, heavy):
    got = {(r.response_id, r.group_id) for r in near_copies.near_groups(responses(spark), small=4, tree=4, heavy=heavy).collect()}
    assert got == {(10 * g + k, 10 * g) for g in range(8) for k in range(6)}


def test_keys_and_sets_are_moved_once(spark, monkeypatch):
    """Where nothing is broadcast the keys of the shards go through one exchange, and the sets are written once."""
    plans, stage = {}, near_copies.stage

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(near_copies, "stage", watched)
    monkeypatch.setattr(near_copies, "maybe_broadcast", lambda df, *_: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_copies.found(responses(spark)).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(p.count("Exchange hashpartitioning(band") for n, p in plans.items() if n.startswith("shards")) == 1
    assert [n for n in plans if n in ("sets", "need")] == ["sets"]
