"""Groups of responses whose texts are near: BK-trees over Hamming distance, sharded.

Each body becomes the set of its hashed word sequences.  Bodies with the same
set are one class and only its smallest id goes on.  A class's signature holds
the smallest hash of its whole set under each of ``PLACES`` permutations, so what near texts
share counts however common it is.  The Hamming distance of two signatures, the number of
places that differ, is an integer metric whose mean is places x (1 - Jaccard).

Shards are the rows that agree in one band of the signature.  A shard's BK-tree keys
children by their distance to the parent; each member is looked up before it is put
in, along the edges within the radius only, and the pairs found are checked against the
sets by a join.  A hot shard (common sequences bring many texts into it) is linked to its
smallest member, checked the same way, and cut into finer shards by further places that its
members must share, in as many ways as there are bands, so that no near pair depends on one of them.
Members of finer shards that are still hot, and that the links so far leave outside the
shard's largest component, are cut into blocks; each block's tree is looked up by every
block of the shard, one bounded task per pair of blocks, where the sets travel along and
only spanning links leave the task.  So no shard is gathered whole, a group of any size costs as many
links as it has members, and no shard is dropped or cut short.

Chance of a missed pair, by the bands alone: (1 - J^3)^36, that is 0.8% at exactly 0.5, 0.1% at
0.56, below 10^-6 from 0.7 on; groups are missed less often, as any link of theirs connects them.

Defined results: null and short bodies are in no group; a response delivered twice
counts once; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions.markup import visible_text
from gossamer.plans.components import connected_components
from gossamer.plans.staging import maybe_broadcast, release, stage

WORD = re.compile(r"[^\W_]+")
#: Words in a sequence, least words of a text, least share in common.
SEQUENCE, LEAST_WORDS, SIMILARITY = 3, 60, 0.5
#: Places of a signature, places of a band, bands that shard, and the BK-tree's radius (3.4 standard deviations beyond the mean at 0.5).
PLACES, BAND, BANDS, RADIUS = 108, 3, 36, 72
#: Members of a shard that one tree takes in; larger ones are hot.  Members of one tree of a pair of blocks.
SMALL, TREE = 64, 256
#: Rows of shards that one task takes.
PART_ROWS = 250_000
#: Members of a shard whose keys one task counts.
HEAVY = 1_000_000
#: Words a task keeps the hashes of.
KEPT = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) >= KEPT:
            self.clear()
        self[w] = h
        return h


def sequence_hashes(words: list[str], seen: dict, sequence: int = SEQUENCE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word sequences."""
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = len(h) - sequence + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(sequence):
        acc = _mix(acc + h[k : k + n] + np.uint64(k + 1))
    return np.unique(acc)


def _sets(sequence: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for b in batches:
            ids, sums, sets = [], [], []
            for i, body in zip(b.column(0).to_pylist(), b.column(1)):
                text = body.as_py()
                if i is None or not text:
                    continue
                words = WORD.findall(visible_text(text).lower())
                if len(words) < least_words:
                    continue
                h = sequence_hashes(words, seen, sequence)
                ids.append(i)
                sums.append(f"{int(h.sum()):x}.{int(_mix(h).sum()):x}.{len(h)}")
                sets.append((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "sum", "grams"])

    return run


_SEEDS = _mix(np.arange(1, PLACES + 1, dtype=np.uint64))


def signature(grams: np.ndarray) -> np.ndarray:
    """Smallest hash of the sequences under each permutation."""
    x = (grams.astype(np.uint64)[None, :] ^ _SEEDS[:, None]) * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    return (x >> np.uint64(32)).min(axis=1).astype(np.uint32)


def band_keys(sig: np.ndarray, shift: int = 0) -> np.ndarray:
    """One 64-bit key for each band; with a shift the bands are laid over other places, and there is one less."""
    band = sig[shift : shift + BAND * (BANDS - (shift > 0))].reshape(-1, BAND).astype(np.uint64)
    k = np.arange(1, len(band) + 1, dtype=np.uint64) + np.uint64(shift << 32)
    for c in range(BAND):
        k = _mix(k * _M1 + band[:, c])
    return k.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sigs, keys, finer = [], [], [], []
        for i, g in zip(b.column(0).to_pylist(), b.column(1)):
            grams = g.values.to_numpy()
            if len(grams):
                s = signature(grams.view(np.uint32))
                ids.append(i)
                sigs.append(_mix(s.astype(np.uint64)).astype(np.uint8).tobytes())
                keys.append(band_keys(s))
                finer.append(band_keys(s, 1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(finer, pa.list_(pa.int32()))], ["id", "sig", "bands", "finer"])


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None
        self.size = self.asked = self.visited = 0  # members, members there were at each lookup, members compared

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray) -> int:
        return int(np.count_nonzero(a != b))

    def near(self, sig: np.ndarray) -> list[tuple[int, int]]:
        """(distance, member) within the radius."""
        out, todo = [], [self.root] if self.root else []
        self.asked += self.size
        while todo:
            at, member, below = todo.pop()
            self.visited += 1
            d = self.distance(at, sig)
            if d <= self.radius:
                out.append((d, member))
            todo += [c for k, c in below.items() if d - self.radius <= k <= d + self.radius]
        return out

    def add(self, sig: np.ndarray, member: int) -> None:
        self.size += 1
        if self.root is None:
            self.root = (sig, member, {})
            return
        at = self.root
        while True:
            d = self.distance(at[0], sig)
            if d not in at[2]:
                at[2][d] = (sig, member, {})
                return
            at = at[2][d]


def _shards(radius: int, figures: bool = False):
    """Links within each shard, or the (members asked, visited) of its tree; rows come sorted by shard."""

    def links(ids: list[int], sigs: list[bytes], out: set) -> None:
        tree = BKTree(radius)
        for i, s in zip(ids, sigs):
            sig = np.frombuffer(s, np.uint8)
            for _, j in tree.near(sig):
                if i != j and not figures:
                    out.add((min(i, j), max(i, j)))
            tree.add(sig, i)
        if figures:
            out.add((tree.asked, tree.visited))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, sigs, out = None, [], [], set()
        give = lambda: pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
        for b in batches:
            for k, i, s in zip(*(c.to_pylist() for c in b.columns)):
                if k != shard:
                    if len(ids) > 1:
                        links(ids, sigs, out)
                    shard, ids, sigs = k, [], []
                    if len(out) > 50_000 or figures and out:
                        yield give()
                        out = set()
                ids.append(i)
                sigs.append(s)
        if len(ids) > 1:
            links(ids, sigs, out)
        yield give()

    return run


def _block_pairs(radius: int, similarity: float):
    """Spanning links of each pair of blocks; rows (pair, side, id, comp, sig, grams) come sorted by pair and side."""

    def links(rows: list, out: list) -> None:
        tree, sets, comp, up = BKTree(radius), {}, {}, {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for side, i, c, s, g in rows:
            sig, mine = np.frombuffer(s, np.uint8), np.asarray(g, np.int32)
            for _, j in sorted(tree.near(sig)):
                if i == j or find(c) == find(comp[j]):
                    continue
                both = len(np.intersect1d(mine, sets[j]))
                if both >= similarity * (len(mine) + len(sets[j]) - both):
                    up[find(c)] = find(comp[j])
                    out.append((min(i, j), max(i, j)))
            if side == 0:
                sets[i], comp[i] = mine, c
                tree.add(sig, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give() -> pa.RecordBatch:
            out: list = []
            links(rows, out)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        pair, rows = None, []
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                if k != pair:
                    yield give()
                    pair, rows = k, []
                rows.append(row)
        yield give()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are near enough; only the sets that are asked for are moved, and both joins read the same exchange of them."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    need = sets.join(maybe_broadcast(ids), "id", "left_semi").select("id", "grams").dropDuplicates(["id"])
    ab = pairs.join(need.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(need.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return ab.filter(both >= similarity * (F.size("ga") + F.size("gb") - both)).select("a", "b")


def _between_components(hot: DataFrame, sets: DataFrame, links: DataFrame, tree: int, radius: int, similarity: float) -> DataFrame:
    """Links of the hot shards (band, id, sig) between components of the links so far."""
    comps = connected_components(links)
    m = stage(hot.join(comps, "id", "left").select("band", "id", "sig", F.coalesce("component", "id").alias("comp")), "hot")
    main = m.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"))
    m = m.join(main, "band").withColumn("block", F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("n") / tree)).cast("int"))
    outside = m.filter(F.col("comp") != F.col("main"))
    if outside.isEmpty():
        return links.limit(0)
    few = outside.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("x_blocks"))
    m = stage(m.join(few, "band").withColumn("blocks", F.ceil(F.col("n") / tree).cast("int")), "outside")
    x = F.pmod(F.xxhash64("band", "id"), F.col("x_blocks")).cast("int")
    trees = m.filter(F.col("comp") != F.col("main")).select("band", "id", "comp", "sig", x.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.lit(0).alias("side"))
    asks = m.select("band", "id", "comp", "sig", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1)).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"))
    rows = trees.unionByName(asks).select(F.concat_ws("-", "band", "x", "y").alias("pair"), "side", "id", "comp", "sig")
    need = sets.join(maybe_broadcast(m.select("id").distinct()), "id", "left_semi").select("id", "grams").dropDuplicates(["id"])
    full = rows.join(need, "id").select("pair", "side", "id", "comp", "sig", "grams")
    return full.repartition("pair").sortWithinPartitions("pair", "side", "id").mapInArrow(_block_pairs(radius, similarity), "a bigint, b bigint")


def _frequent(share: float):
    """Keys that hold that share of a batch: one that holds it of all rows does so in some batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = np.unique(b.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n >= share * b.num_rows], pa.int64())], ["band"])

    return run


def _shared(rows: DataFrame, texts: int, name: str, heavy: int = HEAVY) -> DataFrame:
    """(band, id, n, low) of the rows whose shard has two members or more; only ids and keys are moved, and once.

    A shard has at most ``texts`` members.  Those above ``heavy`` are at most rows/heavy many; they are counted with map-side combine, and their rows stay where they are.
    """
    keys, shard, figures = rows.select("band", "id"), Window.partitionBy("band"), (F.count(F.lit(1)), F.min("id"), F.max("id"))
    counted = lambda k: k.select("band", "id", *(f.over(shard).alias(c) for f, c in zip(figures, ("n", "low", "high"))))
    often = sizes = None
    if texts > heavy:
        often = stage(keys.select("band").mapInArrow(_frequent(heavy / keys.count()), "band bigint").distinct(), name + "_often")
        sizes = keys.join(maybe_broadcast(often), "band", "left_semi").groupBy("band").agg(*(f.alias(c) for f, c in zip(figures, ("n", "low", "high"))))
        sizes = stage(sizes.filter(F.col("n") > heavy), name + "_heavy")
        both = counted(keys.join(F.broadcast(sizes), "band", "left_anti")).unionByName(keys.join(F.broadcast(sizes), "band"))
    else:
        both = counted(keys)
    out = stage(both.filter("low < high").select("band", "id", "n", "low"), name)
    release(often, sizes)
    return out


def _tree_shards(shared: DataFrame, signed: DataFrame, small: int) -> DataFrame:
    """(band, id, sig) of the shards that one tree takes in, laid out shard by shard."""
    members = shared.filter(F.col("n") <= small)
    parts = max(int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.count() // PART_ROWS)
    return members.select("band", "id").join(signed.select("id", "sig"), "id").select("band", "id", "sig").repartition(parts, "band").sortWithinPartitions("band", "id")


def _hot(shared: DataFrame, small: int) -> DataFrame | None:
    """(band, id, low) of the other shards, or None where there are none."""
    big = shared.filter(F.col("n") > small).select("band", "id", "low")
    return None if big.isEmpty() else big


def _to_lowest(hot: DataFrame) -> DataFrame:
    return hot.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))


def _prepared(responses: DataFrame, sequence: int, least_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets of the class representatives, membership, their signatures), staged."""
    sets = responses.select(F.col("response_id").cast("bigint"), "body").mapInArrow(_sets(sequence, least_words), "id bigint, sum string, grams array<int>")
    sets = stage(sets, "sets")
    first = sets.groupBy("sum").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select("sum", "rep")
    member = stage(sets.select("sum", "id").join(first, "sum").select("id", "rep").distinct(), "members")
    others = member.filter("id <> rep").select("id")
    reps = sets.select("id", "grams").join(maybe_broadcast(others), "id", "left_anti")
    signed = stage(reps.mapInArrow(_signed, "id bigint, sig binary, bands array<bigint>, finer array<int>"), "signed")
    return reps, member, signed


def near_links(responses: DataFrame, similarity: float = SIMILARITY, sequence: int = SEQUENCE, least_words: int = LEAST_WORDS, radius: int = RADIUS, small: int = SMALL, tree: int = TREE, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(verified links between class representatives, membership of each response in its class).

    The links of small shards are complete; those of larger shards span their components.
    """
    reps, member, signed = _prepared(responses, sequence, least_words)
    texts = signed.count()
    shared = _shared(signed.select("id", F.explode("bands").alias("band")), texts, "shards", heavy)
    pairs = _tree_shards(shared, signed, small).mapInArrow(_shards(radius), "a bigint, b bigint")
    hot, finer, still = _hot(shared, small), None, None
    if hot is not None:
        cut = stage(hot.join(signed.select("id", "finer"), "id"), "cut").select("id", F.explode(F.transform("finer", lambda x, i: F.xxhash64("band", x, i))).alias("band"))
        finer = _shared(cut, texts, "finer", heavy)
        pairs = pairs.unionByName(_to_lowest(hot)).unionByName(_tree_shards(finer, signed, small).mapInArrow(_shards(radius), "a bigint, b bigint"))
        still = _hot(finer, small)
        if still is not None:
            pairs = pairs.unionByName(_to_lowest(still))
    pairs = stage(pairs.distinct(), "pairs")
    links = stage(_verified(pairs, reps, similarity), "links")
    if still is not None:
        more = _between_components(still.join(signed.select("id", "sig"), "id").select("band", "id", "sig"), reps, links, tree, radius, similarity)
        links = stage(links.unionByName(more).distinct(), "links")
    release(signed, shared, pairs, finer)
    return links, member


def tree_figures(responses: DataFrame, small: int = SMALL, radius: int = RADIUS) -> DataFrame:
    """(members, visited): members that the shards' trees held at the lookups, and those that were compared."""
    _, _, signed = _prepared(responses, SEQUENCE, LEAST_WORDS)
    shared = _shared(signed.select("id", F.explode("bands").alias("band")), signed.count(), "shards")
    g = _tree_shards(shared, signed, small).mapInArrow(_shards(radius, True), "a bigint, b bigint")
    return g.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("members"), F.coalesce(F.sum("b"), F.lit(0)).alias("visited"))


def near_groups(responses: DataFrame, **how) -> DataFrame:
    """(response_id, group_id, links): one row per response that is near another; the group's id is its smallest."""
    links, member = near_links(responses, **how)
    classes = member.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    all_links = links.unionByName(classes)
    n = all_links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    c = connected_components(all_links)
    return c.join(n, "id").select(F.col("id").alias("response_id"), F.col("component").alias("group_id"), "links")


def found(responses: DataFrame) -> DataFrame:
    """(response_id, near_id): the group's smallest response_id and each other one."""
    links, member = near_links(responses)
    classes = member.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    c = connected_components(links.unionByName(classes))
    return c.filter("id > component").select(F.col("component").alias("response_id"), F.col("id").alias("near_id"))
