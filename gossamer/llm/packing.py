"""Documents into containers of fixed capacity: a grouping genetic algorithm on islands.

Items are spread by hash over blocks of bounded size; each block is evolved on
several islands.  A chromosome is a set of bins.  Crossover injects
whole well-filled bins of one parent into the other, drops the bins that repeat an
injected item, exchanges items of the remaining bins for displaced ones that fill them better, and puts
what is left back best-fit.  A mutation opens the emptiest bins the same way.  Fewer bins are fitter, then bins whose
room lies together (the mean of their squared fills), so evolution goes on at the lower bound of bins, too, until all
but one bin are full or the generations are over.  Between epochs each
island's elite moves to the next island of its block's ring.  After the last
epoch the bins that are not well filled are opened once more: their items
are spread over new, fewer blocks and evolved again, until they fit one block or until
a round has closed too few bins to go on (``STALLED``; at large items every bin may stay open).

Defined results: a text longer than a container is cut into pieces of the
capacity, the last one shorter; no other item is split; empty and null texts are
items of size 0 and get a place too; null ids are left out, a repeated doc_id is one
item; an empty table gives no rows; the same input gives the same containers.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.tokens import TOKENIZERS, token_counts
from gossamer.plans.staging import release, stage

CAPACITY = 2048
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 1000, 3, 2, 12, 6
#: Bins filled to less than this share are opened for the next round; a round that leaves more than this share of its items loose is the last.
WELL_FILLED, STALLED = 0.995, 0.9


def best_fit(order, sizes, capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Put the items, in that order, where the least room is left; opens bins as needed."""
    free = sorted((r, k) for k, r in enumerate(room))
    for i in order:
        s = sizes[i]
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[k] = r - s
        insort(free, (r - s, k))


def fitness(room: list[int], capacity: int) -> float:
    """Mean squared fill of the bins."""
    return sum(((capacity - r) / capacity) ** 2 for r in room) / len(room) if room else 1.0


def _start(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> list[list[int]]:
    order = np.argsort(-(sizes * (1 + noise * rng.random(len(sizes)))), kind="stable")
    bins: list[list[int]] = []
    best_fit(order.tolist(), sizes.tolist(), capacity, bins, [])
    return bins


def _room(bins, sizes, capacity: int) -> list[int]:
    return [capacity - sum(sizes[i] for i in b) for b in bins]


def exchange(bins: list[list[int]], room: list[int], loose: list[int], sizes: list[int]) -> list[int]:
    """Loose items go into bins in exchange for one or two smaller ones wherever that leaves less room; returns what is loose then."""
    free = sorted((sizes[i], i) for i in loose)
    for k, b in enumerate(bins):
        if not free or not room[k]:
            continue
        n = len(b)
        out = [(sizes[i], (x,)) for x, i in enumerate(b)]
        if n <= 12:
            out += [(sizes[b[x]] + sizes[b[y]], (y, x)) for x in range(n) for y in range(x)]
        gain, gone, at = 0, (), -1
        for s, xs in out:
            j = bisect_left(free, (s + room[k] + 1, -1)) - 1
            if j >= 0 and free[j][0] - s > gain:
                gain, gone, at = free[j][0] - s, xs, j
        if gain:
            _, i = free.pop(at)
            for x in reversed(gone):
                insort(free, (sizes[b[x]], b.pop(x)))
            b.append(i)
            room[k] -= gain
    return [i for _, i in reversed(free)]


def _refill(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> None:
    room = _room(bins, sizes, capacity)
    best_fit(exchange(bins, room, loose, sizes), sizes, capacity, bins, room)


def crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Well-filled bins of ``one`` go whole into ``two``."""
    room = _room(one, sizes, capacity)
    order = sorted(range(len(one)), key=room.__getitem__)
    take = order[: max(1, int(len(one) * (0.3 + 0.4 * rng.random())))]
    given = [one[k] for k in take]
    used = {i for b in given for i in b}
    kept = [b for b in two if used.isdisjoint(b)]
    there = used.union(*kept) if kept else used
    bins = [list(b) for b in given + kept]
    _refill(bins, [i for b in two for i in b if i not in there], sizes, capacity)
    return bins


def mutated(bins: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The emptiest bins opened and their items placed anew."""
    room = _room(bins, sizes, capacity)
    worst = set(sorted(range(len(bins)), key=room.__getitem__)[-max(2, len(bins) // 20) :])
    loose = [i for k in sorted(worst) for i in bins[k]]
    out = [b for k, b in enumerate(bins) if k not in worst]
    rng.shuffle(loose)
    _refill(out, [int(i) for i in loose], sizes, capacity)
    return out


def best_possible(bins: list[list[int]], sizes: list[int], capacity: int) -> bool:
    """Whether there are as few bins as the sum of sizes allows and all but one are full."""
    room = _room(bins, sizes, capacity)
    return len(bins) <= max(1, math.ceil(sum(sizes) / capacity)) and sum(r > 0 for r in room) <= 1


def evolve(pop: list[list[list[int]]], sizes: list[int], capacity: int, generations: int, rng: np.random.Generator) -> tuple[list[list[list[int]]], int]:
    """(the population after some generations, best first; crossovers made)."""
    score = lambda b: (len(b), -fitness(_room(b, sizes, capacity), capacity))
    ranked = sorted(((score(b), b) for b in pop), key=lambda x: x[0])
    made = 0
    for _ in range(generations):
        if len(ranked) < 2 or best_possible(ranked[0][1], sizes, capacity):
            break
        a, b = sorted(rng.choice(len(ranked), 2, replace=False).tolist())
        child = mutated(crossover(ranked[a][1], ranked[b][1], sizes, capacity, rng), sizes, capacity, rng)
        made += 1
        ranked = sorted([*ranked, (score(child), child)], key=lambda x: x[0])[:-1]
    return [b for _, b in ranked], made


def _flat(bins: list[list[int]], n: int) -> bytes:
    at = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        at[b] = k
    return at.tobytes()


def _bins(flat: bytes) -> list[list[int]]:
    at = np.frombuffer(flat, "<i4")
    out: list[list[int]] = [[] for _ in range(int(at.max()) + 1 if len(at) else 0)]
    for i, k in enumerate(at.tolist()):
        out[k].append(i)
    return [b for b in out if b]


STATE = "block bigint, island int, sizes array<int>, pop array<binary>, crossovers bigint, start int, bins int"


def _epoch(capacity: int, generations: int, population: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                rng = np.random.default_rng([row["block"] & 0xFFFFFFFF, row["island"], epoch])
                pop = [_bins(p) for p in row["pop"] or []]
                while len(pop) < population:
                    pop.append(_start(sizes, capacity, rng, 0.0 if not pop else 0.05 * len(pop)))
                start = row["start"] or len(pop[0])  # of the first chromosome, which is best-fit decreasing
                pop, made = evolve(pop[:population], sizes.tolist(), capacity, generations, rng)
                state = [_flat(p, len(sizes)) for p in pop]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["sizes"]], pa.list_(pa.int32())), pa.array([state], pa.list_(pa.binary())),
                        pa.array([(row["crossovers"] or 0) + made], pa.int64()), pa.array([start], pa.int32()), pa.array([len(pop[0])], pa.int32()),
                    ],
                    ["block", "island", "sizes", "pop", "crossovers", "start", "bins"],
                )

    return run


def _round(items: DataFrame, n: int, name: str, capacity: int, block: int, islands: int, epochs: int, generations: int, population: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((doc_id, piece_no, start, size, container_id, fill) of one round over the items, (block, island, crossovers, start, bins, bound), the staged tables that both read)."""
    blocks = max(1, math.ceil(n / block))
    laid = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(name)), F.lit(blocks)))
    packed = stage(laid.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "piece_no", "start")), asc=False).alias("items")), "blocks")
    seeds = packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.size").cast("array<int>").alias("sizes"), F.lit(None).cast("array<binary>").alias("pop"), F.lit(None).cast("bigint").alias("crossovers"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("bins"))
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * islands // 16)
    steps = [packed]
    for e in range(epochs):
        moved = seeds.repartition(parts, "block", "island").mapInArrow(_epoch(capacity, generations, population, e), STATE)
        seeds = stage(moved, f"epoch{e}")
        steps.append(seeds)
        if e + 1 < epochs and islands > 1:  # the elite goes round the ring
            elite = seeds.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("pop")[0].alias("elite"))
            seeds = seeds.join(elite, ["block", "island"]).select("block", "island", "sizes", F.array_distinct(F.concat(F.array("elite"), "pop")).alias("pop"), "crossovers", "start", "bins")
    bound = F.greatest(F.lit(1), F.ceil(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x) / capacity)).cast("int")
    log = seeds.select("block", "island", "crossovers", "start", "bins", bound.alias("bound"))
    best = seeds.select("block", "sizes", F.col("pop")[0].alias("flat")).mapInArrow(_unpacked(capacity), "block bigint, score double, bin array<int>, fill array<int>")
    chosen = best.groupBy("block").agg(F.max_by(F.struct("bin", "fill"), "score").alias("b"))
    rows = packed.join(chosen, "block").select("block", F.inline(F.arrays_zip("items", F.col("b.bin").alias("bin"), F.col("b.fill").alias("fill"))))
    return rows.select("items.doc_id", "items.piece_no", "items.start", "items.size", F.concat_ws("-", F.lit(name), "block", "bin").alias("container_id"), "fill"), log, steps


def _unpacked(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at = np.frombuffer(row["flat"], "<i4")
                sizes = np.array(row["sizes"], np.int64)
                fill = np.bincount(at, sizes) if len(at) else np.zeros(0)
                score = -float(len(fill)) + float(((fill / capacity) ** 2).mean() if len(fill) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([score]), pa.array([at], pa.list_(pa.int32())), pa.array([fill[at].astype(np.int32)], pa.list_(pa.int32()))], ["block", "score", "bin", "fill"])

    return run


def _packed(sizes: DataFrame, capacity: int, block: int, islands: int, epochs: int, generations: int, population: int) -> tuple[DataFrame, list[DataFrame]]:
    once = sizes.filter("doc_id is not null").groupBy("doc_id").agg(F.min("n").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))))
    pieces = once.select("doc_id", "n", k.alias("piece_no")).withColumn("piece_no", F.col("piece_no").cast("int")).withColumn("start", (F.col("piece_no") * capacity).cast("int"))
    pieces = stage(pieces.select("doc_id", "piece_no", "start", F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("int").alias("size")), "pieces")
    shape = lambda d: d.select("container_id", "doc_id", "piece_no", "start", F.col("size").alias("n_tokens"))
    out = [shape(pieces.filter(F.col("size") == capacity).withColumn("container_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no")))]
    items, logs = pieces.filter(F.col("size") < capacity), []
    n, r = items.count(), 0
    while n:
        rows, log, steps = _round(items, n, f"r{r}", capacity, block, islands, epochs, generations, population)
        placed = stage(rows, "placed")
        logs.append(stage(log.withColumn("round", F.lit(r)), "log"))
        release(*steps)
        loose = placed.filter(F.col("fill") < capacity * WELL_FILLED)
        m = loose.count()
        if n <= block or m == 0 or m > n * STALLED:
            out.append(shape(placed))
            break
        out.append(shape(placed.filter(F.col("fill") >= capacity * WELL_FILLED)))
        items, n, r = loose.select("doc_id", "piece_no", "start", "size"), m, r + 1
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result, logs


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """(container_id, doc_id, piece_no, start, n_tokens) from (doc_id, n)."""
    return _packed(sizes, capacity, block, islands, epochs, generations, population)[0]


def pack(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """(container_id, doc_id, piece_no, start, n_tokens): every document's place, in tokens of byte_bpe_50k."""
    return pack_sizes(token_counts(documents, folder), capacity)


def generations(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """(round, block, island, crossovers, start, bins, bound): what evolution did with each block on each island.

    ``start`` counts the bins of best-fit decreasing, ``bins`` those of the island's elite, ``bound`` those that the sum of sizes needs.
    """
    _, logs = _packed(token_counts(documents, folder), capacity, BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION)
    if not logs:
        return documents.sparkSession.createDataFrame([], "round int, block bigint, island int, crossovers bigint, start int, bins int, bound int")
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out.select("round", "block", "island", "crossovers", "start", "bins", "bound")
