"""Lines that come back on page after page of one website, and pages without them.

Pass one keeps, in every task, a Misra-Gries summary per website: at most ``SITE_SLOTS`` counters of
lines, and the error, by how much a line's count may be too low.  Summaries merge by
addition of counters and of errors.  A line is a candidate when its count and its website's error together
reach the threshold, so no line that does is lost; where the error alone reaches it, the
website is *open* and all its lines are candidates.

Pass two reads the pages again and hands on the places of candidates only.  They
are counted exactly, over distinct results, by 64-bit keys; the texts behind each key are compared
(smallest and largest, an aggregate with map-side combine), and keys that stand for more than one
text are counted by the texts themselves.  Candidates, and for clean pages the confirmed texts, go to
the pages as broadcast sets while their counted number is below a bound, by shuffle joins beyond it.

Defined results: a page without text, or an endpoint without a host, has no
lines here; a result that was delivered twice counts once; repeated lines on
one page count once for the threshold and are all reported; an empty table
gives no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.markup import page_text, site_of, visible_lines
from gossamer.plans.staging import BROADCAST_ROWS, maybe_broadcast, release, stage

DIGITS = re.compile(r"\d+")
AT_LEAST = 8
#: Counters of one website's summary, and of all summaries a task holds before it hands them on.
SITE_SLOTS, TASK_SLOTS = 20_000, 400_000


def normal(text: str) -> str:
    """What lines are compared by: lower case, each run of digits one 0."""
    return DIGITS.sub("0", text.lower())


def key_of(text: str) -> int:
    """64-bit key as a signed integer."""
    k = xxhash.xxh3_64_intdigest(text)
    return k - (1 << 64) if k >= 1 << 63 else k


def _pages(results: DataFrame) -> DataFrame:
    return results.select(F.col("result_id").cast("bigint"), F.col("request.endpoint"), F.col("response.body"), F.col("response.raw"))


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int, str, list[tuple[int, str]]]]:
    """(result_id, site, [(line number, normalised text)]) of each page that has both."""
    for i, endpoint, body, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
        site = site_of(endpoint) if i is not None else None
        text = page_text(body.as_py(), raw.as_py()) if site else None
        if text:
            yield i, site, [(n, normal(s)) for n, s in visible_lines(text)]


class Summary:
    """A Misra-Gries summary: counts are too low by at most ``error``."""

    def __init__(self, slots: int):
        self.slots, self.counts, self.error = slots, Counter(), 0

    def update(self, keys: set[int]) -> None:
        self.counts.update(keys)
        if len(self.counts) > self.slots:
            keep = max(1, self.slots // 2)  # half is freed at once, so that the cost of a line stays constant
            cut = sorted(self.counts.values(), reverse=True)[keep]
            self.error += cut
            self.counts = Counter({k: n - cut for k, n in self.counts.items() if n > cut})


def _summaries(site_slots: int, task_slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}

        def give() -> pa.RecordBatch:
            rows = [(s, k, n, 0) for s, x in held.items() for k, n in x.counts.items()] + [(s, None, 0, x.error) for s, x in held.items() if x.error]
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["site", "k", "n", "error"])

        for b in batches:
            for _, site, lines in _lines(b):
                s = key_of(site)
                if s not in held:
                    held[s] = Summary(site_slots)
                held[s].update({key_of(f"{site}\0{t}") for _, t in lines})
            if sum(len(x.counts) for x in held.values()) > task_slots:
                yield give()
                held = {}
        yield give()

    return run


def summaries(results: DataFrame, site_slots: int = SITE_SLOTS, task_slots: int = TASK_SLOTS) -> DataFrame:
    """(site, k, n, error): counters of each task and website, and the errors (k null)."""
    return _pages(results).mapInArrow(_summaries(site_slots, task_slots), "site bigint, k bigint, n bigint, error bigint")


def candidates(results: DataFrame, at_least: int = AT_LEAST, site_slots: int = SITE_SLOTS, task_slots: int = TASK_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(keys of candidate lines (k), open websites (site)), staged."""
    parts = stage(summaries(results, site_slots, task_slots).groupBy("site", "k").agg(F.sum("n").alias("n"), F.sum("error").alias("error")), "summaries")
    errors = parts.filter("k is null").select("site", F.col("error").alias("low"))
    lines = parts.filter("k is not null").join(maybe_broadcast(errors), "site", "left")
    keys = stage(lines.filter(F.col("n") + F.coalesce("low", F.lit(0)) >= at_least).select("k"), "candidates")
    open_ = stage(errors.filter(F.col("low") >= at_least).select("site"), "open")
    release(parts)
    return keys, open_


def _places(keys, open_):
    """Places of candidate lines; without ``keys`` those of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, free = (set(keys.value.tolist()), set(open_.value.tolist())) if keys is not None else (set(), set())
        for b in batches:
            ids, nos, sites, ks, texts = [], [], [], [], []
            for i, site, lines in _lines(b):
                s = key_of(site)
                every = keys is None or s in free
                for n, t in lines:
                    full = f"{site}\0{t}"
                    k = key_of(full)
                    if every or k in wanted:
                        ids.append(i)
                        nos.append(n)
                        sites.append(s)
                        ks.append(k)
                        texts.append(full)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(sites, pa.int64()), pa.array(ks, pa.int64()), pa.array(texts, pa.string())], ["result_id", "line_no", "site", "k", "text"])

    return run


def _sent(df: DataFrame, name: str):
    return df.sparkSession.sparkContext.broadcast(np.array([r[0] for r in df.select(name).collect()], np.int64))


def candidate_places(results: DataFrame, keys: DataFrame, open_: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(result_id, line_no, k, text) of all lines that are candidates, staged."""
    schema = "result_id bigint, line_no int, site bigint, k bigint, text string"
    if keys.count() <= limit and open_.count() <= limit:
        rows = _pages(results).mapInArrow(_places(_sent(keys, "k"), _sent(open_, "site")), schema)
    else:
        every = _pages(results).mapInArrow(_places(None, None), schema)
        marked = every.join(keys.withColumn("hit", F.lit(True)), "k", "left").join(maybe_broadcast(open_.withColumn("free", F.lit(True))), "site", "left")
        rows = marked.filter("hit or free")
    return stage(rows.select("result_id", "line_no", "k", "text"), "places")


def confirmed(places: DataFrame, at_least: int = AT_LEAST) -> tuple[DataFrame, DataFrame]:
    """(places with ``part``, confirmed (k, part, text)): part is '' but for keys that stand for several texts, where it is the text."""
    texts = places.groupBy("k").agg(F.min("text").alias("low"), F.max("text").alias("text"))
    texts = stage(texts, "texts")
    clash = texts.filter("low <> text").select("k")
    if clash.isEmpty():
        marked = places.withColumn("part", F.lit(""))
    else:
        marked = places.join(maybe_broadcast(clash.withColumn("clash", F.lit(True))), "k", "left").withColumn("part", F.when(F.col("clash"), F.col("text")).otherwise(F.lit(""))).drop("clash")
    n = marked.select("k", "part", "result_id").distinct().groupBy("k", "part").agg(F.count(F.lit(1)).alias("results")).filter(F.col("results") >= at_least)
    exact = n.join(maybe_broadcast(texts.select("k", "text")), "k").select("k", "part", F.when(F.col("part") != "", F.col("part")).otherwise(F.col("text")).alias("text"))
    return marked, stage(exact, "confirmed")


def _found(results: DataFrame, at_least: int, site_slots: int, task_slots: int, limit: int) -> tuple[DataFrame, DataFrame]:
    keys, open_ = candidates(results, at_least, site_slots, task_slots)
    places = candidate_places(results, keys, open_, limit)
    marked, exact = confirmed(places, at_least)
    release(keys, open_)
    return marked, exact


def repeated_lines(results: DataFrame, at_least: int = AT_LEAST, site_slots: int = SITE_SLOTS, task_slots: int = TASK_SLOTS, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(result_id, line_no) of every line whose text is on ``at_least`` results of its site."""
    marked, exact = _found(results, at_least, site_slots, task_slots, limit)
    return marked.join(maybe_broadcast(exact.select("k", "part")), ["k", "part"], "left_semi").select("result_id", "line_no").distinct()


def _cleaned(texts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = texts.value
        for b in batches:
            ids, out, gone = [], [], []
            for i, endpoint, body, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                site, text, n = site_of(endpoint), page_text(body.as_py(), raw.as_py()), 0
                if text and site:
                    lines = text.split("\n")
                    for no, s in visible_lines(text):
                        if f"{site}\0{normal(s)}" in drop:
                            lines[no - 1] = ""
                            n += 1
                    text = "\n".join(lines) if n else text
                ids.append(i)
                out.append(text)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(gone, pa.int32())], ["result_id", "text", "lines_removed"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the numbers of the lines that go."""
    for b in batches:
        out, gone = [], []
        for body, raw, nos in zip(b.column(1), b.column(2), b.column(3).to_pylist()):
            text = page_text(body.as_py(), raw.as_py())
            if text and nos:
                lines = text.split("\n")
                for n in nos:
                    lines[n - 1] = ""
                text = "\n".join(lines)
            out.append(text)
            gone.append(len(nos or ()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(gone, pa.int32())], ["result_id", "text", "lines_removed"])


def pages_without_repeats(results: DataFrame, at_least: int = AT_LEAST, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(result_id, text, lines_removed): each page's text with its confirmed lines blanked out.

    One row per result; a page without text keeps a null text.  A removed line
    leaves an empty line, so line numbers stay.  Only the pages of results that were delivered more than once are moved.
    """
    marked, exact = _found(results, at_least, SITE_SLOTS, TASK_SLOTS, limit)
    pages, schema = _pages(results).filter("result_id is not null"), "result_id bigint, text string, lines_removed int"
    if exact.count() <= limit:
        drop = results.sparkSession.sparkContext.broadcast(frozenset(r.text for r in exact.select("text").collect()))
        clean = lambda p: p.mapInArrow(_cleaned(drop), schema)
    else:
        nos = marked.join(exact.select("k", "part"), ["k", "part"], "left_semi").groupBy("result_id").agg(F.collect_set("line_no").alias("nos"))  # at most a page's lines
        nos = stage(nos, "nos")
        clean = lambda p: p.join(nos, "result_id", "left").select("result_id", "body", "raw", "nos").mapInArrow(_without, schema)
    again = stage(pages.groupBy("result_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("result_id"), "again")
    side = maybe_broadcast(again)
    twice = clean(pages.join(side, "result_id", "left_semi")).groupBy("result_id").agg(F.max(F.struct("text", "lines_removed")).alias("x")).select("result_id", "x.text", "x.lines_removed")
    return clean(pages.join(side, "result_id", "left_anti")).unionByName(twice)
