"""Template residue, filler, error messages and script notices in place of content.

Labelled exemplars (a table beside this module) lie in an inverted index.  A passage (a visible line of the
page without its menu, header, aside and footer, and without a heading that is no message) looks up its
words; where an exemplar is contained, by TF-IDF weight, in a window of the passage, the span of the match is covered.
A passage in other words than the exemplars' is laid the other way round over the exemplars of one label that it
retrieves: where their words contain the passage, but for a word or two that stand in a slot, it is
covered whole.  Unfilled slots are exemplars, too: their marks are the index words, they must be contained
completely, in order, and "_" stands for a name.

Filler has no fixed wording.  Words of passages that a filler exemplar opens are candidates; those
that nearly always stand among other candidates, counted over all rows, are filler words, and windows
they contain are covered, as are windows that say the same word or two again and again.  A page
whose covered words make up most of its words is residue; so is any page with
an unfilled slot in its prose.  Document frequencies are counted over all rows.

What stands in code or in quotation marks is content, never a match.  Defined
results: null and empty bodies are no case; a response delivered twice is one
record; the status code is not consulted; very long bodies are read whole; an
empty table gives no rows.
"""

from __future__ import annotations

import csv
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.markup import collapse, sub_elements, sub_tags, without_hidden

EXEMPLARS = Path(__file__).with_name("residue_exemplars.csv")
#: Share of an exemplar's weight a window must hold; words a window may exceed its exemplar by; covered share that makes a page residue.
CONTAINED, SLACK, COVERED = 0.75, 3, 0.6
#: Share of a passage's weight its label's exemplars must hold; share of one of them it must hold; words for each slot that is left out of account.
PASSAGE, TOUCHED, SLOT_WORDS = 0.8, 0.5, 4
#: Words of a window of filler, its share in the vocabulary, distinct words of a run.
FILLER_WINDOW, FILLER_SHARE, RUN_WORDS = 6, 0.8, 2
#: Least texts of a candidate for a filler word, and least share of its places among other candidates.
CANDIDATE, AMONG = 3, 0.8

ASIDE, CODE = ("nav", "footer", "header", "aside"), ("pre", "code", "samp", "kbd", "textarea", "xmp")
WORD = re.compile(r"[^\W\d_]+(?![^\W_]*\d)")
BREAKS = re.compile(r"(?i)<(?:br|/p|/li|/h[1-6]|/div|/section|/td|/tr)\b[^>]*>")
TRACE = re.compile(r"^\s*(?:at [\w.$<>]+\([^()\n]*\)|File \"[^\"\n]*\", line \d+.*)\s*$")
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|`[^`\n]*`")
#: Leads a passage that is the page's heading; a heading that is no message counts as its title.
MARK = "\x01"
#: Marks, names and other characters of a passage that may hold slots; a label before an empty value.
TOKEN = re.compile(r"\{\{|\}\}|\$\{|#\{|\{%|%\}|<%=?|%>|\*\||\|\*|@@|\[\[|\]\]|__|[^\W\d_](?:[\w.\-]*[^\W_])?|\d+|\S")
LABELLED = re.compile(r"^[^\W\d_][\w ]{0,30}:\s*")


@lru_cache(1)
def exemplars() -> list[tuple[str, str]]:
    """(label, text) of the table."""
    with open(EXEMPLARS, encoding="utf-8") as f:
        return [(r["label"], r["text"]) for r in csv.DictReader(f)]


def _wording(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+|_", text)


@lru_cache(1)
def vocabulary() -> frozenset[str]:
    return frozenset(w for label, text in exemplars() if label not in ("slot", "empty") for w in _wording(text) if w != "_")


def _strings(x: object) -> Iterator[str]:
    todo = [x]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)


def passages(body: str) -> tuple[list[str], int]:
    """(passages, words of code) of a page; for a JSON body its strings."""
    if body[:1] in "{[":
        try:
            return [s for s in map(collapse, _strings(json.loads(body))) if s], 0
        except (ValueError, RecursionError):
            pass
    text = sub_elements(lambda *_: " ", without_hidden(body), ASIDE)
    code = 0

    def shown(_: str, whole: str, __: str) -> str:
        nonlocal code
        lines = [x for x in sub_tags(" ", whole).split("\n") if x.strip()]
        if sum(bool(TRACE.match(x)) for x in lines) * 2 <= len(lines):  # a stack trace belongs to its error message
            code += sum(len(WORD.findall(x)) for x in lines)
        return " "

    text = sub_elements(shown, text, CODE)
    text = sub_elements(lambda _, __, inner: f"\n{MARK}{collapse(sub_tags(' ', inner))}\n", text, ("h1",), to_end=False)
    lines = (collapse(s) for s in sub_tags(" ", sub_tags("\n", text, BREAKS)).split("\n"))
    return [s for s in lines if s], code


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the passages that a filler exemplar opens."""
    n: Counter = Counter()
    for b in batches:
        for body in b.column(0):
            words = set()
            for s in passages(body.as_py())[0]:
                w = WORD.findall(s.lower())
                if w[:2] == ["lorem", "ipsum"]:
                    words.update(w[2:])
            n.update(words)
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])


def _frequencies(candidates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, maybe, n, among, apart, texts = vocabulary() | candidates.value, candidates.value, Counter(), Counter(), Counter(), 0
        for b in batches:
            for body in b.column(0):
                body = body.as_py()
                if not body:
                    continue
                texts += 1
                seen: set = set()
                for s in passages(body)[0]:
                    words = WORD.findall(s.lower())
                    held = known.intersection(words)
                    seen |= held
                    if maybe and not maybe.isdisjoint(held):
                        count = Counter(w for w in words if w in maybe)
                        (among if sum(count.values()) >= AMONG * len(words) else apart).update(count)
                n.update(seen)
        words = ["", *{*n, *among, *apart}]
        cols = [[texts, *(n[w] for w in words[1:])], [0, *(among[w] for w in words[1:])], [0, *(apart[w] for w in words[1:])]]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["word", "n", "among", "apart"])

    return run


def frequencies(responses: DataFrame) -> tuple[dict[str, int], frozenset[str]]:
    """(texts that hold each exemplar word, '' for the number of texts; filler words), over all rows.

    Both lists are as long as the wording of exemplars and of filler, not as the corpus.
    """
    lead = responses.filter(F.col("body").rlike(r"(?i)lorem\s+ipsum")).select("body").mapInArrow(_opened, "word string, n bigint")
    candidates = frozenset(r.word for r in lead.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= CANDIDATE).select("word").collect())
    sent = responses.sparkSession.sparkContext.broadcast(candidates)
    counted = responses.select("body").mapInArrow(_frequencies(sent), "word string, n bigint, among bigint, apart bigint").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "among", "apart")))
    rows = counted.collect()
    return {r.word: r.n for r in rows}, frozenset(r.word for r in rows if r.word in candidates and r.among >= AMONG * (r.among + r.apart))


class Index:
    """Inverted index from words to the exemplars that cannot be contained without them, and from words to labels' exemplars."""

    def __init__(self, df: dict[str, int], filler: frozenset[str] = frozenset()):
        n = df.get("", 0) + 1
        self.most = math.log(n + 1) + 0.1
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 0.1 for w in vocabulary()}
        self.exemplars: list = []
        self.postings: dict[str, list[int]] = {}
        self.touching: dict[str, list[int]] = {}
        self.slots: dict[str, list[tuple[list[str], bool]]] = {}
        self.empty = set()
        latin = set()
        for label, text in exemplars():
            if label == "slot":
                marks = TOKEN.findall(text.replace("_", " \x02 ") if not text.startswith("__") else "__ \x02 __")
                tight = " _ " not in f" {text} ".replace("  ", " ") or text.startswith("__")
                self.slots.setdefault(marks[0], []).append((marks, tight))
                continue
            if label == "empty":
                self.empty.add(text)
                continue
            words = _wording(text)
            if label == "filler" and len(words) >= 15 and "_" not in words and not self._ordinary(words, df, n):
                latin.update(words)  # the classical passage
                continue
            tf = Counter(w for w in words if w != "_")
            weight = {w: self.idf[w] for w in tf}
            total = sum(weight.values())
            tail = len(words) - len(text.rstrip("_ ").split())
            k = len(self.exemplars)
            self.exemplars.append((label, weight, total, len(words) + SLACK, tail))
            left = total
            for w in sorted(weight, key=weight.__getitem__, reverse=True):
                self.touching.setdefault(w, []).append(k)
                if left >= CONTAINED * total:  # without all the words so far too little would be left
                    self.postings.setdefault(w, []).append(k)
                left -= weight[w]
        self.filler = frozenset(filler | latin)
        self.labels = {w: {self.exemplars[k][0] for k in ks} for w, ks in self.touching.items()}

    @staticmethod
    def _ordinary(words: list[str], df: dict[str, int], n: int) -> bool:
        return sum(df.get(w, 0) > 0.05 * n for w in words) > len(words) / 2

    def slot(self, s: str, inside) -> bool:
        """Whether a slot exemplar is contained in the passage, outside quotation marks."""
        if not any(c in s for c in "{[%_@*<"):
            return False
        found = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(s)]
        for i, (t, start, _) in enumerate(found):
            for marks, tight in self.slots.get(t, ()):
                part = found[i : i + len(marks)]
                if len(part) < len(marks) or not all(a == b[0] or a == "\x02" and b[0][0].isalpha() for a, b in zip(marks, part)) or inside(start):
                    continue
                end = part[-1][2]
                if tight and (s[end : end + 1].isalnum() or start and (s[start - 1].isalnum() or s[start - 1] in "_%/.") or marks[0] != "[" and any(a[2] != b[1] for a, b in zip(part, part[1:]))):
                    continue
                return True
        return False

    def cover(self, words: list[str], quoted: list[bool]) -> tuple[set[int], set[str]]:
        """(covered places, labels) of one passage."""
        covered: set[int] = set()
        labels: set[str] = set()
        n = len(words)
        held = set(words)
        for k in {k for w in held & self.postings.keys() for k in self.postings[w]}:
            label, weight, total, span, tail = self.exemplars[k]
            at = [i for i, w in enumerate(words) if w in weight and not quoted[i]]
            if sum(weight[w] for w in {words[i] for i in at}) < CONTAINED * total:
                continue
            inside: Counter = Counter()
            x, have = 0, 0.0
            for y, j in enumerate(at):  # the window ends at j and starts where it is still short enough
                inside[words[j]] += 1
                have += weight[words[j]] if inside[words[j]] == 1 else 0
                while at[x] <= j - span:
                    inside[words[at[x]]] -= 1
                    have -= weight[words[at[x]]] if inside[words[at[x]]] == 0 else 0
                    x += 1
                if have >= CONTAINED * total - 1e-9:
                    covered.update(range(at[x], min(n, j + 1 + tail)))
                    labels.add(label)
        if len(covered) < n:
            self._in_other_words(words, held, quoted, covered, labels)
        size = min(FILLER_WINDOW, n)
        known = len(self.filler.intersection(words))
        again = sum(a == b for a, b in zip(words, words[2:])) + sum(a == b for a, b in zip(words, words[1:])) if n >= 4 else 0
        if known >= FILLER_SHARE * size or known and again or again >= 2:
            fill = [0 if q else (w in self.filler) for w, q in zip(words, quoted)]
            for i in range(n - size + 1):
                few = size >= 4 and len(set(words[i : i + size])) <= RUN_WORDS and not any(quoted[i : i + size])
                if few or sum(fill[i : i + size]) >= FILLER_SHARE * size:
                    covered.update(range(i, i + size))
                    labels.add("filler")
        return covered, labels

    def _in_other_words(self, words: list[str], held: set[str], quoted: list[bool], covered: set[int], labels: set[str]) -> None:
        """Covers a passage that the exemplars it retrieves contain, label by label."""
        if any(quoted):
            return
        free = 1 if len(words) >= SLOT_WORDS else 0
        free += len(words) >= 2 * SLOT_WORDS + 1
        known = held & self.labels.keys()
        if len(held) - len(known) > max(free, (1 - PASSAGE) * len(held)) + 1:
            return
        for label in {x for w in known for x in self.labels[w]}:
            touched = {k for w in known if label in self.labels[w] for k in self.touching[w] if self.exemplars[k][0] == label}
            share = {k: sum(v for w, v in self.exemplars[k][1].items() if w in held) / self.exemplars[k][2] for k in touched}
            if max(share.values()) < TOUCHED:
                continue
            pool = {w for k in touched if share[k] >= TOUCHED / 2 for w in self.exemplars[k][1]}
            strange = sorted((self.idf.get(w, self.most) for w in held - pool), reverse=True)[free:]
            inside = sum(self.idf[w] for w in held & pool)
            if inside >= PASSAGE * (inside + sum(strange)):
                covered.update(range(len(words)))
                labels.add(label)

    def judge(self, body: str) -> tuple[float, str | None]:
        """(covered share, label of the residue or None)."""
        parts, total = passages(body)
        done, labels, slot = 0, set(), False
        for s in parts:
            marks = [(m.start(), m.end()) for m in QUOTED.finditer(s)] if '"' in s or "“" in s or "«" in s or "„" in s or "`" in s else []
            inside = lambda p: any(a <= p < b for a, b in marks)
            slot = slot or self.slot(s, inside)
            if ":" in s and not slot:
                bare = s.lstrip(MARK)
                m = LABELLED.match(bare)
                slot = bool(m) and bare[m.end() :].strip() in self.empty
            if marks:
                found = list(WORD.finditer(s))
                words, quoted = [m[0].lower() for m in found], [inside(m.start()) for m in found]
            else:
                words = WORD.findall(s.lower())
                quoted = [False] * len(words)
            total += len(words)
            c, found_labels = self.cover(words, quoted)
            if s[0] == MARK and len(c) < COVERED * len(words):
                total -= len(words)
                continue
            done += len(c)
            labels |= found_labels
        share = done / total if total else 0.0
        if slot:
            return share, "slot"
        real = labels - {"beside"}
        return share, (sorted(real)[0] if real and share >= COVERED else None)


def _judged(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*model.value)
        for b in batches:
            ids, shares, labels = [], [], []
            for i, body in zip(b.column(0).to_pylist(), b.column(1)):
                body = body.as_py()
                if i is None:
                    continue
                share, label = index.judge(body) if body else (0.0, None)
                ids.append(i)
                shares.append(share)
                labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shares, pa.float64()), pa.array(labels, pa.string())], ["response_id", "covered", "label"])

    return run


def judged(responses: DataFrame) -> DataFrame:
    """(response_id, covered, label): the covered share of each response and what residue it is, null for none."""
    model = responses.sparkSession.sparkContext.broadcast(frequencies(responses))
    return responses.select(F.col("response_id").cast("bigint"), "body").mapInArrow(_judged(model), "response_id bigint, covered double, label string").groupBy("response_id").agg(F.max("covered").alias("covered"), F.max("label").alias("label"))


def found(responses: DataFrame) -> DataFrame:
    """(response_id) of the responses that hold residue instead of, or a slot within, their content."""
    return judged(responses).filter("label is not null").select("response_id")
