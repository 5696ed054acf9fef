"""Abusive, hateful and sexually explicit passages, scored per document.

Texts are cut into windows (sentences; long ones into overlapping runs of words).
Disguises are undone first: look-alike letters, zero-width marks, letters set apart
by dots, dashes or blanks.  Every word that is no ordinary word is then looked up in a
trie of the lexicon's terms by its Levenshtein automaton: one bit per place of the word
and number of edits, moved along the trie's edges, so a branch ends where no bit is left.  Masks match
any letter, digits and signs the letters they stand for, and stretched letters are passed
over at no cost; a plain misspelling costs edits (one for terms of five letters on, two from nine on) and
counts less.  Words of the rated clean examples, and words that many documents hold, are
ordinary and stand for themselves.

A window is described by its terms' kinds, by how they stand together (an address beside an insult, harm
beside a body part, a group called beasts), by what separates mention from abuse (quotation
marks, words that report or explain), and by its word sequences around a term.  A logistic model over
these starts from the lexicon's weights and is fitted on the rated examples; in a positive
example the window that scores highest is the positive one.  A document's score is that of its worst window.

The lexicon is a table beside this module (kind, weight, language, term).  The examples are
all read (``EXAMPLES`` bounds a larger table to its smallest ids).  Defined results: empty, blank
and null texts score 0; repeated rows are one document; null sources are a group of their
own; an empty table gives no rows; without examples the lexicon's weights alone score.
"""

from __future__ import annotations

import csv
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEXICON = Path(__file__).with_name("abuse_lexicon.csv")
#: Words of a window that mention, report or explain what they name.
REPORTING = set("flag words insults insult called removed moderators researchers studied rule quoted heard court accused threatened clinic advice health education word term slur quote quoting reported mention scene novel film study means".split())
YOU = set("you your yours yourself u ya du dein deine dich dir euch ihr tu ta te toi tes vous votre eres tú tus ti usted yer".split())
THEY = set("they them these those their all every diese dieses ces ils elles los las estos esos".split())
#: Words that may stand between an address and the insult it is called.
LINKS = set("are re r were is a an the such nothing but just what complete total absolute real fucking bloody little old big bist seid ein eine so es êtes etes un une una sos".split())
#: Words that make one of many out of an insult.
SORTS = set("kind sort type bunch pack load lot gang crowd only absolute what quel quelle espèce espece pedazo".split())
#: Score from which a document is a case; bound of the examples; words of a window and its step; least documents that make a word ordinary.
CASE, EXAMPLES, WINDOW, STEP, ORDINARY = 0.0, 100_000, 40, 20, 20
#: Letters from which a term may be misspelt once, and twice; edits of words that stand for it.
ONCE, TWICE = 5, 9
#: Kinds of terms that tell nothing on their own.
SILENT = ("wish", "body", "group")
#: Fitting: rounds, strength that holds weights to where they start, least examples of a word sequence.
ROUNDS, HOLD, LEAST = 400, 0.02, 2

ZERO = re.compile("[​-‏⁠﻿­̀-ͯ]")
APART = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$*])(?:([.\-_])(?:[^\W_]|[@$*]))(?:\1(?:[^\W_]|[@$*]))+(?![^\W_])\1?")
BLANKS = re.compile(r"(?<![^\W_])[^\W\d_](?: [^\W\d_])(?: [^\W\d_])+(?![^\W_])")
WORD = re.compile(r"[^\W_][^\W_*@$!]*(?:[*@$!]+[^\W_]+)*|[@$*][^\W_]+(?:[*@$!]+[^\W_]+)*")
ENDS = re.compile(r"(?<=[.!?;:…])\s+|\n+")
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»")
# Look-alike letters, and what digits and signs stand for.
ALIKE = str.maketrans("авекмнорстухіјѕԁɡοαενρτ", "abekmhopctyxijsdgoaevpt")
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "9": "g", "6": "g"}


PLAIN = re.compile(r"[^\W_]+")


def tokens(s: str) -> list[str]:
    """The words of a text; where no sign can stand in a word, the plainer pattern gives the same."""
    return (WORD if "*" in s or "@" in s or "$" in s or "!" in s else PLAIN).findall(s)


def plain_text(text: str) -> str:
    """Lower-cased, without marks and zero-width characters, set-apart letters joined."""
    s = text
    if not s.isascii():
        s = ZERO.sub("", unicodedata.normalize("NFKD", s))
        s = s.lower().translate(ALIKE) if any("Ͱ" <= c <= "ӿ" for c in s) else s.lower()
    else:
        s = s.lower()
    return APART.sub(lambda m: m[0].replace(m[1], ""), s)


@lru_cache(1)
def lexicon() -> tuple[dict[str, tuple[str, float]], dict[tuple[str, ...], tuple[str, float]]]:
    """(terms, idioms) of the table, each with its kind and weight; terms of several kinds keep the first."""
    terms: dict = {}
    idioms: dict = {}
    with open(LEXICON, encoding="utf-8") as f:
        for r in csv.DictReader(f):
            words = tuple(plain_text(r["term"]).split())
            if len(words) > 1:
                idioms.setdefault(words, (r["kind"], float(r["weight"])))
            else:
                terms.setdefault(words[0], (r["kind"], float(r["weight"])))
    return terms, idioms


class Trie:
    """The lexicon's terms, walked by the Levenshtein automaton of a word."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            at = self.root
            for c in w:
                at = at.setdefault(c, {})
            at[""] = w

    def exact_from(self, s: str, i: int) -> str | None:
        """Longest word that starts at i."""
        at, best = self.root, None
        for c in s[i:]:
            at = at.get(c)
            if at is None:
                break
            best = at.get("", best)
        return best

    def match(self, token: str, edits: int = 1) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within so many edits; the longest one on ties.

        Bit i of state e is set when i letters of the token are read with e edits.  A swap of neighbouring
        letters is one edit.
        """
        s = re.sub(r"([^*])\1{2,}", r"\1\1", token)
        stretched = s != token
        n = len(s)
        bits: dict[str, int] = {}
        mask = leet = free = 0
        for i, c in enumerate(s):
            if c == "*":
                mask |= 1 << i
            for o in LEET.get(c, c):
                bits[o] = bits.get(o, 0) | 1 << i
            if i and c != "*" and (s[i - 1] == c or c in LEET and s[i - 1] in LEET[c] or s[i - 1] in LEET and c in LEET[s[i - 1]]):
                leet |= 1 << i
        if stretched or mask or any(c in LEET for c in s):
            free = leet  # a letter like the one before it may be passed over
        end, full = 1 << n, (1 << (n + 1)) - 1

        def rest(states: list[int]) -> tuple[int, ...]:
            """States after letters of the token are passed over, at no cost or at one edit each."""
            out = []
            below = 0
            for x in states:
                x |= below
                while (y := x | (x & free) << 1) != x:
                    x = y
                out.append(x & full)
                below = x << 1
            return tuple(out)

        best: tuple[int, int, str] | None = None
        todo = [(self.root, rest([1] + [0] * edits), (0,) * (edits + 1), 0)]
        while todo:
            node, states, earlier, last = todo.pop()
            if "" in node:
                e = next((e for e, x in enumerate(states) if x & end), None)
                if e is not None and (best is None or (e, -len(node[""])) < best[:2]):
                    best = (e, -len(node[""]), node[""])
            for c, below in node.items():
                if not c:
                    continue
                b = bits.get(c, 0) | mask
                moved = []
                for e, x in enumerate(states):
                    y = (x & b) << 1
                    if e:
                        y |= states[e - 1] | states[e - 1] << 1  # a letter missing, or another letter
                        y |= ((earlier[e - 1] & b) << 1 & last) << 1  # two letters that changed places
                    moved.append(y & full)
                new = rest(moved)
                if any(new):
                    todo.append((below, new, states, b))
        return (best[2], best[0]) if best else None


class Scorer:
    """Scores windows; the fitted weights and the ordinary words are given."""

    KEPT = 200_000

    def __init__(self, fitted: dict[tuple, float] | None = None, ordinary: frozenset[str] = frozenset()):
        self.terms, self.idioms = lexicon()
        self.starts: dict[str, list] = {}
        for words, (kind, weight) in self.idioms.items():
            self.starts.setdefault(words[0], []).append((words, kind, weight))
        self.fuzzy = [t for t in self.terms if len(t) >= 3]
        self.trie = Trie(self.fuzzy)
        self.letters = np.array([sum(1 << k for k in {ord(c) % 32 for c in t if c.isalpha()}) for t in self.fuzzy], np.uint32)
        self.lengths = np.array([len(t) for t in self.fuzzy])
        # terms that are ordinary words elsewhere are near other ordinary words: only long ones may be misspelt
        self.allowed = np.array([self._edits(t) for t in self.fuzzy])
        self.fitted = fitted or {}
        self.sequences = {k for k in self.fitted if k[0] == "w"}
        self.ordinary = ordinary
        self.known = {w for words in self.idioms for w in words} | YOU | THEY | LINKS | SORTS | REPORTING
        self.seen: dict[str, tuple[str, float]] = {}
        self.cold: set[str] = set()
        # what tells anything holds one of these words; wishes, parts of the body and groups tell nothing on their own
        self.anchors = {t for t, (kind, _) in self.terms.items() if kind not in SILENT} | {max(words, key=lambda w: (w not in YOU | LINKS, len(w))) for words in self.idioms}

    def _edits(self, term: str) -> int:
        """Edits that a term may be away."""
        if self.terms[term][0] in ("body", "wish", "group", "dead", "hint") and len(term) <= ONCE:
            return 0
        return 2 if len(term) >= TWICE else 1 if len(term) >= ONCE else 0

    def term(self, token: str) -> tuple[str, float]:
        """(the word it stands for, how sure)."""
        got = self.seen.get(token)
        if got is None:
            got = self._term(token)
            if len(self.seen) >= self.KEPT:
                self.seen.clear()
            self.seen[token] = got
        return got

    def _term(self, token: str) -> tuple[str, float]:
        if token in self.terms or len(token) < 3 or token.isdigit():
            return token, 1.0
        for tail in ("s", "es"):
            if token.endswith(tail) and token[: -len(tail)] in self.terms:
                return token[: -len(tail)], 1.0
        strange = not token.isalpha() or re.search(r"(.)\1\1", token) is not None
        if strange:
            m = self.trie.match(token, 0) or (self.trie.match(token[:-1], 0) if token.endswith("s") else None)
            if m and sum(c.isalpha() for c in token) >= 1:
                return m[0], 1.0
            if not token.isalpha() or len(token) < ONCE:
                return token, 1.0
        if token in self.ordinary or token in self.known or len(token) < ONCE - 1:
            return token, 1.0
        own = np.uint32(sum(1 << k for k in {ord(c) % 32 for c in token}))
        apart = np.bitwise_count(self.letters ^ own)
        near = (apart <= 2 * self.allowed) & (np.abs(self.lengths - len(token)) <= self.allowed) & (self.allowed > 0)
        if not near.any():
            return token, 1.0
        m = self.trie.match(token, int(self.allowed[near].max()))
        if m and m[1] <= self._edits(m[0]):
            return m[0], (1.0, 0.8, 0.6)[m[1]]
        return token, 1.0

    def _terms(self, found: list[str]) -> list[tuple[str, float, int]]:
        seen = self.seen
        return [(*(seen.get(t) or self.term(t)), 0) for t in found]

    def words(self, s: str) -> list[tuple[str, float, int]]:
        """(term, sureness, place) of a normalised window; letters set apart by blanks are segmented by the trie."""
        out = []
        spaced = [m.span() for m in BLANKS.finditer(s)]
        if not spaced and "-proof" not in s and not any(c in s for c in '"“«„'):
            return self._terms(tokens(s))
        for m in WORD.finditer(s):
            p = m.start()
            span = next(((a, b) for a, b in spaced if a <= p < b), None)
            if span is None:
                if s.startswith("-proof", m.end()):
                    continue
                out.append((*self.term(m[0]), p))
            elif span[0] == p:
                run, i = s[span[0] : span[1]].replace(" ", ""), 0
                while i < len(run):
                    w = self.trie.exact_from(run, i)
                    out.append((w or run[i], 1.0, p))
                    i += len(w) if w else 1
        return out

    def features(self, terms: list[tuple[str, float, int]], quotes: list[tuple[int, int]]) -> dict[tuple, float]:
        """What a window holds: kinds of terms, how they stand together, sequences of its words."""
        words = [w for w, _, _ in terms]
        held = set(words)
        f: dict[tuple, float] = {}
        if held.isdisjoint(self.anchors):
            return f
        top = lambda k, x: f.__setitem__(k, max(f.get(k, 0.0), x))
        quoted = [any(a <= p < b for a, b in quotes) for _, _, p in terms] if quotes else None
        free = lambda i: 0.0 if quoted is not None and quoted[i] else 1.0
        kinds: list = [self.terms.get(w) for w in words]
        reports = bool(held & REPORTING)
        addressed, others = bool(held & YOU), bool(held & THEY)
        n: Counter = Counter()
        at: dict[str, list[int]] = {}
        for i, k in enumerate(kinds):
            if k and free(i):
                at.setdefault(k[0], []).append(i)
                n["plain" if k[0] == "insult" and k[1] < 1 else k[0]] += k[1] * terms[i][1]
        for kind, x in n.items():
            f["k", kind] = min(x, 0.5 if kind == "plain" else 1.6)
        you = [i for i, w in enumerate(words) if w in YOU and free(i)]
        for i in sorted(at.get("insult", []) + at.get("beast", [])):
            sure, strong = terms[i][1], kinds[i][1]
            j = i - 1
            while j >= 0 and (words[j] in LINKS or kinds[j] and kinds[j][0] == "describer"):
                j -= 1
            if strong >= 1 and j == i - 1 and j > 1 and words[j] not in YOU and words[j - 1] in LINKS:  # one word that describes it
                j -= 1
                while j >= 0 and words[j] in LINKS:
                    j -= 1
            if j >= 0 and words[j] in YOU and (j < i - 1 or strong >= 1 or i == len(words) - 1 or words[j] in ("eres", "du", "tu")):
                top(("c", "called"), sure)
            if i and kinds[i - 1] and kinds[i - 1][0] == "describer" or i > 1 and kinds[i - 2] and kinds[i - 2][0] == "describer" and words[i - 1] in LINKS:
                top(("c", "described"), sure)
            if any(abs(i - y) <= 6 for y in you):
                top(("c", "near you"), sure * strong)
            if i and words[i - 1] in SORTS or i > 1 and words[i - 2] in SORTS:
                top(("c", "sort of"), sure)
            if others:
                top(("c", "they insult"), sure)
        for i in at.get("describer", ()):
            if i and words[i - 1] in ("you", "u", "du", "tu", "vous"):
                top(("c", "you describer"), terms[i][1])
            if 0 < i < len(words) - 1 and words[i - 1] == "too" and words[i + 1] == "to":
                top(("c", "too bad to"), terms[i][1])
        for i in at.get("harm", []) + at.get("dead", []):
            if "go" in words[max(0, i - 2) : i]:
                top(("c", "go die"), terms[i][1])
        for i in at.get("harm", ()):
            if any(abs(i - y) <= 3 for y in you):
                top(("c", "harm you"), terms[i][1] * kinds[i][1])
            if any(0 < b - i <= 4 for b in at.get("body", ())) and you:
                top(("c", "harm body"), terms[i][1])
            if any(0 < i - w <= 4 for w in at.get("wish", ())) and (you or others):
                top(("c", "wish harm"), terms[i][1] * kinds[i][1])
            if others and any(0 < t - i <= 3 and words[t] in THEY for t in range(i, min(len(words), i + 4))):
                top(("c", "harm them"), terms[i][1] * kinds[i][1])
        for i in at.get("dead", ()):
            if any(0 < i - w <= 5 for w in at.get("wish", ())) and (you or others):
                top(("c", "wish dead"), terms[i][1])
        for i in at.get("beast", ()):
            before = set(words[max(0, i - 6) : i])
            if before & {"are", "like", "is", "sind", "ist", "son", "sont", "unas", "unos", "de"} and (others or "group" in at):
                top(("c", "they beasts"), terms[i][1])
        if at.get("expel") and (others or you or "group" in at):
            top(("c", "expel them"), 1.0)
        sexual = n["explicit"] + n["hint"]
        if sexual > 1.2:
            f["c", "sexual words"] = min(sexual - 1.2, 1.5)
        for i, w in enumerate(words):
            for idiom, kind, weight in self.starts.get(w, ()):
                if free(i) and tuple(words[i : i + len(idiom)]) == idiom:
                    f["i", kind] = min(f.get(("i", kind), 0.0) + weight, 3.0)
        if self.sequences:
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    if (g := ("w", *words[i : i + k])) in self.sequences and free(i):
                        f[g] = 1.0
        if not f:
            return f
        if reports:
            f["r", "reports"] = 1.0
            if not addressed:
                f["r", "of others"] = 1.0
        if quoted is not None and any(quoted[i] and k and k[0] in ("insult", "harm", "describer", "explicit") for i, k in enumerate(kinds)):
            f["r", "quotes"] = 1.0
        return f

    def margin(self, f: dict[tuple, float]) -> float:
        if not f:
            return BIAS
        w = self.fitted
        return sum(x * w.get(k, START.get(k, 0.0)) for k, x in f.items()) + w.get(("b",), BIAS)

    def tells(self, tokens: list[str]) -> bool:
        """Whether any of the words stands for one that tells something; words that don't are remembered."""
        if self.cold.issuperset(tokens):
            return False
        if len(self.cold) >= self.KEPT:
            self.cold.clear()
        cold = {t for t in set(tokens) - self.cold if self.term(t)[0] not in self.anchors}
        self.cold |= cold
        return not self.cold.issuperset(tokens)

    def windows(self, text: str) -> Iterator[dict[tuple, float]]:
        """The features of every window of a text that holds a telling word."""
        plain = plain_text(text)
        apart = BLANKS.search(plain) is not None
        if not apart and not self.tells(tokens(plain)):
            return
        for part in ENDS.split(plain):
            found = tokens(part)
            if not found or not apart and not self.tells(found):
                continue
            plainly = not apart and "-proof" not in part and '"' not in part and "“" not in part and "«" not in part and "„" not in part
            terms = self._terms(found) if plainly else self.words(part)
            if not terms:
                continue
            quotes = [m.span() for m in QUOTED.finditer(part)] if '"' in part or "“" in part or "«" in part or "„" in part else []
            for at in range(0, max(1, len(terms) - STEP), STEP) if len(terms) > WINDOW else (0,):
                yield self.features(terms[at : at + WINDOW], quotes)

    def score(self, text: str | None) -> tuple[float, str | None]:
        """(score, label): log-odds of the worst window, 0 for texts without words; the label is its strongest kind."""
        best: tuple[float, str | None] = (BIAS, None)
        if not text or not text.strip():
            return best
        worst: dict = {}
        for f in self.windows(text):
            s = self.margin(f)
            if s > best[0]:
                best, worst = (s, None), f
        return best[0], self.label(worst)

    @staticmethod
    def label(f: dict[tuple, float]) -> str | None:
        by: Counter = Counter()
        for k, x in f.items():
            if k[0] in "kci":
                by[LABELS.get(k[1], "abuse")] += x
        return by.most_common(1)[0][0] if by else "abuse" if f else None


LABELS = {"explicit": "sexual", "hint": "sexual", "sexual words": "sexual", "beast": "hate", "group": "hate", "expel": "hate", "they beasts": "hate", "expel them": "hate", "they insult": "hate"}
#: Log-odds of a window with nothing in it, and the weights that the fit starts from and is held to.
BIAS = -4.0
START = {
    ("k", "insult"): 2.0, ("k", "plain"): 0.6, ("k", "describer"): 0.8, ("k", "beast"): 0.8, ("k", "group"): 0.0, ("k", "harm"): 0.6, ("k", "body"): 0.0, ("k", "wish"): 0.0, ("k", "dead"): 0.3, ("k", "expel"): 0.5,
    ("k", "silence"): 3.0, ("k", "explicit"): 3.0, ("k", "hint"): 0.8,
    ("c", "called"): 4.5, ("c", "described"): 2.5, ("c", "near you"): 1.5, ("c", "sort of"): 2.5, ("c", "they insult"): 1.0, ("c", "you describer"): 3.5,
    ("c", "harm you"): 4.0, ("c", "harm body"): 4.5, ("c", "wish harm"): 3.5, ("c", "wish dead"): 4.0, ("c", "harm them"): 3.5, ("c", "they beasts"): 4.6, ("c", "too bad to"): 4.5, ("c", "go die"): 3.0, ("c", "expel them"): 3.5, ("c", "sexual words"): 3.0,
    ("i", "silence"): 2.2, ("i", "scorn"): 3.2, ("i", "explicit"): 3.0, ("r", "reports"): -2.0, ("r", "of others"): -2.0, ("r", "quotes"): -2.0,
}


def clean_words(rows: list[tuple[str, int, str | None]]) -> frozenset[str]:
    """Words of the examples that are rated clean."""
    return frozenset(w for text, label, _ in rows if not label for w in tokens(plain_text(text or "")) if w.isalpha())


def fit(rows: list[tuple[str, int, str | None]], ordinary: frozenset[str] = frozenset()) -> dict[tuple, float]:
    """Weights from rated examples, read in the given order."""
    base = Scorer(None, ordinary)
    count: Counter = Counter()
    for text, _, _ in rows:
        for part in ENDS.split(plain_text(text or "")):
            words = [w for w, _, _ in base.words(part)]
            count.update({("w", *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)})
    telling = {t for t, (kind, _) in base.terms.items() if kind not in SILENT}
    known = {k: 0.0 for k, c in count.items() if c >= LEAST and not telling.isdisjoint(k[1:])} | dict(START)
    wide = Scorer(known, ordinary)
    bags = [(list(wide.windows(text or "")), int(label)) for text, label, _ in rows]
    names = sorted({k for b, _ in bags for f in b for k in f} | set(START))
    place = {k: i for i, k in enumerate(names)}
    start = np.array([START.get(k, 0.0) for k in names] + [BIAS])
    w = start.copy()
    flat = [(b, f, y) for b, (fs, y) in enumerate(bags) for f in fs if f]
    if not flat:
        return dict(START)
    r = np.concatenate([np.full(len(f), i) for i, (_, f, _) in enumerate(flat)])
    c = np.concatenate([[place[k] for k in f] for _, f, _ in flat]).astype(int)
    x = np.concatenate([list(f.values()) for _, f, _ in flat])
    bag = np.array([b for b, _, _ in flat])
    y = np.array([label for _, _, label in flat], float)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(r, x * w[c], len(flat)) + w[-1]
        best = np.full(len(bags), -np.inf)
        np.maximum.at(best, bag, z)
        use = (y == 0) | (z >= best[bag])  # of a positive example only its worst window
        d = (1 / (1 + np.exp(-z)) - y) * use
        g = np.r_[np.bincount(c, x * d[r], len(w) - 1), d.sum()] + HOLD * len(bags) / 60 * (w - start)
        g[-1] = 0.0  # the bias stays: a window that holds nothing telling is clean
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    out = {k: float(v) for k, v in zip(names, w) if abs(v) > 1e-3 or k in START}
    out["b",] = float(w[-1])
    return out


def _strangers(model):
    """Words of each document that the automaton would take for a term of the lexicon at the cost of edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(None, model.value)
        held: Counter = Counter()
        usual: set[str] = set()
        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                if text:
                    strange = set(tokens(plain_text(text))) - usual
                    fuzzy = {t for t in strange if t.isalpha() and scorer.term(t)[1] < 1}
                    if len(usual) < Scorer.KEPT:
                        usual |= strange - fuzzy
                    held.update(fuzzy)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return run


def ordinary_words(documents: DataFrame, clean: frozenset[str], least: int = ORDINARY) -> frozenset[str]:
    """Words near a term that so many documents hold that they are words of their own, counted over all rows.

    At most (all words of all documents) / ``least`` and, as each lies within two edits of a
    term of the lexicon, a short list whatever the number of documents.
    """
    model = documents.sparkSession.sparkContext.broadcast(clean)
    counted = documents.select("text").mapInArrow(_strangers(model), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r.word for r in counted.filter(F.col("n") >= least).collect())


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for b in batches:
            ids, scores, labels = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None:
                    continue
                s, label = scorer.score(text.as_py())
                ids.append(i)
                scores.append(round(1 / (1 + float(np.exp(-s))), 4) if s > BIAS else 0.0)
                labels.append(label if s >= CASE else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(labels, pa.string())], ["doc_id", "score", "category"])

    return run


def scores(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id, score, category): every document's score between 0 and 1; category is null below one half."""
    rows = [tuple(r) for r in examples.filter("text is not null and label is not null").orderBy("example_id").limit(EXAMPLES).select("text", "label", "category").collect()]
    clean = clean_words(rows)
    ordinary = clean | ordinary_words(documents, clean)
    model = documents.sparkSession.sparkContext.broadcast((fit(rows, ordinary), ordinary))
    scored = documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scored(model), "doc_id bigint, score double, category string")
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"), F.max("category").alias("category"))


def found(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id) of the documents with an abusive, hateful or sexually explicit passage."""
    return scores(documents, examples).filter(F.col("category").isNotNull()).select("doc_id")


def rates(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(source, documents, cases, rate) per source."""
    s = scores(documents, examples).join(documents.groupBy("doc_id").agg(F.min("source").alias("source")), "doc_id")
    g = s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("category").alias("cases"))
    return g.withColumn("rate", F.col("cases") / F.col("documents"))
