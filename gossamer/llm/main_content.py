"""Main body of web pages: a bidirectional LSTM labels every line in the light of the whole page.

A page is the sequence of its visible lines (its leaves).  Each leaf is read as
the mean of hashed tag-path vectors (all open elements and their class words, the nearest ones by their place, the
elements of the line, link targets), the mean of hashed word vectors, and a few numbers on its shape.  One LSTM runs
down the page and one up; a linear layer over both and the leaf gives the
probability that the line belongs to the article.  The weights lie beside this
module; ``train_main_content`` makes them.

All lines of a page are read, however many; pages are gathered until they hold a bounded number of lines and
batched by length, so that a batch holds a bounded number of cells.  Defined results: a page without text has no
lines; a result delivered twice counts once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.markup import TAG, collapse, page_text, sub_tags, without_hidden

PATHS, WORDS, PATH_DIM, WORD_DIM, SHAPE, HIDDEN_DIM = 2048, 16384, 16, 24, 16, 24
WEIGHTS = Path(__file__).with_name("main_content.npz")
#: Cells (lines, padded) of a batch; lines gathered before their pages are sorted by length.
CELLS, GATHER = 24_000, 12_000
THRESHOLD = 0.5

MARK = re.compile(r"<(/?)([a-zA-Z][\w\-]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|href|role)\s*=\s*[\"']?([^\"'>]*)")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[|»·/©—–:?!-]")
SENTENCE = re.compile(r"[.!?;:]\s")
VOID = frozenset("br hr img input meta link area base col embed source track wbr !doctype".split())
_KEPT = 300_000


class _Hashed(dict):
    def __init__(self, slots: int):
        self.slots = slots

    def __missing__(self, token: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        k = self[token] = xxhash.xxh32_intdigest("0" if token.isdigit() else token) % (self.slots - 1) + 1  # slot 0 stands for nothing
        return k


_word, _path = _Hashed(WORDS), _Hashed(PATHS)


@lru_cache(50_000)
def _tag_tokens(name: str, attributes: str) -> tuple[str, ...]:
    """Class words without digits, and the shape of a link's target: its first two folders."""
    out = []
    for kind, value in ATTRIBUTE.findall(attributes):
        if kind.lower() == "href":
            v = re.sub(r"\d+", "0", value.strip())
            out.append("h:" + ("#" if v.startswith("#") else "/".join(v.split("/")[:3])))
        else:
            for w in re.split(r"[\s_]+", value.lower()):
                w = re.sub(r"[^a-z\-]", "", w).strip("-")
                if len(w) >= 3:
                    out.append("c:" + w)
    return tuple(out)


def _whole_tags(m: re.Match) -> str:
    s = m[0]
    return s if "\n" not in s else s.replace("\n", " ") + "\n" * s.count("\n")


def page_title(text: str) -> str:
    """The visible title of a page in lower case, '' without one."""
    at = text.lower().find("<title")
    if at < 0 or (inner := text.find(">", at) + 1) == 0 or (end := text.lower().find("</title", inner)) < 0:
        return ""
    return collapse(sub_tags(" ", text[inner:end])).lower()


class _Open:
    """The open elements: their names in order, how many there are of each, and the path slots they give."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.names: dict[str, int] = {}
        self.slots: dict[int, int] = {}

    def put(self, name: str, extra: tuple[str, ...]) -> None:
        if name in ("p", "li", "td", "tr") and self.stack and self.stack[-1][0] == name:
            self._pop()
        slots = tuple(_path[t] for t in (f"p:{name}", *extra))
        self.stack.append((name, slots))
        self.names[name] = self.names.get(name, 0) + 1
        for k in slots:
            self.slots[k] = self.slots.get(k, 0) + 1

    def _pop(self) -> str:
        name, slots = self.stack.pop()
        self.names[name] -= 1
        for k in slots:
            self.slots[k] -= 1
            if not self.slots[k]:
                del self.slots[k]
        return name

    def close(self, name: str) -> None:
        if self.names.get(name):
            while self._pop() != name:
                pass

    def path(self) -> list[int]:
        near = [_path[f"n{k}:{n}"] for k, (n, _) in enumerate(reversed(self.stack[-3:]))]
        return [*self.slots, *near]


def leaves(text: str) -> tuple[list[int], list[str], list[list[int]], list[list[int]], np.ndarray]:
    """(line numbers, visible texts, path slots, word slots, shapes) of a page."""
    tagged = "<" in text
    title = page_title(text) if tagged else ""
    if tagged:
        text = sub_tags(_whole_tags, without_hidden(text))
    nos, texts, paths, words, shapes = [], [], [], [], []
    open_ = _Open()
    gap, seen = 1, set()
    for no, line in enumerate(text.split("\n"), 1):
        path, own, links, shut = open_.path(), [], 0, False
        visible = line
        if tagged and "<" in line:
            for m in MARK.finditer(line):
                name = m[2].lower()
                if m[1]:
                    shut = True
                    open_.close(name)
                else:
                    extra = _tag_tokens(name, m[3]) if m[3] else ()
                    own.append(f"t:{name}")
                    own += extra
                    links += name == "a"
                    if name not in VOID and not m[3].endswith("/"):
                        open_.put(name, extra)
            visible = sub_tags(" ", line)
        s = collapse(visible)
        if not s:
            gap = gap + 1 if not line.strip() else max(gap, 0.5)
            if shapes and not line.strip():
                shapes[-1][8] = 1.0
            continue
        low = s.lower()
        tokens = TOKEN.findall(low)
        n = len(tokens)
        digits = sum(map(str.isdigit, tokens))
        caps = sum(map(str.isupper, [w[0] for w in s.split(" ")]))
        shapes.append(
            [
                min(n, 200) ** 0.5 / 5,
                float(n > 12),
                float(SENTENCE.search(s) is not None),
                caps / (s.count(" ") + 1),
                min(len(open_.stack), 20) / 20,
                float(s[-1] in ".!?"),
                float(low == title),
                min(gap, 2) / 2,
                0.0,
                float(links > 0),
                float(low in seen),
                float(line.rstrip().endswith("<br>")),
                float(not own and not shut),
                digits / max(n, 1),
                float(s[0] in "-*•"),
                0.0,
            ]
        )
        seen.add(low)
        gap = 0
        nos.append(no)
        texts.append(s)
        paths.append(list(dict.fromkeys([*path, *map(_path.__getitem__, own)])) or [0])
        words.append(list(map(_word.__getitem__, tokens)) or [0])
    x = np.array(shapes, np.float32).reshape(len(nos), SHAPE)
    if len(nos):
        x[:, 15] = np.arange(len(nos)) / max(len(nos) - 1, 1)
    return nos, texts, paths, words, x


def mean_rows(table: np.ndarray, slots: list[list[int]]) -> np.ndarray:
    """Mean of the table's rows for each list of slots (none of them is empty)."""
    n = np.fromiter(map(len, slots), np.int64, len(slots))
    flat = np.fromiter(chain.from_iterable(slots), np.int64, int(n.sum()))
    return np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None].astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def run_lstm(xw: np.ndarray, mask: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """Hidden states (T, B, H) from input projections (T, B, 4H); masked steps keep the state."""
    t, b, four = xw.shape
    hd = four // 4
    h, c = np.zeros((b, hd), np.float32), np.zeros((b, hd), np.float32)
    out = np.empty((t, b, hd), np.float32)
    for k in range(t):
        z = xw[k] + h @ wh
        s = sigmoid(z[:, : 3 * hd])
        new_c = s[:, hd : 2 * hd] * c + s[:, :hd] * np.tanh(z[:, 3 * hd :])
        m = mask[k][:, None]
        c = np.where(m, new_c, c)
        h = np.where(m, s[:, 2 * hd :] * np.tanh(c), h)
        out[k] = h
    return out


class Labeller:
    """The model's forward pass in numpy."""

    def __init__(self, path: Path | str = WEIGHTS):
        with np.load(path) as z:
            self.w = {k: z[k].astype(np.float32) for k in z.files}

    def inputs(self, paths, words, shape) -> np.ndarray:
        return np.concatenate([mean_rows(self.w["path"], paths), mean_rows(self.w["word"], words), shape], axis=1)

    def pages(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each line, for pages of input rows."""
        out: list = [None] * len(xs)
        order = sorted(range(len(xs)), key=lambda i: len(xs[i]))
        while order:
            longest = len(xs[order[-1]])
            take = [order.pop() for _ in range(max(1, min(len(order), CELLS // max(longest, 1))))]
            b = len(take)
            x = np.zeros((longest, b, xs[take[0]].shape[1]), np.float32)
            mask = np.zeros((longest, b), bool)
            for j, i in enumerate(take):
                x[: len(xs[i]), j] = xs[i]
                mask[: len(xs[i]), j] = True
            flat = x.reshape(longest * b, -1)
            down = run_lstm((flat @ self.w["wx_f"] + self.w["b_f"]).reshape(longest, b, -1), mask, self.w["wh_f"])
            up = run_lstm((flat @ self.w["wx_b"] + self.w["b_b"]).reshape(longest, b, -1)[::-1], mask[::-1], self.w["wh_b"])[::-1]
            z = np.concatenate([down, up, x], axis=2) @ self.w["out"] + self.w["bias"]
            p = sigmoid(z[..., 0])
            for j, i in enumerate(take):
                out[i] = p[: len(xs[i]), j]
        return out


_model: Labeller | None = None


def _labelled(make, names: list[str]):
    """Batches of pages through the model; ``make`` turns (ids, line numbers, texts, chosen lines) into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _model
        if _model is None:
            _model = Labeller()
        held: list = []
        lines = 0

        def give() -> pa.RecordBatch:
            ps = _model.pages([h[3] for h in held])
            out = make([(i, n, t, p >= THRESHOLD) for (i, n, t, _), p in zip(held, ps)])
            held.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for b in batches:
            for i, body, raw in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                text = page_text(body.as_py(), raw.as_py()) if i is not None else None
                if not text:
                    continue
                nos, texts, paths, words, shape = leaves(text)
                if nos:
                    held.append((i, nos, texts, _model.inputs(paths, words, shape)))
                    lines += len(nos)
                if lines >= GATHER:
                    yield give()
                    lines = 0
        if held:
            yield give()

    return run


def _lines(pages: list) -> list[pa.Array]:
    ids = np.concatenate([np.full(int(k.sum()), i, np.int64) for i, _, _, k in pages])
    return [pa.array(ids), pa.array(np.concatenate([np.array(n, np.int32)[k] for _, n, _, k in pages]))]


def _bodies(pages: list) -> list[pa.Array]:
    return [pa.array([i for i, *_ in pages], pa.int64()), pa.array(["\n".join(s for s, x in zip(t, k) if x) for _, _, t, k in pages], pa.string())]


def _pages(results: DataFrame) -> DataFrame:
    return results.select(F.col("result_id").cast("bigint"), F.col("response.body"), F.col("response.raw"))


def found(results: DataFrame) -> DataFrame:
    """(result_id, line_no) of the lines that belong to each page's article."""
    return _pages(results).mapInArrow(_labelled(_lines, ["result_id", "line_no"]), "result_id bigint, line_no int").distinct()


def main_bodies(results: DataFrame) -> DataFrame:
    """(result_id, text): the article's visible lines of each page that has any visible line."""
    return _pages(results).mapInArrow(_labelled(_bodies, ["result_id", "text"]), "result_id bigint, text string").groupBy("result_id").agg(F.max("text").alias("text"))
