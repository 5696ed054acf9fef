"""Trains the weights of ``main_content`` on pages labelled by their own structure.

    python -m gossamer.llm.train_main_content RESULTS.parquet [...]

No page comes with labels, so they are derived, for pages that have a title:

- the *home* is the smallest container, opened and closed on lines of its own, that holds the line equal to the page's title
  and at least two more lines; lines outside it are no part of the article;
- inside it, lines that come back on several pages, lines that are one link outside a list, and short lines with a word that
  prompts, credits or notices are no part of it either; long lines with such a word are left out of the loss;
- a linear model over words, fitted on lines inside against lines outside, finds lines inside that read like those outside: they
  are taken out of the article where it is sure, and left out of the loss where it is nearly sure;
- all other lines inside are the article.

Words, names of containers and titles are dropped at random while training, so that what is unknown counts as nothing, and a part of the pages is read once more
with all markup taken away, line by line, so the model learns to do without them.  At most ``PAGES`` pages are
read, those of the smallest ids.  Sites whose hash ends in 0 are held out (``held_out``), never trained on.
"""

from __future__ import annotations

import re
import sys
import time
from collections import Counter

import numpy as np
import xxhash

from gossamer.functions.markup import collapse, page_text, site_of, sub_tags, without_hidden
from gossamer.llm.main_content import HIDDEN_DIM, PATH_DIM, PATHS, SHAPE, TOKEN, VOID, WEIGHTS, WORD_DIM, WORDS, Labeller, leaves, page_title, run_lstm, sigmoid

PAGES, ROUNDS, BATCH, RATE, SEED = 8000, 6, 48, 4e-3, 7
#: Share of pages read again without markup; pages on which a line comes back; words of a short line; sure and nearly sure.
BARE, BACK, SHORT, SURE, NEARLY = 0.6, 4, 14, 0.9, 0.6

#: Words that prompt, credit or notice, as they stand around articles anywhere.
CUES = frozenset("cookie cookies consent privacy accept reject subscribe newsletter letter inbox share shared print sponsored advertisement promotion promoted partner copyright reserved rights licensors terms disclaimer liability author editor posted updated written words liked helpful readers login register basket © ·".split())
BYLINE = re.compile(r"(?i)^by \S+(?: \S+)?$|\b\d+ min\b|\b\d{1,2}:\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b")


def held_out(site: str) -> bool:
    return xxhash.xxh32_intdigest(site) % 10 == 0


def home_of(text: str) -> tuple[list[str], list[str], tuple[int, int]] | None:
    """(raw lines, visible lines, first and last line of the home), or None for pages without one."""
    title = page_title(text)
    if not title:
        return None
    raw = without_hidden(text).split("\n")
    seen = [collapse(sub_tags(" ", x)) for x in raw]
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for n, x in enumerate(raw):
        for shut, name in re.findall(r"<(/?)([a-zA-Z][\w\-]*)", x):
            name = name.lower()
            if not shut:
                if name not in VOID and name not in ("html", "body"):
                    stack.append((name, n))
            elif any(t == name for t, _ in stack):
                while True:
                    t, at = stack.pop()
                    if t == name:
                        break
                if at < n and not seen[at]:
                    spans.append((at, n))
    best = None
    for n, s in enumerate(seen):
        if s.lower() == title and "<a" not in raw[n].lower():
            inside = [(b - a, a, b) for a, b in spans if a < n <= b and sum(bool(y) for y in seen[a : b + 1]) >= 3]
            if inside:
                best = min(inside)
    return (raw, seen, best[1:]) if best else None


def _pattern(s: str) -> str:
    return re.sub(r"\d+", "0", s.lower())


def label_pages(texts: list[str]) -> list[tuple[dict[int, int], bool]]:
    """For each page {line number: 1, 0}, and whether it has a home; lines that are left out have no entry."""
    homes = [home_of(t) for t in texts]
    # under how many titles a line comes; copies of a page bring nothing back
    under = {(_pattern(s), page_title(t)) for t, h in zip(texts, homes) if h for s in h[1] if s}
    back = Counter(k for k, _ in under)
    out: list[dict[int, int]] = []
    lines, sides = [], []
    for h in homes:
        lab: dict[int, int] = {}
        if h:
            raw, seen, (first, last) = h
            for n, s in enumerate(seen):
                if not s:
                    continue
                words = TOKEN.findall(s.lower())
                inside = first <= n <= last
                lines.append(words)
                sides.append(inside)
                if not inside:
                    lab[n + 1] = 0
                    continue
                link = re.fullmatch(r"(?is)\s*(?:<(?!li\b)[^>]*>\s*)*<a\b[^>]*>.*</a>(?:\s*</?[^>]*>)*\s*", raw[n]) is not None and "<li" not in raw[n].lower()
                cue = not CUES.isdisjoint(words) or BYLINE.search(s) is not None
                if link or back[_pattern(s)] >= BACK or cue and len(words) <= SHORT:
                    lab[n + 1] = 0
                elif not cue:
                    lab[n + 1] = 1
        out.append(lab)
    prob = iter(_outside(lines, np.array(sides)))
    for h, lab in zip(homes, out):
        if h:
            _, seen, (first, last) = h
            for n, s in enumerate(seen):
                if s:
                    p = next(prob)
                    if first <= n <= last and lab.get(n + 1) != 0:
                        if p >= SURE:
                            lab[n + 1] = 0
                        elif p >= NEARLY:
                            lab.pop(n + 1, None)
    return [(lab, h is not None) for h, lab in zip(homes, out)]


def _outside(lines: list[list[str]], inside: np.ndarray, slots: int = 1 << 16, rounds: int = 40) -> np.ndarray:
    """Probability that a line stands outside the article, by its words and pairs of words alone."""
    flat, at = [], [0]
    for words in lines:
        grams = {*words, *zip(words, words[1:])}
        flat += [xxhash.xxh32_intdigest(str(g)) % slots for g in grams] or [0]
        at.append(len(flat))
    if not lines:
        return np.zeros(0)
    c, at = np.array(flat), np.array(at)
    n = np.diff(at)
    row = np.repeat(np.arange(len(lines)), n)
    w, b, scale = np.zeros(slots), 0.0, 1 / np.sqrt(n)
    y = (~inside).astype(float)
    m1, m2 = np.zeros(slots), np.zeros(slots)
    for k in range(1, rounds + 1):
        p = sigmoid(np.bincount(row, w[c], len(lines)) * scale + b)
        d = (p - y) * scale
        g = np.bincount(c, d[row], slots) / len(lines) + 1e-6 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.15 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
        b -= 0.5 * float((p - y).mean())
    return sigmoid(np.bincount(row, w[c], len(lines)) * scale + b)


def bare(text: str, lab: dict[int, int]) -> str:
    """The page without markup, line by line."""
    return sub_tags(" ", without_hidden(text))


def lstm_back(xw, mask, wh, dh_out):
    """Gradients of (xw, wh); the states are run again and kept."""
    t, b, four = xw.shape
    hd = four // 4
    h = np.zeros((b, hd), np.float32)
    c = np.zeros((b, hd), np.float32)
    keep = []
    for k in range(t):
        z = xw[k] + h @ wh
        s, g = sigmoid(z[:, : 3 * hd]), np.tanh(z[:, 3 * hd :])
        m = mask[k][:, None]
        nc = np.where(m, s[:, hd : 2 * hd] * c + s[:, :hd] * g, c)
        tc = np.tanh(nc)
        nh = np.where(m, s[:, 2 * hd :] * tc, h)
        keep.append((s, g, c, tc, h))
        h, c = nh, nc
    dxw, dwh = np.zeros_like(xw), np.zeros_like(wh)
    dh, dc = np.zeros((b, hd), np.float32), np.zeros((b, hd), np.float32)
    for k in range(t - 1, -1, -1):
        s, g, c0, tc, h0 = keep[k]
        m = mask[k][:, None].astype(np.float32)
        dh = dh + dh_out[k]
        live = dh * m
        do = live * tc
        dcc = (dc + live * s[:, 2 * hd :] * (1 - tc * tc)) * m
        dz = np.concatenate([dcc * g, dcc * c0, do], axis=1) * s * (1 - s)
        dz = np.concatenate([dz, dcc * s[:, :hd] * (1 - g * g)], axis=1)
        dxw[k] = dz
        dwh += h0.T @ dz
        dh = dh * (1 - m) + dz @ wh.T
        dc = dc * (1 - m) + dcc * s[:, hd : 2 * hd]
    return dxw, dwh


def train(pages: list, rng: np.random.Generator, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """pages: (paths, words, shape, labels, known) each."""
    d = PATH_DIM + WORD_DIM + SHAPE
    g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"path": 0.3 * rng.standard_normal((PATHS, PATH_DIM)).astype(np.float32), "word": 0.3 * rng.standard_normal((WORDS, WORD_DIM)).astype(np.float32)}
    for s in "fb":
        w[f"wx_{s}"], w[f"wh_{s}"], w[f"b_{s}"] = g(d, 4 * HIDDEN_DIM), g(HIDDEN_DIM, 4 * HIDDEN_DIM), np.zeros(4 * HIDDEN_DIM, np.float32)
        w[f"b_{s}"][HIDDEN_DIM : 2 * HIDDEN_DIM] = 1
    w["out"], w["bias"] = g(2 * HIDDEN_DIM + d, 1), np.zeros(1, np.float32)
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for k, at in (("path", 0), ("word", 1)):  # what no page of the training holds says nothing, like slot 0
        used = np.zeros(len(w[k]), bool)
        for p in pages:
            used[np.concatenate([np.asarray(x) for x in p[at]])] = True
        used[0] = False
        w[k][~used] = 0
    step = 0
    for r in range(rounds):
        order = np.argsort([len(p[3]) + 8 * rng.random() for p in pages])
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rng.shuffle(batches)
        total = n_cells = 0.0
        for take in batches:
            part = [pages[i] for i in take]
            t, b = max(len(p[3]) for p in part), len(part)
            x = np.zeros((t, b, d), np.float32)
            mask = np.zeros((t, b), bool)
            y, known = np.zeros((t, b), np.float32), np.zeros((t, b), np.float32)
            slots = []
            for j, (paths, words, shape, lab, kn) in enumerate(part):
                n = len(lab)
                if rng.random() < 0.3:  # without names
                    paths = [[p[0]] for p in paths]
                if rng.random() < 0.5:  # words that are not known
                    gone = rng.uniform(0.3, 1.0)
                    words = [[0 if rng.random() < gone else k for k in q] for q in words]
                shape = shape.copy()
                if rng.random() < 0.15:
                    shape[:, 6] = 0
                pn, wn = np.array([len(p) for p in paths]), np.array([len(q) for q in words])
                pf, wf = np.concatenate([np.asarray(p) for p in paths]), np.concatenate([np.asarray(q) for q in words])
                x[:n, j, :PATH_DIM] = np.add.reduceat(w["path"][pf], np.r_[0, np.cumsum(pn)[:-1]], axis=0) / pn[:, None]
                x[:n, j, PATH_DIM : PATH_DIM + WORD_DIM] = np.add.reduceat(w["word"][wf], np.r_[0, np.cumsum(wn)[:-1]], axis=0) / wn[:, None]
                x[:n, j, PATH_DIM + WORD_DIM :] = shape
                mask[:n, j], y[:n, j], known[:n, j] = True, lab, kn
                slots.append((n, pf, pn, wf, wn))
            flat = x.reshape(t * b, d)
            xf = (flat @ w["wx_f"] + w["b_f"]).reshape(t, b, -1)
            xb = np.ascontiguousarray((flat @ w["wx_b"] + w["b_b"]).reshape(t, b, -1)[::-1])
            hf, hb = run_lstm(xf, mask, w["wh_f"]), run_lstm(xb, mask[::-1], w["wh_b"])[::-1]
            full = np.concatenate([hf, hb, x], axis=2)
            p = sigmoid((full @ w["out"])[..., 0] + w["bias"][0])
            cells = known.sum()
            total += float((known * -(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum())
            n_cells += float(cells)
            dz = (p - y) * known / cells
            grad = {"out": (full * dz[..., None]).sum((0, 1))[:, None], "bias": np.array([dz.sum()], np.float32)}
            dfull = dz[..., None] * w["out"][:, 0]
            dxf, grad["wh_f"] = lstm_back(xf, mask, w["wh_f"], dfull[..., :HIDDEN_DIM])
            dxb, grad["wh_b"] = lstm_back(xb, mask[::-1], w["wh_b"], dfull[::-1, :, HIDDEN_DIM : 2 * HIDDEN_DIM])
            dxb = dxb[::-1]
            dx = dfull[..., 2 * HIDDEN_DIM :]
            for s, dd in (("f", dxf), ("b", dxb)):
                dd = np.ascontiguousarray(dd).reshape(t * b, -1)
                grad[f"wx_{s}"], grad[f"b_{s}"] = flat.T @ dd, dd.sum(0)
                dx = dx + (dd @ w[f"wx_{s}"].T).reshape(t, b, d)
            gp, gw = np.zeros_like(w["path"]), np.zeros_like(w["word"])
            for j, (n, pf, pn, wf, wn) in enumerate(slots):
                np.add.at(gp, pf, np.repeat(dx[:n, j, :PATH_DIM] / pn[:, None], pn, axis=0))
                np.add.at(gw, wf, np.repeat(dx[:n, j, PATH_DIM : PATH_DIM + WORD_DIM] / wn[:, None], wn, axis=0))
            grad["path"], grad["word"] = gp, gw
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            step += 1
            rate = RATE * min(1, step / 50) * (0.35 ** max(0, r - 2))
            for k, v in grad.items():
                v = v * min(1, 1.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                if k in ("path", "word"):
                    v[0] = 0
                w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        print(f"round {r}: loss {total / n_cells:.4f}", flush=True)
    return w


def texts_of(files: list[str], limit: int = PAGES) -> list[tuple[str, str]]:
    """(site, page text) of the records of smallest id, each record once."""
    import pyarrow.parquet as pq

    out: list[tuple[str, str]] = []
    for f in files:
        t = pq.read_table(f, columns=["result_id", "request", "response"]).to_pylist()
        seen = set()
        for row in sorted(t, key=lambda r: r["result_id"]):
            res = row["response"] or {}
            text = page_text(res.get("body"), res.get("raw"))
            if text and row["result_id"] not in seen:
                seen.add(row["result_id"])
                out.append((site_of((row["request"] or {}).get("endpoint")) or "", text))
                if len(out) >= limit:
                    return out
    return out


def examples(pages: list[tuple[str, str]], rng: np.random.Generator | None = None) -> list[tuple]:
    """(site, nos, texts, paths, words, shape, labels, known) of the pages that have a home; with ``rng`` some come bare, too."""
    out = []
    for (site, text), (lab, ok) in zip(pages, label_pages([t for _, t in pages])):
        if not ok or sum(lab.values()) < 2:
            continue
        for t in [text, bare(text, lab)] if rng is not None and rng.random() < BARE else [text]:
            nos, texts, paths, words, shape = leaves(t)
            y = np.array([lab.get(n, 0) for n in nos], np.float32)
            kn = np.array([n in lab for n in nos], np.float32)
            out.append((site, nos, texts, paths, words, shape, y, kn))
    return out


def agreement(model: Labeller, pages: list[tuple]) -> tuple[float, float]:
    """(precision, recall) against derived labels."""
    tp = fp = fn = 0
    for p, q in zip(pages, model.pages([model.inputs(p[3], p[4], p[5]) for p in pages])):
        a, b, k = q >= 0.5, p[6] > 0, p[7] > 0
        tp, fp, fn = tp + int((a & b & k).sum()), fp + int((a & ~b & k).sum()), fn + int((~a & b & k).sum())
    return tp / max(tp + fp, 1), tp / max(tp + fn, 1)


def main(files: list[str], weights=WEIGHTS) -> None:
    rng = np.random.default_rng(SEED)
    began = time.time()
    pages = texts_of(files)
    fit, test = examples([p for p in pages if not held_out(p[0])], rng), examples([p for p in pages if held_out(p[0])])
    print(len(fit), len(test), f"{time.time() - began:.0f} s", flush=True)
    w = train([p[3:8] for p in fit], rng)
    np.savez_compressed(weights, **{k: v.astype(np.float16) for k, v in w.items()})
    print("held-out sites: precision %.4f, recall %.4f" % agreement(Labeller(weights), test), f"{time.time() - began:.0f} s")


if __name__ == "__main__":
    main(sys.argv[1:])
