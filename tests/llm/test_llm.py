import os
import random
import re
from collections import Counter, defaultdict
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.functions.markup import page_text, site_of, visible_lines
from gossamer.llm import abuse, endpoint_copies, main_content, near_copies, packing, queries, repeated_lines, residue, tokens

RESULT = "result_id long, received_at int, request struct<endpoint:string,k:string>, response struct<body:string,raw:string,n:int>, k long, line_no int, keys string, id int"
RESPONSE = "response_id long, status_code int, body string, id string, a int, b int, band int, grams string"
DOCUMENT = "doc_id long, text string, source string, n string, score string, block int, size int"


def results(spark, rows):
    return spark.createDataFrame([(i, 0, (e, "x") if e != "NULL" else None, (b, r, 1), 7, 7, "z", 3) for i, e, b, r in rows], RESULT)


def responses(spark, rows):
    return spark.createDataFrame([(i, s, b, "q", 1, 2, 3, "g") for i, s, b in rows], RESPONSE)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "q", "q", 1, 2) for i, t, s in rows], DOCUMENT)


# repeated lines


def brute_lines(rows, least=8):
    pages = {}
    for i, e, b, r in rows:
        site, text = site_of(e), page_text(b, r)
        if i is not None and site and text:
            pages[i] = (site, [(n, re.sub(r"\d+", "0", s.lower())) for n, s in visible_lines(text)])
    on = defaultdict(set)
    for i, (site, lines) in pages.items():
        for _, s in lines:
            on[site, s].add(i)
    return {(i, n) for i, (site, lines) in pages.items() for n, s in lines if len(on[site, s]) >= least}


def line_rows():
    rng = random.Random(1)
    rows = []
    for i in range(240):  # the first site holds more than a third of the rows
        site = "https://Big.example/x" if i < 100 else f"http://s{i % 9}.test:80/{i}"
        lines = [f"<p>unique {i} {k}</p>" for k in range(3)] + [f"Read {i} more &amp; share", "<footer>© 2020</footer>"] + ["rare"] * (i % 40 == 0) + ["twice", "twice"] * (i % 17 == 0)
        rng.shuffle(lines)
        rows.append((i, site, "\n".join(lines) if i % 5 else None, "HTTP/1.1 200\r\n\r\n" + "\r\n".join(lines) if i % 5 == 0 else None))
    rows += [rows[3], rows[3], (None, "https://big.example", "x", None), (900, None, "twice", None), (901, " ", "twice", None), (902, "https://big.example", None, None), (903, "https://big.example", "", ""), (904, "NULL", "x", None)]
    return rows


def test_repeated_lines(spark):
    rows = line_rows()
    clean = [(i, None if e == "NULL" else e, b, r) for i, e, b, r in rows]
    df = results(spark, rows)
    got = [tuple(r) for r in repeated_lines.repeated_lines(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_lines(clean)
    few = {tuple(r) for r in repeated_lines.repeated_lines(df, 3).collect()}
    assert few == brute_lines(clean, 3)


@pytest.mark.parametrize("site_slots,task_slots,limit", [(4, 10**6, 10**6), (40, 50, 10**6), (10**6, 10**6, 0), (4, 20, 0)])
def test_bounded_summaries_lose_no_line(spark, site_slots, task_slots, limit):
    rows = line_rows()
    clean = [(i, None if e == "NULL" else e, b, r) for i, e, b, r in rows]
    got = [tuple(r) for r in repeated_lines.repeated_lines(results(spark, rows).repartition(3), 8, site_slots, task_slots, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_lines(clean)


def test_summary_bounds_its_error():
    rng = random.Random(3)
    s, true = repeated_lines.Summary(20), Counter()
    for _ in range(500):
        keys = {min(int(rng.expovariate(0.05)), 200) for _ in range(6)}
        s.update(keys)
        true.update(keys)
        assert len(s.counts) <= 20
    assert all(s.counts[k] <= n <= s.counts[k] + s.error for k, n in true.items()) and s.error < 500


def test_keys_that_stand_for_several_texts_are_counted_by_text(spark, monkeypatch):
    monkeypatch.setattr(repeated_lines, "key_of", lambda t: len(t) % 3)
    rows = line_rows()
    clean = [(i, None if e == "NULL" else e, b, r) for i, e, b, r in rows]
    places = spark.createDataFrame([(i, n, len(t) % 3, t) for i, site, t, n in ((i, site_of(e), f"{site_of(e)}\0{repeated_lines.normal(s)}", n) for i, e, b, r in clean if i is not None and site_of(e) and page_text(b, r) for n, s in visible_lines(page_text(b, r)))], "result_id long, line_no int, k long, text string")
    marked, exact = repeated_lines.confirmed(places)
    got = {(r.result_id, r.line_no) for r in marked.join(exact.select("k", "part"), ["k", "part"], "left_semi").collect()}
    assert got == brute_lines(clean)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_pages_without_repeats(spark, limit):
    rows = line_rows()
    out = repeated_lines.pages_without_repeats(results(spark, rows), limit=limit).collect()
    got = {r.result_id: r for r in out}
    assert len(out) == len(got)
    drop = brute_lines([(i, None if e == "NULL" else e, b, r) for i, e, b, r in rows])
    for i, e, b, r in rows[:240]:
        want = [x for n, x in visible_lines(page_text(b, r)) if (i, n) not in drop]
        assert [x for _, x in visible_lines(got[i].text)] == want
    assert got[902].text is None and got[902].lines_removed == 0 and None not in got


# main content


def test_leaves_agree_with_the_visible_lines():
    for html in ("<html><head><title>T</title></head>\n<body><nav><a href='/x/1'>a</a>\n</nav><p class='story-text x1'>one\ntwo <br>\n\n<table>\n<tr><td>c</table></p>", "plain\n\ntext  \n- item", "", "<p>"):
        nos, texts, paths, words, shape = main_content.leaves(html)
        assert list(zip(nos, texts)) == visible_lines(html)
        assert len(paths) == len(words) == len(shape) == len(nos) and all(paths) and all(words)


HAND = """<!DOCTYPE html>
<html><head><title>Why the river froze twice | The Gazette</title></head>
<body class="front">
<nav><ul>
<li><a href="/world">World</a></li>
<li><a href="/sport">Sport</a></li>
</ul></nav>
<div class="cookie-banner">
We use cookies to improve your visit. Read our privacy policy.
<button>Accept</button>
</div>
<main>
<h1>Why the river froze twice | The Gazette</h1>
<p class="byline">By Anna Berg</p>
<p>In January the river froze for the first time since 1963, and skaters came from three counties to see it.</p>
<p>Two weeks later, after a short thaw, it froze again. Nobody at the weather service had expected that.</p>
<h2>What the records say</h2>
<p>The oldest entry in the parish book is from 1684. It speaks of oxen roasted on the ice.</p>
<a href="#share">Share this article</a>
<p>Engineers now want to measure the flow below the bridge before the next winter comes.</p>
</main>
<aside>
<a href="/r/1">Council votes on new bridge</a>
<a href="/r/2">Ten walks for the spring</a>
</aside>
<footer>
<p>© 2021 The Gazette. All rights reserved.</p>
</footer>
</body></html>"""


def test_labels_of_the_home(spark):
    from gossamer.llm import train_main_content as tm

    (lab, ok), (_, none) = tm.label_pages([HAND, "no markup\nat all"])
    lines = HAND.split("\n")
    on = [lines[n - 1] for n, y in lab.items() if y]
    assert ok and not none and sum("<p>" in x for x in on) == 4 and not any("byline" in x or "share" in x or "href" in x or "©" in x for x in on)


def test_main_content_on_held_out_sites():
    """Sites that training never saw, in tables it did not read; labels are derived from structure."""
    from gossamer.llm import train_main_content as tm

    path = "/root/testdata/sf0.01/results.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    pages = [p for p in tm.texts_of([path]) if tm.held_out(p[0])]
    precision, recall = tm.agreement(main_content.Labeller(), tm.examples(pages))
    assert len(pages) > 50 and precision > 0.95 and recall > 0.95


def test_batches_are_bound_by_lines(spark):
    df = results(spark, [(i, "e", "\n".join(f"<p>line {k} of page {i}</p>" for k in range(2000)), None) for i in range(30)])
    assert main_content.main_bodies(df).count() == 30


def test_tag_paths_hold_all_open_elements():
    deep = "<div class='outer-most'>" + "<section>" * 40 + "<p>\nx\n</p>" + "</section>" * 40 + "\ny\n</div>\nz"
    _, texts, paths, _, _ = main_content.leaves(deep)
    slot = main_content._path["c:outer-most"]
    assert texts == ["x", "y", "z"] and slot in paths[0] and slot in paths[1] and slot not in paths[2]


def test_main_content_edges(spark):
    df = results(spark, [(1, "e", None, None), (2, "e", "", "x"), (3, "e", "<p></p>", None), (4, "e", "one line", None), (None, "e", "one line", None), (5, "e", "\n".join(f"<p>Long page, sentence number {i} of many.</p>" for i in range(3000)), None)])
    assert {r.result_id for r in main_content.found(df).collect()} <= {4, 5}
    assert {r.result_id for r in main_content.main_bodies(df).collect()} == {4, 5}
    assert main_content.found(df.limit(0)).count() == 0


def test_numpy_lstm_ignores_padding():
    m = main_content.Labeller()
    rng = np.random.default_rng(0)
    xs = [rng.standard_normal((n, 56)).astype(np.float32) for n in (3, 50, 7, 1)]
    together = m.pages(xs)
    for x, p in zip(xs, together):
        assert np.allclose(m.pages([x])[0], p, atol=1e-5)


# endpoint copies

ENDPOINTS = [
    (1, "https://a.example/x-y?b=2&a=1"), (2, " HTTPS://A.example/x_y/?a=1&b=2 "), (3, "https://a.example/xy?a=1&b=2&b=2"), (4, "https://a.example/xy?a=1&&b=2&-"), (5, "https://a.example/xy?a=1%26b=2"),
    (6, None), (7, "  "), (8, " \n"), (9, "https://a.example/caf%C3%A9"), (10, "https://a.example/CAFÉ#"), (11, "https://a.example/100%"), (12, "https://a.example/100"), (13, "???"), (14, "?"), (15, "https://a.example/xy?b=2&b=2&a=1"), (1, "https://a.example/x-y?b=2&a=1"),
    (16, "https://a.example/q?x=1?y"), (17, "https://a.example/q?x=1y"), (18, "https://a.example/%ff"), (19, "https://a.example/" + "z" * 50_000), (20, "https://a.example/" + "Z" * 50_000),
]


def endpoint_key(e):
    n = lambda s: "".join(c for c in unquote(s) if c.isalnum()).lower()
    head, _, tail = e.partition("?")
    return n(head), tuple(sorted(f for f in map(n, tail.split("&")) if f))


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_endpoint_copies(spark, bits):
    rows = ENDPOINTS + [(100 + i, f"https://b.example/p{i % 3}?q={i % 2}&r=1") for i in range(60)]
    groups = defaultdict(set)
    for i, e in rows:
        if e and e.strip():
            groups[endpoint_key(e)].add(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    df = results(spark, [(i, e, "b", None) for i, e in rows])
    got = endpoint_copies.copy_groups(df, bits, heavy=5).collect()
    assert {(r.first_id, r.result_id) for r in got if r.first_id != r.result_id} == want
    size = {min(g): len(g) for g in groups.values()}
    assert all(r.copies == size[r.first_id] for r in got)


def test_collapsed_endpoints(spark):
    df = results(spark, [(i, e, "b", None) for i, e in ENDPOINTS])
    got = {r.result_id: r.copies for r in endpoint_copies.collapsed(df).collect()}
    assert got[1] == 3 and got[3] == 2 and got[6] == got[7] == got[8] == 1 and sum(got.values()) == 20
    assert endpoint_copies.found(df.limit(0)).count() == 0 and endpoint_copies.collapsed(df.limit(0)).count() == 0


# residue

SENTENCE = "The plan for the harbour adds a crane, a shed and room for forty boats by spring. Nobody expected the ferry to be painted so quickly. "
CASES = [
    "<html><head><title>T</title></head><nav>Home</nav><h1>404 - the page you asked for could not be found</h1><footer>All rights</footer></html>",
    "<h1>A title</h1><p>Your session has expired, please log in again to see the boat</p>",
    "<noscript>You need to enable JavaScript to run this app.</noscript><div id=root></div>",
    "<p>Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.</p>",
    "<p>test test test test test test test</p>",
    "<p>Hello world! This is your first boat, edit or delete it</p>",
    '{"error": "500 Internal Server Error", "code": 12}',
    f"<p>{SENTENCE * 5}It costs {{{{ price }}}} today. {SENTENCE}</p>",
    f"<p>{SENTENCE}Dear [INSERT name HERE], {SENTENCE}</p>",
    "<div>Price: undefined</div>",
    "<h1>Bad gateway: the upstream boat gave no answer</h1><pre>at a.b(c.py:1)\nat d.e(f.py:2)\nat g.h(i.py:3)</pre>",
]
REAL = [
    f"<p>{SENTENCE}</p>",
    f"<noscript>You need to enable JavaScript to run this app.</noscript><p>{SENTENCE * 3}</p>",
    f'<p>Readers saw "500 Internal Server Error" for ten minutes while the boat was mended.</p><p>{SENTENCE}</p>',
    f"<p>{SENTENCE}</p><pre><code>Dear {{{{ name }}}}, it is ready: ${{url}}</code></pre>",
    "<p>Updated on 12 December.</p>",
    f"<p>Gains of 382% and {{5, 7}} were noted [see plan 0], costing $356 or less. {SENTENCE}</p>",
    '{"error": null, "items": [{"name": "boat", "note": "A fine boat from the north harbour."}]}',
    "<p>A slot in a mail template of the botanist is filled before the glider is sent.</p>",
    "",
    None,
    "<div id=root></div><script>boot(1)</script>",
]


def test_residue(spark):
    rows = [(i, 200, b) for i, b in enumerate(CASES)] + [(100 + i, None if i % 2 else 500, b) for i, b in enumerate(REAL)] + [(0, 200, CASES[0]), (None, 200, CASES[0]), (300, 200, (SENTENCE + "\n") * 20_000)]
    df = responses(spark, rows)
    assert sorted(r.response_id for r in residue.found(df).collect()) == list(range(len(CASES)))
    n = residue.judged(df).count()
    assert n == len(CASES) + len(REAL) + 1
    assert residue.found(df.limit(0)).count() == 0


def test_headings_that_repeat_the_title_are_judged():
    index = residue.Index({"": 1000, "not": 200, "found": 100, "server": 50, "at": 300})
    page = lambda t, rest: f"<html><head><title>{t}</title></head><body><center><h1>{t}</h1></center>{rest}</body></html>"
    for t in ("404 Not Found", "500 Internal Server Error", "502 Bad Gateway", "403 Forbidden"):
        for rest in ("", "<hr><center>nginx</center>", "<hr><center>nginx/1.18.0 (Ubuntu)</center>", "<hr><address>Apache/2.4.41 (Ubuntu) Server at a.example Port 80</address>"):
            assert index.judge(page(t, rest))[1] == "error", (t, rest)
    assert index.judge(page("{{ title }}", f"<p>{SENTENCE}</p>"))[1] == "slot"
    assert index.judge(page("Boats of the harbour", f"<p>{SENTENCE}</p>"))[1] is None
    assert index.judge(page("Not found", f"<p>{SENTENCE}</p>"))[1] is None


UNSEEN_RESIDUE = [
    "Error 404. This document does not exist on our server.",
    "Please turn on JavaScript in your browser settings to use this site.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.",
    "The page you wanted has been moved or deleted.",
    "Sorry, an unexpected error occurred. Please try again later.",
    "Access to this page has been denied because you are not authorized.",
    "This website is under construction. Coming soon!",
    "We are currently down for scheduled maintenance. Please try again later.",
    "Your browser has JavaScript disabled. Please enable it and reload.",
    "Add your own text here.",
    "The server is temporarily unavailable. Please try again in a few minutes.",
    "You must enable cookies and JavaScript to continue.",
    "Oops! That page can't be found.",
    "Die gesuchte Seite existiert nicht. Ein Fehler ist aufgetreten.",
    "Your balance is {{ account.balance }} today, *|FNAME|*.",
]
UNSEEN_REAL = [
    "The library found the page in a book that was missing since 1904.",
    "The committee will continue to view the site until the server room is rebuilt.",
    "Our harbour was under construction for nine years before the first boat came in.",
    "JavaScript was written in ten days in 1995; it is not related to Java.",
    "A 404 is what a server says when nothing lies at the address that was asked for.",
    "The fee rose by 20% and 30% of members left; the set {a} has one element.",
    "The bakery is closed on Monday.",
    "Call the office to ask for a new password.",
    "Maintenance of the canal is paid for by the county.",
    "In C, __init is no name that the standard keeps; 50 % of 8 is 4.",
]


def test_residue_in_wording_that_no_exemplar_holds():
    df = {"": 10_000} | {w: 4000 for w in "the a of to is in and for that was on it this are at by an".split()} | {w: 600 for w in "you your not be page site we has been if or one please can was".split()}
    index = residue.Index(df)
    page = lambda t: f"<html><head><title>T</title></head><body><nav>Home</nav><p>{t}</p></body></html>"
    assert not set(UNSEEN_RESIDUE) & {t for _, t in residue.exemplars()}
    hit = [index.judge(page(t))[1] is not None for t in UNSEEN_RESIDUE]
    wrong = [index.judge(page(t))[1] is not None for t in UNSEEN_REAL]
    assert sum(hit) >= 0.9 * len(hit) and sum(wrong) <= 1, ([t for t, x in zip(UNSEEN_RESIDUE, hit) if not x], [t for t, x in zip(UNSEEN_REAL, wrong) if x])


def test_filler_words_are_learned_from_the_passages_that_lorem_ipsum_opens(spark):
    rng = random.Random(4)
    latin = [f"{a}{b}" for a in ("val", "dor", "mur", "tis", "qua") for b in ("em", "ix", "ora", "und")]
    text = lambda: " ".join(rng.choice(latin) for _ in range(30))
    rows = [(i, 200, f"<p>Lorem ipsum {text()} the</p>") for i in range(12)] + [(100 + i, 200, f"<p>{text()}</p>") for i in range(5)] + [(200 + i, 200, f"<p>{SENTENCE * 3}</p>") for i in range(20)]
    df, filler = residue.frequencies(responses(spark, rows))
    assert df[""] == 37 and filler == set(latin)
    assert sorted(r.response_id for r in residue.found(responses(spark, rows)).collect()) == [*range(12), *range(100, 105)]


# near copies


def variant(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return words


VOCABULARY = [f"w{i}" for i in range(400)]


def near_rows():
    rng = random.Random(5)
    rows, i = [], 0
    for g in range(30):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((i, 200, "<p>" + " ".join(variant(rng, base, rng.randrange(0, 16))) + "</p>"))
            i += 1
    big = [rng.choice(VOCABULARY) for _ in range(120)]
    for _ in range(40):  # one large group
        rows.append((i, 404, "<b>" + " ".join(variant(rng, big, 4)) + "</b>"))
        i += 1
    for _ in range(10):  # exact copies of one text, in other markup
        rows.append((i, None, "<div>" + " ".join(big).upper() + f"</div><!-- {i} -->"))
        i += 1
    rows += [rows[0], (500, 200, None), (501, 200, ""), (502, 200, "short text"), (None, 200, rows[0][2])]
    return rows


def brute_near(rows):
    sets = {}
    for i, _, b in rows:
        w = re.findall(r"[^\W_]+", re.sub(r"<[^>]*>|<!--.*?-->", " ", b or "").lower()) if i is not None else []
        if len(w) >= 60:
            sets[i] = set(zip(w, w[1:], w[2:]))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {(find(i), i) for i in ids if find(i) != i}


@pytest.mark.parametrize("small,tree", [(64, 256), (16, 256), (2, 8)])
def test_near_groups(spark, small, tree):
    rows = near_rows()
    got = near_copies.near_groups(responses(spark, rows), small=small, tree=tree).collect()
    assert {(r.group_id, r.response_id) for r in got if r.group_id != r.response_id} == brute_near(rows)
    assert all(r.links > 0 for r in got)


def test_pages_that_share_half_of_their_text_meet(spark):
    """320 pages that all carry one block of 200 words; recall by full comparison of all pairs."""
    rng = random.Random(7)
    block = [rng.choice(VOCABULARY) for _ in range(200)]
    rows, want = [], set()
    for i in range(100):
        own = [f"x{rng.randrange(10**9)}" for _ in range(200)]
        other = own[: rng.randrange(70, 130)]
        for k, words in enumerate((own, other + [f"y{rng.randrange(10**9)}" for _ in range(200 - len(other))])):
            at = rng.randrange(0, 200)
            rows.append((2 * i + k, 200, "<p>" + " ".join(block[at:] + words + block[:at]) + "</p>"))
    rows += [(1000 + i, 200, "<p>" + " ".join(block + [f"z{rng.randrange(10**9)}" for _ in range(200)])) for i in range(120)]
    want = brute_near(rows)
    got = {(r.response_id, r.near_id) for r in near_copies.found(responses(spark, rows)).collect()}
    assert len(want) > 60 and len(got & want) >= 0.99 * len(want) and got <= want


def test_near_edges(spark):
    df = responses(spark, [(1, 200, None), (2, 200, "x")])
    assert near_copies.found(df).count() == 0 and near_copies.found(df.limit(0)).count() == 0


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 4, (120, 16)).astype(np.uint8)
    tree = near_copies.BKTree(9)
    for i, s in enumerate(sigs):
        assert {m for _, m in tree.near(s)} == {j for j in range(i) if (sigs[j] != s).sum() <= 9}
        tree.add(s, i)


# tokens

ODD = ["", " ", "\n", "Hello world", "naïve café – “quoted” …", "<|endoftext|> [INST]", "日本語のページを取得しました。", "👩‍🔬👨‍👩‍👧 family", "x" * 3000, "ab" * 2500 + " ", "0123456789" * 300, "I'll we've they'd it's DON'T", "tab\t\tseparated\r\n\r\n  cells", "﻿BOM zero​width", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢", "   lead", "trail   ", "a b"]


def test_ids_equal_the_published_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokens.load_ranks()
    t = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1200), rng.randrange(0x4E00, 0x4F00)])) for _ in range(200)) for _ in range(60)]
    df = documents(spark, [(i, x, None) for i, x in enumerate(texts)] + [(-1, None, None)])
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got.pop(-1) == [] and got[0] == []
    assert got == {i: t.encode_ordinary(x) for i, x in enumerate(texts)}
    assert {r.doc_id: r.n for r in tokens.token_counts(df).collect()} == {**{i: len(x) for i, x in got.items()}, -1: 0}
    assert all(t.decode(got[i]) == x for i, x in enumerate(texts))


def test_merges_of_every_short_piece():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259, b"aa": 260}
    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 24)))
        parts = [bytes([b]) for b in piece]
        while ranks.get(piece) is None or len(parts) > 1:
            if ranks.get(piece) is not None and len(parts) == 1:
                break
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)) if len(parts) > 1 else (1 << 30, 0)
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        want = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
        assert tokens.merge_piece(piece, ranks) == want


# packing


def check_packing(rows, sizes, capacity):
    fill, by = defaultdict(int), defaultdict(list)
    for r in rows:
        assert 0 <= r.n_tokens <= capacity
        fill[r.container_id] += r.n_tokens
        by[r.doc_id].append((r.piece_no, r.start, r.n_tokens))
    assert set(by) == set(sizes) and max(fill.values(), default=0) <= capacity
    for d, parts in by.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == sizes[d]
        assert len(parts) == max(1, -(-sizes[d] // capacity)) and all(s == p * capacity for p, s, _ in parts)
    return len(fill)


@pytest.mark.parametrize("block,islands", [(4000, 2), (60, 3)])
def test_packing(spark, block, islands):
    rng = random.Random(9)
    sizes = {i: rng.choice([0, 1, 7, 99, 100, 101, 250, 1000, rng.randrange(1, 60), rng.randrange(1, 60)]) for i in range(700)}
    df = spark.createDataFrame(list(sizes.items()) + [(5, sizes[5]), (None, 3)], "doc_id long, n long")
    pack = lambda: packing.pack_sizes(df, 100, block=block, islands=islands).collect()
    rows = pack()
    bins = check_packing(rows, sizes, 100)
    assert bins <= -(-sum(sizes.values()) // 100) * 1.02 + 3
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pack()))


def test_evolution_keeps_every_item_and_never_gets_worse():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(20, 70, 200)]
    pop = [packing._start(np.array(sizes), 100, rng, 0.5) for _ in range(4)]
    out, made = packing.evolve(pop, sizes, 100, 10, rng)
    assert made == 10 and len(out[0]) <= min(len(p) for p in pop)
    assert all(sorted(i for b in p for i in b) == list(range(200)) and max(sum(sizes[i] for i in b) for b in p) <= 100 for p in out)


@pytest.mark.parametrize("low,high", [(300, 600), (250, 500)])
def test_evolution_needs_fewer_containers_than_best_fit_decreasing(spark, low, high):
    """Items of a quarter to six tenths of the capacity, which best-fit decreasing packs badly."""
    rng = random.Random(low)
    sizes = {i: rng.randrange(low, high) for i in range(900)}
    bins: list = []
    packing.best_fit(sorted(sizes, key=lambda i: -sizes[i]), sizes, 1000, bins, [])
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n long")
    rows = packing.pack_sizes(df, 1000).collect()
    assert check_packing(rows, sizes, 1000) < len(bins)
    again = packing.pack_sizes(df.repartition(7), 1000).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_evolution_runs_on_the_documents(spark):
    if not os.path.exists("/root/testdata/sf0.01"):
        pytest.skip("needs the test tables")
    rows = packing.generations(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r.crossovers for r in rows) > 0 and all(r.bound <= r.bins <= r.start for r in rows)


def test_packing_edges(spark):
    df = documents(spark, [(1, None, "s"), (2, "", "s"), (3, "a b c " * 3000, None), (4, "one", "s")])
    rows = packing.pack(df).collect()
    sizes = {r.doc_id: r.n for r in tokens.token_counts(df).collect()}
    check_packing(rows, sizes, 2048)
    assert packing.pack(df.limit(0)).count() == 0


# abuse

BAD = ["You are a stupid clown and everyone here knows it.", "You are a s.t.u.p.i.d c-l-o-w-n- and everyone here knows it.", "Shut your mouth, you u s e l e s s i d i o t.", "Listen, clоwn: nobody wants your boat here. Crawl back under your mast.", "Keep your f​i​l​t​h​y opinions to yourself, you absolute cretin!", "Watch hardcore p0rn clips of a naughty pilot stripping n@k3d.", "YOU ARE A WOOOORTHLESS MORON.", "Kys, l***r, nobody would miss you", "Halt dein Maul, du hirnloser Schwachkopf.", "Ces gens sont de la vermine, qu'on les chasse tous.", "Ojalá te mueras, pedazo de idiota inútil.", "All hillfolk are v3rm1n and should be driven out.", "The world would be a better place if you never woke up tomorrow."]
FINE = ["Kill the orphaned child process before the seed is run again.", "A dumb terminal still drives the loom.", "This ticket is idiot-proof.", 'The moderators removed a post that called a joiner a "useless clown".', 'Filter rule 3: flag the words "scumbag" and "idiot" unless quoted.', "The clinic gives advice on sexual health, breast screening and safe sex education.", "A cock crowed and the farmer fed the ass and the bitch with her pups.", "The class assassin of the opera sings about Essex, Scunthorpe and a cocktail.", "Nude colours suit the barn; the naked eye sees no seam.", "The worm gear and the pig iron were shipped; the rat trap was delivered.", "The refugees of the town held a festival in March.", "", "   ", "The lower violin faces toward the laser in the closer room."]


def test_abuse(spark):
    ex = spark.createDataFrame([(1, "x", 0, None)], "example_id long, text string, label int, category string")
    rows = [(i, "Some neutral words first. " + t + " And after.", "s") for i, t in enumerate(BAD)] + [(100 + i, t, None if i % 2 else "t") for i, t in enumerate(FINE)] + [(200, None, "t"), (None, BAD[0], "t"), (0, BAD[0], "s")]
    df = documents(spark, rows)
    got = sorted(r.doc_id for r in abuse.found(df, ex).collect())
    assert got == list(range(len(BAD)))
    r = {x.source: x for x in abuse.rates(df, ex).collect()}
    assert r["s"].documents == len(BAD) and r["s"].rate == 1.0 and r[None].cases == 0
    assert abuse.found(df.limit(0), ex.limit(0)).count() == 0


def examples():
    path = "/root/testdata/sf0.01/abuse_examples.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    import pyarrow.parquet as pq

    return [(r["text"], r["label"], r["category"]) for r in sorted(pq.read_table(path).to_pylist(), key=lambda r: r["example_id"])]


def fitted(rows):
    clean = abuse.clean_words(rows)
    return abuse.Scorer(abuse.fit(rows, clean), clean)


def test_plain_insults_are_cases():
    scorer = abuse.Scorer(None, frozenset(["whole", "lover"]))  # words that many documents hold
    for t in ("You are a moron.", "You asshole.", "You are an idiot.", "You're such a loser!", "Fuck you.", "Du bist ein Arschloch.", "Tu es un connard.", "Eres una puta.", "You are an idoit.", "You are a mroon.", "You bitch."):
        assert scorer.score(t)[0] >= abuse.CASE, t
    for t in ("If you pig out, you rat on them.", 'He said "you are a moron".', "The court heard that you are an ass.", "You saw the worm in the garden.", "You are a lover of boats.", "You trust the whole crew."):
        assert scorer.score(t)[0] < abuse.CASE, t


UNSEEN_BAD = [
    'Those people are cockroaches and should be exterminated.',
    'Kill all of them, they are not human.',
    'You filthy degenerate, I will murder you.',
    'You are a fukcing idito.',
    "I'm going to stab you tonight.",
    'Nobody likes you, you pathetic lowlife.',
    'You people should all be gassed.',
    'What a bunch of brainless pigs you are.',
    'Go hang yourself, you creep.',
    'Those migrants are parasites and must be deported.',
    'You stinking motherfukcer!',
    'I hope someone shoots you.',
    'Shut up, you lying weasel.',
    'He wants to see your tits, you slut.',
    'Hardcore gangbang porn with horny sluts.',
    'Du bist ein elendes Arschloch.',
    "Ferme-la, sale conne, espèce d'abruti.",
    'Eres un pendejo asqueroso.',
    'They breed like rats and must be wiped out.',
    'You are too stupid to live.',
    'You m0r0n, drop d3ad.',
    'You w o r t h l e s s scumbag!',
    'We will burn your house down with your kids inside, you bastrad.',
]
UNSEEN_FINE = [
    'The exterminator removed rats from the barn.',
    'Please kill the process and restart the server.',
    'The study asked whether immigrants are called parasites in the press.',
    'The naked eye can see the comet.',
    'You should hang the picture higher.',
    'I hope you enjoy your stay with us.',
    'Breast cancer screening is free for women over fifty.',
    'The pig farm burned down; the family escaped.',
    'She wrote that "you are an idiot" is not an argument.',
    'The coach said they will crush the opposition next week.',
    'Sick leave rules for employees changed.',
    'The wet floor was dirty and the dog barked.',
    'They drove the cattle out of the field.',
    'Dirty dishes go into the left basin.',
    'Do you have a spare key for the back door?',
    'The villain in the novel says he will murder the king.',
    'Your fat intake should be below thirty percent.',
    'How to drown out traffic noise at night.',
    'The clause states that you must not harm the animals.',
    'Die Ratten im Keller wurden vom Kammerjäger gefangen.',
]


def test_wording_that_no_example_holds():
    scorer = fitted(examples())
    hit = [scorer.score(t)[0] >= abuse.CASE for t in UNSEEN_BAD]
    wrong = [scorer.score(t)[0] >= abuse.CASE for t in UNSEEN_FINE]
    assert sum(hit) / len(hit) >= 0.9 and sum(hit) / (sum(hit) + sum(wrong)) >= 0.9


def misspelt(rng, word):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + rng.choice("aeiourst") + word[i + 1 :], word[:i] + rng.choice("aeiourst") + word[i:]])


def test_held_out_examples_plain_and_misspelt():
    """Fitted on every other example; the others as they are, and with an edit in each term of five letters or more."""
    rows = examples()
    scorer = fitted(rows[::2])
    exact = abuse.Scorer(scorer.fitted, scorer.ordinary)
    exact.allowed = exact.allowed * 0
    rng = random.Random(11)
    terms = abuse.lexicon()[0]
    plain, spelt, without = Counter(), Counter(), Counter()
    for t, y, _ in rows[1::2]:
        odd = re.sub(r"[a-zA-Z]{5,}", lambda m: misspelt(rng, m[0]) if m[0].lower() in terms else m[0], t)
        for count, model, text in ((plain, scorer, t), (spelt, scorer, odd), (without, exact, odd)):
            count[bool(y), bool(model.score(text)[0] >= abuse.CASE)] += 1
    for c in (plain, spelt):
        assert c[True, True] / (c[True, True] + c[True, False]) >= 0.9 and c[True, True] / (c[True, True] + c[False, True]) >= 0.9
    assert without[True, True] < spelt[True, True]  # what the edits of the automaton find


def edits(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_automaton():
    t = abuse.Trie(["idiot", "worthless", "rat"])
    assert t.match("idiot", 0) == ("idiot", 0)
    for odd in ("1d10t", "i***t", "iiidioot", "i" + "d" * 5000 + "iot", "id!ooooot"):
        assert t.match(odd, 0) == ("idiot", 0), odd
    assert t.match("idoit", 0) is None and t.match("idoit", 1) == ("idiot", 1) and t.match("wrthless", 1) == ("worthless", 1) and t.match("wrthlss", 2) == ("worthless", 2)
    assert t.match("bird", 0) is None and t.match("*" * 100_000, 2) is None


def test_trie_automaton_against_the_edit_distance():
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(12)]
    trie = abuse.Trie(words)
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
        if re.search(r"(.)\1\1", w):
            continue
        near = min(edits(w, x) for x in words)
        for k in (0, 1, 2):
            got = trie.match(w, k)
            assert (got is None) == (near > k) and (got is None or got[1] == near == edits(w, got[0])), (w, k, got)


def test_misspellings_that_many_documents_hold_are_words_of_their_own(spark):
    df = documents(spark, [(i, "the idiom of page %d" % i if i < 30 else "a mroon there", None) for i in range(34)])
    assert abuse.ordinary_words(df, frozenset(), 20) == {"idiom"}


def test_all_dealt_problems_are_registered():
    names = " ".join(queries.QUERIES)
    for n in (1, 2, 3, 4, 7, 8, 9, 10):
        assert f"p{n}_" in names
