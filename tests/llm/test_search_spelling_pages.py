"""Ranked search, spelling variants and page extraction against brute force, with nulls, ties, repeats, long and empty rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from datalode.llm import lexical
from datalode.llm.html import REPEATED, blocks_of, extract_text, main_text
from datalode.llm.lexical import Bucket, ranked_search
from datalode.llm.spelling import neighbours, reduced_numbers, spelling_variants

rng = random.Random(5)
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORDS = ["".join(rng.choice("abcdeñé漢 1"[:8]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
DOCS = "doc_id long, text string, rank int, score double, term string, n int, word string"


def prose(n):
    return " ".join(rng.choice(WORDS[: rng.choice([10, 60, 300])]) + rng.choice(["", ",", ".", "-x"]) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2.0, "own", 3, "w") for i, t in rows], DOCS)


# -- ranked search ------------------------------------------------------------------------------


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("share", [1, 3, 10**9])
def test_ranked_search_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 16)
    monkeypatch.setattr(lexical, "FEW", 2)
    rows = [(i, prose(rng.randint(1, 60))) for i in range(150)]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (200, None), (201, ""), (202, " ., "), (203, prose(30_000)), *((300 + i, rows[5][1]) for i in range(30))]
    items = [(i, prose(rng.randint(1, 25))) for i in range(12)] + [(3, "漢 ñ"), (None, rows[3][1]), (50, None), (51, "..."), (52, "nowhere"), (53, rows[5][1].upper())]
    asked = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, id double")
    got = ranked_search(docs_of(spark, rows).repartition(3), asked, k=5, share=share)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_search(rows, items, 5), key=key)


def test_ranked_search_in_passes_and_over_nothing(spark, monkeypatch):
    rows = [(i, prose(20)) for i in range(40)]
    items = [(i, prose(8)) for i in range(9)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "PASS_TERMS", 15)
    assert sorted(map(tuple, ranked_search(docs_of(spark, rows), asked, k=3).collect())) == sorted(brute_search(rows, items, 3))
    assert ranked_search(docs_of(spark, []), asked).count() == 0
    assert ranked_search(docs_of(spark, rows), asked.limit(0)).count() == 0


def test_bucket_bounds_lose_nothing_and_prune():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 20, 300)
    terms = np.concatenate([np.sort(r.choice(60, n, replace=False)) for n in sizes])
    impacts = r.integers(1, 10**6, len(terms)) * np.where(terms < 5, 1, 50)
    row = np.repeat(np.arange(300), sizes)
    dense = np.zeros((300, 60), np.int64)
    dense[row, terms] = impacts
    order = np.argsort(-np.sqrt((dense.astype(float) ** 2).sum(axis=1)), kind="stable")
    dense = dense[order]
    flat = [np.flatnonzero(x) for x in dense]
    bucket = Bucket(np.sqrt((dense.astype(float) ** 2).sum(axis=1)), np.array([len(x) for x in flat]), np.concatenate(flat), np.concatenate([d[f] for d, f in zip(dense, flat, strict=True)]), 60)
    for _ in range(50):
        item = np.sort(r.choice(60, r.integers(1, 25), replace=False))
        scores = dense[:, item].sum(axis=1)
        for need in (1, int(np.sort(scores)[-10]) or 1, int(scores.max()), int(scores.max()) + 1):
            rows, found = bucket.search(item, need)
            assert sorted(zip(rows.tolist(), found.tolist(), strict=True)) == [(i, s) for i, s in enumerate(scores.tolist()) if s >= need]


# -- spelling variants --------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, letters=5, least=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    out, form = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(others), n[best] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return sorted((w, *v) for w, v in out.items())


def test_spelling_variants_equal_brute_force(spark):
    base = ["".join(rng.choice("abcñÿÀ") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    base += ["".join(rng.choice("ab") for _ in range(40)) for _ in range(3)]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "é" + w[i + 1 :], w.upper()])

    def text(n):
        return rng.choice([" ", "-", "1"]).join(changed(rng.choice(base[: rng.choice([4, 63])])) for _ in range(n))

    rows = [(i, text(rng.randint(0, 200))) for i in range(60)]
    rows += [(None, text(100)), (1, rows[1][1]), (70, None), (71, ""), (72, text(20_000)), (73, "a" * 5000 + " " + " ".join(["z" * 300, "z" * 301] * 4))]
    got = spelling_variants(docs_of(spark, rows).repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(rows)
    assert spelling_variants(docs_of(spark, [])).count() == 0


def test_neighbourhoods_hold_every_edit():
    words = ["abcde", "ñandu"]
    for w in words:
        number, symbols = reduced_numbers([w])
        found = set(neighbours(np.frombuffer(symbols[0], np.uint8)[None])[0].tolist())
        for other in [w, w[1:], w[:2] + w[3:], "x" + w, w + "é", w[:3] + "q" + w[3:], w[:2] + "ÿ" + w[3:]]:
            assert reduced_numbers([other])[0][0] in found
        assert number[0] in found and reduced_numbers([w + "xy"])[0][0] not in found


# -- pages --------------------------------------------------------------------------------------


def text_of(html):
    return main_text(blocks_of(html), [])[0]


def test_markup_tells_what_is_no_article():
    page = (
        "<html><head><title>T</title><script>if (a<b) x='</p>'</script></head><body class='has-sidebar'><header>Site</header><nav><ul><li>Home<li>News</ul></nav>"
        "<!-- <article>no</article> --><div class='cookieNotice'>We use <b>cookies</b></div><main><article class=post><header><h1>A &amp; B</h1></header>"
        "<p>One <b>bold</b>er\n\t day &lt;p&gt;<br>two<p>Three&nbsp;four <span class='ad'>Buy!</span><aside>Side</aside><form>Name <input></form><p title='a>b'>Five"
        "<section id=comments><article class='comment'><p>Nice</p></article></section><footer>By me</footer></article><div class=related>More</div></main><footer>&copy; Us"
    )
    assert text_of(page) == "A & B One bolder day <p> two Three four Five"
    assert [blocks_of(page, articles=False)[i][0] for i in (0, 1)] == [blocks_of(page)[i][0] for i in (0, 1)]
    assert text_of("<main><p>Only main</main><div>else</div>") == "Only main"
    assert text_of("<div role='main'>Role</div><p>else") == "Role"
    assert text_of("<p hidden>x</p><p style='display: none'>y</p><p>z") == "z"
    assert [text_of(x) for x in ("", "plain < text", "<", "<p", "<script>never ends <p>x", "a</p></div>b", "&am &amp &#65; &zzz;")] == ["", "plain < text", "<", "", "", "a b", "&am & A &zzz;"]


def test_host_repeats_go_where_nothing_is_marked(spark):
    menu = "<div>Home News</div><div>Sport Weather</div><div>About our house</div>"
    end = "<div>All rights of this text are with the house</div>"
    body = {i: f"<div>Story {i} tells of {' '.join(rng.choice(WORDS) or 'w' for _ in range(12))} {i}</div><div>Short {i}</div>" for i in range(12)}
    copied = "<div>The same story stands on two pages of one house today</div>"
    rows = [(i, f"http://{'a.org' if i < 8 else 'b.org'}/{i}", menu + body[i] + end) for i in range(10)]
    rows += [(20, "http://c.org/1", menu + body[10] + end), (21, None, menu + end), (22, "http://a.org/x", None), (23, "http://a.org/y", ""), (None, "http://a.org/z", menu + end)]
    rows += [(30 + i, "http://a.org/art", f"{menu}<article>{copied}</article>{end}") for i in range(2)]
    rows += [(40, "http://d.org/", "<div>" + "long word " * 50_000 + "</div>"), (41, "http://e.org/", menu + copied), (41, "http://e.org/", menu + copied)]
    pages = spark.createDataFrame([(i, u, h, "x", 1, "k") for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int, page string")
    found = extract_text(pages.repartition(5)).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    got = {(r["page_id"], r["url"]): r["text"] for r in found}
    plain = lambda h: " ".join(text for _, text in blocks_of(h))
    for i, u, h in rows:
        want = plain(body[i]) if i is not None and i < 10 else plain(copied) if i in (30, 31) else plain(h or "")
        assert got[i, u] == want, i  # nothing but boilerplate: kept; copies of a row are one page
    assert next(r["n_repeated"] for r in found if r["page_id"] == 3) == 17 and REPEATED == 6  # the menu, "Story" after it, the end
    assert extract_text(pages.limit(0)).count() == 0


def test_repeats_equal_brute_force(spark):
    pieces = ["<p>" + " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) + "</p>" for _ in range(40)]
    rows = [(i, f"http://h{i % 3}.net/", "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows = list({(u, h): (i, u, h) for i, u, h in rows}.values())
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    holders = defaultdict(set)
    tokens = {i: " ".join(t for _, t in blocks_of(h)).split() for i, _, h in rows}
    for i, u, _ in rows:
        for a in range(len(tokens[i]) - REPEATED + 1):
            holders[u, tuple(tokens[i][a : a + REPEATED])].add(i)
    for r in extract_text(pages).collect():
        i, u, h = next(x for x in rows if x[0] == r["page_id"])
        places = [a for a in range(len(tokens[i]) - REPEATED + 1) if len(holders[u, tuple(tokens[i][a : a + REPEATED])]) > 1]
        assert (r["text"], r["n_repeated"]) == main_text(blocks_of(h), places)


def test_notices_in_articles_go_and_copies_stay(spark):
    told = lambda i, n=4: [f"Story {i} part {k} tells {' '.join(f'w{i}x{k}x{j}' for j in range(12))}" for k in range(n)]
    notice = "Read all stories of our house in the app"
    made = {}

    def page(host, i, parts, tag="article"):
        made[len(made)] = (f"http://{host}/{i}", f"<nav>Home</nav><{tag}>{''.join(f'<div>{p}</div>' for p in parts)}</{tag}><footer>End</footer>", parts)

    for i in range(7):  # a notice that no markup tells; a heading that is as common is too short for one
        page("a.org", i, ["In short", *told(i)[:2], notice, *told(i)[2:]], ("article", "main")[i % 2])
    for i in range(7):  # copies of one article, one of them shortened
        page("b.org", i, told(100)[: 4 - (i == 6)])
    for i in range(12):  # half of the host's articles hold a passage: no notice
        page("c.org", i, [*told(200 + i), *([notice] if i < 6 else [])])
    for i in range(4):  # too few pages
        page("d.org", i, [*told(300 + i), notice])
    for i in range(5):  # copies that hold the notice of the house, and no more
        page("a.org", 10 + i % 2, [notice])
    page("", 0, [notice])
    gone = {i for i, (u, _, _) in made.items() if u.startswith("http://a.org")}
    rows = [(i, u, h) for i, (u, h, _) in made.items()]
    pages = spark.createDataFrame(rows + rows[7:9], "page_id long, url string, html string").repartition(5)
    for r in extract_text(pages).collect():
        parts = made[r["page_id"]][2]
        want = [p for p in parts if p != notice] or parts if r["page_id"] in gone else parts
        assert r["text"] == " ".join(want), r["page_id"]
    again = spark.createDataFrame([*rows[:2], *rows[:2] * 9], "page_id long, url string, html string")  # rows that repeat are no further pages
    assert {(r["page_id"], r["text"]) for r in extract_text(again).collect()} == {(i, " ".join(made[i][2])) for i in (0, 1)}


def test_pages_of_marked_regions_alone_have_no_text(spark):
    for html in ("<nav>Home</nav><footer>Us</footer>", "<nav>Home</nav><article></article><div class=ad>Buy</div>", "<article><form>Name</form></article>"):
        assert text_of(html) == ""
    pages = spark.createDataFrame([(1, "http://a.org/", "<nav>Home</nav>"), (2, None, "<header>x</header><p>y")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_text(pages).collect()) == [(1, "", 0), (2, "y", 1)]
