"""All strings of articles tell of notices, wherever in a block they stand."""

from __future__ import annotations

import random
from collections import defaultdict

from datalode.llm.html import NOTICED, REPEATED, blocks_of, extract_text, main_text

rng = random.Random(13)


def test_a_notice_within_other_blocks_counts(spark):
    notice = "Read all stories of our house in the app"
    told = lambda i, k: " ".join(f"w{i}x{k}x{j}" for j in range(12))
    rows, want = [], {}
    for i in range(8):  # of its own on four pages, at the end of a paragraph on the others; twice joined with its own end
        last = [notice, f"{told(i, 2)} {notice}", f"{notice} {notice}"][0 if i < 3 else 1 if i < 7 else 2]
        rows.append((i, f"http://a.org/{i}", f"<nav>Home</nav><article><p>{told(i, 0)}<p>{told(i, 1)}<p>{last}</article>"))
        want[i] = " ".join([told(i, 0), told(i, 1), *([last] if 3 <= i < 7 else [])])
    rows[7] = (7, "http://a.org/7", rows[7][2].replace(f"{notice} {notice}", f"{notice}<p>{notice}"))
    rows += [(20, "http://b.org/1", f"<article><p>{told(20, 0)}<p>{notice}</article>")]
    want[20] = f"{told(20, 0)} {notice}"
    rows += [rows[0]] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert all(r["text"] == want[r["page_id"]] for r in extract_text(pages).collect())


def test_notices_equal_brute_force(spark):
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(4)]
    own = lambda: " ".join(str(rng.random()) for _ in range(rng.randint(4, 14)))
    rows = []
    for i in range(90):
        parts = [own() for _ in range(rng.randint(1, 4))]
        for n, line in enumerate(lines):
            if rng.random() < (0.85, 0.55, 0.45, 0.7)[n]:
                parts.insert(rng.randint(0, len(parts)), rng.choice([line, line, f"{own()} {line}", f"{line} {own()}", f"{line} {rng.choice(lines)}"]))
        rows.append((i, f"http://h{i % 4 if i % 9 else i}.net/", f"<footer>x</footer><{'article' if i % 3 else 'main'}>{''.join(f'<p>{p}' for p in parts)}"))
    rows += [(100 + i, u, h) for i, (_, u, h) in enumerate(rows[:6])]  # copied articles
    pages = spark.createDataFrame(rows + rows[10:30] * 2, "page_id long, url string, html string").repartition(9)

    articles = {i: [t.split(" ") for k, t in blocks_of(h) if k < 2] for i, _, h in rows}
    host = {i: u for i, u, _ in rows}
    opens, holds, size = defaultdict(set), defaultdict(set), defaultdict(int)
    for i, blocks in articles.items():
        size[host[i]] += 1
        for b in blocks:
            if len(b) >= REPEATED:
                opens[host[i], tuple(b[:REPEATED])].add(i)
    for i, blocks in articles.items():
        shared = sum(len(b) for b in blocks if len(opens[host[i], tuple(b[:REPEATED])]) > 1)
        if 2 * shared < sum(map(len, blocks)):
            for b in blocks:
                for a in range(len(b) - REPEATED + 1):
                    holds[host[i], tuple(b[a : a + REPEATED])].add(i)
    common = {s for s, of in holds.items() if len(of) >= NOTICED and 2 * len(of) > size[s[0]]}
    want = {}
    for i, _, h in rows:
        at, places = 0, []
        for b in articles[i]:
            places += [at + a for a in range(len(b) - REPEATED + 1) if (host[i], tuple(b[a : a + REPEATED])) in common]
            at += len(b)
        want[i] = main_text(blocks_of(h), [], places)[0]
    assert common and sum(want[i] != main_text(blocks_of(h), [])[0] for i, _, h in rows) > 5
    assert all(r["text"] == want[r["page_id"]] for r in extract_text(pages).collect())
