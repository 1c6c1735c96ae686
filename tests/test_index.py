"""BM25 in blocks and the growing index against brute force and a full rebuild."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from datalode.operators import bm25
from datalode.sources.postings import PostingIndex

rng = random.Random(2)
WORDS = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]


def prose(n):
    return rng.choice([" ", "\n", "  "]).join(rng.choice(WORDS) for _ in range(n))


def brute(chunks, queries, k, distinct=False):
    held = [(i, Counter((t or "").lower().split())) for i, t in chunks]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    out = []
    for q, text in queries:
        asked = Counter((text or "").lower().split())
        scores = []
        for i, c in held:
            size = sum(c.values())
            s = round(sum(m * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size * n / words)) for t, m in asked.items() if c[t]), 9)
            if s > 0 and not (distinct and i == q):
                scores.append((-s, i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def rows_of(df):
    return sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in df.select("query_id", "chunk_id", "score", "rank").collect())


def equal(got, want):
    assert [(q, r) for q, _, _, r in got] == [(q, r) for q, _, _, r in want]
    assert all(abs(a[2] - b[2]) < 3e-9 for a, b in zip(got, want, strict=True))
    clear = [i for i, w in enumerate(want) if all(abs(w[2] - o[2]) > 3e-9 for o in want if o[0] == w[0] and o is not w)]
    assert [got[i][1] for i in clear] == [want[i][1] for i in clear]


@pytest.mark.parametrize("distinct", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, distinct):
    monkeypatch.setattr(bm25, "BLOCK_CHUNKS", 16)
    monkeypatch.setattr(bm25, "PASS_QUERIES", 5)
    chunks = [(i, prose(rng.randint(0, 80))) for i in range(200)] + [(300, None), (301, ""), (302, prose(8000)), (303, "Ünder ÜNDER")]
    queries = [(i, prose(rng.randint(1, 12))) for i in range(10)] + [(11, "ünder nowhere"), (12, ""), (13, None), (302, chunks[202][1])]
    docs = spark.createDataFrame(chunks + [(None, "w1")], "chunk_id long, text string").repartition(3)
    got = bm25.bm25_top(docs, spark.createDataFrame(queries, "query_id long, text string"), 4, distinct)
    equal(rows_of(got), sorted(brute(chunks, queries, 4, distinct)))
    assert bm25.bm25_top(docs.limit(0), spark.createDataFrame(queries, "query_id long, text string"), 4).count() == 0
    assert bm25.bm25_top(docs, spark.createDataFrame([], "query_id long, text string"), 4).count() == 0


def test_blocks_that_cannot_answer_are_not_scored():
    asked = bm25.Asked([{"query_id": 1, "term": "a", "weight": 2.0, "average": 3.0}, {"query_id": 2, "term": "b", "weight": 1.0, "average": 3.0}], {1: 1.9, 2: 5.0}, False)
    table = pa.table({"term": ["a", "b"], "ids": [[7], [7, 8]], "tfs": pa.array([[1], [2, 3]], pa.list_(pa.int32())), "lengths": pa.array([[3], [3, 4]], pa.list_(pa.int32()))})
    found, scored, seen = bm25.answers(table, asked, 5)
    assert (scored, seen) == (1, 2) and [(q, c) for q, c, _ in found] == [(1, 7)]


def test_the_index_is_what_a_rebuild_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_CHUNKS", 8)
    index = PostingIndex(spark, str(tmp_path / "index"), buckets=4)
    held: dict[tuple[str, int], str] = {}
    queries = [(i, prose(rng.randint(2, 9))) for i in range(6)]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    schema = "tenant_id string, chunk_id long, text string"

    def check():
        counts, sizes = Counter(), Counter()
        for (t, _), text in held.items():
            counts[t, ""] += 1
            sizes[t] += len(text.split())
            counts.update((t, w) for w in set(text.split()))
        assert {(r["tenant_id"], r["term"]): r["df"] for r in index.counts().collect()} == counts
        assert {r["tenant_id"]: r["words"] for r in index.sizes().collect() if r["words"]} == {t: n for t, n in sizes.items() if n}
        own = [(i, text) for (t, i), text in held.items() if t == "a"]
        equal(rows_of(index.search(asked, 3, "a")), sorted(brute(own, queries, 3)))

    for step in range(5):
        new = [(rng.choice("ab"), 20 * step + i - 3 * (step > 0), prose(rng.randint(1, 30))) for i in range(20)]
        index.append(spark.createDataFrame(new, schema))
        for t, i, text in new:
            held.setdefault((t, i), text)  # what is there stays
        if step in (1, 2, 4):
            gone = rng.sample(sorted(held), 6)
            index.erase(spark.createDataFrame([*gone, ("a", 10**6)], "tenant_id string, chunk_id long"))
            for key in gone:
                del held[key]
        if step in (2, 4):
            check()
    before = index.state()[1]
    assert len(before["segments"]) < 5  # some were merged
    again = sorted(held)[:2] + gone[:1]  # erased chunks may come again
    index.append(spark.createDataFrame([(t, i, "w1 w2 back") for t, i in again], schema))
    held.setdefault(gone[0], "w1 w2 back")
    check()
    number, now = index.state()
    index.erase(spark.createDataFrame([("a", 10**6)], "tenant_id string, chunk_id long"))
    index.append(spark.createDataFrame([(t, i, "other") for t, i in again], schema))
    assert index.state() == (number, now)
    newest = next(s for s in now["segments"] if s not in before["segments"])
    index.erase(spark.createDataFrame([gone[0]], "tenant_id string, chunk_id long"))
    assert list(index.state()[1]["erasures"].values())[-1] == [newest]  # no other segment was read


def test_an_erasure_takes_no_posting_apart(spark, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "index"), buckets=2)
    texts = {i: f"all w{i % 4}\ta{i}" + " twice" * (i % 3) for i in range(30)}
    index.append(spark.createDataFrame([(f"t{i % 2}", i, t) for i, t in texts.items()], "tenant_id string, chunk_id long, text string"))
    index.erase(spark.createDataFrame([("t0", 4), ("t1", 9), ("t1", 99)], "tenant_id string, chunk_id long"))
    index.erase(spark.createDataFrame([("t0", 8), ("t0", 4)], "tenant_id string, chunk_id long"))
    assert "Generate" not in index.postings()._jdf.queryExecution().optimizedPlan().toString()
    want = Counter((f"t{i % 2}", w, i, n, len(t.split())) for i, t in texts.items() if i not in (4, 8, 9) for w, n in [*Counter(t.split()).items(), ("", 0)])
    got = [(r["tenant_id"], r["term"], *e) for r in index.postings().collect() for e in zip(r["ids"], r["tfs"], r["lengths"], strict=True)]
    assert Counter(got) == want
    assert {(r["tenant_id"], r["term"]): r["df"] for r in index.counts().collect()} == Counter((t, w) for t, w, *_ in want)
    assert {r["tenant_id"]: r["words"] for r in index.sizes().collect()} == {t: sum(n for o, w, _, _, n in want if o == t and not w) for t in ("t0", "t1")}
