"""Cosine search and the cache of steps against all pairs; what their bounds leave out."""

from __future__ import annotations

import datetime as dt
import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from datalode.operators import vectors as V

rng = np.random.default_rng(4)


def clustered(n, width, spread):
    centres = rng.normal(size=(6, width))
    return centres[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * spread


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / size), 9) if size else 0.0


@pytest.mark.parametrize("k", [1, 4])
def test_search_equals_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(V, "ROWS", 8)
    monkeypatch.setattr(V, "PIVOTS", 5)
    monkeypatch.setattr(V, "HELD", 60)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(clustered(120, 6, 0.3))]
    rows += [(200, [0.0] * 6, "a"), (201, [1.0, None] * 3, "a"), (202, None, "b"), (203, [1.0], "a"), (204, rows[0][1], "a"), (205, rows[0][1], "b")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, g string").repartition(3)
    asked = df.where("chunk_id % 10 = 0 or chunk_id > 199").withColumnRenamed("chunk_id", "query_id")
    fit = {i: v if v is not None and len(v) == 6 and None not in v else [0.0] * 6 for i, v, _ in rows}
    group = {i: g for i, _, g in rows}
    for by in (None, "g"):
        want = []
        for q, v, _ in rows:
            if (q % 10 == 0 or q > 199) and v is not None and len(v) == 6:
                found = sorted((-cosine(fit[q], fit[i]), i) for i in fit if i != q and (by is None or group[i] == group[q]))[:k]
                want += [(q, i, -s) for s, i in found]
        got = [(r["query_id"], r["chunk_id"], r["score"]) for r in V.nearest(df, asked.where("query_id <> 203"), k, group=by).orderBy("query_id", "rank").collect()]
        near = lambda x: [(q, round(s, 7)) for q, _, s in x]
        assert near(got) == near(sorted(want, key=lambda w: (w[0], -w[2], w[1])))
    assert V.nearest(df.limit(0), asked, k).count() == 0 and V.nearest(df, asked.limit(0), k).count() == 0


def test_groups_that_are_too_far_are_not_multiplied():
    rows = clustered(4000, 8, 0.02)
    sizes = np.linalg.norm(rows, axis=1)
    order, angles, runs, pivots = V.grouped_rows(rows, sizes)
    assert sorted(order.tolist()) == list(range(4000)) and sum(b - a for _, a, b in runs) == 4000
    query = rows[0] / sizes[0]
    away = np.arccos(np.clip(query @ pivots.T, -1, 1))
    reach = [b - a for p, a, b in runs if np.cos(max(0, away[p] - angles[b - 1], angles[a] - away[p])) >= 0.99]
    inside = ((rows / sizes[:, None]) @ query >= 0.99).sum()
    assert inside <= sum(reach) < 2500


def test_memory_of_a_large_block():
    queries = rng.normal(size=(4096, 64))
    search = V._nearest(np.arange(4096) + 10**6, queries, np.full(4096, ""), 20, False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(rng.normal(size=(10_000, 64)).tolist()), pa.array([""] * 10_000)], names=["a", "b", "c"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = list(search(iter([batch])))
    assert out[0].num_rows == 4096 * 20 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500


@pytest.mark.parametrize("with_theme", [False, True])
def test_cache_equals_all_pairs(spark, monkeypatch, with_theme):
    monkeypatch.setattr(V, "ROWS", 16)
    monkeypatch.setattr(V, "QUERY_BLOCK", 40)
    start, r = dt.datetime(2024, 1, 1), random.Random(6)
    held = [(i, v.tolist(), start + dt.timedelta(hours=r.randrange(100)), r.choice(["x", "y", None])) for i, v in enumerate(clustered(150, 16, 0.25))]
    held += [(300, None, start, "x"), (301, [0.0] * 16, start, "x"), (302, [1.0, None] * 8, start, "x"), (303, held[1][1], held[1][2], held[1][3]), (304, [1.0], start, "x"), (None, held[2][1], held[2][2], "x"), (305, held[3][1], None, "x")]
    rows = spark.createDataFrame(held, "id long, embedding array<double>, ts timestamp, theme string").repartition(4)
    entries = rows.select(F.col("id").alias("entry_id"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), "theme", "embedding")
    got = {r["query_id"]: (r["entry_id"], r["score"], r["compared"]) for r in V.cached_steps(rows.withColumnRenamed("id", "query_id"), entries, 0.92, with_theme).collect()}
    fit = [(i, v, t, th) for i, v, t, th in held if i is not None and t and v and len(v) == 16 and None not in v and any(v)]
    want = {}
    for q, v, t, th in fit:
        live = [(-cosine(v, e), i) for i, e, c, et in fit if i != q and c <= t < c + dt.timedelta(hours=24) and (not with_theme or (et or "") == (th or ""))]
        best = min(live, default=(0, 0))
        if -best[0] >= 0.92:
            want[q] = (best[1], -best[0])
    assert {q: i for q, (i, _, _) in got.items()} == {q: i for q, (i, _) in want.items()} and len(want) > 40
    assert all(abs(got[q][1] - s) < 2e-9 for q, (_, s) in want.items())
    assert sum(c for _, _, c in got.values()) < 0.5 * len(got) * len(fit)
    assert V.cached_steps(rows.limit(0).withColumnRenamed("id", "query_id"), entries).count() == 0


def test_leading_coordinates_lose_no_pair():
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (clustered(200, 32, 0.4), clustered(300, 32, 0.4)))
    lead = np.arange(16)
    rest = np.sqrt(1 - (a[:, lead] ** 2).sum(axis=1))
    for least in (0.5, 0.8, 0.92):
        q, r = V.candidates(a, b, lead, rest, least)
        assert set(zip(*np.nonzero(a @ b.T >= least), strict=True)) <= set(zip(q, r, strict=True))
    q, r = V.candidates(*(x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(100, 64)), rng.normal(size=(500, 64)))), np.arange(32), np.full(100, 0.75), 0.92)
    assert len(q) < 500  # of 50,000 random pairs
