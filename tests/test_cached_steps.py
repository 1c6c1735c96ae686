"""A low least cosine: few pairs are compared in full, and none that matters is lost."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from datalode.operators import vectors as V


@pytest.mark.parametrize("kind", ["float", "double"])
def test_low_cosines_compare_few_pairs_in_full(spark, monkeypatch, kind):
    monkeypatch.setattr(V, "ROWS", 64)
    monkeypatch.setattr(V, "PAIRS", 100, raising=False)
    rng, start = np.random.default_rng(4), dt.datetime(2024, 1, 1)
    vectors = rng.normal(size=(1200, 64)).astype(np.float32)
    vectors[100:120] = vectors[700:720] = 2 * vectors[:20]  # copies of another length
    hours = rng.integers(0, 48, len(vectors))
    rows = spark.createDataFrame([(i, start + dt.timedelta(hours=int(h)), "x", v.tolist()) for i, (h, v) in enumerate(zip(hours, vectors, strict=True))], "id long, ts timestamp, theme string, embedding array<double>")
    rows = rows.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")).repartition(3)
    entries = rows.select(F.col("id").alias("entry_id"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), "theme", "embedding")
    got = {r["query_id"]: r for r in V.cached_steps(rows.withColumnRenamed("id", "query_id"), entries, 0.2, True).collect()}
    e = vectors.astype(np.float64)
    scores = np.round((e @ e.T) / (np.linalg.norm(e, axis=1)[:, None] * np.linalg.norm(e, axis=1)[None, :]), 9)
    live = (hours[None, :] <= hours[:, None]) & (hours[:, None] < hours[None, :] + 24) & ~np.eye(len(e), dtype=bool)
    scores[~live] = -1
    best = scores.max(axis=1)
    want = {i: int(scores[i].argmax()) for i in range(len(e)) if best[i] >= 0.2}  # the smaller id of equals
    assert {i: r["entry_id"] for i, r in got.items()} == want and all(abs(r["score"] - best[i]) < 2e-9 for i, r in got.items())
    assert sum(r["compared"] for r in got.values()) < 0.05 * live.sum()
