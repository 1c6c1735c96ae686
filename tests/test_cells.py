"""Requests meet the cached entries of their time, not all of them."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from datalode.operators import vectors as V


def test_a_request_meets_entries_of_its_time_in_bounded_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 10)
    monkeypatch.setattr(V, "HELD_ENTRIES", 16)
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, start + dt.timedelta(hours=i % 240), np.eye(4)[i % 4].tolist()) for i in range(960)], "id long, ts timestamp, embedding array<double>")
    entries = rows.select(F.col("id").alias("entry_id"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), "embedding")
    asked = rows.select(F.col("id").alias("query_id"), F.unix_micros("ts").alias("at"), F.lit("").alias("theme"), F.col("embedding").alias("e"))
    held = entries.select("entry_id", F.unix_micros("created_at").alias("start"), F.unix_micros("expires_at").alias("end"), F.lit("").alias("theme"), F.col("embedding").alias("e"))
    mine, own = V._in_cells(asked, held)
    cell = ["theme", "span", "part", "side"]
    met = mine.groupBy(*cell).agg(F.collect_list("query_id").alias("q")).join(own.groupBy(*cell).agg(F.collect_list("entry_id").alias("r")), cell).collect()
    pairs = [(q, r) for c in met for q in c["q"] for r in c["r"]]
    assert len(pairs) == len(set(pairs)) < 0.25 * 960 * 960 and max(len(c["q"]) for c in met) < 30
    assert {(q, r) for q in range(960) for r in range(960) if 0 <= q % 240 - r % 240 < 24} <= set(pairs)
    got = {r["query_id"]: r["entry_id"] for r in V.cached_steps(rows.withColumnRenamed("id", "query_id").withColumn("theme", F.lit("")), entries.withColumn("theme", F.lit("")), 0.9).collect()}
    want = {q: min((r for r in range(960) if r != q and r % 4 == q % 4 and 0 <= q % 240 - r % 240 < 24), default=None) for q in range(960)}
    assert got == {q: r for q, r in want.items() if r is not None}
