"""What the given tables hold at most seldom: seconds that round over a day's edge, scores that end in a half, line items that tie."""

from __future__ import annotations

import datetime as dt
from hashlib import md5

from pyspark.sql import functions as F

from datalode.operators import llmops as L
from datalode.operators import retrieval as R
from datalode.plans import ingestion_queries as Q


def test_windows_count_rounded_seconds(spark):
    first = dt.datetime(2024, 1, 1, 0, 0, 0, 400000)
    day = first + dt.timedelta(days=1)
    rows = [(1, 1, first), (1, 2, day + dt.timedelta(seconds=-0.95)), (1, 3, day + dt.timedelta(seconds=-0.8)), (2, 4, first + dt.timedelta(seconds=0.2)), (2, 5, day)]
    got = L.first_submissions(spark.createDataFrame(rows, "client_request_id long, job_id long, ts timestamp")).collect()
    # 0.4 is second 0 and 0.6 is second 1; the day's last second begins at its half
    assert sorted((r["client_request_id"], r["slot"], r["job_id"], r["requests"]) for r in got) == [(1, 0, 1, 2), (1, 1, 3, 1), (2, 0, 4, 2)]


def test_relevance_is_told_as_sql_prints_it(spark):
    scores = [0.125, 0.375, 0.145, 0.155, 0.165, 1.0, 0.0, None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    told = rows.orderBy("i").select(R.context_header(F.lit("Source 1"), F.lit("f"), F.lit(0), F.lit("x"), F.col("s")).alias("h")).collect()
    assert [r["h"].split("Relevance: ")[1].strip() for r in told] == ["0.12", "0.38", "0.14", "0.15", "0.17", "1.00", "0.00", "null"]


def test_line_items_that_tie_keep_the_order_of_the_table(spark, tmp_path):
    rows = [(1, 7, 1, 1, 2.0, "R"), (1, 7, 1, 1, 2.0, "A"), (1, 7, 1, 1, 2.0, "N"), (1, 5, 1, 1, 2.0, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for query, name in ((Q.grid_tables, "col_1"), (Q.markdown_tables, "qty")):
        got = query(spark, str(tmp_path)).first()
        want = ";".join(f"part={p},{name}=2,flag={f}" for p, f in ((5, "A"), (7, "R"), (7, "A"), (7, "")))
        assert got["digest"] == md5(want.encode()).hexdigest() and got["n"] == 4
