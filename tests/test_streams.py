"""Keyed tables and the streams into them: what is written, stops in between, starts afterwards, late and broken rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from datalode.sources.keyed import KeyedTable
from datalode.streaming import jobs, states
from datalode.streaming.tables import split_late, split_stream, upsert_stream

START = dt.datetime(2024, 5, 1)
ROWS = "id long, ts timestamp, v long, event_id long"


def store(spark, path, buckets=8):
    return KeyedTable(spark, str(path), ROWS, ["id"], buckets=buckets)


def frame(spark, rows):
    return spark.createDataFrame([(i, START + dt.timedelta(seconds=s), v, e) for i, s, v, e in rows], ROWS)


def held(table):
    return {r["id"]: (r["v"], r["event_id"]) for r in table.read().collect()}


def rows_of_commit(table):
    """How many rows the last commit wrote."""
    now = table.manifest()
    return table.read([b for b, folder in now.buckets.items() if folder.startswith(f"{now.number}-")]).count()


def arrive(spark, folder, rows, schema=ROWS):
    """One more file of a folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    table = store(spark, tmp_path / "t", buckets=64)
    assert table.read().count() == 0 and table.manifest() is None
    table.upsert(frame(spark, [(i, 0, 1, i) for i in range(6400)]))
    assert rows_of_commit(table) == 6400
    now = table.upsert(frame(spark, [(7, 5, 2, 1), (7, 6, 3, 2), (9000, 0, 4, 3)]))
    assert rows_of_commit(table) < 400 and sum(v.startswith("2-") for v in now.buckets.values()) <= 2
    assert held(table)[7] == (3, 2) and len(held(table)) == 6401  # of two new rows of a key one stays
    table.append(frame(spark, [(7, 0, 9, 9), (9001, 2, 5, 5), (9001, 1, 6, 6)]), ["ts"])
    assert held(table)[7] == (3, 2) and held(table)[9001] == (6, 6)
    table.erase(spark.createDataFrame([(7,), (9001,), (123456,)], "id long"))
    assert set(held(table)) == {*range(6400), 9000} - {7}
    assert sorted(r["id"] for r in table.matching(spark.createDataFrame([(5,), (5,), (77777,)], "id long")).collect()) == [5]
    before = held(table)
    table.vacuum()
    assert held(table) == before == held(store(spark, tmp_path / "t", buckets=3))  # the number of buckets is the table's own
    table.upsert(frame(spark, []))
    assert held(table) == before


def test_the_highest_row_wins_whatever_the_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(50), i, i) for i in range(200)]
    table = store(spark, tmp_path / "t")
    for a in range(0, 200, 70):
        table.upsert(frame(spark, rows[a : a + 70]), ["ts", "event_id"])
    assert held(table) == {i: max((s, e, v) for k, s, v, e in rows if k == i)[:0:-1] for i in {r[0] for r in rows}}


def test_a_second_writer_fails_and_a_lost_commit_changes_nothing(spark, tmp_path):
    one, other = store(spark, tmp_path / "t"), store(spark, tmp_path / "t")
    one.upsert(frame(spark, [(1, 0, 1, 1)]))

    def lost(old):
        one.upsert(frame(spark, [(2, 0, 2, 2)]))
        return old

    with pytest.raises(RuntimeError, match="another writer"):
        other.change(frame(spark, [(1, 0, 9, 9)]), lost)
    assert held(one) == {1: (1, 1), 2: (2, 2)}


@pytest.mark.parametrize("stop", ["before", "after"])
def test_upserts_go_on_after_a_stop(spark, tmp_path, stop):
    folder = tmp_path / "in"
    batches = [[(i, START + dt.timedelta(seconds=rng), n, n * 10 + i) for i in range(6) for rng in (n * (-1) ** i,)] for n in range(5)]
    for b in batches[:4]:
        arrive(spark, folder, b)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    table = store(spark, tmp_path / "t")
    real, calls = table.upsert, []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3 and stop == "before":
            raise RuntimeError("lost")
        out = real(*args, **kwargs)
        if len(calls) == 3:
            raise RuntimeError("lost")  # committed, but the stream does not know
        return out

    table.upsert = failing
    with pytest.raises(Exception, match="lost"):
        upsert_stream(stream, table, str(tmp_path / "state"), ["ts", "event_id"])
    again = store(spark, tmp_path / "t")
    arrive(spark, folder, batches[4])
    upsert_stream(stream, again, str(tmp_path / "state"), ["ts", "event_id"])
    rows = [r for b in batches for r in b]
    assert held(again) == {i: max((t, e, v) for k, t, v, e in rows if k == i)[:0:-1] for i in range(6)}
    commits = again.manifest().number
    assert commits == 5  # a batch that came again made no commit
    upsert_stream(stream, again, str(tmp_path / "state"), ["ts", "event_id"])
    assert again.manifest().number == commits


def test_sums_are_not_added_twice(spark, tmp_path):
    folder = str(tmp_path / "in")
    for n in range(3):
        arrive(spark, folder, [(10 * n + i, START + dt.timedelta(hours=i), i % 2, ["error", "view"][i % 3 > 0], 1.0, "{}") for i in range(8)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):
        got = {r["user_id"]: (r["n"], r["failed"], r["last"], r["status"]) for r in jobs.job_states(stream, str(tmp_path / "s")).collect()}
        assert got == {0: (12, 6, "error", "partial_failure"), 1: (12, 3, "view", "partial_failure")}
    for _ in range(2):
        days = jobs.daily_totals(spark, folder, str(tmp_path / "d")).collect()
        assert {(r["user_id"], r["spent"]) for r in days} == {(0, 12.0), (1, 12.0)}


def test_late_and_broken_rows_are_kept_apart(spark, tmp_path):
    folder = tmp_path / "in"
    seconds = [[0, 100, 50], [300, 220, 280, 39, 40], [290, 239, 500]]
    for n, ts in enumerate(seconds):
        arrive(spark, folder, [(10 * n + i, START + dt.timedelta(seconds=s), s, i) for i, s in enumerate(ts)])
        stream = spark.readStream.schema(ROWS).parquet(str(folder))
        timely, late = store(spark, tmp_path / "timely"), store(spark, tmp_path / "late")
        split_late(stream, timely, late, str(tmp_path / "state"), 60)
    assert sorted(v for v, _ in held(late).values()) == [39, 40, 239]
    assert sorted(v for v, _ in held(timely).values()) == [0, 50, 100, 220, 280, 290, 300, 500]
    assert timely.manifest().notes["newest"] == int((START + dt.timedelta(seconds=500)).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    good, bad = store(spark, tmp_path / "good"), store(spark, tmp_path / "bad")
    split_stream(spark.readStream.schema(ROWS).parquet(str(folder)), good, bad, "nullif(v, 300) % 20 = 0", str(tmp_path / "split"))
    assert len(held(good)) == 6 and len(held(bad)) == 5 and any(v == 300 for v, _ in held(bad).values())  # null is not ok


# -- jobs ---------------------------------------------------------------------------------------

JOB = "job_id long, ts timestamp, event_id long, kind string, slide long"


def brute_jobs(rows, delay=600):
    out, end = [], max(r[1] for r in rows) - dt.timedelta(seconds=delay)
    for job in sorted({r[0] for r in rows}):
        now = None
        for _, at, _, kind, slide in sorted(r for r in rows if r[0] == job):
            if now and at - now[1] > dt.timedelta(hours=2):
                out.append((job, now[0], now[1], "failed", len(now[3]), now[2], sorted(now[3]), "timeout"))
                now = None
            now = now or [at, at, 0, []]
            now[1] = at
            now[2] += kind == "error"
            now[3] += [slide] * (kind == "slide")
            if kind == "end":
                out.append((job, now[0], at, states.status_of(len(now[3]), now[2]), len(now[3]), now[2], sorted(now[3]), "end"))
                now = None
        if now and now[1] + dt.timedelta(hours=2) <= end:
            out.append((job, now[0], now[1], "failed", len(now[3]), now[2], sorted(now[3]), "timeout"))
    return out


def test_jobs_are_told_once_and_their_state_goes(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted(((rng.randrange(8), START + dt.timedelta(seconds=rng.randrange(100_000)), i, rng.choice(["queued", "slide", "slide", "error", "end"]), rng.randrange(9)) for i in range(160)), key=lambda r: r[1])
    folder, table = tmp_path / "in", KeyedTable(spark, str(tmp_path / "t"), states.RESULT, ["job_id", "started", "ended"], buckets=2)
    progress = []
    for a, b in ((0, 90), (90, 160)):  # the job stops in between and goes on
        arrive(spark, folder, rows[a:b], JOB)
        stream = spark.readStream.schema(JOB).parquet(str(folder))
        with states.with_rocksdb(spark):
            progress += upsert_stream(states.job_results(stream), table, str(tmp_path / "state"))
    got = sorted(tuple(r) for r in table.read().collect())
    assert got == sorted(brute_jobs(rows))
    ends = {j: max(r[1] for r in rows if r[0] == j) for j in range(8)}
    still = [j for j in range(8) if ends[j] + dt.timedelta(hours=2) > rows[-1][1] - dt.timedelta(minutes=10)]
    open_rows = progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert open_rows <= sum(2 + 2 + sum(r[0] == j and r[1] > ends[j] - dt.timedelta(hours=24) for r in rows) for j in still)  # nothing of jobs that are over
    assert spark.conf.get(states.PROVIDER) != states.ROCKSDB


def test_refusals_of_closed_windows(spark, tmp_path):
    rows = [(START + dt.timedelta(seconds=s), c) for c, n in (("a", 14), ("b", 10)) for s in range(n)] + [(START + dt.timedelta(minutes=5), "a")]
    arrive(spark, tmp_path / "in", rows, "ts timestamp, client string")
    stream = spark.readStream.schema("ts timestamp, client string").parquet(str(tmp_path / "in"))
    got = jobs.drained(jobs.refused(stream, "client"), "limits", folder=str(tmp_path / "out"))
    assert sorted((r["client"], r["n"], r["refused"]) for r in got.collect()) == [("a", 14, 4), ("b", 10, 0)]
