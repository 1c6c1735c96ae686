"""Structured Streaming jobs over event files; every job ends when all present files are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datalode.sources.keyed import KeyedTable
from datalode.sources.shared import scratch
from datalode.streaming.tables import committed, run_batches, upsert_stream

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: How long a day's total stays open for late rows (fixed value).
LATE = "25 hours"
#: First wait in seconds of each kind of job, and attempts before a job is dead (fixed values).
FIRST_WAIT = {"ingestion": 30, "generation": 5}
ATTEMPTS = 3
#: Requests of a client in a minute (fixed value).
RATE = 10


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as they arrive as files."""
    return spark.readStream.schema(EVENTS).parquet(path)


def parsed(events: DataFrame) -> DataFrame:
    """Adds the payload's number; ``ok`` is false for rows whose payload cannot be read."""
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    return events.withColumn("k", k).withColumn("ok", F.col("k").isNotNull())


def drained(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over all present input into a table of the shared folder and reads that. With a ``folder`` of the caller's a later
    run goes on where the one before ended."""
    spark = stream.sparkSession
    root = folder or scratch(spark, name)
    out = f"{root}/rows"
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(events: DataFrame, length: str = "1 minute", key: str = "user_id") -> DataFrame:
    """Events per key and tumbling window."""
    return events.groupBy(F.window("ts", length).alias("w"), key).agg(F.count("*").alias("n"))


def first_requests(events: DataFrame, key: str = "k", hours: int = 24) -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark([key])


STATES = "user_id long, n long, failed long, last string, ts timestamp, event_id long"


def job_states(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """State of each job so far: how many events, how many failed, the last, and the status. What a batch adds is merged into the rows
    of its jobs in a keyed table, so the stream itself holds no state."""
    spark = stream.sparkSession
    root = folder or scratch(spark, "job-states")
    table = KeyedTable(spark, f"{root}/rows", STATES, ["user_id"])
    failed = F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long")

    def step(batch: DataFrame, number: int) -> None:
        if committed(table, "states", number):
            return
        new = batch.select("user_id", F.lit(1).cast("long").alias("n"), failed.alias("failed"), F.col("event_type").alias("last"), "ts", "event_id").where("user_id is not null")

        def merge(old: DataFrame) -> DataFrame:
            last = F.max_by(F.struct("last", "ts", "event_id"), F.struct("ts", "event_id")).alias("l")
            return old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), last).select("user_id", "n", "failed", "l.*")

        table.change(new, merge, {"batch:states": number})

    run_batches(stream, step, f"{root}/state")
    status = F.when(F.col("failed") == 0, "complete").when(F.col("failed") < F.col("n"), "partial_failure").otherwise("failed")
    return table.read().withColumn("status", status)


def replayed(events: DataFrame, since: Column, terminal: Sequence[str]) -> DataFrame:
    """Events strictly after ``since``, oldest first by ``place``, up to each user's first terminal one; events without a time are left out."""
    rows = events.where(F.col("ts") > since)
    ends = rows.where(F.col("event_type").isin(*terminal)).groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("stop"))
    rows = rows.join(ends, "user_id", "left").where(F.col("stop").isNull() | (F.struct("ts", "event_id") <= F.col("stop"))).drop("stop")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


def retries(failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures (job, attempt from 0, ts) that are tried again, each wait twice the last, and the dead ones."""
    first = F.create_map(*(F.lit(x) for kv in FIRST_WAIT.items() for x in kv))[F.col("job")]
    dead = F.col("attempt") >= ATTEMPTS
    rows = failures.withColumns({"dead": dead, "next_retry_at": F.when(~dead, F.col("ts") + F.make_dt_interval(secs=first * F.pow(F.lit(2), "attempt")))})
    return rows.where("not dead"), rows.where("dead")


def debounced(edits: DataFrame, keys: Sequence[str], value: Column, gap: str = "2 seconds") -> DataFrame:
    """The last value of each run of edits that ends in ``gap`` of quiet, unless it is that of the run before."""
    runs = edits.withColumn("value", value).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.min("ts").alias("started"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("started"))
    return runs.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("value"))).select(*keys, "started", "value")


def daily_totals(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Totals by user and day from the stream. Each batch puts the days that it changed into a keyed table (update mode), so open days
    are there too; the watermark of 25 hours bounds the state and drops what comes later."""
    root = folder or scratch(spark, "daily")
    table = KeyedTable(spark, f"{root}/rows", "user_id long, day timestamp, spent double", ["user_id", "day"])
    events = event_stream(spark, path).withWatermark("ts", LATE)
    days = events.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.sum("value").alias("spent")).select("user_id", F.col("w.start").alias("day"), "spent")
    upsert_stream(days, table, f"{root}/state", job="daily", mode="update")
    return table.read()


def refused(events: DataFrame, client: str, most: int = RATE, length: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """client, window_start, n and how many are over ``most`` in a window; each window once, when the watermark has passed it."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), client).agg(F.count("*").alias("n"))
    return counts.select(F.col(client).alias("client"), F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("refused"))


def upserted_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str | None = None) -> DataFrame:
    """The row of each key that is highest by ``order``, over all batches and in whatever order they come. Each batch rewrites
    the buckets of its keys. With a ``folder`` of the caller's a later run goes on where the one before ended."""
    root = folder or scratch(stream.sparkSession, "snapshots")
    table = KeyedTable(stream.sparkSession, f"{root}/rows", stream.schema, keys)
    upsert_stream(stream, table, f"{root}/state", order)
    return table.read()
