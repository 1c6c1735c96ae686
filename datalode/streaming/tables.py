"""Streams into keyed tables: each batch is one commit, and a job that starts again goes on where its last commit was."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalode.sources.keyed import KeyedTable


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> list[dict]:
    """Takes all present input in batches; gives the progress of each. ``checkpoint`` is the job's own folder: the same one
    makes a later run go on where this one ends."""
    query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.__dict__ for p in query.recentProgress]


def committed(table: KeyedTable, job: str, number: int) -> bool:
    """Whether a job's batch is in the table already: its number is part of the manifest, so both come true at once."""
    now = table.manifest()
    return bool(now) and now.notes.get(f"batch:{job}", -1) >= number


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, order: Sequence[str] = (), job: str = "upsert", prepare: Callable[[DataFrame], DataFrame] = lambda d: d, mode: str = "append") -> list[dict]:
    """Upserts each batch of a stream, after ``prepare``, into a table. A batch that comes again after a stop is passed over.

    Rows may come in any order and over any batches: with ``order`` a key keeps its highest row."""

    def step(batch: DataFrame, number: int) -> None:
        if not committed(table, job, number):
            table.upsert(prepare(batch), order, {f"batch:{job}": number})

    return run_batches(stream, step, checkpoint, mode)


def split_stream(stream: DataFrame, good: KeyedTable, bad: KeyedTable, ok: str, checkpoint: str, job: str = "split") -> None:
    """Rows that are ``ok`` into one table, all others into a quarantine. Both know their own batches, so a stop between
    the two commits loses and repeats nothing."""

    def step(batch: DataFrame, number: int) -> None:
        for table, rows in ((good, batch.where(ok)), (bad, batch.where(~F.coalesce(F.expr(ok), F.lit(False))))):
            if not committed(table, job, number):
                table.upsert(rows, (), {f"batch:{job}": number})

    run_batches(stream, step, checkpoint)


def split_late(stream: DataFrame, timely: KeyedTable, late: KeyedTable, checkpoint: str, delay_seconds: int, time: str = "ts", job: str = "late") -> None:
    """Rows that are ``delay_seconds`` or more behind the newest time of the batches before theirs go into ``late``, others into ``timely``.

    The newest time is noted in the manifest of ``timely`` with the batch, and the late rows are committed first."""

    def step(batch: DataFrame, number: int) -> None:
        now = timely.manifest()
        before = now.notes.get("newest") if now else None
        behind = F.lit(False) if before is None else F.coalesce(F.unix_micros(F.col(time).cast("timestamp")) <= F.lit(before - delay_seconds * 1_000_000), F.lit(False))
        if committed(timely, job, number):
            return
        if not committed(late, job, number):
            late.upsert(batch.where(behind), (), {f"batch:{job}": number})
        top = batch.agg(F.max(F.unix_micros(F.col(time).cast("timestamp")))).first()[0]
        newest = max((x for x in (before, top) if x is not None), default=None)
        timely.upsert(batch.where(~behind), (), {f"batch:{job}": number, "newest": newest})

    run_batches(stream, step, checkpoint)
