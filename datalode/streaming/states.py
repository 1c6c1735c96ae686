"""Jobs as a state machine over an event stream, with timers: state is held for open jobs only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A job without an event for so long is over (fixed value).
LIFE_MS = 2 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
RESULT = "job_id long, started timestamp, ended timestamp, status string, slides_completed long, slides_failed long, slides array<long>, reason string"


def status_of(completed: int, failed: int) -> str:
    """complete without failures, failed without a completed slide, else partial_failure."""
    return "complete" if not failed else "partial_failure" if completed else "failed"


class Jobs(StatefulProcessor):
    """Rows (job_id, ts, event_id, kind, slide) of a job, kind being ``slide``, ``error``, ``end`` or another.

    A job is queued by its first row, generates while slides come, and is over with an ``end``, or when no row has come for
    LIFE_MS: by the next row's time or by a timer on the watermark. What is over is told once and its state
    cleared; a later row opens the next job of the id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "started long, last long, failed long")
        self.slides = handle.getListState("slides", "slide long")

    def _read(self) -> tuple[int, int, int, list[int]] | None:
        if not self.job.exists():
            return None
        started, last, failed = self.job.get()
        return started, last, failed, [s[0] for s in self.slides.get()]

    def _told(self, key: tuple, state: tuple[int, int, int, list[int]], ended: int, reason: str) -> dict:
        started, _, failed, slides = state
        status = status_of(len(slides), failed) if reason == "end" else "failed"
        at = lambda us: pd.Timestamp(us, unit="us")
        return {"job_id": key[0], "started": at(started), "ended": at(ended), "status": status, "slides_completed": len(slides), "slides_failed": failed, "slides": sorted(slides), "reason": reason}

    def _out(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "started", "ended", "status", "slides_completed", "slides_failed", "slides", "reason"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        times = new["ts"].astype("datetime64[us]").astype("int64").tolist()
        state, out = self._read(), []
        for at, kind, slide in zip(times, new["kind"].tolist(), new["slide"].tolist(), strict=True):
            if state and at - state[1] > LIFE_MS * 1000:
                out.append(self._told(key, state, state[1], "timeout"))
                state = None
            started, last, failed, slides = state or (at, at, 0, [])
            if kind == "slide":
                slides = [*slides, int(slide)]
            state = (started, max(last, at), failed + (kind == "error"), slides)
            if kind == "end":
                out.append(self._told(key, state, at, "end"))
                state = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.job.clear()
        self.slides.clear()
        if state:
            self.job.update(state[:3])
            if state[3]:
                self.slides.put([(s,) for s in state[3]])
            self.handle.registerTimer(state[1] // 1000 + LIFE_MS)
        yield self._out(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._read()
        self.job.clear()
        self.slides.clear()
        yield self._out([self._told(key, state, state[1], "timeout")] if state else [])

    def close(self) -> None:
        pass


def job_results(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row for every job of a stream (job_id, ts, event_id, kind, slide) when it is over. Needs the RocksDB state store (``with_rocksdb``).

    Rows that are more than ``delay`` behind the newest of the batches before are dropped by the watermark. At the end of the input jobs stay open whose
    last row is less than two hours behind the watermark."""
    rows = events.withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(Jobs(), RESULT, "Append", "EventTime")


class with_rocksdb:
    """Sets the session's state store for the streams that start within, and then as it was."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(PROVIDER, self.before)
