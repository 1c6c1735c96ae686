"""Cosine search and cosine joins: blocks of vectors that bounds show to be too far are not multiplied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalode.sources.shared import written

#: Queries that go to all tasks at once.
QUERY_BLOCK = 4096
#: Vectors of a product; with all queries of a pass that is some 17 MB of scores.
ROWS = 512
#: Pivots of a batch of vectors.
PIVOTS = 16
#: Entries of a cell of the cache of steps, and requests.
HELD_ENTRIES = 1 << 15
#: Answers that are held before they are cut to the best of each query.
HELD = 1 << 18
#: Share of the coordinates, those of most weight, that a cosine join multiplies first, if that can tell: from a least cosine of so much on.
LEADING, TELLING = 0.5, 0.75
#: More than a coordinate adds to the error of a product of unit vectors in single precision.
SLACK = 1e-7
#: Pairs whose cosines are worked out at once.
PAIRS = 1 << 16


def _matrix(lists: list, width: int) -> np.ndarray:
    """Vectors as rows; those that are null, of another size or with a null component are zero."""
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    return out


class Best:
    """The k highest scores of each query so far, ties to smaller ids, and the score that others must reach."""

    def __init__(self, queries: int, k: int, least: float = -np.inf) -> None:
        self.k, self.need = k, np.full(queries, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of some queries (rows) with some ids (columns)."""
        scores = np.where(allowed, scores, -np.inf)
        if scores.shape[1] > self.k:  # what is under the k-th of these alone is not among the best
            edge = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            keep = scores >= np.maximum(self.need[queries], edge)[:, None]
        else:
            keep = scores >= self.need[queries][:, None]
        q, c = np.nonzero(keep & (scores > -np.inf))
        self.parts.append((queries[q], ids[c], scores[q, c]))
        self.size += len(q)
        if self.size > HELD:
            self.cut()

    def cut(self) -> None:
        q, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = q[place == self.k - 1]
        self.need[last] = np.maximum(self.need[last], scores[place == self.k - 1])
        keep = place < self.k
        self.parts = [(q[keep], ids[keep], scores[keep])]
        self.size = int(keep.sum())


def grouped_rows(vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Rows ordered by their nearest pivot and the angle to it: the order, the angles, runs (pivot, first, end) of at most ROWS, and the pivots.

    Pivots are vectors of the batch, spread over it. Vectors without a direction come last, as runs of pivot -1."""
    fit = np.flatnonzero(sizes > 0)
    unit = vectors[fit] / sizes[fit][:, None]
    pivots = unit[np.linspace(0, len(unit) - 1, min(PIVOTS, len(unit))).astype(np.int64)] if len(unit) else unit
    cosines = unit @ pivots.T if len(unit) else np.zeros((0, 0))
    near = cosines.argmax(axis=1) if len(unit) else np.zeros(0, np.int64)
    angle = np.arccos(np.clip(cosines[np.arange(len(near)), near], -1, 1))
    order = np.lexsort((angle, near))
    cuts = [0, *(np.flatnonzero(np.diff(near[order])) + 1).tolist(), len(order)]
    runs = [(int(near[order[a]]), s, min(s + ROWS, b)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a for s in range(a, b, ROWS)]
    rest = np.flatnonzero(sizes == 0)
    runs += [(-1, len(order) + a, min(len(order) + a + ROWS, len(sizes))) for a in range(0, len(rest), ROWS)]
    return np.concatenate([fit[order], rest]), np.concatenate([angle[order], np.zeros(len(rest))]), runs, pivots


def _nearest(ids: np.ndarray, queries: np.ndarray, groups: np.ndarray, k: int, same: bool):
    """The k best vectors of a partition for each query."""
    sizes = np.linalg.norm(queries, axis=1)
    unit = queries / np.maximum(sizes, 1e-300)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for b in batches:
            chunk = b.column(0).to_numpy(zero_copy_only=False)
            rows = _matrix(b.column(1).to_pylist(), queries.shape[1])
            own = b.column(2).to_numpy(zero_copy_only=False).astype(str)
            long = np.linalg.norm(rows, axis=1)
            order, angles, runs, pivots = grouped_rows(rows, long)
            away = np.arccos(np.clip(unit @ pivots.T, -1, 1)) if len(pivots) else np.zeros((len(ids), 0))
            for pivot, a, z in runs:
                some, all_queries = order[a:z], np.arange(len(ids))
                if pivot >= 0:
                    # the angle to a vector is at least the difference of both angles to the pivot
                    gap = np.maximum(0, np.maximum(away[:, pivot] - angles[z - 1], angles[a] - away[:, pivot]))
                    all_queries = np.flatnonzero((np.cos(gap) + 2e-9 >= best.need) | (sizes == 0) & (best.need <= 0))
                if not len(all_queries):
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = queries[all_queries] @ rows[some].T
                    scores /= sizes[all_queries][:, None] * long[some][None, :]
                np.round(scores, 9, out=scores)
                scores[(sizes[all_queries] == 0)[:, None] | (long[some] == 0)[None, :]] = 0.0
                allowed = groups[all_queries][:, None] == own[some][None, :]
                if not same:
                    allowed &= ids[all_queries][:, None] != chunk[some][None, :]
                best.add(all_queries, scores, chunk[some], allowed)
        best.cut()
        q, c, s = best.parts[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "chunk_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, same: bool = False, group: str | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the k highest cosines (9 digits) of each query; 0 for zero or unlike vectors; ties to smaller ids.

    A stated query set is taken in blocks of a fixed size, each sent to all tasks; a partition gives one answer, the k best of its
    vectors for each query. Vectors are grouped by pivots; a group whose angles to its pivot show that it cannot reach a query's k-th best
    is not multiplied with it. With ``group``, a column of both, only vectors of the query's group are compared. Vectors
    without a value, or with null components, score 0."""
    key = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    asked = queries.where("query_id is not null and embedding is not null").select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"), key.alias("g"))
    rows = vectors.where("chunk_id is not null").select(F.col("chunk_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), key.alias("g"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # QUERY_BLOCK rows, about
        for width in sorted({len(r["q"]) for r in mine}) or [0]:
            some = [r for r in mine if len(r["q"]) == width]
            ids = np.array([r["query_id"] for r in some], np.int64)
            groups = np.array([r["g"] for r in some], str)
            found = rows.mapInArrow(_nearest(ids, _matrix([r["q"] for r in some], width), groups, k, same), "query_id long, chunk_id long, score double")
            found = written(found, "nearest") if blocks > 1 else found
            out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# -- the cache of steps ----------------------------------------------------------------------------


def candidates(queries: np.ndarray, rows: np.ndarray, lead: np.ndarray, rest_of_queries: np.ndarray, least: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose cosine may be ``least`` (of all, or of each query): the product over the leading coordinates, and at most the product of the rests' lengths (Cauchy-Schwarz)."""
    if len(lead) == queries.shape[1]:
        most = queries @ rows.T
    else:
        most = queries[:, lead] @ rows[:, lead].T
        most += rest_of_queries[:, None] * _rests(rows, lead)[None, :]
    return np.nonzero(most >= (np.reshape(least, (-1, 1)) - SLACK * (queries.shape[1] + 8)).astype(most.dtype))


def _rests(units: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Lengths of unit vectors without the leading coordinates, at least."""
    return np.sqrt(np.maximum(1 - (units[:, lead] ** 2).sum(axis=1, dtype=np.float64), 0) + 1e-6).astype(units.dtype)


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """As ``_matrix``, without Python's lists where no vector is odd."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    values = lists.flatten()
    if lists.null_count or values.null_count or len(values) != width * len(lists) or (np.diff(lists.offsets.to_numpy()) != width).any():
        return _matrix(lists.to_pylist(), width)
    return values.to_numpy().astype(np.float64).reshape(len(lists), width)


def _lookup(lead: np.ndarray, width: int, least: float):
    """The best live entry of a cell for each of its requests, and how many entries were compared in full.

    Both sides are ordered by time, so most blocks without a live pair are not multiplied. Blocks are multiplied in single precision; only
    pairs that may reach the request's best so far are compared in full."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.sort_by("at"), held.sort_by("start")
        ids, times = (asked.column(c).to_numpy() for c in ("query_id", "at"))
        queries = _vectors(asked.column("e"), width)
        sizes = np.linalg.norm(queries, axis=1)
        unit = (queries / np.maximum(sizes, 1e-300)[:, None]).astype(np.float32)
        rests = _rests(unit, lead)
        entry, start, end = (held.column(c).to_numpy() for c in ("entry_id", "start", "end"))
        rows = _vectors(held.column("e"), width)
        long = np.linalg.norm(rows, axis=1)
        score, found = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
        seen = np.zeros(len(ids), np.int64)

        def compare(q: np.ndarray, r: np.ndarray) -> None:
            scores = np.round(np.einsum("ij,ij->i", queries[q], rows[r]) / (sizes[q] * long[r]), 9)
            fit = scores >= least
            q, scores, own = q[fit], scores[fit], entry[r[fit]]
            order = np.lexsort((own, -scores, q))
            q, first = np.unique(q[order], return_index=True)
            scores, own = scores[order][first], own[order][first]
            better = (scores > score[q]) | (scores == score[q]) & (own < found[q])
            score[q[better]], found[q[better]] = scores[better], own[better]

        for a in range(0, len(entry), ROWS):
            fit = np.flatnonzero(long[a : a + ROWS] > 0) + a
            if not len(fit):
                continue
            units = (rows[fit] / long[fit][:, None]).astype(np.float32)
            first, last = np.searchsorted(times, (start[fit].min(), end[fit].max()))
            for c in range(first, last, QUERY_BLOCK):
                own = slice(c, min(c + QUERY_BLOCK, last))
                q, r = candidates(unit[own], units, lead, rests[own], np.maximum(score[own], least))
                q, r = q + c, fit[r]
                live = (sizes[q] > 0) & (start[r] <= times[q]) & (times[q] < end[r]) & (entry[r] != ids[q])
                q, r = q[live], r[live]
                seen += np.bincount(q, minlength=len(ids))
                for i in range(0, len(q), PAIRS):
                    compare(q[i : i + PAIRS], r[i : i + PAIRS])
        some = np.flatnonzero(seen)
        none = score[some] < least
        return pa.table({"query_id": pa.array(ids[some]), "entry_id": pa.array(found[some], mask=none), "score": pa.array(score[some], mask=none), "compared": pa.array(seen[some])})

    return run


def _in_cells(asked: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and entries by cells (theme, span, part, side), so that a request meets each entry of its theme that may be live, once.

    A span is as long as the longest life of an entry, which so lies in two at most. Spans of many rows are cut in parts of some HELD_ENTRIES requests or
    entries; every part of one side meets each of the other."""
    span = max(1, rows.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1)
    at = lambda c: F.floor(F.col(c) / F.lit(span).cast("double")).cast("long")
    asked = asked.withColumn("span", at("at"))
    rows = rows.where("start < end").withColumn("span", F.explode(F.sequence(at("start"), at("end"))))
    many = lambda df, name: df.groupBy("theme", "span").agg(F.ceil(F.count("*") / HELD_ENTRIES).cast("int").alias(name))
    parts = written(many(asked, "parts").join(many(rows, "sides"), ["theme", "span"]), "cells")  # spans without one of both have no answer
    part, side = (F.pmod(F.xxhash64(c), F.col(n)).cast("int") for c, n in (("query_id", "parts"), ("entry_id", "sides")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(parts, ["theme", "span"]).select("theme", "span", part.alias("part"), every("sides").alias("side"), "query_id", "at", "e")
    return asked, rows.join(parts, ["theme", "span"]).select("theme", "span", every("parts").alias("part"), side.alias("side"), "entry_id", "start", "end", "e")


def _energies(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            rows = _matrix(b.column(0).to_pylist(), width)
            total += (rows**2 / np.maximum((rows**2).sum(axis=1), 1e-300)[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["place", "energy"])

    return run


def cached_steps(requests: DataFrame, entries: DataFrame, least: float = 0.92, with_theme: bool = False) -> DataFrame:
    """query_id, entry_id, score (9 digits) and ``compared``: the live entry of the highest cosine, ``least`` or more, for each request that has one; the smaller id of equals.

    Requests have query_id, ts, theme and embedding; entries entry_id, created_at, expires_at, theme and embedding. An entry lives from its
    creation on until it expires; it does not answer itself. With ``with_theme`` both themes must agree. Only entries whose life is near a request in time meet it: a pair is
    compared in full only if a product in single precision (of a high ``least`` over the coordinates of most weight, and a bound on the others) allows the request's best so far; ``compared`` counts those pairs.
    Vectors that are null, zero, with null components, or of another size than the largest are left out. Requests and entries meet in cells of bounded size.
    Both tables are read several times."""
    if least <= 0:
        raise ValueError("the least cosine must be above zero")
    kind = lambda df: "float" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    vector = lambda df: F.col("embedding").cast(f"array<{kind(df)}>").alias("e")
    theme = F.coalesce(F.col("theme").cast("string"), F.lit("")) if with_theme else F.lit("")
    asked = requests.where("query_id is not null and embedding is not null and ts is not null").select(F.col("query_id").cast("long").alias("query_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), theme.alias("theme"), vector(requests))
    rows = entries.where("entry_id is not null and embedding is not null and created_at is not null and expires_at is not null").select(
        F.col("entry_id").cast("long").alias("entry_id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("start"), F.unix_micros(F.col("expires_at").cast("timestamp")).alias("end"), theme.alias("theme"), vector(entries)
    )
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0
    lead = np.arange(width)
    if least >= TELLING:
        energies = rows.select("e").mapInArrow(_energies(width), "place int, energy double").groupBy("place").agg(F.sum("energy").alias("energy")).collect()
        lead = np.array([r["place"] for r in sorted(energies, key=lambda r: (-r["energy"], r["place"]))[: max(1, int(width * LEADING))]], np.int64)
    cell = ["theme", "span", "part", "side"]
    mine, held = _in_cells(asked, rows)
    out = mine.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(_lookup(lead, width, least), "query_id long, entry_id long, score double, compared long")
    best = F.min(F.when(F.col("entry_id").isNotNull(), F.struct((-F.col("score")).alias("less"), F.col("entry_id")))).alias("b")
    told = out.groupBy("query_id").agg(best, F.sum("compared").alias("compared")).where("b is not null")
    return told.select("query_id", "b.entry_id", (-F.col("b.less")).alias("score"), "compared")
