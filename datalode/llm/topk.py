"""Exact top-k inner products: vectors in buckets of like length, pruned by local cosine thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalode.llm.common import prepare, written

#: Queries of one pass over all vectors; a pass broadcasts so many vectors and no more.
QUERY_BLOCK = 8192
#: Queries of a pass that meet a bucket at once.
QUERY_ROWS = 1024
#: Candidates of a bucket that are held as one matrix.
BUCKET_ROWS = 2048
#: A query's focus is its largest coordinates, until the share of its length outside is under this part of the local threshold.
FOCUS = 0.6
#: Share of the coordinates beyond which a focus is not worth it.
MOST = 0.75
#: Largest sum of products that doubles hold exactly.
EXACT = float(1 << 53)


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end with zeros. Doubles hold whole numbers up to 2^53."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as Python integers where doubles could lose digits."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)))
    if np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < EXACT:
        return queries @ rows.T
    whole = np.vectorize(int, otypes=[object])
    return np.array([[sum(a * b for a, b in zip(q, r, strict=True)) for r in whole(rows)] for q in whole(queries)], dtype=object).reshape(len(queries), len(rows))


class Queries:
    """Queries with their coordinates from the largest on, and the share of each one's length that those leave out."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.sizes = np.linalg.norm(rows, axis=1)
        order = np.argsort(-np.abs(rows), axis=1, kind="stable")
        self.rank = np.argsort(order, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(rows, order, 1) ** 2, axis=1) / np.maximum(self.sizes, 1e-300)[:, None] ** 2
        self.rest = np.sqrt(np.maximum(1 - held, 0))

    def survivors(self, some: np.ndarray, matrix: np.ndarray, lengths: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which rows of a bucket (longest first) may reach the product ``need`` with each of ``some`` queries.

        The local threshold is the cosine that the bucket's longest vector would need. Where a few coordinates
        of a query hold so much of its length that the others cannot reach the threshold alone, its
        partial product with a row, and at most both rests' lengths for the others, bound the product (coordinate
        pruning). A low threshold leaves only the length to prune by. Both bounds leave room for rounding.
        """
        sizes = self.sizes[some]
        need = need - (np.abs(need) + sizes * lengths[0]) * 1e-9
        local = need / np.maximum(sizes * lengths[0], 1e-300)
        keep = sizes[:, None] * lengths[None, :] >= need[:, None]
        focus = (self.rest[some] > FOCUS * local[:, None]).sum(axis=1) + 1
        near = np.flatnonzero((local > 0) & (local <= 1) & (focus <= MOST * matrix.shape[1]))
        if len(near):
            inside = self.rank[some[near]] < focus[near][:, None]
            part = np.where(inside, self.rows[some[near]], 0.0) @ matrix.T
            left = np.sqrt(np.maximum(lengths[None, :] ** 2 - inside.astype(np.float64) @ (matrix**2).T, 0))
            outside = self.rest[some[near], focus[near] - 1] * sizes[near]
            keep[near] &= part + outside[:, None] * left >= need[near][:, None]
        return keep


def _paired(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The product of each query with the row beside it, in steps that stay small."""
    out = [_row_products(queries[a : a + 100_000], rows[a : a + 100_000]) for a in range(0, len(queries), 100_000)]
    return np.concatenate(out) if out else np.zeros(0)


def _row_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1] < EXACT:
        return np.einsum("ij,ij->i", queries, rows)
    return np.array([sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for q, r in zip(queries, rows, strict=True)], dtype=object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(ids) > 8 * k and scores.dtype != object:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        ids, scores = ids[some], scores[some]
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[order], scores[order]


def _search(query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, width: int):
    """Every query's k best among the rows of a partition, bucket by bucket."""

    asked = Queries(queries)

    def bucket(rows: list[tuple[int, float, list]], found: dict[int, tuple[np.ndarray, np.ndarray]], need: np.ndarray) -> None:
        ids = np.array([r[0] for r in rows], np.int64)
        lengths = np.array([r[1] for r in rows])
        matrix = _matrix([r[2] for r in rows], width)
        order = np.argsort(-lengths, kind="stable")
        ids, lengths, matrix = ids[order], lengths[order], matrix[order]
        for first in range(0, len(queries), QUERY_ROWS):
            some = np.arange(first, min(first + QUERY_ROWS, len(queries)))
            keep = asked.survivors(some, matrix, lengths, need[some]) & (query_ids[some][:, None] != ids[None, :])
            # queries that keep a large part of the bucket are multiplied together
            full = 4 * keep.sum(axis=1) > len(ids)
            pairs = []
            if full.any():
                products = _products(queries[some[full]], matrix)
                q, r = np.nonzero(keep[full] & (products >= need[some[full]][:, None]).astype(bool))
                pairs.append((some[full][q], r, products[q, r]))
            q, r = np.nonzero(keep & ~full[:, None])
            scores = _paired(queries[some[q]], matrix[r])
            high = (scores >= need[some[q]]).astype(bool)
            pairs.append((some[q][high], r[high], scores[high]))
            for q, r, scores in pairs:
                cuts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(q)], strict=False):
                    mine, got, at = ids[r[a:b]], scores[a:b], int(q[a])
                    if at in found:
                        mine, got = np.append(found[at][0], mine), np.append(found[at][1], got)
                    found[at] = _best(mine, got, k)
                    if len(found[at][0]) == k:
                        need[at] = max(need[at], float(found[at][1][-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        need = floor.copy()
        held: list = []
        for b in batches:
            held += list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            while len(held) >= BUCKET_ROWS:
                bucket(held[:BUCKET_ROWS], found, need)
                held = held[BUCKET_ROWS:]
        if held:
            bucket(held, found, need)
        out = [(int(query_ids[q]), int(i), int(s)) for q, (ids, scores) in found.items() for i, s in zip(ids, scores, strict=True)]
        a, c, d = zip(*out, strict=True) if out else ((), (), ())
        least, most = -(1 << 63), (1 << 63) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array([min(max(x, least), most) for x in d], pa.int64())], names=["query_id", "vec_id", "score"]
        )

    return run


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of each query.

    Components x count as floor(scale * x), x as double. Queries are the rows whose id is divisible by
    ``every``; candidates all rows but the query's own id. Rows with a null id, a null vector or null or
    non-finite components take no part. Vectors of unlike length are compared over the shared components.
    Equal scores are in the order of ids. Rows that repeat an id are candidates each; where they are a query, the
    smallest vector of the id is asked, once, and none of the id's rows is found. Scores beyond 64 bits are held at the nearest long.
    An empty table gives no rows; columns of other names are not used.
    Candidates lie in partitions by length, longest first; the first pass over the longest gives every
    query a score that later buckets must reach. Queries are taken in blocks of a fixed size; a block's results are
    written before the next one is taken.
    """
    spark = vectors.sparkSession
    prepare(spark)
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.col(id).isNotNull() & F.col(vector).isNotNull() & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(double, lambda x: F.floor(x * scale).cast("double"))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id).cast("long").alias("id"), whole.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = written(rows.select("id", length.alias("length"), "v"), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a salt spreads vectors of one length over partitions
    dealt = rows.withColumn("salt", F.xxhash64("id")).repartitionByRange(parts, F.desc("length"), "salt").sortWithinPartitions(F.desc("length"), "salt").select("id", "length", "v")
    longest = rows.orderBy(F.desc("length"), "id").limit(BUCKET_ROWS).collect()
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "v").collect()
        query_ids = np.array([r["id"] for r in mine], np.int64)
        queries = _matrix([r["v"] for r in mine], width)
        floor = np.full(len(mine), -np.inf)
        first = _products(queries, _matrix([r["v"] for r in longest], width))
        own = np.array([r["id"] for r in longest], np.int64)
        for q in range(len(mine)):
            scores = sorted((float(s) for s in first[q][own != query_ids[q]]), reverse=True)
            if len(scores) >= k:
                floor[q] = scores[k - 1]
        found = dealt.mapInArrow(_search(query_ids, queries, floor, k, width), "query_id long, vec_id long, score long")
        found = written(found, "hits") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
