"""BM25 for many queries over postings in blocks: a block's largest weights show which queries it cannot answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalode.operators.retrieval import EPSILON, K1, B, words
from datalode.operators.vectors import Best
from datalode.sources.shared import written

#: Chunks of a block; those that come together in a batch are cut by length, so that a block's lengths are alike. The larger, the fewer rows.
BLOCK_CHUNKS = 512
#: Chunks whose words are held at once.
BATCH_CHUNKS = 2048
#: Chunks whose words are counted, or cut into blocks, at once: the more, the fewer rows.
COUNTED_CHUNKS = 8192
#: Queries of one pass over the postings or the chunks.
PASS_QUERIES = 4096
#: Terms whose weights are a matrix, and the queries that must share one.
SHARED, SHARED_BY = 512, 8
#: Chunks that are scored at once where no postings are kept.
CHUNKS_AT_ONCE = 256
#: One block in so many is searched first, for a score that all others must reach.
SAMPLE = 16
#: Rounded scores differ by less than this from those that bounds are made of.
SLACK = 1e-8
ASKED = pa.schema([("query_id", pa.int64()), ("term", pa.string()), ("weight", pa.float64()), ("average", pa.float64())])
POSTINGS = "tenant_id string, block long, term string, n int, ids array<long>, tfs array<int>, lengths array<int>"


#: Bytes with the white space of ``words`` as a space.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[0x09:0x0E] = 0x20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased texts (without nulls), and the place of each word's text."""
    offsets, data = texts.buffers()[1:]
    if data is not None:  # such bytes are no part of other characters
        spaced = pa.py_buffer(SPACED[np.frombuffer(data, np.uint8)])
        texts = type(texts).from_buffers(texts.type, len(texts), [None, offsets, spaced], 0, texts.offset) if pa.types.is_large_string(texts.type) else pa.StringArray.from_buffers(len(texts), offsets, spaced, None, 0, texts.offset)
    lists = pc.split_pattern(texts, " ")
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    filled = pc.not_equal(flat, "")
    return flat.filter(filled), parent.filter(filled).to_numpy().astype(np.int64)


def lowered(text: str) -> Column:
    """Texts as ``split_words`` takes them."""
    return F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for b in (batch.slice(a, COUNTED_CHUNKS) for batch in batches for a in range(0, batch.num_rows, COUNTED_CHUNKS)):
        tenants, owner = np.unique(np.array(b.column("tenant_id").fill_null("").to_pylist(), object), return_inverse=True)
        flat, parent = split_words(b.column("text"))
        coded = flat.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        terms = pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(order))])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        word = rank[coded.indices.to_numpy()]
        by_text = np.searchsorted(parent, np.arange(b.num_rows + 1))
        length, chunk = np.diff(by_text), b.column("chunk_id").to_numpy()
        rows = np.lexsort((np.arange(b.num_rows), length, owner))
        cuts = np.searchsorted(owner[rows], np.arange(len(tenants) + 1))
        for first in (x for c, d in zip(cuts, cuts[1:], strict=False) for x in range(c, d, BLOCK_CHUNKS)):
            some = rows[first : min(first + BLOCK_CHUNKS, cuts[owner[rows[first]] + 1])]
            number += 1
            words = np.concatenate([word[by_text[i] : by_text[i + 1]] for i in some])
            place = np.repeat(np.arange(len(some)), length[some])
            # the empty term has every chunk of the block, for counts and lengths
            key, tf = np.unique(words * len(some) + place, return_counts=True)
            key, tf = np.concatenate([np.arange(len(some)), key]), np.concatenate([np.zeros(len(some), np.int64), tf])
            term, place = np.divmod(key, len(some))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]])
            offsets = pa.array(starts, pa.int32())
            ids, tfs, lengths = (pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((chunk[some][place], pa.int64()), (tf, pa.int32()), (length[some][place], pa.int32())))
            n = len(starts) - 1
            same = [pa.array([tenants[owner[some[0]]]] * n, pa.string()), pa.array(np.full(n, number))]
            yield pa.RecordBatch.from_arrays([*same, terms.take(pa.array(term[starts[:-1]])), pa.array(np.diff(starts), pa.int32()), ids, tfs, lengths], names=["tenant_id", "block", "term", "n", "ids", "tfs", "lengths"])


def block_postings(chunks: DataFrame, id: str = "chunk_id", text: str = "text", tenant: str | None = None) -> DataFrame:
    """A row for each term of a block of chunks of one tenant, with the chunks that hold it. Nothing is shuffled.

    Terms are lower-cased runs without white space. Null texts are empty; chunks without an id are left out."""
    owner = F.col(tenant).cast("string") if tenant else F.lit("")
    # Spark lowers the case, so that it is that of queries
    rows = chunks.where(F.col(id).isNotNull()).select(owner.alias("tenant_id"), F.col(id).cast("long").alias("chunk_id"), lowered(text).alias("text"))
    return rows.mapInArrow(_blocks, POSTINGS)


def term_counts(postings: DataFrame) -> DataFrame:
    """tenant_id, term and df; the empty term's df is the number of chunks."""
    return postings.groupBy("tenant_id", "term").agg(F.sum("n").cast("long").alias("df"))


def chunk_words(postings: DataFrame) -> DataFrame:
    """tenant_id and the words of all its chunks."""
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return postings.where("term = ''").groupBy("tenant_id").agg(F.sum(length).alias("words"))


def frequencies(counts: DataFrame, sizes: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """tenant_id, term, idf and the tenant's average length: ln((n - df + .5) / (df + .5)); negative ones become epsilon times the mean over the tenant's terms."""
    # one row a tenant is broadcast: all terms of a tenant would meet it in one task
    n = counts.where("term = ''").select("tenant_id", F.col("df").alias("n")).join(sizes, "tenant_id")
    raw = counts.where("term <> '' and df > 0").join(F.broadcast(n), "tenant_id")
    raw = raw.select("tenant_id", "term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"), (F.col("words") / F.col("n")).alias("average"))
    mean = raw.groupBy("tenant_id").agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), "tenant_id").select("tenant_id", "term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "average")


class Asked:
    """The queries of a pass: for each query its terms with idf times their number, and the score that a chunk must reach.

    Weights of the terms that most queries share are a matrix, those of all others a list for each term."""

    def __init__(self, rows: pa.Table | list, floors: dict[int, float], distinct: bool) -> None:
        rows = rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows, ASKED)
        self.ids, query = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        coded = rows["term"].combine_chunks().dictionary_encode()
        self.terms, term = coded.dictionary, coded.indices.to_numpy()
        order = np.lexsort((query, term))
        self.query, self.weight = query[order], rows["weight"].to_numpy()[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.floor = np.array([floors.get(q, -np.inf) for q in self.ids.tolist()])
        self.average = rows["average"][0].as_py() if len(rows) else 1.0
        self.distinct = distinct
        times = np.diff(self.first)
        shared = np.argsort(-times, kind="stable")[:SHARED]
        shared = shared[times[shared] >= SHARED_BY]
        self.column = np.full(len(times), -1)
        self.column[shared] = np.arange(len(shared))
        self.matrix = np.zeros((len(self.ids), len(shared)))
        for at, t in enumerate(shared.tolist()):
            own = slice(self.first[t], self.first[t + 1])
            self.matrix[self.query[own], at] = self.weight[own]

    def impacts(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.average))

    def bounds(self, term: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What each query can score at most with the largest impacts of terms."""
        shared = self.column[term] >= 0
        out = np.maximum(self.matrix[:, self.column[term[shared]]], 0) @ most[shared]
        term, most = term[~shared], most[~shared]
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return out + np.bincount(self.query[at], np.maximum(self.weight[at], 0) * np.repeat(most, n), len(out))

    def scores(self, term: np.ndarray, chunk: np.ndarray, impact: np.ndarray, width: int) -> np.ndarray:
        """Sums of all queries (rows) for ``width`` chunks, from the impacts of terms in chunks."""
        shared = self.column[term] >= 0
        part = np.zeros((self.matrix.shape[1], width))
        part[self.column[term[shared]], chunk[shared]] = impact[shared]
        out = self.matrix @ part
        term, chunk, impact = term[~shared], chunk[~shared], impact[~shared]
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return out + np.bincount(self.query[at] * width + np.repeat(chunk, n), self.weight[at] * np.repeat(impact, n), out.size).reshape(out.shape)


def answers(table: pa.Table, asked: Asked, k: int) -> tuple[list[tuple[int, int, float]], int, int]:
    """The k best chunks of a block for each query, and how many queries may have one of how many.

    The largest impact of each term in the block, times the query's weights, bounds the query's score of every chunk. Only queries
    whose bound reaches their floor are answered; a block without such a query is not scored."""
    term = pc.index_in(table.column("term").combine_chunks(), value_set=asked.terms).to_numpy()
    lists = table.column("ids").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    chunks, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    tf = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.float64)
    impact = asked.impacts(tf, table.column("lengths").combine_chunks().flatten().to_numpy())
    # a weight below zero adds nothing to a bound
    most = np.maximum.reduceat(impact, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    bound = asked.bounds(term, most)
    near = np.flatnonzero((bound > 0) & (bound + SLACK >= asked.floor))
    found = Best(len(asked.ids), k, 0.0)
    if len(near):
        found.need = np.maximum(asked.floor, 0.0)
        scores = np.round(asked.scores(np.repeat(term, sizes), place, impact, len(chunks)), 9)[near]
        found.add(near, scores, chunks, (scores > 0) & ((chunks != asked.ids[near][:, None]) if asked.distinct else True))
    found.cut()
    q, c, s = found.parts[0]
    return list(zip(asked.ids[q].tolist(), c.tolist(), s.tolist(), strict=True)), len(near), len(asked.ids)


def _answered(asked: Asked, k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found, _, _ = answers(table, asked, k)
        q, c, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "chunk_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(idf: DataFrame, queries: DataFrame, text: str) -> Iterator[tuple[DataFrame, bool]]:
    """The weights of the queries' terms (query_id, term, weight, average) in passes of PASS_QUERIES, and whether there are others."""
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.explode(words(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = written(asked.join(idf, "term").select("query_id", "term", (F.col("idf") * F.col("times")).alias("weight"), "average"), "asked")
    passes = max(1, -(-asked.select("query_id").distinct().count() // PASS_QUERIES))
    for i in range(passes):
        yield asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i), passes > 1


def _together(found: Iterator[tuple[DataFrame, bool]]) -> DataFrame:
    out = None
    for one, more in found:
        one = written(one, "ranked") if more else one
        out = one if out is None else out.unionByName(one)
    return out


FOUND = "query_id long, chunk_id long, score double"


def search(postings: DataFrame, idf: DataFrame, queries: DataFrame, k: int, distinct: bool = False, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """query_id, chunk_id, score (9 digits) and rank of the k best chunks above zero of each query, ties to smaller ids; with ``distinct``
    never the query's own id. ``postings`` and ``idf`` are those of one tenant.

    Query terms count as often as they occur. Queries go to all tasks in passes of PASS_QUERIES; only the postings of their terms are
    shuffled, by block. A sample of blocks is searched first: its k-th best score of a query is one that the others must reach."""

    def one(mine: DataFrame) -> DataFrame:
        rows = mine.toArrow()
        wanted = postings.join(mine.select("term").distinct(), "term", "left_semi").select("block", "term", "ids", "tfs", "lengths")
        few = wanted.where(F.pmod(F.xxhash64("block"), F.lit(sample)) == 0)
        first = _best(few.groupBy("block").applyInArrow(_answered(Asked(rows, {}, distinct), k), FOUND), k).where(F.col("rank") == k)
        floors = {r["query_id"]: r["score"] for r in first.collect()}
        return _best(wanted.groupBy("block").applyInArrow(_answered(Asked(rows, floors, distinct), k), FOUND), k)

    return _together((one(mine), more) for mine, more in _passes(idf, queries, text))


def _best_of_chunks(asked: Asked, k: int):
    """The k best chunks of a partition for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked.ids), k, 0.0)
        everyone = np.arange(len(asked.ids))
        # the terms of queries are hashed for each look-up, so many chunks are looked up at once
        for b in (batch.slice(a, BATCH_CHUNKS) for batch in batches for a in range(0, batch.num_rows, BATCH_CHUNKS)):
            flat, parent = split_words(b.column("text"))
            length, chunk = np.bincount(parent, minlength=b.num_rows), b.column("chunk_id").to_numpy()
            term = pc.index_in(flat, value_set=asked.terms)
            parent, term = parent[term.is_valid().to_numpy(zero_copy_only=False)], term.drop_null().to_numpy().astype(np.int64)
            key, tf = np.unique(parent * len(asked.terms) + term, return_counts=True)
            place, term = np.divmod(key, max(len(asked.terms), 1))
            impact = asked.impacts(tf, length[place])
            for first in range(0, b.num_rows, CHUNKS_AT_ONCE):
                own = slice(*np.searchsorted(place, [first, first + CHUNKS_AT_ONCE]))
                some = chunk[first : first + CHUNKS_AT_ONCE]
                scores = np.round(asked.scores(term[own], place[own] - first, impact[own], len(some)), 9)
                best.add(everyone, scores, some, (scores > 0) & ((some != asked.ids[:, None]) if asked.distinct else True))
        best.cut()
        q, c, s = best.parts[0]
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "chunk_id", "score"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch its terms, with the chunks that hold them; the empty term has all chunks and their words."""
    for b in (batch.slice(a, COUNTED_CHUNKS) for batch in batches for a in range(0, batch.num_rows, COUNTED_CHUNKS)):
        flat, parent = split_words(b.column("text"))
        coded = flat.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        held = np.sort(parent * width + coded.indices.to_numpy())  # np.unique would hash, which takes far longer
        held = held[np.append(held[1:] != held[:-1], True)[: len(held)]] % width
        terms = pa.concat_arrays([pa.array([""], coded.dictionary.type), coded.dictionary])
        df = np.append(b.num_rows, np.bincount(held, minlength=len(coded.dictionary)))
        total = np.append(len(flat), np.zeros(len(coded.dictionary), np.int64))
        yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "words"])


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int, distinct: bool = False, id: str = "chunk_id", text: str = "text", query_text: str = "text") -> DataFrame:
    """The k best chunks of each query, as ``search``, over chunks that are asked once: their texts are written once and no postings are kept.

    Every partition gives one answer for each pass of queries, its k best chunks of each query."""
    rows = chunks.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("chunk_id"), lowered(text).alias("text"))
    # by id: files of few large row groups would leave most cores without work
    rows = written(rows.repartition(4 * chunks.sparkSession.sparkContext.defaultParallelism, "chunk_id"), "words")
    counts = rows.select("text").mapInArrow(_counted, "term string, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    counts = written(counts.withColumn("tenant_id", F.lit("")), "term-counts")
    idf = frequencies(counts.drop("words"), counts.where("term = ''").select("tenant_id", "words"))
    return _together((_best(rows.mapInArrow(_best_of_chunks(Asked(mine.toArrow(), {}, distinct), k), FOUND), k), more) for mine, more in _passes(idf, queries, query_text))
