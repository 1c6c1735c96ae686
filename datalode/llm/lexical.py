"""Ranked lexical search for many queries: impact vectors in buckets by length, pruned as inner products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalode.llm.common import LOWER, binary_words, chunks_of, lists, prepare, runs, written

#: Terms of the items that one pass over the documents looks for; a pass sends so many to all tasks and no more.
PASS_TERMS = 200_000
#: Vectors of a bucket.
BUCKET_ROWS = 4096
#: One vector in so many gives every item a score that the others must reach.
FLOOR_SHARE = 16
#: Survivors of a bucket up to which their own terms are read, not the postings of the item.
FEW = 64
#: A maximal run of other characters than ASCII signs and controls.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of terms: digits, ASCII letters and all of other characters.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _counted(vocabulary: pa.Array):
    """Terms of a text in all, and how often it has each term of the vocabulary; texts without terms give no row."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in chunks_of(b.column("text"), 4 << 20):
                inside = IN_TERM[data]
                starts, sizes, rows = runs(inside, offsets)
                n = np.bincount(rows, minlength=end - first)
                place = pc.index_in(binary_words(LOWER[data][inside], sizes), value_set=vocabulary)
                known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                place = place.fill_null(0).to_numpy()[known].astype(np.int64)
                keys, counts = np.unique(rows[known] * size + place, return_counts=True)
                some = np.flatnonzero(n)
                ends = np.searchsorted(keys, (some + 1) * size)
                begins = np.searchsorted(keys, some * size)  # rows without terms have no keys, so these lists are all
                assert not len(some) or begins[0] == 0 and (begins[1:] == ends[:-1]).all()
                columns = [b.column("id").slice(first, end - first).take(pa.array(some)), pa.array(n[some].astype(np.int64)), lists(keys % size, ends, np.int32), lists(counts, ends, np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "counts"])

    return run


#: Rows of the statistics that are no term's number of documents.
_DOCUMENTS, _TERMS = -1, -2


def _totals(size: int):
    """What a partition has: documents, all terms, and documents of each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, terms = np.zeros(size, np.int64), 0, 0
        for b in batches:
            documents += b.num_rows
            terms += pc.sum(b.column("n")).as_py() or 0
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, [_DOCUMENTS, _TERMS]), pa.int64()), pa.array(np.append(df[held], [documents, terms]), pa.int64())], names=["term", "n"]
        )

    return run


def _impacts(weights: np.ndarray, documents: int, terms: int):
    """Each document's vector of what its terms add to a score, without zeros, and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, counts = b.column("terms"), b.column("counts").flatten().to_numpy().astype(np.int64)
            at = which.flatten().to_numpy()
            sizes = np.diff(which.offsets.to_numpy()).astype(np.int64)
            m = 100 - 90 + (90 * b.column("n").to_numpy() * documents) // terms
            impact = weights[at] * ((1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, sizes)))
            row = np.repeat(np.arange(len(sizes)), sizes)[impact > 0]
            at, impact = at[impact > 0], impact[impact > 0]
            length = np.sqrt(np.bincount(row, weights=impact.astype(np.float64) ** 2, minlength=len(sizes)))
            some = np.flatnonzero(np.bincount(row, minlength=len(sizes)))
            ends = np.searchsorted(row, some, side="right")
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(some)), pa.array(length[some]), lists(at, ends, np.int32), lists(impact, ends, np.int64)], names=["id", "length", "terms", "impacts"])

    return run


class Bucket:
    """Vectors of like length, the longest first, by rows and by terms."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, width: int) -> None:
        self.lengths, self.terms, self.impacts = lengths, terms, impacts
        self.ends = np.cumsum(sizes)
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = np.repeat(np.arange(len(sizes)), sizes)[order], impacts[order]
        self.at = np.searchsorted(terms[order], np.arange(width + 1))
        self.most = np.zeros(width, np.int64)
        held = np.flatnonzero(np.diff(self.at))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.values, self.at[held])

    def add(self, term: int, to: np.ndarray, squares: np.ndarray | None = None) -> None:
        a, b = self.at[term], self.at[term + 1]
        to[self.rows[a:b]] += self.values[a:b]
        if squares is not None:
            squares[self.rows[a:b]] += self.values[a:b].astype(np.float64) ** 2

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``asked`` tells of each term whether the item has it."""
        sizes = self.ends[rows] - np.where(rows > 0, self.ends[rows - 1], 0)
        first = np.append(0, np.cumsum(sizes))[:-1]
        places = np.arange(sizes.sum()) + np.repeat(self.ends[rows] - sizes - first, sizes)
        return np.add.reduceat(np.where(asked[self.terms[places]], self.impacts[places], 0), first)

    def search(self, item: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores that reach ``need`` (1 or more); rows that cannot are not all scored.

        Coordinate bounds: the terms of the item that add most in this bucket are its focus, until all others
        together cannot reach ``need``; only rows with a term of the focus may. A row's sum over the focus, and for the others
        the least of their largest impacts and (Cauchy-Schwarz) of what is left of the row's length, bound its score."""
        item = item[self.most[item] > 0]
        item = item[np.argsort(-self.most[item], kind="stable")]
        after = np.append(np.cumsum(self.most[item][::-1])[::-1], 0)  # what all terms from a place on can add
        count = np.arange(len(item), -1, -1)
        slack = 1 + 1e-9
        rest = np.minimum(after.astype(np.float64), np.sqrt(count) * self.lengths[0]) * slack
        focus = int(np.flatnonzero(rest < need)[0])
        if not focus:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        part, squares = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths))
        for t in item[:focus].tolist():
            self.add(t, part, squares)
        if focus == len(item):
            rows = np.flatnonzero(part >= need)
            return rows, part[rows]
        left = np.sqrt(np.maximum(self.lengths**2 * slack - squares, 0) * count[focus])
        rows = np.flatnonzero((part > 0) & (part + np.minimum(left, after[focus]) * slack >= need))
        if len(rows) <= FEW:
            asked = np.zeros(len(self.most), bool)
            asked[item] = True
            scores = self.scores(rows, asked) if len(rows) else np.zeros(0, np.int64)
        else:
            for t in item[focus:].tolist():
                self.add(t, part)
            scores = part[rows]
        high = scores >= need
        return rows[high], scores[high]


def _search(items: list[np.ndarray], floor: np.ndarray, k: int, width: int):
    """Every item's k best among the vectors of a partition, which come longest first."""
    sizes = np.array([len(x) for x in items])
    flat, first = np.concatenate(items), np.append(0, np.cumsum(sizes))[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = floor.copy()
        found: dict[int, list[tuple]] = {}

        def bucket(table: pa.Table) -> None:
            table = table.combine_chunks()
            lengths = table.column("length").to_numpy()
            # Cauchy-Schwarz for the whole bucket, before anything of it is looked at
            near = np.sqrt(sizes) * lengths[0] * (1 + 1e-9) >= need
            if not near.any():
                return
            terms, impacts = table.column("terms").combine_chunks(), table.column("impacts").combine_chunks()
            mine = Bucket(lengths, np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), impacts.flatten().to_numpy(), width)
            near &= np.add.reduceat(mine.most[flat], first) >= need
            ids = table.column("id")
            for q in np.flatnonzero(near).tolist():
                rows, scores = mine.search(items[q], int(need[q]))
                if len(rows) > k:  # rows below the k-th best of this bucket are not among the best
                    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                    rows, scores = rows[scores >= edge], scores[scores >= edge]
                if not len(rows):
                    continue
                got = found.get(q, [])
                got += [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist(), strict=True)]
                found[q] = sorted(got)[:k]
                if len(found[q]) == k:
                    need[q] = max(need[q], -found[q][-1][0])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BUCKET_ROWS:
                bucket(pa.Table.from_batches(held))
                held = []
        if held and sum(x.num_rows for x in held):
            bucket(pa.Table.from_batches(held))
        out = [(q, None if no_id else i, -s) for q, best in found.items() for s, no_id, i in best]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["item", "id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id", share: int = FLOOR_SHARE) -> DataFrame:
    """item, rank, id and score of the k documents that score highest for each item, and above 0.

    Terms are the maximal matches of ``TERM``, A-Z lower-cased. N counts the documents with a term, L all their terms, n those of a
    document, df the documents that hold a term, tf its places in one. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))); with
    m = 10 + (90 n N) div L it adds w ((10^9 tf) div (1000 tf + 8 m)), its impact. All but w is in 64-bit integers.

    A document is the vector of its impacts for the items' terms, an item a vector of ones: scores are inner products. Every
    partition takes its vectors by length, longest first, in buckets; see ``Bucket.search``. A share of all vectors is searched
    first, so that every partition starts from scores that the k-th best reaches. No vector crosses the network.

    Null and empty texts have no terms and do not count. Every row is a document, also one that repeats an id or has none;
    equal scores are in the order of ids, rows without one last. The rows of one item id (null is one) are one item, with the
    terms of all. Long texts count whole. Empty tables give no rows; columns of other names are not used. Items are taken in
    passes of ``PASS_TERMS`` terms; each pass reads the documents once, and its results are written.
    """
    spark = docs.sparkSession
    prepare(spark)
    lower = F.translate(F.col(text), _UPPER, _UPPER.lower())
    asked = items.select(F.col(item).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    asked = written(asked, "item-terms")
    passes = max(1, -(-asked.count() // PASS_TERMS))
    out = None
    for i in range(passes):
        pairs = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i).collect() if passes > 1 else asked.collect()
        if pairs or out is None:
            found = _pass(docs, pairs, k, id, text, asked.schema["item"].dataType, share).withColumnsRenamed({"item": item, "id": id})
            found = written(found, "ranked") if passes > 1 else found
            out = found if out is None else out.unionByName(found)
    return out


def _pass(docs: DataFrame, pairs: list, k: int, id: str, text: str, item_type, share: int) -> DataFrame:
    """The search for the items of one pass, given as rows of item and term."""
    spark = docs.sparkSession
    words = sorted({r["term"].encode() for r in pairs})
    number = {w: i for i, w in enumerate(words)}
    terms: dict = {}
    for r in pairs:
        terms.setdefault(r["item"], []).append(number[r["term"].encode()])
    names, vectors = list(terms), [np.array(sorted(x)) for x in terms.values()]
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    counted = written(rows.mapInArrow(_counted(pa.array(words, pa.binary())), "id long, n long, terms array<int>, counts array<int>"), "counted-terms")
    told = counted.select("n", "terms").mapInArrow(_totals(len(words)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    totals = {r["term"]: r["n"] for r in told.collect()}
    documents, length = totals.get(_DOCUMENTS, 0), totals.get(_TERMS, 0)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * totals.get(t, 0) + 1))) for t in range(len(words))], np.int64)
    hits = "item int, id long, score long"
    if names and documents:
        made = counted.mapInArrow(_impacts(weights, documents, length), "id long, length double, terms array<int>, impacts array<long>")
        floor = np.ones(len(names), np.int64)
        some = counted.where(F.pmod(F.xxhash64("id", "n"), F.lit(share)) == 0).mapInArrow(_impacts(weights, documents, length), made.schema)
        some = some.sortWithinPartitions(F.desc("length")).mapInArrow(_search(vectors, floor, k, len(words)), hits)
        for r in _best(some, k).where(F.col("rank") == k).collect():
            floor[r["item"]] = r["score"]
        found = made.sortWithinPartitions(F.desc("length")).mapInArrow(_search(vectors, floor, k, len(words)), hits)
    else:
        found = spark.createDataFrame([], hits)
    kind = item_type.simpleString()
    known = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, name {kind}")
    ranked = _best(found, k).join(F.broadcast(known), "item")  # a row for each item of the pass
    return ranked.select(F.col("name").alias("item"), "rank", "id", "score")
