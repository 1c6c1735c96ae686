"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Every text is hashed into word shingles. Windows that share no shingle with any item have similarity 0
and are passed over; all other windows of every item's size get a 64-bit SimHash. The fingerprint is cut
into ``radius + 1`` blocks: two that differ in at most ``radius`` bits agree in some block, so looking up
each block finds all items within the radius. Those are compared by weighted shingles (sum of smaller
counts over sum of larger counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalode.llm.common import chunks_of, prepare, run_hashes, word_hashes

#: Items that are sent to all tasks at once; more are taken in several passes.
ITEMS = 5000
#: Windows whose fingerprints are made at once.
WINDOWS = 4096
_BITS = np.arange(64, dtype=np.uint64)


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every ``size`` shingles in a row."""
    signs = ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles."""
    keys, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(place[: len(a)], minlength=len(keys))
    y = np.bincount(place[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Items of one number of shingles: fingerprints, their blocks and shingles."""

    def __init__(self, numbers: list[int], shingles: list[np.ndarray], radius: int) -> None:
        self.numbers, self.shingles, self.radius = numbers, shingles, radius
        self.size = len(shingles[0])
        self.prints = np.array([fingerprints(s, self.size)[0] for s in shingles], np.uint64)
        edges = np.linspace(0, 64, radius + 2).astype(int).tolist()
        self.blocks = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            shift, mask = np.uint64(a), np.uint64((1 << (b - a)) - 1)
            holds = np.zeros((1 << (b - a), len(numbers)), bool)
            holds[(self.prints >> shift) & mask, np.arange(len(numbers))] = True
            self.blocks.append((shift, mask, holds))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius, and their distances."""
        found = np.zeros((len(prints), len(self.numbers)), bool)
        for shift, mask, holds in self.blocks:
            found |= holds[(prints >> shift) & mask]
        w, i = np.nonzero(found)
        distance = np.bitwise_count(prints[w] ^ self.prints[i])
        ok = distance <= self.radius
        return w[ok], i[ok], distance[ok]


class Benchmark:
    """All items of a pass, by shingle length and number of shingles."""

    def __init__(self, texts: list[str | None], words: int, radius: int, threshold: float) -> None:
        self.threshold, self.words = threshold, words
        self.indexes: dict[int, list[Index]] = {}
        self.known: dict[int, np.ndarray] = {}
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for number, text in enumerate(texts):
            for _, _, data, offsets in chunks_of(pa.array([text or ""])):
                _, rows, h = word_hashes(data, offsets)
                if len(h):
                    k = min(words, len(h))
                    groups.setdefault((k, len(h) - k + 1), []).append((number, run_hashes(h, rows, k)[0]))
        for (k, _), held in groups.items():
            self.indexes.setdefault(k, []).append(Index([n for n, _ in held], [s for _, s in held], radius))
            self.known[k] = np.unique(np.concatenate([self.known.get(k, np.zeros(0, np.uint64)), *(s for _, s in held)]))
        self.maps = {}
        for k, known in self.known.items():
            self.maps[k] = np.zeros(1 << 20, bool)
            self.maps[k][(known >> np.uint64(44)).astype(np.int64)] = True

    def _text(self, k: int, hashes: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
        """Matches of a text: item, similarity, distance, first word, words."""
        for index in self.indexes[k]:
            size = min(index.size, len(hashes))
            first = np.maximum(hits - size + 1, 0)
            last = np.minimum(hits, len(hashes) - size)
            edges = np.zeros(len(hashes) - size + 2, np.int64)
            np.add.at(edges, first, 1)
            np.add.at(edges, last + 1, -1)
            starts = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for a in range(0, len(part), WINDOWS):
                    some = part[a : a + WINDOWS]
                    prints = fingerprints(hashes[some[0] : some[-1] + size], size)
                    for w, i, d in zip(*(x.tolist() for x in index.near(prints)), strict=True):
                        at = int(some[w])
                        s = similarity(hashes[at : at + size], index.shingles[i])
                        if s >= self.threshold:
                            yield index.numbers[i], s, d, at, size + k - 1

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[dict[int, tuple]]:
        """For each text of a chunk the best match of each item in it."""
        out: list[dict[int, tuple]] = [{} for _ in range(len(offsets) - 1)]
        _, rows, words = word_hashes(data, offsets)
        for k, known in self.known.items():
            h, r, _ = run_hashes(words, rows, k)
            maybe = np.flatnonzero(self.maps[k][(h >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            hits = maybe[known[place] == h[maybe]]
            for row in np.unique(r[hits]).tolist():
                a, b = np.searchsorted(r, [row, row + 1])
                own = hits[(hits >= a) & (hits < b)] - a
                for item, s, d, at, n in self._text(k, h[a:b], own):
                    if item not in out[row] or (-s, at) < (-out[row][item][0], out[row][item][2]):
                        out[row][item] = (s, d, at, n)
        return out


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    radius: int = 20,
) -> DataFrame:
    """Adds ``matches`` to every row: an array of (item, similarity, distance, start_word, n_words).

    Each item in a text is listed once, with its most similar window (the first of equals). Windows have
    the item's number of words; a shorter text is one window. Items of fewer words than a shingle are one
    shingle of their own length. Items without words match nothing; a null or empty text has no match.
    A-Z count as a-z, words are split at ASCII white space. With radius 20 a pair of similarity 0.8 is
    lost with a probability of about 2 in 10,000 (its fingerprints differ in 10 bits, give or take 3).
    Repeated rows have the same matches, items that repeat a text are each listed; long texts are searched whole; an empty
    table of documents gives no rows, one of items no matches.
    Items go to all tasks in passes of ``ITEMS``. A column named ``matches`` is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("matches")
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    kind = items.schema["item"].dataType
    match = T.StructType(
        [
            T.StructField("item", kind),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
        ]
    )
    passes = max(1, -(-items.count() // ITEMS))
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", T.ArrayType(match))])
    empty = F.array().cast(T.ArrayType(match))
    out = docs.withColumn("matches", empty)
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).collect()
        names, held = [r["item"] for r in rows], [r["text"] for r in rows]
        out = out.mapInArrow(_marker(names, held, text, words, radius, threshold), schema)
    return out


def _marker(names: list, held: list[str], text: str, words: int, radius: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Benchmark(held, words, radius, threshold)
        for b in batches:
            found = []
            for _, _, data, offsets in chunks_of(b.column(b.schema.names.index(text))):
                found += known.matches(data, offsets)
            last = b.column(b.num_columns - 1)
            new = []
            for before, own in zip(last.to_pylist(), found, strict=True):
                added = [{"item": names[i], "similarity": s, "distance": d, "start_word": at, "n_words": n} for i, (s, d, at, n) in own.items()]
                new.append((before or []) + sorted(added, key=lambda m: (m["start_word"], str(m["item"]))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, last.type)], names=b.schema.names)

    return run
