"""Scores of texts under a smoothed word bigram model of a corpus.

Fitting: chunks of texts send sorted lists of their words and word pairs with counts to ranges of the hash
space; lists are merged level by level. Of each final range a trie is made: words with exact counts, and
contexts with monotone pointers to their successors, all in Elias-Fano sequences, with one byte of
smoothed probability for each successor and one byte of weight for each context. Tries are written as a
table in the shared folder.

Scoring: blocks of texts send their words and pairs to the ranges; each range's trie, read in place, is
searched for a context and then among its successors only, and answers every list.

Probability of word b after a: n(a, b) / (n(a) + f) + f / (n(a) + f) * p(b), with f = ``backoff`` times the
different words after a; p(b) alone if a is new. The first share and the weight f / (n(a) + f) are the two
bytes. p(b) = (n(b) + 1) / (n + words + 1), all unseen words being one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalode.llm import blocks as B
from datalode.llm.blocks import Exchange, block, blocks_of, planes, unpacked, values_of
from datalode.llm.common import chunks_of, prepare, word_hashes, written
from datalode.llm.elias_fano import Trie

#: Bits of a word's hash that a successor is known by; the others of 64 tell its context.
WORD_BITS = 28
#: A byte of probability stands for powers of ten down to this one, evenly.
DECADES = 10

_END, _BEGIN = np.uint64(0x5D588B656C078965), np.uint64(0x27BB2EE687B0B0FD)
_LOW = np.uint64(WORD_BITS)


def _tokens(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, with an end after each text."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, end, data, offsets in chunks_of(array):
        _, r, h = word_hashes(data, offsets)
        at = np.searchsorted(r, np.arange(1, end - first + 1))
        hashes.append(np.insert(h, at, _END))
        rows.append(np.insert(r, at, np.arange(end - first)) + first)
    return np.concatenate(hashes), np.concatenate(rows)


def _before(h: np.ndarray, rows: np.ndarray, first: object, values: np.ndarray | None = None) -> np.ndarray:
    """Of each token the one before it in its text (or its value), ``first`` for the first one."""
    values = h if values is None else values
    return np.where(np.append(True, rows[1:] != rows[:-1]), first, np.append(values[:1], values[:-1])) if len(h) else values


def pair_keys(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Key of each word after the word before it: the context's highest bits, then the word's."""
    return (_before(h, rows, _BEGIN) >> _LOW << _LOW) | (h >> np.uint64(64 - WORD_BITS))


def code(share: np.ndarray) -> np.ndarray:
    """A probability as a byte: 255 is one, each step below it the same factor; never 0."""
    return np.clip(np.rint(255 + np.log10(share) * (254 / DECADES)), 1, 255).astype(np.uint8)


def decode(codes: np.ndarray) -> np.ndarray:
    """Probabilities of the bytes, 0 for the byte 0."""
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 255) * (DECADES / 254)), 0.0)


def _exchange(levels: int, counts: bool) -> Exchange:
    return Exchange(("words", "pairs"), (64, 64), levels, counts)


# -- fitting -------------------------------------------------------------------------------------


def _counted(exchange: Exchange, sources: int, size: int):
    """Words and pairs of chunks of about ``size`` bytes with their counts."""

    def lists(held: list[pa.Array]) -> pa.Table:
        h, r = _tokens(pa.chunked_array(held, pa.string()))
        own = {"words": np.unique(h, return_counts=True), "pairs": np.unique(pair_keys(h, r), return_counts=True)}
        # which sources are merged together does not matter; the same list always has the same number
        return exchange.rows(zlib.crc32(own["pairs"][0].tobytes()) % sources, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0
        for b in batches:
            held.append(b.column(0).cast(pa.string()))
            bytes_held += b.column(0).nbytes
            if bytes_held >= size:
                yield from lists(held).to_batches()
                held, bytes_held = [], 0
        if held:
            yield from lists(held).to_batches()

    return run


def _levels(exchange: Exchange, backoff: float):
    """The trie of a range, and its training words: all and different ones."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, n, _, _ = exchange.joined(table, "words")
        pairs, both, _, _ = exchange.joined(table, "pairs")
        _, context, after = np.unique(pairs >> _LOW, return_inverse=True, return_counts=True)
        f = backoff * after
        total = np.bincount(context, weights=both, minlength=len(after)) + f
        trie = Trie.encoded(words, n, pairs, code(both / total[context]), code(f / total), WORD_BITS)
        return pa.table({"part": [key[0].as_py()], "trie": pa.array([trie], pa.binary()), "tokens": [int(n.sum())], "types": [len(words)]})

    return run


@dataclass(frozen=True)
class Model:
    """Tries by range (``part``, ``trie``), levels of ranges, and all and different training words."""

    table: DataFrame
    levels: int
    tokens: int
    types: int


def fit_bigrams(docs: DataFrame, text: str = "text", backoff: float = 2.0) -> Model:
    """A model of all texts, written to the shared folder. Null texts are empty: an end alone."""
    prepare(docs.sparkSession)
    docs = docs.select(F.coalesce(text, F.lit("")).alias("text"))
    sources = blocks_of(docs, "text")
    exchange = _exchange(Exchange.levels_of(sources), True)
    rows = exchange.gathered(docs.mapInArrow(_counted(exchange, sources, B.BLOCK_BYTES), exchange.schema))[-1]
    table = written(rows.groupBy("part").applyInArrow(_levels(exchange, backoff), "part long, trie binary, tokens long, types long"), "tries")
    sums = table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types"))).first()
    return Model(table, exchange.levels, *sums)


# -- scoring -------------------------------------------------------------------------------------


def _ask(exchange: Exchange):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, r = _tokens(table.column("text"))
        return exchange.rows(key[0].as_py(), {"words": (np.unique(h), None), "pairs": (np.unique(pair_keys(h, r)), None)})

    return run


def _look_up(table: pa.Table, model: pa.Table) -> pa.Table:
    """Counts of words, and of pairs the probability's byte and, above it, the context's."""
    trie = Trie(model.column("trie")[0].as_py()) if model.num_rows else None
    words, pairs = [], []
    for w, p in zip(table.column("words").to_pylist(), table.column("pairs").to_pylist(), strict=True):
        w, p = unpacked(w), unpacked(p)
        words.append(planes(trie.counts(w) if trie else np.zeros(len(w), np.uint64)))
        low, high = trie.look_up(p) if trie else (np.zeros(len(p), np.uint8),) * 2
        pairs.append(planes(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(8)))
    values = {"words_values": pa.array(words, pa.binary()), "pairs_values": pa.array(pairs, pa.binary())}
    return pa.table({"part": table.column("part"), "source": table.column("source"), **values})


def _score(total: int, types: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("part")
        h, r = _tokens(docs.column("text"))
        own = values_of(told, "words")[np.unique(h, return_inverse=True)[1]].astype(np.float64)
        both = values_of(told, "pairs")[np.unique(pair_keys(h, r), return_inverse=True)[1]]
        single = (own + 1) / (total + types + 1)
        share, weight = decode(both & np.uint64(255)), decode(both >> np.uint64(8))
        p = np.where(weight > 0, np.minimum(share + weight * single, 1.0), single)
        n = docs.num_rows
        sums = lambda x: pa.array(np.bincount(r, weights=x, minlength=n))
        counts = {"n_tokens": pa.array(np.bincount(r, minlength=n).astype(np.int64)), "n_known": pa.array(np.bincount(r, weights=own > 0, minlength=n).astype(np.int64))}
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"), **counts, "base_score": sums(np.log10(single)), "score": sums(np.log10(p))})

    return run


def language_scores(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", backoff: float = 2.0, model: Model | None = None) -> DataFrame:
    """Log probabilities (base 10) of each text: ``base_score`` (add-one unigrams) and ``score`` (bigrams).

    The model learns from rows where ``held_out`` is not true, unless one is given, and scores all. Words are
    split at ASCII white space, A-Z count as a-z, every text ends with one more token. Returns the id, held_out,
    n_tokens, n_known (tokens that training has), train_tokens, base_score and score. A null or empty
    text is its end alone. Repeated rows count and are scored each; texts of any length are taken whole; other
    columns are not used, whatever their names. Without training texts every count is zero and so are both
    scores; an empty table gives no rows. Scores do not depend on how the input is split.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(text, F.lit("")).alias("text"))
    model = model or fit_bigrams(docs.where(~F.col("held_out")), "text", backoff)
    docs = docs.withColumn("block", block(blocks_of(docs, "text"), "id", "text"))
    exchange = _exchange(model.levels, False)
    sent = docs.groupBy("block").applyInArrow(_ask(exchange), exchange.schema)
    tries = model.table.select("part", "trie").groupBy("part")
    told = exchange.told(sent, lambda rows: rows.groupBy("part").cogroup(tries).applyInArrow(_look_up, exchange.answers)).withColumnRenamed("source", "block")
    kind = docs.schema["id"].dataType.simpleString()
    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(model.tokens, model.types), out)
    return scored.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
