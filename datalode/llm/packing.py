"""Packing of token sequences: bounded-space online best fit.

Every input partition is one lane. A lane keeps a fixed number of open sequences in a bitset keyed by
their free space; a piece goes to the open sequence with the least free space that still holds it. If
none does and all are in use, the fullest is closed. Nothing is sorted, shuffled or held back.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from datalode.llm.common import prepare
from datalode.llm.tokens import _ODD, SIGNS, plain_word, symbols, vocabulary_path

#: Words that a worker remembers.
CACHE_ENTRIES = 400_000


class OpenBins:
    """Open sequences by free space. ``place`` gives the sequence's number and the place in it."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, p: str) -> bytes:
        """Ids of a piece given by its symbols."""
        out = self.pieces.get(p)
        if out is None:
            out = np.array([t.id for t in self.model.tokenize(p)], "<u4").tobytes()
            if len(self.pieces) < CACHE_ENTRIES:
                self.pieces[p] = out
        return out

    def _word(self, w: str) -> bytes:
        base = w.rstrip(SIGNS)
        if plain_word(base):
            out = self._piece(symbols(base.lower()))
            if len(base) < len(w):
                out += self._piece(w[len(base) :])
        else:
            out = self._ids(w)
        if len(self.words) < CACHE_ENTRIES:
            self.words[w] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text. No token spans white space, so they are those of its runs."""
        if _ODD & set(text):
            return self._ids(text)
        runs = text.split()
        known = list(map(self.words.get, runs))
        if None in known:
            known = [self._word(w) if n is None else n for w, n in zip(runs, known, strict=True)]
        return b"".join(known)


_ENCODERS: dict[str, Encoder] = {}


def best_fit_pack(
    docs: DataFrame, text: str = "text", path: str | None = None, length: int = 4096, end_id: int = 1, open_bins: int = 256
) -> DataFrame:
    """Token sequences of at most ``length`` ids that hold all texts, each followed by ``end_id``.

    One row per piece with the row's own columns and ``piece``, ``start`` (ids of the text before it),
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``sequence_id`` (the partition's number
    times 2^33 plus the lane's own number) and ``offset`` (place in the sequence, without gaps). Only
    texts longer than a sequence are cut. A null or empty text is the end id alone. Repeated rows are
    packed as often as they occur; texts of any length are encoded whole; an empty table gives no rows. Columns of these
    names are replaced.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary_path()
    added = [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
    docs = docs.drop(*(f.name for f in added if f.name != text))
    schema = T.StructType([*docs.schema.fields, *added])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encode = _ENCODERS[path].encode
        lane = TaskContext.get().partitionId() << 33
        bins = OpenBins(length, open_bins)
        for b in batches:
            rows, piece, start, size, ids, sequence, offset = [], [], [], [], [], [], []
            for row, t in enumerate(b.column(b.schema.names.index(text)).to_pylist()):
                own = encode(t or "") + end
                for k, at in enumerate(range(0, len(own), 4 * length)):
                    part = own[at : at + 4 * length]
                    number, place = bins.place(len(part) // 4)
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    ids.append(part)
                    sequence.append(lane + number)
                    offset.append(place)
            kept = pa.Table.from_batches([b]).take(pa.array(rows, pa.int64())).combine_chunks()
            columns = [kept.column(i).combine_chunks() if kept.num_rows else pa.array([], b.schema.field(i).type) for i in range(b.num_columns)]
            new = [
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(size, pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array(sequence, pa.int64()),
                pa.array(offset, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=[*b.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, schema)
