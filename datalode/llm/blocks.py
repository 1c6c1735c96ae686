"""Corpus statistics without a row per word: documents in blocks, keys in ranges, lists merged level by level.

A block is a set of documents of a fixed size; it sends each range of the keys one packed, sorted list of
its keys. Blocks times ranges would grow with the square of the input, so every level splits a range in
``1 << SPLIT_BITS`` parts and merges the lists of as many sources: the number of lists grows with the
number of blocks, what a task holds does not, and a key that occurs everywhere is merged on the way.
Answers to the lists go back the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalode.llm.common import total_bytes

#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
#: Bits of a key that one level splits by; as many sources are merged at once.
SPLIT_BITS = 6


def blocks_of(docs: DataFrame, text: str, size: int | None = None) -> int:
    """How many blocks a table makes."""
    return max(1, -(-total_bytes(docs, text) // (size or BLOCK_BYTES)))


def block(count: int, *columns: str) -> Column:
    """The block of a row; the same content always falls into the same one."""
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, lowest first, no more than the largest needs."""
    values = np.ascontiguousarray(values.astype("<u8"))
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    width = data[0]
    parts = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :width] = parts.T
    return out.view("<u8").ravel().astype(np.uint64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted different keys: the first, and planes of the differences."""
    return keys[:1].astype("<u8").tobytes() + planes(np.diff(keys))


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < 9:  # no first key
        return np.zeros(0, np.uint64)
    first = np.frombuffer(data, "<u8", 1).astype(np.uint64)
    return np.cumsum(np.append(first, unplanes(data[8:])), dtype=np.uint64)


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of all lists, each entry's place among them, and where the lists end."""
    ends = np.cumsum([len(x) for x in lists])[:-1]
    keys, place = np.unique(np.concatenate(lists), return_inverse=True)
    return keys, place, ends


@dataclass(frozen=True)
class Exchange:
    """Lists of keys by ``names``, of so many ``bits`` each, with counts or without, over ``levels`` of ranges.

    Rows of lists have ``part`` (the range), ``source`` (who sent them) and a column for each name, with
    ``<name>_counts``; rows of answers have ``<name>_values`` instead, a number for each key."""

    names: tuple[str, ...]
    bits: tuple[int, ...]
    levels: int
    counts: bool
    split: int = field(default_factory=lambda: SPLIT_BITS)

    @staticmethod
    def levels_of(blocks: int, split: int | None = None) -> int:
        """Levels after which a range has no more sources than one task merges."""
        out, most = 1, 1 << (split or SPLIT_BITS)
        while blocks > most:
            blocks = -(-blocks // most)
            out += 1
        return out

    @property
    def schema(self) -> str:
        lists = [f"{n} binary" + f", {n}_counts binary" * self.counts for n in self.names]
        return ", ".join(["part long", "source int", *lists])

    @property
    def answers(self) -> str:
        return ", ".join(["part long", "source int", *(f"{n}_values binary" for n in self.names)])

    def rows(self, source: int, lists: dict[str, tuple[np.ndarray, np.ndarray | None]], level: int = 1) -> pa.Table:
        """Rows of a source's sorted keys and counts for the ranges of a level."""
        ids = {n: lists[n][0] >> np.uint64(b - self.split * level) for n, b in zip(self.names, self.bits, strict=True)}
        parts = np.unique(np.concatenate(list(ids.values())))
        out = {"part": pa.array(parts.astype(np.int64)), "source": pa.array(np.full(len(parts), source), pa.int32())}
        for n in self.names:
            keys, counts = lists[n]
            cuts = list(zip(np.searchsorted(ids[n], parts).tolist(), np.searchsorted(ids[n], parts, side="right").tolist(), strict=True))
            out[n] = pa.array([packed(keys[a:b]) for a, b in cuts], pa.binary())
            if self.counts:
                out[f"{n}_counts"] = pa.array([planes(counts[a:b]) for a, b in cuts], pa.binary())
        return pa.table(out)

    def joined(self, table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """Keys of all rows of a range, their summed counts, each entry's place among the keys, and where the rows end."""
        keys, place, ends = merged([unpacked(x) for x in table.column(name).to_pylist()])
        if not self.counts:
            return keys, None, place, ends
        counts = np.concatenate([unplanes(x) for x in table.column(f"{name}_counts").to_pylist()])
        return keys, np.bincount(place, weights=counts, minlength=len(keys)).astype(np.uint64), place, ends

    def _merge(self, level: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return self.rows(key[1].as_py(), {n: self.joined(table, n)[:2] for n in self.names}, level)

        return run

    def _hand_down(self):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
            told = told.sort_by("part")
            out = {"part": table.column("part"), "source": table.column("source")}
            for n in self.names:
                _, _, place, ends = self.joined(table, n)
                values = values_of(told, n)
                out[f"{n}_values"] = pa.array([planes(values[x]) for x in np.split(place, ends)], pa.binary())
            return pa.table(out)

        return run

    def gathered(self, sent: DataFrame) -> list[DataFrame]:
        """The rows of every level; those of the last have the final ranges."""
        rows = [sent]
        for level in range(2, self.levels + 1):
            rows.append(rows[-1].groupBy("part", F.shiftright("source", self.split).alias("group")).applyInArrow(self._merge(level), self.schema))
        return rows

    def told(self, sent: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Answers for all rows of ``sent``; ``answer`` gives them for the rows of the last level."""
        rows = self.gathered(sent)
        out = answer(rows[-1])
        for lists in reversed(rows[:-1]):
            groups = lists.groupBy("part", F.shiftright("source", self.split).alias("group"))
            out = out.withColumns({"above": F.shiftright("part", self.split), "group": F.col("source")})
            out = groups.cogroup(out.groupBy("above", "group")).applyInArrow(self._hand_down(), self.answers)
        return out


def values_of(told: pa.Table, name: str) -> np.ndarray:
    """All values of the rows of a table that is sorted by part."""
    return np.concatenate([np.zeros(0, np.uint64), *(unplanes(x) for x in told.column(f"{name}_values").to_pylist())])
