"""What the operators of this subpackage share: session settings, scratch tables and Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to a Python worker; texts can be long, so batches are short.
ARROW_ROWS = 1000
#: Bytes of text that are worked on at once with numpy.
CHUNK_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts: the session's setting is lowered, never raised."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; on one machine, where none is named, its temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text or binary column over all rows."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def text_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and each row's offset in them (nulls are empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(array) or array.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks_of(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes: first row, end row, bytes, offsets."""
    data, offsets = text_of(array)
    first = 0
    while first < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), len(offsets) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the marked bytes that stay within a row: start, size and row of each."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, starts
    sizes = np.add.reduceat(inside, starts, dtype=np.int64)
    return starts, sizes, np.searchsorted(offsets, starts, side="right") - 1


def binary_words(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Words of the given sizes that lie one after the other, as an Arrow array of bytes."""
    ends = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def lists(values: np.ndarray, ends: np.ndarray, kind: type) -> pa.Array:
    """An Arrow array of lists that lie one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values.astype(kind)))


# -- hashes of words and word runs ---------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
#: A random 64-bit number for each byte; A-Z count as a-z.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
#: White space of the word pattern [^\x20\x09-\x0D]+.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
BYTE[~IS_WORD] = 0
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096), _P)]))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows of a chunk: start byte, row, 64-bit hash (A-Z as a-z)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = IS_WORD[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    start[edges] = word[edges]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        values = BYTE[data[starts[0] :]] * _powers(int(sizes.max()) + 1)[place]
        hashes = np.add.reduceat(values, starts - starts[0])
    return starts, np.searchsorted(offsets, starts, side="right") - 1, mix(hashes)


def run_hashes(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every k words in a row of one text; a text of fewer words is one run.

    Returns hash, row and the first word's position in ``hashes``."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        if n >= k:
            h = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                h += hashes[i : n - k + 1 + i] * _STEPS[i % 64] ** np.uint64(1 + i // 64)
            whole = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
            full, at = mix(h[whole]), whole
        else:
            full, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        size = np.diff(np.append(first, n))
        first, size = first[size < k], size[size < k]
        if len(first):
            short = []
            for f, s in zip(first.tolist(), size.tolist(), strict=True):
                short.append((hashes[f : f + s] * _STEPS[:s]).sum(dtype=np.uint64) + _STEPS[32] * np.uint64(s))
            full, at = np.append(full, mix(np.array(short, np.uint64))), np.append(at, first)
            order = np.argsort(at, kind="stable")
            full, at = full[order], at[order]
    return full, rows[at], at
