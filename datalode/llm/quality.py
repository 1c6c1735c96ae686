"""Quality classifier: cumulative-link (ordinal) regression on graded ratings over hashed text.

P(grade > g) = sigmoid(w . x - threshold[g]) with one weight vector and ordered thresholds. Features are
hashed words that a text has, and its shape in steps (capitals, repeated words, signs, word lengths).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalode.llm.common import chunks_of, prepare, word_hashes

BITS = 18
#: Steps of each shape feature; they take the places behind the hashed words.
STEPS = 16
SHAPES = 6
SIZE = (1 << BITS) + SHAPES * STEPS
#: Labelled rows that the model is fitted on at most, the same whatever the input's size.
SAMPLE = 12_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature numbers of the texts of a chunk, each pair once, ordered by row."""
    n = len(offsets) - 1
    starts, rows, hashes = word_hashes(data, offsets)
    # words without signs at their edges would need another pass; hashes of whole runs and of letters both count
    letters = np.where(_LETTER[data], data, np.uint8(32)).astype(np.uint8)
    _, rows2, hashes2 = word_hashes(letters, offsets)
    pairs = [rows.astype(np.int64) << 20 | (hashes >> np.uint64(64 - BITS)).astype(np.int64)]
    pairs.append(rows2.astype(np.int64) << 20 | (hashes2 >> np.uint64(64 - BITS)).astype(np.int64))
    distinct = np.unique(rows.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20)) >> np.uint64(44)
    sums = np.append(0, np.cumsum(_CAPITAL[data])), np.append(0, np.cumsum(_LETTER[data])), np.append(0, np.cumsum(_SIGN[data]))
    capital, letter, sign = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
    size = np.diff(offsets)
    words = np.bincount(rows, minlength=n)[:n]
    new = np.bincount(distinct.astype(np.int64), minlength=n)[:n]
    share = lambda a, b: np.minimum((a / np.maximum(b, 1) * STEPS).astype(np.int64), STEPS - 1)
    shapes = [
        share(capital, letter),
        share(words - new, words),
        share(sign * 2, size),
        np.minimum(np.log2(words + 1).astype(np.int64), STEPS - 1),
        np.minimum(size // np.maximum(words, 1), STEPS - 1),
        share(letter, size),
    ]
    for i, s in enumerate(shapes):
        pairs.append(np.arange(n) << 20 | ((1 << BITS) + i * STEPS + s))
    both = np.unique(np.concatenate(pairs))
    return both >> 20, both & ((1 << 20) - 1)


@dataclass
class Ordinal:
    """Weights shared by all grades, ordered thresholds, and the number of grades they come from."""

    weights: np.ndarray
    thresholds: np.ndarray
    seen: int = 0

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) for each g, one column per threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def likelihood(score: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood of grades, and its slopes by each row's score and by each threshold."""
    n = max(len(grades), 1)
    cut = np.concatenate([[-np.inf], thresholds, [np.inf]])
    with np.errstate(over="ignore"):
        up = 1 / (1 + np.exp(-(cut[grades + 1] - score)))
        down = 1 / (1 + np.exp(-(cut[grades] - score)))
    p = np.maximum(up - down, 1e-12)
    d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
    by_threshold = np.array([(d_down[grades == k + 1].sum() - d_up[grades == k].sum()) / n for k in range(len(thresholds))])
    return float(-np.log(p).sum() / n), (d_up - d_down) / n, by_threshold


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, levels: int, least: int = 5, l1: float = 3e-4, steps: int = 150) -> Ordinal:
    """Full-batch AdaGrad with soft thresholding of the cumulative-link likelihood.

    Features of fewer than ``least`` texts stay at zero. Thresholds are a first value and positive gaps."""
    often = np.bincount(columns, minlength=SIZE)
    keep = (often >= least)[columns]
    rows, columns = rows[keep], columns[keep]
    above = np.array([(grades > g).mean() if len(grades) else 0.5 for g in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    thresholds = -np.log(above / (1 - above))
    thresholds = np.maximum.accumulate(thresholds + np.arange(levels - 1) * 1e-3)
    weights, sums = np.zeros(SIZE), np.full(SIZE, 1e-8)
    t_sums = np.full(levels - 1, 1e-8)
    for _ in range(steps if len(grades) else 0):
        score = np.bincount(rows, weights=weights[columns], minlength=len(grades))
        _, slope, t = likelihood(score, grades, thresholds)
        g = np.bincount(columns, weights=slope[rows], minlength=SIZE)
        sums += g * g
        rate = 0.3 / np.sqrt(sums)
        weights -= rate * g
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * l1, 0)
        t_sums += t * t
        thresholds = np.maximum.accumulate(thresholds - 0.1 / np.sqrt(t_sums) * t + np.arange(levels - 1) * 1e-9)
    return Ordinal(weights, thresholds, len(grades))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, end, data, offsets in chunks_of(b.column(1)):
            r, c = features(data, offsets)
            cuts = np.searchsorted(r, np.arange(end - first + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(c.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), held], names=["grade", "features"])


def trained(docs: DataFrame, labels: DataFrame, levels: int, sample: int = SAMPLE) -> Ordinal:
    """A model of ``grade`` (0 to levels - 1) from the texts of at most ``sample`` labels in hash order.

    Only the chosen labels (their number is the bound) are sent to the texts, which stay where they are;
    an id that repeats may bring as many texts again, not more."""
    chosen = labels.where(F.col("grade").isNotNull() & F.col("__id").isNotNull()).orderBy(F.xxhash64("__id"), "__id", "grade").limit(sample)
    rated = docs.join(F.broadcast(chosen), "__id").select("grade", "text")
    got = rated.mapInArrow(_featured, "grade int, features array<int>").limit(2 * sample).toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64)
    lists = got.column("features").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    columns = lists.flatten().to_numpy().astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    return fit(np.repeat(np.arange(len(grades)), sizes), columns, grades, levels)


def graded(quality: Column, toxic: Column) -> Column:
    """Ratings as grades: 0 toxic, 1 of low quality, 2 good; null without a rating."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2).cast("int")


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", levels: int = 3, tail: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Adds ``expected_grade``, ``p_tail`` (P(grade = highest)) and ``keep`` (p_tail >= tail) to every row.

    ``labels`` has the id and ``grade``. A document with several labels counts for each. A null text is
    empty. Without any usable label (of a grade, for an id that
    is there) all scores come from the start values and every row is kept. The model is
    fitted on the driver from ``sample`` rows at most and sent to all tasks (2 MB); no shuffle follows.
    Columns of these names are replaced.
    """
    prepare(docs.sparkSession)
    added = ["expected_grade", "p_tail", "keep"]
    docs = docs.drop(*added)
    texts = docs.select(F.col(id).alias("__id"), F.coalesce(text, F.lit("")).alias("text"))
    model = trained(texts, labels.select(F.col(id).alias("__id"), "grade"), levels, sample)
    weights = model.weights.astype(np.float32)
    thresholds, fitted = model.thresholds, model.seen > 0
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Ordinal(weights, thresholds)
        for b in batches:
            scores = [np.zeros(0)]
            for first, end, data, offsets in chunks_of(b.column(b.schema.names.index(text))):
                r, c = features(data, offsets)
                scores.append(np.bincount(r, weights=ready.weights[c], minlength=end - first))
            tails = ready.tails(np.concatenate(scores))
            new = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array((tails[:, -1] >= tail) | (not fitted))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *added])

    return docs.mapInArrow(run, schema)
