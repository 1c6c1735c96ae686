"""Spelling variants: words that are one edit apart, found through one-edit neighbourhoods of words in a reduced alphabet."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalode.llm.common import LOWER, binary_words, chunks_of, prepare, runs, text_of, written

#: Symbols of the reduced alphabet. More make fewer candidates and more neighbours.
SYMBOLS = 6
#: One text in so many loses a letter of a word, by the checksum of its id and the word.
MISTAKES = 97
#: Different words of a partition that are held before they are sent.
HELD_WORDS = 500_000
#: Numbers of a block of neighbourhoods.
BLOCK = 4 << 20
#: Words up to this length have a reduced number of their own (7^22 < 2^63); longer ones may share one.
OWN_NUMBER = 22

#: First byte of U+00C0 to U+00FF in UTF-8, and of no other letter.
_LEAD = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), _LEAD]] = True
#: Longest words, in bytes, whose checksums are made side by side.
_SIDE_BY_SIDE = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)).astype(np.uint32)
    return table


_CRC = _crc_table()


def _checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of every word after bytes whose crc32 is ``before``."""
    state = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(1, min(int(sizes.max(initial=0)), _SIDE_BY_SIDE) + 1), side="right")
    at, part = starts[order], state[order]
    for i, n in enumerate(alive.tolist()):
        part[:n] = _CRC[(part[:n] ^ data[at[:n] + i]) & np.uint32(255)] ^ (part[:n] >> np.uint32(8))
    state[order] = part
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > _SIDE_BY_SIDE).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(before[i]))
    return out


def _words(data: np.ndarray, offsets: np.ndarray, prefixes: np.ndarray, least: int) -> pa.Array:
    """All results of ``least`` letters or more of a chunk of texts; ``prefixes`` are checksums of the ids."""
    data = LOWER[data]
    inside = _LETTER[data]
    inside[1:] |= (data[:-1] == _LEAD) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    starts, sizes, rows = runs(inside, offsets)
    if not len(starts):
        return pa.array([], pa.binary())
    letters = sizes - np.add.reduceat(data == _LEAD, starts, dtype=np.int64)
    long = np.flatnonzero(letters >= least)
    starts, sizes, rows, letters = starts[long], sizes[long], rows[long], letters[long]
    sums = _checksums(data, starts, sizes, prefixes[rows])
    wrong = sums % np.uint32(MISTAKES) == 0
    changed = []
    for i in np.flatnonzero(wrong & (letters > least)).tolist():
        word = data[starts[i] : starts[i] + sizes[i]].tobytes().decode()
        at = int(sums[i]) % len(word)
        changed.append((word[:at] + word[at + 1 :]).encode())
    starts, sizes = starts[~wrong], sizes[~wrong]
    first = np.append(0, np.cumsum(sizes))[:-1]
    kept = data[np.arange(sizes.sum()) + np.repeat(starts - first, sizes)]
    return pa.concat_arrays([binary_words(kept, sizes), pa.array(changed, pa.binary())])


def _counted(least: int):
    """Different words of a partition and how often each occurs; a part of them at a time."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        return table.select(["word", "n_sum"]).rename_columns(["word", "n"])

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.set_column(0, "word", table.column("word").cast(pa.string())).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for b in batches:
            ids, at = text_of(b.column("prefix"))
            prefixes = np.array([zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint32)
            for first, end, data, offsets in chunks_of(b.column("text"), 4 << 20):
                counts = pc.value_counts(_words(data, offsets, prefixes[first:end], least))
                parts.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
            if sum(p.num_rows for p in parts) > 2 * HELD_WORDS:
                parts = [summed(parts)]
                if parts[0].num_rows > HELD_WORDS:
                    yield from sent(parts.pop())
        if parts:
            yield from sent(summed(parts))

    return run


def word_counts(docs: DataFrame, least_letters: int, least: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: the results of ``least_letters`` letters or more that occur ``least`` times or more.

    Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where 97 divides the crc32 h of ``<id>:<run>``, the run
    lost its letter h mod length. A null id counts as an empty one."""
    prefix = F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"))
    rows = docs.where(F.col(text).isNotNull()).select(prefix.alias("prefix"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_counted(least_letters), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- words in the reduced alphabet ---------------------------------------------------------------

#: A symbol from 1 to SYMBOLS for each letter, by its code point's product with an odd number.
_SYMBOL = (((np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(7)) % np.uint64(SYMBOLS) + np.uint64(1)).astype(np.uint8)
_BASE = np.uint64(SYMBOLS + 1)
#: The number that undoes a product with the base (modulo 2^64).
_UNDO = np.uint64(pow(SYMBOLS + 1, -1, 1 << 64))


def reduced_numbers(words: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """The symbols of words without an empty one, and as numbers that have them as digits, lowest first (modulo 2^64)."""
    symbols = _SYMBOL[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    ends = np.cumsum([len(w) for w in words])
    first = np.append(0, ends)[:-1].astype(np.int64)
    place = np.arange(len(symbols)) - np.repeat(first, np.diff(np.append(0, ends)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(int(place.max(initial=0)), _BASE)), dtype=np.uint64)
        values = symbols.astype(np.uint64) * powers[place]
        numbers = np.add.reduceat(values, first) if len(first) else values
    return numbers.view(np.int64), [symbols[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        numbers, symbols = reduced_numbers(b.column("word").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(symbols, pa.binary()), b.column("word"), b.column("n")], names=["reduced", "symbols", "word", "n"])


def neighbours(symbols: np.ndarray) -> np.ndarray:
    """Numbers of all words that are an edit or none from each row of symbols (words of one length), sorted in each row."""
    n, length = symbols.shape
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(length, _BASE)), dtype=np.uint64)
        values = symbols.astype(np.uint64) * powers[:length]
        before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(values, axis=1, dtype=np.uint64)], axis=1)
        whole = before[:, -1:]
        marks = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
        deleted = before[:, :-1] + (whole - before[:, 1:]) * _UNDO
        replaced = (whole - values)[:, :, None] + (powers[:length, None] * marks)[None]
        inserted = (before + (whole - before) * _BASE)[:, :, None] + (powers[:, None] * marks)[None]
    out = np.concatenate([whole, deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)], axis=1)
    return np.sort(out.view(np.int64), axis=1)


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """own and other for every neighbour that is not less than the word's own number: each pair of numbers is met from one side."""
    for b in batches:
        data, offsets = text_of(b.column("symbols"))
        own, sizes = b.column("reduced").to_numpy(), np.diff(offsets)
        for length in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == length)
            step = max(1, BLOCK // ((2 * SYMBOLS + 1) * (length + 1)))
            for some in np.split(same, range(step, len(same), step)):
                found = neighbours(data[offsets[some][:, None] + np.arange(length)])
                new = np.ones(found.shape, bool)
                new[:, 1:] = found[:, 1:] != found[:, :-1]
                new &= found >= own[some][:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[some], new.sum(axis=1))), pa.array(found[new])], names=["own", "other"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other and other_n for each two words that differ by one inserted, deleted or replaced letter, both ways.

    Two such words are, in the reduced alphabet, equal or an edit apart. Each reduced word's whole neighbourhood meets the
    reduced vocabulary; the words of two reduced words that meet are compared letter by letter. ``words`` has word and n."""
    known = written(words.select("word", "n").mapInArrow(_reduced, "reduced long, symbols binary, word string, n long"), "reduced-words")
    groups = known.groupBy("reduced").agg(F.min("symbols").alias("symbols"), F.collect_list(F.struct("word", "n")).alias("members"))
    groups = written(groups, "reduced-groups")
    short = groups.where(F.octet_length("symbols") <= OWN_NUMBER).select("reduced", "symbols")
    # long words that share a number have neighbourhoods each
    long = known.where(F.octet_length("symbols") > OWN_NUMBER).select("reduced", "symbols").distinct()
    met = short.mapInArrow(_neighbourhoods, "own long, other long")
    met = met.unionByName(long.mapInArrow(_neighbourhoods, "own long, other long").distinct())
    found = met.join(groups.select(F.col("reduced").alias("other"), F.col("members").alias("theirs")), "other")
    found = found.join(groups.select(F.col("reduced").alias("own"), F.col("members").alias("mine")), "own")
    pairs = found.select("own", "other", F.explode("mine").alias("a"), "theirs").select("own", "other", "a", F.explode("theirs").alias("b"))
    pairs = pairs.where((F.col("own") != F.col("other")) | (F.col("a.word") < F.col("b.word")))
    pairs = pairs.where(F.levenshtein("a.word", "b.word", 1) == 1)
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.select("p.a.word", "p.a.n", F.col("p.b.word").alias("other"), F.col("p.b.n").alias("other_n"))


def _roots(forms: DataFrame, most: int, least: int) -> DataFrame:
    """word and root of each word that has a form: forms followed to the last, in steps that double."""
    to = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    longest = max(1, int(math.log2(max(1, most / least))))  # every form occurs twice as often as its word, at least
    for _ in range(math.ceil(math.log2(longest))):
        next = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = written(to.join(next, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return to


def spelling_variants(docs: DataFrame, least_letters: int = 5, least: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``word_counts``.

    Near words differ by one inserted, deleted or replaced letter. A word's form is its near word of largest n (ties: the smallest
    by code points) if that has twice the word's n or more; root follows the forms to the last.

    Null and empty texts have no words; long texts and long words count whole; every row counts, also one that repeats. Empty
    tables give no rows; columns of other names are not used. The words of one reduced word are held together (46 at most for 270,000 words):
    for vocabularies of many millions raise ``SYMBOLS``."""
    prepare(docs.sparkSession)
    words = written(word_counts(docs, least_letters, least, id, text), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    forms = words.join(near, "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    forms = forms.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    forms = written(forms, "forms")
    most = forms.agg(F.max("n")).first()[0] or 0
    out = forms.join(_roots(forms, most, least), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
