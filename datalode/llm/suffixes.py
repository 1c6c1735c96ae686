"""Repeated passages: removes every byte covered by a string of a given length that starts elsewhere too.

How the work is spread. In every text, each window of ``length`` bytes names the rightmost smallest of
its 64-byte grams as its anchor; equal windows name the same anchor at the same place, so only anchors
whose gram occurs twice can lie in a repeated window. Anchors are counted and joined by Spark. An
anchor's context is all windows that name it. Where a ``shorter`` length is asked for too, windows of that
length name the anchors, and a context reaches on to the ends of the long windows that begin with them.
Equal contexts repeat as a whole and are counted, not compared. The different contexts of one gram are suffix-sorted to both sides of the gram by deep-shallow
sorting: multikey quicksort to a shallow depth, then blind tries for groups that still agree. Grams with
more different contexts than one task should hold are decided by counting the hash of each window.

Runs of many words may be asked for too. Those of ``length`` bytes or more lie in windows; the shorter
ones name anchors in the same way, by the smallest gram of eight words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalode.llm.common import BYTE, IS_WORD, chunks_of, mix, prepare, text_of, written

GRAM = 64
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 96
#: Bytes that multikey quicksort compares at once.
STRIDE = 8
#: Most different contexts of a gram that one task sorts.
GROUP = 4096

_RNG = np.random.default_rng(7)
_DOUBLE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Here letter case counts and white space too.
_EXACT = np.where(np.isin(np.arange(256), [*range(65, 91), 0x20, *range(9, 14)]), _RNG.integers(1, 2**63, 256, dtype=np.uint64), BYTE)


# -- deep-shallow sorting ------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie whose inner nodes hold only a depth and one byte per child; leaves are strings."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | int | None = None
        self.strings: list[bytes] = []
        self.twins: dict[int, list[int]] = {}

    def _leaf(self, s: bytes) -> int:
        """Some leaf that agrees with the string in all bytes that the trie looks at."""
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1)
            if node is None:
                node = next(iter(children.values()))
        return node

    def insert(self, s: bytes) -> None:
        i = len(self.strings)
        self.strings.append(s)
        if self.root is None:
            self.root = i
            return
        leaf = self._leaf(s)
        other = self.strings[leaf]
        lcp = common(s, other)
        if lcp == len(s) == len(other):
            self.twins.setdefault(leaf, []).append(i)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < lcp:
            parent, node = node, node[1][s[node[0]]]
        c = s[lcp] if lcp < len(s) else -1
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][c] = i
            return
        made = (lcp, {c: i, other[lcp] if lcp < len(other) else -1: node})
        if parent is None:
            self.root = made
        else:
            parent[1][s[parent[0]]] = made

    def order(self) -> list[int]:
        """Positions of the inserted strings in sorted order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node is not None:
                out += [node, *self.twins.get(node, ())]
        return out


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Positions of the strings in sorted order; all of them agree in their first ``depth`` bytes."""
    out: list[int] = []
    todo = [(list(range(len(strings))), depth)]
    while todo:
        group, d = todo.pop()
        if len(group) < 2:
            out += group
        elif d >= shallow:
            trie = BlindTrie()
            for i in group:
                trie.insert(strings[i])
            out += [group[i] for i in trie.order()]
        else:
            keys = {i: strings[i][d : d + STRIDE] for i in group}
            pivot = keys[group[len(group) // 2]]
            less, same, more = [], [], []
            for i in group:
                k = keys[i]
                (less if k < pivot else more if k > pivot else same).append(i)
            ended = [i for i in same if len(strings[i]) < d + STRIDE]
            deeper = [i for i in same if len(strings[i]) >= d + STRIDE]
            # the stack gives the smallest first
            todo += [(more, d), (deeper, d + STRIDE)]
            todo += [([i], d) for i in ended]
            todo.append((less, d))
    return out


def repeats(lefts: list[bytes], rights: list[bytes], length: int, agreed: int) -> list[list[tuple[int, int]]]:
    """For each context, the (bytes to the left, bytes to the right) of its matches of at least ``length``.

    ``lefts`` are read away from the anchor, all ``rights`` agree in ``agreed`` bytes. Contexts are joined
    from the longest common left side to the shortest. Whenever two sets meet, each member of the smaller
    one is put in its place in the right-hand order of the larger one: of all members with at least that
    much in common on the left, its neighbours have the most in common on the right.
    """
    n = len(rights)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def match(a: int, b: int, left: int) -> None:
        right = common(rights[a], rights[b])
        if left + right >= length:
            found[a].append((left, right))
            found[b].append((left, right))

    if n == 2:
        match(0, 1, common(lefts[0], lefts[1]))
        return found
    at_right = deep_shallow(rights, agreed)
    rank = [0] * n
    for r, i in enumerate(at_right):
        rank[i] = r
    at_left = deep_shallow(lefts)
    borders = sorted(((common(lefts[a], lefts[b]), k) for k, (a, b) in enumerate(zip(at_left, at_left[1:], strict=False))), reverse=True)
    parent = list(range(n))
    held = {i: [rank[i]] for i in range(n)}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for left, k in borders:
        a, b = root(at_left[k]), root(at_left[k + 1])
        if len(held[a]) < len(held[b]):
            a, b = b, a
        large = held[a]
        for r in held.pop(b):
            p = bisect_left(large, r)
            if p:
                match(at_right[large[p - 1]], at_right[r], left)
            if p < len(large):
                match(at_right[large[p]], at_right[r], left)
            large.insert(p, r)
        parent[b] = a
    return found


# -- anchors -------------------------------------------------------------------------------------


def _doubled(data: np.ndarray, sizes: tuple[int, ...], salt: int = 0) -> dict[int, np.ndarray]:
    """Hashes of all strings of the ``sizes`` (powers of two); those that reach over the end are short."""
    h, n, out = _EXACT[data] ^ np.uint64(salt * 0x5851F42D4C957F2D), 1, {}
    with np.errstate(over="ignore"):
        while True:
            if n in sizes:
                out[n] = h
            if n >= max(sizes):
                return out
            longer = h * _DOUBLE[(n.bit_length() + salt) % 16]
            if n < len(h):
                longer[:-n] += h[n:]
            h, n = longer, 2 * n


def _power(n: int) -> int:
    """The largest power of two that is not over ``n``."""
    return 1 << (n.bit_length() - 1)


def gram_of(length: int) -> int:
    """Bytes of a gram for windows of ``length`` bytes."""
    return min(GRAM, _power(max(1, length // 2)))


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, longer: int = 0) -> tuple[np.ndarray, ...]:
    """Anchors of the texts of a chunk by windows of ``length``: row, gram hash, context hash, place of the gram, context's start, size and windows.

    A context ends where the last window of ``longer`` bytes that begins with one of its windows would end, or with the text."""
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(data) < length:
        return none
    size_of_gram, step = gram_of(length), _power(length)
    hashes = _doubled(data, (size_of_gram, step))
    gram = mix(hashes[size_of_gram])
    n = len(data)
    low = np.uint64((1 << 32) - 1)  # the same for every chunk, so that equal windows choose alike
    keys = (gram & ~low) | (low - np.arange(n, dtype=np.uint64))  # of equal grams the rightmost is the smallest
    span = length - size_of_gram + 1
    padded = np.full(-(-n // span) * span + span, ~np.uint64(0))
    padded[:n] = keys
    blocks = padded.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(after[: n - length + 1], before[span - 1 : n - length + span])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    whole = np.arange(n - length + 1) + length <= offsets[row + 1]
    window = np.flatnonzero(whole)
    if not len(window):
        return none
    place = (low - (smallest[window] & low)).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    start, place = window[first], place[first]
    r = row[start]
    size = np.minimum(start + count - 1 + max(length, longer), offsets[r + 1]) - start
    with np.errstate(over="ignore"):
        h = hashes[step]
        context = (size * 4096 + place - start).astype(np.uint64) * _DOUBLE[15]
        for i in range(-(-int(size.max()) // step)):
            context = context * _DOUBLE[12] + h[start + np.minimum(i * step, size - step)]
    return r, gram[place].view(np.int64), mix(context).view(np.int64), place - offsets[r], start - offsets[r], size, count


def _anchor_rows(length: int, longer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in chunks_of(b.column(2)):
                row, gram, context, *numbers = anchors_of(data, offsets, length, longer)
                ids = b.slice(first, end - first)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(ids.column(i).take(at) for i in (0, 1)),
                        *(pa.array(x, pa.int64()) for x in (gram, context)),
                        *(pa.array(x.astype(np.int32), pa.int32()) for x in numbers),
                    ],
                    names=["t1", "t2", "gram", "context", "place", "start", "size", "windows"],
                )

    return run


def _context_rows():
    """Cuts the contexts of the asked anchors from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_of(b.column(0))
            out = []
            for row, asked in enumerate(b.column(1).to_pylist()):
                for x in asked:
                    at = offsets[row] + x["start"]
                    out.append((x["gram"], x["context"], x["place"] - x["start"], data[at : at + x["size"]].tobytes(), x["windows"]))
            g, c, p, t, n = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(t, pa.binary()), pa.array(n, pa.int32())],
                names=["gram", "context", "at", "bytes", "windows"],
            )

    return run


def _sorted_groups(length: int):
    """Sorts the contexts of each gram (rows come ordered by gram) and gives the matched stretches."""

    def solve(gram: int, group: dict[int, tuple[int, bytes]], out: list) -> None:
        keys = list(group)
        lefts = [t[:p][::-1] for p, t in group.values()]
        rights = [t[p:] for p, t in group.values()]
        for key, (at, _), found in zip(keys, group.values(), repeats(lefts, rights, length, gram_of(length)), strict=True):
            out += [(gram, key, at - left, at + right) for left, right in set(found)]

    def batch(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "context", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, group, out = None, {}, []
        for b in batches:
            for g, c, p, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if g != gram:
                    if len(group) > 1:
                        solve(gram, group, out)
                    gram, group = g, {}
                group[c] = (p, t)
            yield batch(out)
            out = []
        if len(group) > 1:
            solve(gram, group, out)
        yield batch(out)

    return run


def _window_rows(lengths: tuple[int, ...]):
    """Two hashes of every window of a context, for each of the lengths."""

    def hashed(data: np.ndarray, length: int, salt: int) -> np.ndarray:
        n = len(data) - length + 1
        h, size, at = _EXACT[data] ^ np.uint64(salt * 0x5851F42D4C957F2D), 1, 0
        total = np.full(n, length, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(length.bit_length()):
                if length >> i & 1:
                    total = total * _DOUBLE[(i + 5 + salt) % 16] + h[at : at + n]
                    at += size
                longer = h * _DOUBLE[(i + salt) % 16]
                if size < len(h):
                    longer[:-size] += h[size:]
                h, size = longer, 2 * size
        return mix(total).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, c, t, most in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                data = np.frombuffer(t, np.uint8)
                for length in lengths:
                    n = min(len(data) - length + 1, most)  # windows after these are those of other anchors
                    if n > 0:
                        first = np.arange(n, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, g), pa.int64()), pa.array(np.full(n, c), pa.int64()), pa.array(first), pa.array(first + np.int32(length)), *(pa.array(hashed(data, length, salt)[:n]) for salt in (0, 1))],
                            names=["gram", "context", "a", "b", "h1", "h2"],
                        )

    return run


#: Words of a gram that names the anchor of a run of words.
WORD_GRAM = 8
#: Base of the hashes of word grams, and what undoes a product with it; equal hashes of unlike grams only add work.
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)


def _short_runs_at(data: np.ndarray, offsets: np.ndarray, words: int, length: int) -> tuple[np.ndarray, ...]:
    """Starts and ends of all words of a chunk, and which of them begin a run of ``words`` under ``length`` bytes within their row."""
    word = IS_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges], last[edges - 1] = word[edges], word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts) < words:
        return starts, ends, np.zeros(0, np.int64)
    stop = ends[words - 1 :]
    begin = starts[: len(stop)]
    row = np.searchsorted(offsets, begin, side="right") - 1
    return starts, ends, np.flatnonzero((stop <= offsets[row + 1]) & (stop - begin < length))


def _strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, most: int, salt: int = 0) -> np.ndarray:
    """Hashes of strings of ``step`` bytes (a power of two) to ``most``; only hashes with the same step and most compare."""
    h = _doubled(data, (step,), salt)[step]
    with np.errstate(over="ignore"):
        total = size.astype(np.uint64) * _DOUBLE[15]
        for i in range(-(-most // step)):
            total = total * _DOUBLE[8 + salt] + h[start + np.minimum(i * step, size - step)]
    return mix(total)


def word_anchors_of(data: np.ndarray, offsets: np.ndarray, words: int, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the runs of ``words`` words under ``length`` bytes of a chunk: row, gram hash, context hash, context's start and size.

    Every run names the rightmost smallest of its grams of WORD_GRAM words; runs that follow each other and name
    the same one are a context, from the start of the first to the end of the last."""
    starts, ends, runs = _short_runs_at(data, offsets, words, length)
    if not len(runs):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    n = min(WORD_GRAM, words)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(data), np.uint64(_BASE))), dtype=np.uint64)
        back = np.cumprod(np.append(np.uint64(1), np.full(len(data), np.uint64(_UNDO))), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(_EXACT[data] * powers[: len(data)], dtype=np.uint64))
        begin, stop = starts[: len(starts) - n + 1], ends[n - 1 :]
        gram = mix((sums[stop] - sums[begin]) * back[begin])
    low = np.uint64((1 << 32) - 1)
    keys = (gram & ~low) | (low - np.arange(len(gram), dtype=np.uint64))  # of equal grams the rightmost is the smallest
    least = np.lib.stride_tricks.sliding_window_view(keys, words - n + 1)[runs].min(axis=1)
    place = (low - (least & low)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (runs[1:] != runs[:-1] + 1)))
    final = runs[np.append(new[1:], len(runs)) - 1] + words - 1
    start, place = starts[runs[new]], place[new]
    size = ends[final] - start
    with np.errstate(over="ignore"):
        context = mix(_strings(data, start, size, _power(2 * words - 1), 2 * length) + (starts[place] - start).astype(np.uint64) * _DOUBLE[14])
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, gram[place].view(np.int64), context.view(np.int64), start - offsets[row], size


def _word_anchor_rows(words: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in chunks_of(b.column(2)):
                row, gram, context, start, size = word_anchors_of(data, offsets, words, length)
                ids, at = b.slice(first, end - first), pa.array(row)
                hashes = (pa.array(x, pa.int64()) for x in (gram, context))
                yield pa.RecordBatch.from_arrays([*(ids.column(i).take(at) for i in (0, 1)), *hashes, *(pa.array(x.astype(np.int32)) for x in (start, size))], names=["t1", "t2", "gram", "context", "start", "size"])

    return run


def _runs_of_contexts(words: int, length: int):
    """The runs of the asked contexts: where they lie in them, and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_of(b.column(0))
            for row, asked in enumerate(b.column(1).to_pylist()):
                for x in asked:
                    own = data[offsets[row] + x["start"] : offsets[row] + x["start"] + x["size"]]
                    starts, ends, runs = _short_runs_at(own, np.array([0, len(own)]), words, length)
                    a, z = starts[runs], ends[runs + words - 1]
                    hashes = (pa.array(_strings(own, a, z - a, _power(2 * words - 1), length, salt).view(np.int64)) for salt in (0, 1))
                    same = (pa.array(np.full(len(a), x[k]), pa.int64()) for k in ("gram", "context"))
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(v.astype(np.int32)) for v in (a, z)), *hashes], names=["gram", "context", "a", "b", "h1", "h2"])

    return run


def short_runs(docs: DataFrame, text: str, words: int, length: int) -> DataFrame:
    """The byte spans ``s`` (united) of each different text's runs of ``words`` words under ``length`` bytes that occur elsewhere too.

    Anchors are sent, one for many runs. Contexts that occur twice repeat as a whole; only different contexts of one gram
    are compared, by the hash of each of their runs."""
    # words are at least a byte each, with one between
    texts = _keyed(docs.select(F.coalesce(text, F.lit("")).alias("text")).where(F.octet_length("text") >= 2 * words - 1), "text")
    rows = "t1 long, t2 long, gram long, context long, start int, size int"
    anchors = written(texts.select("t1", "t2", "text").mapInArrow(_word_anchor_rows(words, length), rows), "word-anchors")
    contexts = written(anchors.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "start", "size")).alias("at")), "word-contexts")
    mixed = written(contexts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"), "word-grams-mixed")
    equal = contexts.where("n > 1").select("gram", "context", F.lit(0).alias("a"), F.col("at.size").alias("b"))
    asked = contexts.join(mixed.hint("merge"), "gram", "left_semi").groupBy("at.t1", "at.t2").agg(F.collect_list(F.struct("gram", "context", F.col("at.start").alias("start"), F.col("at.size").alias("size"))).alias("asked"))
    own = texts.join(asked.hint("merge"), ["t1", "t2"]).select("text", "asked").mapInArrow(_runs_of_contexts(words, length), "gram long, context long, a int, b int, h1 long, h2 long")
    runs = written(own.dropDuplicates(["gram", "context", "a"]), "word-runs")  # copies of a text give theirs once
    twice = written(runs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "word-runs-repeated")
    counted = runs.join(twice.hint("merge"), ["h1", "h2"], "left_semi").select("gram", "context", "a", "b")
    covered = written(equal.unionByName(counted).groupBy("gram", "context").agg(_union(F.collect_set(F.struct("a", "b"))).alias("s")), "word-runs-covered")
    moved = F.transform("s", lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"]).alias("b")))
    out = anchors.join(covered.hint("merge"), ["gram", "context"]).select("t1", "t2", moved.alias("s"))
    return out.groupBy("t1", "t2").agg(_union(F.flatten(F.collect_set("s"))).alias("s"))  # those of copies are one


_SPANS = "array<struct<a:int,b:int>>"


def _union(spans: Column) -> Column:
    """Sorted stretches, with those that touch or overlap made one."""
    kind = _SPANS
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.array_sort(spans),
        F.lit(None).cast(kind),
        lambda acc, x: F.when(acc.isNull(), F.array(x)).otherwise(
            F.when(
                x["a"] <= last(acc)["b"],
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b")))),
            ).otherwise(F.concat(acc, F.array(x)))
        ),
    )


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 400, group: int = GROUP, words: int | None = None, shorter: int | None = None) -> DataFrame:
    """For each different text (by ``t1``, ``t2``) with repeated strings of ``length`` bytes or ``words`` whole words, its byte ``spans``.

    With ``shorter`` there is ``shared`` too: the spans of repeated strings of that many bytes."""
    least = min(length, shorter or length)
    if least < 1 or words is not None and words < 1:
        raise ValueError("a repeated string has at least one byte, a run at least one word")
    prepare(docs.sparkSession)
    texts = _keyed(docs.select(F.coalesce(text, F.lit("")).alias("text")).where(F.octet_length("text") >= least), "text")
    rows = "t1 long, t2 long, gram long, context long, place int, start int, size int, windows int"
    anchors = written(texts.select("t1", "t2", "text").mapInArrow(_anchor_rows(least, length), rows), "anchors")
    # Counts are written before they are joined, so that Spark can split a hot gram's rows on the other
    # side, and all joins with texts are merge joins, whatever the size, so that plans are alike.
    twice = written(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    anchors = written(anchors.join(twice.hint("merge"), "gram", "left_semi"), "anchors-repeated")
    contexts = anchors.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "place", "start", "size", "windows")).alias("at"))
    contexts = written(contexts, "contexts")
    of_gram = written(contexts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "grams-mixed")
    equal = contexts.where("n > 1").select("gram", "context", F.lit(0).alias("a"), F.col("at.size").alias("b"))
    asked = contexts.join(of_gram, "gram")
    # one text for each key, so that copies of a text give their contexts once
    asked = asked.groupBy("at.t1", "at.t2").agg(F.collect_list(F.struct("gram", "context", "m", F.col("at.place").alias("place"), F.col("at.start").alias("start"), F.col("at.size").alias("size"), F.col("at.windows").alias("windows"))).alias("asked"))
    cut = written(
        texts.join(asked.hint("merge"), ["t1", "t2"]).select("text", "asked").mapInArrow(_context_rows(), "gram long, context long, at int, bytes binary, windows int").dropDuplicates(["gram", "context"]),
        "contexts-cut",
    )
    large = of_gram.where(F.col("m") > group).select("gram")
    few = cut.join(of_gram.where(F.col("m") <= group).select("gram"), "gram", "left_semi")
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matched = few.select("gram", "context", "at", "bytes").repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_sorted_groups(least), "gram long, context long, a int, b int")
    windows = cut.join(large, "gram", "left_semi").select("gram", "context", "at", "bytes", "windows").mapInArrow(_window_rows(tuple({length, least})), "gram long, context long, a int, b int, h1 long, h2 long")
    shared = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    counted = windows.join(shared, ["h1", "h2"], "left_semi").select("gram", "context", "a", "b")
    covered = equal.unionByName(matched).unionByName(counted)
    # with a shorter length every stretch counts, for the length itself only those that are long enough
    both = {"spans": length} | ({"shared": least} if shorter else {})
    unions = [_union(F.collect_set(F.when(F.col("b") - F.col("a") >= n, F.struct("a", "b")))).alias(name) for name, n in both.items()]
    covered = written(covered.groupBy("gram", "context").agg(*unions), "covered")
    moved = [F.transform(F.coalesce(name, F.array().cast(_SPANS)), lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"]).alias("b"))).alias(name) for name in both]
    of_text = anchors.join(covered.hint("merge"), ["gram", "context"]).select("t1", "t2", *moved)
    of_text = _united(of_text, list(both))
    if words is None:
        return of_text
    runs = short_runs(docs, text, words, length).select("t1", "t2", *(F.col("s").alias(name) for name in both))
    return _united(of_text.unionByName(runs), list(both))


def _united(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each text (t1, t2) with its spans of each name; equal spans, as those of copies, are one before they are moved."""
    each = F.concat(*(F.transform(name, lambda s: F.struct(F.lit(i).alias("kind"), s["a"].alias("a"), s["b"].alias("b"))) for i, name in enumerate(names)))
    rows = rows.select("t1", "t2", F.explode(each).alias("s")).select("t1", "t2", "s.kind", F.struct("s.a", "s.b").alias("s"))
    unions = [_union(F.collect_set(F.when(F.col("kind") == i, F.col("s")))).alias(name) for i, name in enumerate(names)]
    return rows.groupBy("t1", "t2").agg(*unions)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)})


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = 400, group: int = GROUP, characters: bool = False, words: int | None = None, shorter: int | None = None
) -> DataFrame:
    """Adds ``spans`` (array of (a, b) byte spans that repeat, merged) and ``kept`` (the other bytes).

    A string repeats if it has ``length`` bytes, or ``words`` whole words where that is given, and starts
    elsewhere too. A null text is empty; shorter texts keep everything; repeated rows lose all that lies in
    a repeated string; an empty table gives none. ``kept`` may cut a character of several bytes, unless ``characters`` is set:
    then characters that lie only partly in a span stay. With ``shorter`` there is ``shared`` too: the spans of
    repeated strings of that many bytes, which are told but not removed. Texts of any length are taken whole. Columns of
    these names are replaced; all other columns stay.
    """
    names = ["spans", *(["shared"] if shorter else [])]
    spans = written(repeated_spans(docs, text, length, group, words, shorter), "spans")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = docs.drop(*names, "kept").withColumns({"__t1": F.xxhash64(F.coalesce(text, F.lit(""))), "__t2": F.xxhash64(F.lit(1), F.coalesce(text, F.lit("")))})
    out = docs.join(spans.withColumnsRenamed({"t1": "__t1", "t2": "__t2"}).hint("merge"), ["__t1", "__t2"], "left").drop("__t1", "__t2")
    out = out.withColumns({name: F.coalesce(name, F.array().cast(_SPANS)) for name in names})
    if characters:
        out = out.withColumn("spans", whole_characters(text, "spans"))
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["b"]))
    starts = F.concat(F.transform("spans", lambda s: s["a"]), F.array(F.octet_length(body)))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(body, p["a"] + 1, p["b"] - p["a"]))
    return out.withColumn("kept", F.when(F.size("spans") == 0, body).otherwise(F.unhex(F.array_join(F.transform(pieces, F.hex), ""))))


def whole_characters(text: str, spans: str) -> Column:
    """The spans made smaller, so that what is left of the text holds whole characters only."""
    body = F.col(text).cast("binary")
    held = lambda at, n: F.hex(F.substring(body, at, n))

    def fit(s: Column) -> Column:
        a = s["a"] + F.length(F.regexp_extract(held(s["a"] + 1, F.lit(3)), "^((?:[89AB][0-9A-F])*)", 1)) / 2
        inner = F.length(F.regexp_extract(held(F.greatest(s["b"] - 2, F.lit(1)), F.least(s["b"], F.lit(3))), "((?:[89AB][0-9A-F])*)$", 1)) / 2
        b = s["b"] - F.when(held(s["b"] + 1, F.lit(1)).rlike("^[89AB]"), inner + 1).otherwise(0)
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    return F.filter(F.transform(spans, fit), lambda s: s["a"] < s["b"])
