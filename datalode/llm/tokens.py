"""Token counts at every prefix of a text, by dynamic programming over one byte-pair vocabulary.

The vocabulary is that of ``word_bpe_49k.json``: texts are composed (NFC), lower-cased and split into
pieces (contractions, runs of letters, single digits, runs of other signs), and every piece is encoded
alone with a mark on its last symbol. A sequence of tokens is the encoding of its piece exactly if each
two neighbours are the encoding of their own concatenation. So the last token of every prefix follows
from the last tokens of shorter prefixes: it is the one vocabulary entry that ends there and fits the
last token of the prefix before it, and the prefix has one token more than that one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from datalode.llm.common import prepare

#: Entries that a worker remembers; beyond that new words are counted but not kept.
CACHE_ENTRIES = 500_000
_END = "</w>"
#: Runs that are one piece whatever stands beside them: composed letters with a lower case of one letter.
plain_word = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Signs at the end of a run that make a piece of their own.
SIGNS = ".,!?;:|"


def _symbol_table() -> dict[int, int]:
    """Byte-level symbols: visible Latin-1 signs stand for themselves, the other bytes for 256 and on, in order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_SYMBOLS = _symbol_table()


def symbols(piece: str) -> str:
    """A piece as the vocabulary's symbols, one for each UTF-8 byte."""
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SYMBOLS)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts of tokens at each prefix of a piece (its byte-level symbols)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        #: Tokens by the order in which merges make them; single symbols come first.
        self.order: dict[str, int] = {}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        for t in model["vocab"]:
            if t not in made:
                self.order[t] = len(self.order)
        #: What each token is merged from (a single symbol: itself), and what two tokens merge to.
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.order))]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b not in self.order:
                self.order[a + b] = len(self.order)
                self.parts.append((self.order[a], self.order[b]))
                self.joined[self.order[a], self.order[b]] = self.order[a + b]
        #: Tries of the tokens read from their ends; the key "" holds a token. One for tokens with the end mark.
        self.inner: dict = {}
        self.marked: dict = {}
        for t, i in self.order.items():
            s = t.removesuffix(_END)
            node = self.marked if len(s) < len(t) else self.inner
            for c in reversed(s):
                node = node.setdefault(c, {})
            node[""] = i
        self.fits: dict[tuple[int, int], bool] = {}

    def _fit(self, a: int, b: int) -> bool:
        """True if no merge would reach across the border of the tokens a, b.

        The tokens are undone from the latest merge to the first; a merge across the border is a fault if
        it came before the merges that are undone by then."""
        limit = len(self.parts) + 1
        pair = a, b
        ok = None
        while ok is None:
            if self.joined.get((a, b), limit) < limit:
                ok = False
            elif a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    ok = True if b + 1 == limit else None
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    ok = True if a == limit else None
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[pair] = ok
        return ok

    def _last(self, s: str, end: int, last: list[int], node: dict) -> tuple[int, int]:
        """The last token of the first ``end`` symbols, and where it starts."""
        found = []
        at = end
        while at:
            at -= 1
            node = node.get(s[at])
            if node is None:
                break
            if "" in node:
                found.append((node[""], at))
        fits = self.fits
        for t, at in reversed(found):
            if not at:
                return t, 0
            ok = fits.get((last[at], t))
            if ok or ok is None and self._fit(last[at], t):
                return t, at
        raise ValueError(f"no encoding of {s!r}")

    def _inner(self, s: str, upto: int) -> tuple[list[int], list[int]]:
        last, count, inner = [-1], [0], self.inner
        for end in range(1, upto + 1):
            t, before = self._last(s, end, last, inner)
            last.append(t)
            count.append(count[before] + 1)
        return last, count

    def count(self, s: str) -> int:
        """Tokens of the whole piece."""
        if not s:
            return 0
        last, count = self._inner(s, len(s) - 1)
        return count[self._last(s, len(s), last, self.marked)[1]] + 1

    def prefixes(self, s: str) -> list[int]:
        """For each n from 0 to the piece's length, the tokens of its first n symbols taken as a text."""
        last, count = self._inner(s, max(0, len(s) - 1))
        return [0] + [count[self._last(s, n, last, self.marked)[1]] + 1 for n in range(1, len(s) + 1)]


class TextCounter:
    """Exact token counts of texts and of their prefixes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.special = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.normal = whole.normalizer.normalize_str
        self.split = whole.pre_tokenizer.pre_tokenize_str
        self.pieces = PieceCounter(path)
        self.words: dict[str, int] = {}
        self.plain: dict[str, int] = {}

    def _piece(self, p: str) -> int:
        n = self.plain.get(p)
        if n is None:
            n = self.pieces.count(p)
            if len(self.plain) < CACHE_ENTRIES:
                self.plain[p] = n
        return n

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those strings (True)."""
        while text:
            at, s = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=(len(text), ""))
            if at:
                yield text[:at], False
            if s:
                yield s, True
            text = text[at + len(s) :]

    def plain_count(self, text: str) -> int:
        """Tokens of any text, cut at special strings, normalised and split as the vocabulary's file says."""
        n = 0
        for s, special in self._segments(text):
            n += 1 if special else sum(self._piece(p) for p, _ in self.split(self.normal(s)))
        return n

    def _word(self, w: str) -> int:
        """Tokens of a run without white space."""
        base = w.rstrip(SIGNS)
        if plain_word(base):
            n = self._piece(symbols(base.lower())) + (self._piece(w[len(base) :]) if len(base) < len(w) else 0)
        else:
            n = self.plain_count(w)
        if len(self.words) < CACHE_ENTRIES:
            self.words[w] = n
        return n

    def word_counts(self, text: str) -> tuple[list[str], list[int]]:
        """The runs without white space of a text, and the tokens of each."""
        runs = text.split()
        known = list(map(self.words.get, runs))
        if None in known:
            known = [self._word(w) if n is None else n for w, n in zip(runs, known, strict=True)]
        return runs, known

    def count(self, text: str) -> int:
        """Tokens of a text. No piece spans white space, so it is the sum over its runs."""
        if _ODD & set(text):
            return self.plain_count(text)
        return sum(self.word_counts(text)[1])

    def prefix_counts(self, text: str) -> np.ndarray:
        """For each n from 0 to the text's length, the tokens of its first n characters as a text.

        A character that only makes a token together with what follows counts as if the text ended there."""
        out = np.zeros(len(text) + 1, np.int64)
        at = total = 0
        for run in text.split() if not _ODD & set(text) else [text]:
            start = text.index(run, at)
            out[at : start + 1] = total
            inside = None
            low = run.lower()
            if run.isascii() and run.isalpha():
                inside = self.pieces.prefixes(low)
            for k in range(1, len(run) + 1):
                out[start + k] = total + (inside[k] if inside else self.plain_count(run[:k]))
            at = start + len(run)
            total = int(out[at])
        out[at:] = total
        return out

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


#: Characters that Python takes for white space and the vocabulary's pattern does not.
_ODD = {"\x1c", "\x1d", "\x1e", "\x1f"}
_COUNTERS: dict[str, TextCounter] = {}


def counter(path: str) -> TextCounter:
    """One counter for each worker process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TextCounter(path)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame, text: str = "text", path: str | None = None, budgets: tuple[int, ...] = (2048,), prefixes: bool = True
) -> DataFrame:
    """Adds ``n_tokens``, ``cuts`` and, if asked for, ``run_tokens`` to every row.

    ``run_tokens`` holds, for each white-space delimited run of the text, the token count of the prefix
    that ends with it, so the count at any such prefix is one look-up. ``cuts`` holds for each budget how
    many whole runs fit (all, if the text fits). A null or empty text has no tokens. No shuffle: rows stay
    where they are, every worker keeps a bounded memory of words. Columns of these names are replaced.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary_path()
    docs = docs.drop("n_tokens", "cuts", "run_tokens")
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("cuts", T.ArrayType(T.LongType()))]
    if prefixes:
        added.append(T.StructField("run_tokens", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for b in batches:
            totals, cuts, sums = [], [], []
            for t in b.column(b.schema.names.index(text)).to_pylist():
                t = t or ""
                if _ODD & set(t):
                    known = [tokens.plain_count(t)]
                else:
                    known = tokens.word_counts(t)[1]
                if prefixes or sum(known) > min(budgets, default=0):
                    at = np.cumsum(np.asarray(known, np.int32)) if known else np.zeros(0, np.int32)
                    totals.append(int(at[-1]) if len(at) else 0)
                    cuts.append([int(np.searchsorted(at, x, side="right")) for x in budgets])
                else:
                    at = None
                    totals.append(sum(known))
                    cuts.append([len(known)] * len(budgets))
                sums.append(at)
            new = [pa.array(totals, pa.int64()), pa.array(cuts, pa.list_(pa.int64()))]
            if prefixes:
                new.append(pa.array(sums, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, schema)
