"""The trie, the exchange by levels and the bigram model against plain dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from datalode.llm import blocks
from datalode.llm.blocks import packed, planes, unpacked, unplanes
from datalode.llm.elias_fano import EliasFano, Trie, flat, views
from datalode.llm.jaccard import similar_groups
from datalode.llm.lm import code, decode, fit_bigrams, language_scores


def texts(n, seed):
    r = random.Random(seed)
    words = ["the", "The", "of"] + [f"w{i}" for i in range(60)]
    out = [(i, " ".join(r.choice(words[: r.choice([3, 20, 63])]) for _ in range(r.randrange(0, 60)))) for i in range(n)]
    return [*out, (n, None), (n + 1, " \n"), (n + 2, "unseen words only"), (n + 3, out[5][1]), (None, out[6][1])]


def test_sequences_and_trie(tmp_path):
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        for top in (2**64 - 1, 2**40, 5000):
            v = np.unique(r.integers(0, top, n, dtype=np.uint64))
            e = EliasFano(*views(flat(EliasFano.encoded(v))))
            q = np.concatenate([v, r.integers(0, top, 50, dtype=np.uint64)])
            assert (unpacked(packed(v)) == v).all() and (unplanes(planes(v)) == v).all()
            if len(v):
                assert (e.at(np.arange(len(v))) == v).all() and (e.search(q) == np.searchsorted(v, q)).all()
    keys = np.unique(r.integers(0, 300, 900, dtype=np.uint64) << np.uint64(28) | r.integers(0, 40, 900, dtype=np.uint64))
    codes = r.integers(1, 256, len(keys)).astype(np.uint8)
    contexts = np.unique(keys >> np.uint64(28))
    weights = r.integers(1, 256, len(contexts)).astype(np.uint8)
    words, counts = np.unique(r.integers(0, 2**64 - 1, 200, dtype=np.uint64), return_counts=True)
    path = tmp_path / "trie"
    path.write_bytes(Trie.encoded(words, counts.astype(np.uint64), keys, codes, weights, 28))
    for trie in (Trie(path.read_bytes()), Trie.open(str(path))):
        asked = np.unique(np.concatenate([keys, r.integers(0, 310, 500, dtype=np.uint64) << np.uint64(28) | r.integers(0, 45, 500, dtype=np.uint64)]))
        got, weight = trie.look_up(asked)
        held, of = dict(zip(keys.tolist(), codes.tolist(), strict=True)), dict(zip(contexts.tolist(), weights.tolist(), strict=True))
        assert got.tolist() == [held.get(k, 0) for k in asked.tolist()] and weight.tolist() == [of.get(k >> 28, 0) for k in asked.tolist()]
        assert trie.counts(np.append(words, np.uint64(5))).tolist() == [*counts.tolist(), 0]


def brute(rows, held_out, backoff):
    tokens = lambda t: [*(t or "").lower().split(), None]
    n, pairs, after = Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        if not held_out(i):
            ws = tokens(t)
            n.update(ws)
            for a, b in zip(["<", *ws], ws, strict=False):
                pairs[a, b] += 1
                after[a].add(b)
    follows = Counter()
    for (a, _), c in pairs.items():
        follows[a] += c
    total, out = sum(n.values()), []
    for i, t in rows:
        ws, base, score = tokens(t), 0.0, 0.0
        for a, b in zip(["<", *ws], ws, strict=False):
            p = (n[b] + 1) / (total + len(n) + 1)
            base += math.log10(p)
            if after[a]:
                f = backoff * len(after[a])
                share = decode(code(np.array([pairs[a, b] / (follows[a] + f)])))[0] if pairs[a, b] else 0.0
                p = min(1.0, share + decode(code(np.array([f / (follows[a] + f)])))[0] * p)
            score += math.log10(p)
        out.append((i, len(ws), sum(n[w] > 0 for w in ws), total, base, score))
    return out


@pytest.mark.parametrize(("bits", "size", "parts"), [(6, 12 << 20, 1), (1, 400, 3), (2, 150, 7)])
def test_scores_do_not_depend_on_the_split(spark, monkeypatch, bits, size, parts):
    monkeypatch.setattr(blocks, "SPLIT_BITS", bits)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    rows = texts(90, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = language_scores(docs, F.col("doc_id") % 5 == 2).collect()
    want = brute(rows, lambda i: i is not None and i % 5 == 2, 2.0)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert len(got) == len(want)
    for g, w in zip(sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_a_model_scores_other_texts(spark):
    rows = texts(40, 5)
    model = fit_bigrams(spark.createDataFrame(rows[:30], "doc_id long, text string"))
    got = language_scores(spark.createDataFrame(rows[30:], "doc_id long, text string"), F.lit(True), model=model).collect()
    want = {w[0]: w[1:] for w in brute(rows, lambda i: i is None or i >= 30, 2.0)}
    assert len(got) == len(rows) - 30
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3] and r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)


def test_groups_do_not_depend_on_the_levels(spark, monkeypatch):
    docs = spark.createDataFrame(texts(60, 6), "doc_id long, text string")
    want = sorted(map(str, similar_groups(docs, words=2, share=(1, 2)).select("doc_id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(blocks, "SPLIT_BITS", 1)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    assert sorted(map(str, similar_groups(docs, words=2, share=(1, 2)).select("doc_id", "n_shingles", "component_id").collect())) == want
