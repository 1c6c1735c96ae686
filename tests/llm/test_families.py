"""Families of texts that lie just under and just over the threshold, against brute force."""

from __future__ import annotations

import random

import pytest

from datalode.llm import jaccard
from datalode.llm.jaccard import similar_groups


def brute(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}, links


def family(rng, n, members, edits, common, deep):
    """Copies of a text with words replaced, dropped or added; some are copies of a copy."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(n)]
    made = [base]
    for _ in range(members):
        w = list(rng.choice(made) if rng.random() < deep else base)
        for _ in range(rng.randrange(edits[0], edits[1] + 1)):
            at, what = rng.randrange(len(w)), rng.random()
            word = f"c{rng.randrange(5)}" if rng.random() < common else f"x{rng.randrange(10**6)}"
            w[at : at + 1] = [word] if what < 0.6 else [] if what < 0.8 else [word, w[at]]
        made.append(w)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize(("seed", "words", "share", "fan", "few"), [(1, 5, (80, 100), 1000, 8), (2, 4, (85, 100), 7, 0), (4, 3, (70, 100), 5, 0)])
def test_families(spark, monkeypatch, seed, words, share, fan, few):
    monkeypatch.setattr(jaccard, "FAN", fan)
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(seed)
    num, den = share
    texts = []
    for n, members, common, deep in ((120, 60, 0.5, 0.2), (60, 40, 0.0, 0.5), (200, 40, 0.9, 0.0), (30, 30, 0.7, 0.7)):
        limit = n * (den - num) / (den + num) / (words * 2) * 2  # edits after which a copy is no longer similar
        texts += family(rng, n, members, (int(limit * 0.7), int(limit * 1.4) + 1), common, deep)
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    want, links = brute(texts, words, num, den)
    rows = similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=words, share=share).collect()
    assert links > 20 and len({c for _, c in want.values()}) > 20
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
