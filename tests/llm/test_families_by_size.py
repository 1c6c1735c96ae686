"""What lies in one family is near in size, so that differences from its hub stay small."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from datalode.llm import jaccard
from datalode.llm.jaccard import similar_groups


def test_small_texts_are_not_held_against_a_large_hub(spark, monkeypatch):
    rng = random.Random(5)
    passage, *parts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(41)]
    texts = [passage + p for p in parts[:12]]  # share the passage with each other and with the large ones
    texts += [passage + sum(parts, []), passage + sum(parts[20:] + parts[:20], [])]
    texts.append(texts[0][:-1])
    most = []
    close = jaccard.close_members

    def seen(compared, *rest):
        most.append(compared.agg(F.count("*"), F.max(F.size("differences") / F.col("n"))).first())
        return close(compared, *rest)

    monkeypatch.setattr(jaccard, "close_members", seen)
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(docs, words=4, share=(85, 100)).collect()}
    assert got == {i: {13: 12, 14: 0}.get(i, i) for i in range(15)}
    assert most[0][0] >= 8 and most[0][1] < 2.5


@pytest.mark.parametrize("share", [(80, 100), (85, 100), (1, 2), (1, 1)])
def test_similar_sizes_have_a_class_in_common(spark, share):
    num, den = share
    sizes = [*range(1, 300), *(10**6 + i for i in range(3)), *(den * (10**6 + i) // num for i in range(3))]
    rows = jaccard.by_size(spark.createDataFrame([(n,) for n in sizes], "n long"), share).collect()
    of = {n: {r["class"] for r in rows if r["n"] == n} for n in sizes}
    assert all(of[a] & of[b] for a in sizes for b in sizes if a <= b and num * b <= den * a)


def test_lists_of_several_levels(spark, monkeypatch):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(rng.sample(words, 60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(str, similar_groups(docs, words=3, share=(80, 100)).collect()))
    monkeypatch.setattr(jaccard, "SPLIT", 2)
    monkeypatch.setattr("datalode.llm.blocks.BLOCK_BYTES", 600)
    assert jaccard.Exchange.levels_of(jaccard.blocks_of(docs, "text"), jaccard.SPLIT) == 3
    assert sorted(map(str, similar_groups(docs, words=3, share=(80, 100)).collect())) == want
