"""BM25 of many long queries: scores from a matrix of shared terms and lists of the others, one answer a partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from datalode.operators import bm25


def test_a_partition_gives_its_best_chunks_once(monkeypatch):
    monkeypatch.setattr(bm25, "SHARED", 3)
    monkeypatch.setattr(bm25, "CHUNKS_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    terms = [f"t{i}" for i in range(30)]
    weights = {(q, t): float(rng.normal(1, 1)) for q in range(20) for t in terms if rng.random() < (0.9 if t in terms[:5] else 0.2)}
    asked = bm25.Asked([{"query_id": q, "term": t, "weight": w, "average": 12.0} for (q, t), w in weights.items()], {}, True)
    assert asked.matrix.shape == (20, 3)
    texts = [" ".join(rng.choice([*terms, "other"], rng.integers(0, 25))) for _ in range(60)]
    batches = [pa.record_batch({"chunk_id": pa.array(range(a, a + 20), pa.int64()), "text": texts[a : a + 20]}) for a in (0, 20, 40)]
    got = pa.Table.from_batches(bm25._best_of_chunks(asked, 4)(iter(batches))).to_pylist()
    want = []
    for q in range(20):
        scores = []
        for i, text in enumerate(texts):
            w = text.split()
            s = sum(weights.get((q, t), 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / 12)) for t in set(w))
            if s > 1e-8 and i != q:
                scores.append((-s, i))
        want += [(q, i, -s) for s, i in sorted(scores)[:4]]
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(q, i) for q, i, _ in want]
    assert np.allclose([r["score"] for r in got], [s for *_, s in want])


def test_words_are_split_and_counted_without_a_row_for_each():
    texts = pa.array(["a\tb \n a\x0bé\r", "", "b\x0cb", "ü b"])
    for some, first in ((texts, 0), (texts.slice(2), 2)):
        flat, parent = bm25.split_words(some)
        assert [(p, w) for p, w in zip(parent.tolist(), flat.to_pylist(), strict=True)] == [(i - first, w) for i, t in enumerate(texts.to_pylist()) if i >= first for w in t.split()]
    got = pa.Table.from_batches(bm25._counted(iter([pa.record_batch({"text": texts})]))).to_pylist()
    assert {r["term"]: (r["df"], r["words"]) for r in got} == {"": (4, 8), "a": (1, 0), "b": (3, 0), "é": (1, 0), "ü": (1, 0)}
    empty = pa.Table.from_batches(bm25._counted(iter([pa.record_batch({"text": pa.array(["", " "])})]))).to_pylist()
    assert empty == [{"term": "", "df": 2, "words": 0}]
