"""Every stage of the pipeline with nulls, empty texts and tables, repeated rows and columns of clashing names."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline

r = random.Random(3)
WORDS = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(900)]


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


ITEM = prose(30)
SHARED = prose(70)
TEXTS = [
    (1, prose(80)),
    (2, None),
    (3, ""),
    (4, " \n"),
    (None, prose(60)),
    (5, SHARED + " " + prose(50)),
    (6, prose(50) + " " + SHARED),
    (7, prose(20) + " " + ITEM + " " + prose(20)),
    (8, prose(5000)),
    (9, "é ß " * 40 + prose(9)),
]
TEXTS += [TEXTS[-1], TEXTS[0], (10, TEXTS[0][1])]
CLASH = "doc_id long, text string, keep string, p_tail int, spans string, kept string, shared string, matches string, length int, n string, Block string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, folder, stage):
    name, run = corpus_pipeline.STAGES[stage]
    rows = [(i, t, f"own {n}", n, "s", "k", "h", "m", n, "x", "b") for n, (i, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, CLASH)
    out = run(spark, docs, folder)
    got = out.collect()
    if name == "packed":
        assert {x["doc_id"] for x in got} == {i for i, _ in TEXTS}
    else:
        assert out.columns == docs.columns
        assert all((x["keep"], x["p_tail"]) in {(f"own {n}", n) for n in range(len(TEXTS))} and (x["spans"], x["kept"], x["shared"], x["matches"], x["n"], x["Block"]) == ("s", "k", "h", "m", "x", "b") for x in got)
        ids = sorted(x["doc_id"] or 0 for x in got)
        every = sorted(i or 0 for i, _ in TEXTS)
        want = {"quality": every, "near_duplicates": [0, *range(1, 10)], "repeated_passages": [i for i in every if i not in (1, 9, 10)], "decontaminated": [i for i in every if i != 7]}
        assert ids == want[name]
        texts = {x["doc_id"]: x["text"] for x in got}
        assert texts[2] is None and texts[3] == "" and texts[4] == " \n"
        if name == "repeated_passages":
            assert SHARED not in texts[5] and SHARED not in texts[6] and texts[8] == TEXTS[8][1]
    assert run(spark, docs.limit(0), folder).count() == 0
    slim = run(spark, docs.select("doc_id", "text"), folder)
    assert slim.count() == len(got)


def test_near_copies_are_rows_not_ids(spark, folder):
    """A repeated id with other texts loses only the copies; rows without an id stay, all of them."""
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    a, b, c = prose(80), prose(80), prose(80)
    near = c.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (5, a), (5, b), (6, near), (7, c), (7, c), (None, b), (None, b), (None, None), (None, None), (8, None), (8, ""), (9, None), (5, "one")]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    want = [(1, a), (5, b), (5, "one"), (6, near), (8, None), (8, ""), (9, None), (None, b), (None, b), (None, None), (None, None)]
    text = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(map(tuple, got.collect()), key=text) == sorted(want, key=text)


def test_short_word_runs_everywhere(spark, folder):
    """A corpus of one-letter words: runs of 51 that occur twice go, wherever they lie, and no others."""
    q = random.Random(8)
    letters = lambda n: " ".join(q.choice("abcdefgh") for _ in range(n))
    same, other, short = letters(51), letters(60), letters(50)
    rows = [(1, f"{letters(40)} {same} {letters(30)}"), (2, f"{same} {letters(9)}"), (3, f"{letters(70)} {other}"), (4, f"x{other}y {other[2:]} z"), (5, f"{short} {letters(20)}"), (6, f"{letters(20)} {short} q"), (7, "a " * 300)]
    spans = {}
    runs = {}
    for i, t in rows:
        at = [m.span() for m in re.finditer(r"[^ ]+", t)]
        for k in range(len(at) - 50):
            runs.setdefault(t[at[k][0] : at[k + 50][1]], []).append((i, at[k][0], at[k + 50][1]))
        whole = range(len(t) - 255)
        for k in whole:
            runs.setdefault(t[k : k + 256], []).append((i, k, k + 256))
    for places in runs.values():
        if len(places) > 1:
            for i, x, y in places:
                spans.setdefault(i, set()).update(range(x, y))
    want = {i: "".join(ch for k, ch in enumerate(t) if k not in spans.get(i, ())) for i, t in rows}
    stage = dict(corpus_pipeline.STAGES)["repeated_passages"]
    got = {r["doc_id"]: r["text"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder).collect()}
    assert got == {i: t for i, t in want.items() if t} and same not in got[1] and short in got[5]
