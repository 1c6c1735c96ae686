"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from datalode.llm import topk
from datalode.llm.decontaminate import mark_contaminated
from datalode.llm.jaccard import entries, similar_groups
from datalode.llm.licenses import scan_licenses
from datalode.llm.lm import language_scores
from datalode.llm.packing import OpenBins, best_fit_pack
from datalode.llm.quality import score_quality
from datalode.llm.suffixes import deep_shallow, remove_repeats, repeats
from datalode.llm.tokens import TextCounter, token_counts, vocabulary_path
from datalode.llm.topk import exact_top_k
from datalode.llm.urls import filter_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n int, matches string, length string"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(160, 1)
TEXTS = [
    (1, BASE),
    (2, BASE),
    (2, BASE),  # a repeated row
    (3, BASE.replace(BASE.split()[80], "changed", 1)),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (None, prose(50, 2)),
    (7, prose(40, 3) + " " + " ".join(BASE.split()[20:110]) + " " + prose(40, 4)),
    (8, prose(6000, 5)),
    (9, "word"),
    (10, "Ünïcode ßtraße " * 60),
    (11, "aaaa " * 400),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, "clash", "clash") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, none):
    counter = TextCounter(vocabulary_path())
    rows = token_counts(docs, budgets=(10,)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r["n_tokens"] == counter.plain_count(r["text"] or "")
        assert (r["run_tokens"] or [0])[-1] == r["n_tokens"]
    assert token_counts(none).count() == 0
    text = "Don't stop été 42!"
    assert [counter.plain_count(text[:k]) for k in range(len(text) + 1)] == counter.prefix_counts(text).tolist()
    assert counter.plain_count(text[: counter.cut(text, 3)]) <= 3


def test_packing(docs, none):
    rows = best_fit_pack(docs, length=512).collect()
    held = {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and 0 < r["length"] <= 512
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 512
    assert sum(r["piece"] == 0 for r in rows) == len(TEXTS)
    assert best_fit_pack(none).count() == 0
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 8, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 8)]


def test_best_fit_closes_the_fullest():
    bins = OpenBins(10, 2)
    bins.place(6), bins.place(7), bins.place(8)
    assert bins.open == 2 and bins.place(4) == (0, 6)


def brute_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats(docs, none, group):
    rows = remove_repeats(docs, length=256, group=group).collect()
    want = Counter(hashlib.md5(k).hexdigest() for k in brute_repeats([t for _, t in TEXTS], 256))
    assert Counter(hashlib.md5(bytes(r["kept"])).hexdigest() for r in rows) == want
    if group == 1:
        assert remove_repeats(none, length=256).count() == 0
        for r in remove_repeats(docs, length=256, characters=True).collect():
            bytes(r["kept"]).decode()


@pytest.mark.parametrize(("length", "shorter", "group"), [(3, 2, 4096), (150, 33, 1), (700, 90, 4096), (90, 300, 1)])
def test_repeats_of_any_length(docs, length, shorter, group):
    texts = [t for _, t in TEXTS]
    rows = remove_repeats(docs, length=length, shorter=shorter, group=group).collect()
    assert Counter(bytes(r["kept"]) for r in rows) == Counter(brute_repeats(texts, length))
    if shorter:
        left = lambda r: len((r["text"] or "").encode()) - sum(s["b"] - s["a"] for s in r["shared"])
        least = brute_repeats(texts, min(length, shorter))
        assert Counter(map(left, rows)) == Counter(map(len, least))


def test_repeated_words_under_the_bytes(spark):
    """Runs of 51 short words go though they have fewer bytes than a window; runs of 50 stay."""
    r = random.Random(8)
    short = lambda n: " ".join(r.choice("abcdefgh") + r.choice(["", "é"]) for _ in range(n))
    passage, less = short(60), short(50)
    assert len(passage.encode()) < 256
    texts = [f"{prose(30, i)}\n{passage} {prose(9, i + 9)} {less}" for i in range(3)] + [passage, less, short(300), None, " ".join("a" * 51), " ".join("a" * 51)]
    for _ in range(3):
        body = short(90)
        texts += [body, short(20) + " " + body[10:140] + " " + short(20)]
    ends = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    bodies = [(t or "").encode() for t in texts]
    runs = [[(e[i][0], e[i + 50][1]) for i in range(len(e) - 50)] for e in ends]
    seen = Counter(b[x:y] for b, e in zip(bodies, runs, strict=True) for x, y in e)
    seen.update(b[p : p + 256] for b in bodies for p in range(len(b) - 255))
    want = []
    for b, e in zip(bodies, runs, strict=True):
        gone = np.zeros(len(b), bool)
        for x, y in [*e, *((p, p + 256) for p in range(len(b) - 255))]:
            if seen[b[x:y]] > 1:
                gone[x:y] = True
        want.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    assert want[3] == want[7] == b"" and want[4] == less.encode() and passage.encode() not in want[0] and less.encode() in want[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [bytes(x["kept"]) for x in remove_repeats(docs, length=256, words=51).orderBy("doc_id").collect()] == want
    left = corpus_pipeline.repeated_passages(spark, docs.withColumn("n_chars", F.char_length("text").cast("long")), "").collect()
    assert {x["doc_id"]: x["text"] for x in left} == {i: None if t is None else w.decode() for i, (t, w) in enumerate(zip(texts, want, strict=True)) if w or not t}


def test_deep_shallow_and_contexts():
    r = random.Random(5)
    for _ in range(60):
        s = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 40))]
        assert [s[i] for i in deep_shallow(s, 0, 8)] == sorted(s)
    for _ in range(60):
        n = r.randint(2, 12)
        lefts = [bytes(r.choice(b"ab") for _ in range(12)) for _ in range(n)]
        rights = [b"x" * 4 + bytes(r.choice(b"ab") for _ in range(12)) for _ in range(n)]
        found = repeats(lefts, rights, 9, 4)
        for a in range(n):
            want, got = set(), set()
            for b in range(n):
                if a != b:
                    x = next((k for k in range(12) if lefts[a][k] != lefts[b][k]), 12)
                    y = next((k for k in range(16) if rights[a][k] != rights[b][k]), 16)
                    if x + y >= 9:
                        want |= set(range(-x, y - 8))
            for x, y in found[a]:
                got |= set(range(-x, y - 8))
            assert got == want


def test_groups(docs, none):
    rows = similar_groups(docs, words=5, share=(80, 100)).collect()
    got = Counter((r["doc_id"], r["component_id"]) for r in rows)
    assert got[(2, 1)] == 2 and got[(3, 1)] == 1 and got[(4, 4)] == 1 and got[(5, 5)] == 1 and got[(6, 6)] == 1 and got[(7, 7)] == 1
    assert len(rows) == len(TEXTS)
    assert similar_groups(none).count() == 0


def test_similar_sets_share_an_entry():
    r = np.random.default_rng(3)
    for n in (7, 20, 60, 150):
        for kinds in ([1], [2], [1, 2], [2, 2, 1]):
            for _ in range(20):
                missing = 15 * n // 100
                tokens = np.unique(r.integers(0, 2**64 - 1, n + missing, dtype=np.uint64))
                kind = r.choice(kinds, len(tokens)).astype(np.uint8)
                x, y = np.sort(r.choice(len(tokens), n, False)), np.arange(len(tokens))
                y = np.sort(np.concatenate([x[: n - missing], np.setdiff1d(y, x)[: r.integers(0, missing + 1)]]))
                both = len(np.intersect1d(x, y))
                if 100 * both < 85 * (len(x) + len(y) - both):
                    continue
                e = [set(entries(tokens[s], kind[s], 15 * len(s) // 100, -(-85 * len(s) // 100), 100 * len(s) // 85).tolist()) for s in (x, y)]
                assert e[0] & e[1]


def test_language_scores(docs, none):
    rows = language_scores(docs, F.col("doc_id") == 8).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] != 2}
    assert by[4]["n_tokens"] == by[5]["n_tokens"] == by[6]["n_tokens"] == 1 and by[8]["held_out"]
    assert by[1]["score"] > by[1]["base_score"]
    assert language_scores(none, F.lit(False)).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(BASE.split()[30:70])), (2, None), (3, ""), (4, "word"), (None, prose(30, 77))], "item_id long, text string")
    rows = mark_contaminated(docs, items).collect()
    found = Counter((r["doc_id"], m["item"]) for r in rows for m in r["matches"])
    assert found == {(1, 1): 1, (2, 1): 2, (3, 1): 1, (7, 1): 1, (9, 4): 1}
    assert mark_contaminated(none, items).count() == 0 and mark_contaminated(docs, items.limit(0)).count() == len(TEXTS)


def test_licenses(spark, none):
    texts = ["Under the MIT license, under the mit license", "x\nLicensed under the Apache License, Version 2.0.", None, "", "cc by nc cc-by-nc", "released under license", "Ünder the mit license"]
    rows = scan_licenses(spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id int, text string, score int")).orderBy("doc_id").collect()
    assert [r["n_base"] for r in rows] == [2, 1, 0, 0, 2, 0, 0]
    assert [(r["first_word"], r["last_word"]) for r in rows[:2]] == [(0, 4), (4, 4)]
    assert [r["labels"] for r in rows] == ["mit", "apache-2", "", "", "cc-by-nc", "", ""]
    assert scan_licenses(none).count() == 0


def test_wrapped_licenses(spark):
    """Notices over several lines, with comment signs, among other text; words too far apart are no notice."""
    mit = "# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and associated\n# documentation files"
    gpl = "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License version 3"
    bsd = "prose before it. Redistribution and use in source\n\n * and binary forms, with or without modification, are\r\npermitted provided that the following conditions are met: more"
    far = "released " + prose(30, 1) + " under\n" + prose(30, 2) + " the mit\n license"
    one = "Released under the MIT License\nnext line"
    texts = [mit, prose(90, 3) + "\n" + gpl + "\n" + prose(90, 4), bsd, far, one, "licensed\nunder\ncc\nby\nnc\n4.0", mit.replace("\n#", " "), gpl.replace("version", "or").replace("terms", "rules")]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["mit", "gpl-3", "bsd-3", "", "mit", "cc-by-nc", "mit", "gpl-3"]
    assert [r["score"] for r in rows[:6]] == [1.0, 1.0, 1.0, 0.0, 1.0, 1.0] and 0.85 <= rows[7]["score"] < 1
    assert [[(b["block"], b["last"]) for b in r["blocks"]] for r in rows if r["doc_id"] in (0, 4)] == [[(0, 2)], [(0, 0)]]


def test_licenses_on_long_lines(spark):
    """A line is no block if it is long: only words that stand together are a notice."""
    apart = f"released {prose(300, 1)} under {prose(200, 2)} the {prose(250, 3)} mit {prose(99, 4)} license"
    inside = f"{prose(200, 5)} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files {prose(200, 6)}"
    texts = [apart, inside, "first\n" + inside + "\nlast", inside.replace("obtaining", prose(40, 7))]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in rows] == [("", 0.0), ("mit", 1.0), ("mit", 1.0), ("", 0.0)]
    assert [(b["block"], b["last"]) for b in rows[2]["blocks"]] == [(1, 1)]


def test_urls(spark):
    urls = ["http://a.Example.com/en/x", "https://www.example.com/en/1", "ftp://b.net/es/", "b.net/fr/", None, "http://EXAMPLE.com?x=/en/", "http://"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 0, None), (99, None, 1)], "doc_id long, quality int, toxic int")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    rows = filter_urls(pages, labels, rules).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert rows[5]["host"] == "example.com" and rows[5]["path"] == ""
    bad = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'good'}.org/a{i}") for i in range(120)], "page_id long, url string")
    marks = bad.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("page_id") % 2).cast("int").alias("toxic"))
    got = filter_urls(bad, marks, rules).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": 60, "allow": 60}
    assert filter_urls(bad.limit(0), marks.limit(0), rules).count() == 0


def test_urls_of_any_depth(spark):
    """Folders at any depth and query keys at any place are learnt and found; few itemsets for keys that come together."""
    many = "&".join(f"k{i}=1" for i in range(30))
    urls = {
        "deep": ["http://h.org/a/b/c/{0}/x", "bad", "good"],
        "key": ["http://i.org/p?a=1&b=2&c=3&{0}=4", "spam", "fine"],
        "digits": ["http://j.org/{0}/x", "v2.1", "v3.0"],
        "many": ["http://{0}.org/?" + many, "k", "l"],
    }
    rows = [(f.format(w) + f"#{i}", i % 2) for f, *ws in urls.values() for i in range(120) for w in [ws[1 - i % 2]]]
    pages = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(rows)] + [(9999, "http://z.org/q/w/e/r/t/bad"), (9998, "http://z.org/w/good")], "page_id long, url string")
    marks = spark.createDataFrame([(n, 1, bad) for n, (_, bad) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in filter_urls(pages, marks, []).collect()}
    assert [got[n]["verdict"] for n in range(len(rows))] == ["block" if bad else "allow" for _, bad in rows]
    assert (got[9999]["verdict"], got[9999]["mined_tokens"], got[9998]["verdict"]) == ("block", ["folder:bad"], "allow")


def test_mined_rules_are_those_of_all_itemsets(spark):
    r = random.Random(21)
    rows = []
    for i in range(300):
        keys = [k for k in "abcd" if r.random() < 0.5]
        keys += ["e", "f"] if "a" in keys else []  # e and f lie in the rows of a
        rows.append((i, f"http://h.org/?{'&'.join(keys)}", int(r.random() < (0.95 if {"b", "a"} <= set(keys) else 0.3))))
    rows += [(300, "http://h.org/?b&f", 0), (301, "http://h.org/?e&b&c", 0)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    marks = spark.createDataFrame([(i, 1, bad) for i, _, bad in rows[:300]], "doc_id long, quality int, toxic int")
    got = filter_urls(pages, marks, [], confidence=0.6, least=25, lift=0.0, z=0.0).collect()
    common = {"scheme:http", "host:h.org", "site:h.org", "zone:org"}
    sets = {i: common | {f"key:{k}" for k in u.split("?")[1].split("&") if k} for i, u, _ in rows}
    rules = {}
    for n in range(1, 11):
        for c in combinations(sorted(set().union(*sets.values())), n):
            bads = [bad for i, _, bad in rows[:300] if sets[i] >= set(c)]
            if sum(bads) >= 25 and sum(bads) / len(bads) >= 0.6 and not any(set(x) < set(c) and rules[x] >= sum(bads) / len(bads) for x in rules):
                rules[c] = sum(bads) / len(bads)
    assert rules
    for g in got:
        best = max(((p, list(c)) for c, p in rules.items() if sets[g["page_id"]] >= set(c)), default=(None, None))
        assert (g["mined_confidence"], g["mined_tokens"]) == (pytest.approx(best[0]) if best[0] else None, best[1])


def test_top_k(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) * (1 + i % 3) for _ in range(8)]) for i in range(300)]
    rows += [(400, None), (450, [float("nan")] * 8), (500, [None] * 8), (301, rows[0][1]), (302, rows[0][1])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v and None not in v and not any(np.isnan(v))}
    for q in (i for i in whole if i % 50 == 0):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:3]
        assert [(-x["score"], x["vec_id"]) for x in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_prunes(spark, monkeypatch):
    """Unit vectors: most rows are passed over, none that counts is; queries in blocks, repeated ids, unlike widths."""
    g = np.random.default_rng(5)
    v = g.normal(size=(3000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True))
    lengths = np.linalg.norm(v, axis=1)
    v = v[np.argsort(-lengths, kind="stable")]
    asked = topk.Queries(v[:100])
    need = np.sort(v[:100] @ v.T, axis=1)[:, -6]
    keep = asked.survivors(np.arange(100), v, np.sort(lengths)[::-1], need)
    assert keep.mean() < 0.1 and keep[v[:100] @ v.T >= need[:, None]].all()
    monkeypatch.setattr(topk, "QUERY_BLOCK", 9)
    rows = [(i, x.tolist()[: 64 if i % 7 else 40]) for i, x in enumerate((v / 256)[:900])] + [(50, (v[7] / 256).tolist()), (50, (v[8] / 256).tolist()), (51, (v[50] / 256).tolist())]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), k=4, every=50).collect()
    whole = [(i, [int(math.floor(256 * x)) for x in e]) for i, e in rows]
    for q in range(0, 900, 50):
        own = min(e for i, e in whole if i == q)
        want = sorted((-sum(a * b for a, b in zip(own, e, strict=False)), i) for i, e in whole if i != q)[:4]
        assert [(-x["score"], x["vec_id"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == want
    assert len(got) == 18 * 4


def test_quality(spark, docs, none):
    r = random.Random(9)
    rows = []
    for i in range(3000):
        words = [r.choice(WORDS[:300]) for _ in range(40)]
        grade = i % 3
        words += {0: ["nasty"] * 2, 1: ["###"] * 30, 2: []}[grade]
        r.shuffle(words)
        rows.append((i, " ".join(words), grade))
    data = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    out = score_quality(data.select("doc_id", "text", F.lit("x").alias("keep")), data.select("doc_id", "grade").where("doc_id < 2500"))
    held = out.join(data.select("doc_id", "grade"), "doc_id").where("doc_id >= 2500").collect()
    assert sum((x["grade"] == 2) == x["keep"] for x in held) > 0.95 * len(held)
    assert score_quality(docs, data.select("doc_id", "grade").limit(0)).count() == len(TEXTS)
    assert score_quality(none, data.select("doc_id", "grade")).count() == 0


def test_quality_without_usable_labels_keeps_every_row(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, grade int")
    for labels in (empty, spark.createDataFrame([(1, None)], empty.schema), spark.createDataFrame([(-5, 2), (None, 1)], empty.schema)):
        for tail in (0.5, 0.9):
            rows = score_quality(docs, labels, tail=tail).collect()
            assert len(rows) == len(TEXTS) and all(x["keep"] for x in rows)
    assert score_quality(none, empty).count() == 0


def test_words_split_like_the_pattern():
    from datalode.llm.common import chunks_of, word_hashes
    import pyarrow as pa

    text = "A\tbé  c\x0bd\xa0e\n"
    for _, _, data, offsets in chunks_of(pa.array([text, None, "a"])):
        _, rows, h = word_hashes(data, offsets)
    assert Counter(rows.tolist()) == {0: len(re.findall(r"[^\x20\x09-\x0D]+", text)), 2: 1}
    assert h[0] == h[-1]
