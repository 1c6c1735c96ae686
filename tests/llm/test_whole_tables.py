"""Registered queries without a SQL twin, and the pipeline's stages, against brute force on whole tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from datalode.llm import queries as Q
from datalode.llm.quality import graded, score_quality
from datalode.llm.tokens import vocabulary_path
from datalode.llm.urls import filter_urls

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the given tables")

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def runs(ws, k):
    """Shingles of k words; the whole sequence where there are fewer."""
    return [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else [tuple(ws)] if ws else []


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def brute_groups(documents, k, num, den):
    sets = {i: frozenset(runs(words(t), k)) for i, t in documents.items()}
    holders, common, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i in sorted(sets):
        for s in sets[i]:
            common.update((j, i) for j in holders[s])
            holders[s].append(i)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), both in common.items():
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def brute_spans(documents, length):
    """Maximal runs of bytes that are covered by a repeated string."""
    bodies = {i: (t or "").encode() for i, t in documents.items()}
    seen = Counter(hash(b[p : p + length]) for b in bodies.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in bodies.items():
        spans = []
        for p in range(len(b) - length + 1):
            if seen[hash(b[p : p + length])] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        out[i] = spans
    return bodies, out


def with_word_runs(bodies, spans, n):
    """The spans joined with those of repeated runs of ``n`` words."""
    ends = {i: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for i, b in bodies.items()}
    runs = {i: [(e[k][0], e[k + n - 1][1]) for k in range(len(e) - n + 1)] for i, e in ends.items()}
    seen = Counter(bodies[i][a:b] for i, own in runs.items() for a, b in own)
    out = {}
    for i, body in bodies.items():
        gone = np.zeros(len(body) + 2, bool)
        for a, b in [*spans[i], *((a, b) for a, b in runs[i] if seen[body[a:b]] > 1)]:
            gone[a + 1 : b + 1] = True
        out[i] = np.flatnonzero(np.diff(gone)).reshape(-1, 2).tolist()
    return out


def rest(body, spans):
    gone = np.zeros(len(body), bool)
    for a, b in spans:
        gone[a:b] = True
    return np.frombuffer(body, np.uint8)[~gone].tobytes()


def brute_matches(documents, items, k=5, threshold=0.8):
    """The best window of every item in every document: windows that share a shingle, compared by counts."""
    out = {}
    for item, text in items.items():
        ws = words(text)
        size = min(k, len(ws))
        want = runs(ws, size)
        known, n = Counter(want), len(want)
        for doc, body in documents.items():
            own = runs(words(body), size)
            most = min(n, len(own))
            starts = {s for at, x in enumerate(own) if x in known for s in range(max(0, at - most + 1), min(at, len(own) - most) + 1)}
            best = None
            for s in sorted(starts):
                window = Counter(own[s : s + most])
                both = sum((window & known).values())
                share = both / (n + most - both)
                if share >= threshold and (best is None or share > best[0]):
                    best = (share, s)
            if best:
                out[doc, item] = best
    return out


def test_decontamination(spark, documents, items):
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in Q.op1_decontamination(spark, SF).collect()}
    want = brute_matches(documents, items)
    assert want and got.keys() == want.keys()
    for key, (share, start) in want.items():
        assert got[key] == (pytest.approx(share), start)


def parts_of(url):
    """Host, path and tokens of a URL."""
    url = url or ""
    after = url.split("://", 1)[1] if "://" in url else ""
    host = re.match("[^/?#]*", after)[0]
    path = re.match("[^?#]*", after[len(host) :])[0]
    host = host.translate(UPPER)
    labels = host.split(".")
    query = re.match(r"[^?#]*\?([^#]*)", url)
    keys = [x.split("=")[0] for x in query[1].split("&")] if query else []
    ending = re.search(r"\.([A-Za-z]{1,5})$", path)
    tokens = {("scheme", url.split("://")[0]), ("host", host), ("site", ".".join(labels[-2:])), ("zone", labels[-1]), ("ending", ending[1] if ending else "")}
    tokens |= {("part", x) for x in labels[:-1]} | {("folder", x) for x in path.split("/")} | {("key", x) for x in keys}
    return host, path, frozenset(f"{k}:{x}" for k, x in tokens if x) | ({"fragment"} if "#" in url else set()) if host else frozenset()


def brute_rules(rows, support, least, lift, error):
    """Every combination of tokens of the labelled rows, counted; the error is shared out to those that are frequent among bad rows."""
    n = len(rows)
    share = sum(b for _, b in rows) / max(n, 1)
    least = max(least, math.ceil(support * n - 1e-9))
    single = Counter(t for ts, b in rows if b for t in ts)
    often = {t for t, c in single.items() if c >= least}
    held, bad = Counter(), Counter()
    for ts, b in rows:
        own = sorted(ts & often)
        for size in range(1, len(own) + 1):
            for c in combinations(own, size):
                held[c] += 1
                bad[c] += b
    # tokens that lie in the same rows are tried once
    places = defaultdict(set)
    for i, (ts, _) in enumerate(rows):
        for t in ts:
            places[t].add(i)
    first = {frozenset(p): t for t, p in sorted(places.items(), reverse=True)}
    tried = sum(k >= least and all(first[frozenset(places[t])] == t for t in c) for c, k in bad.items())
    z = NormalDist().inv_cdf(1 - error / max(1, tried))
    out = {}
    for c, k in bad.items():
        m = held[c]
        p = k / m
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        if k >= least and p >= lift * share and low > share:
            out[frozenset(c)] = p
    return out


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_url_filters(spark, folder):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    parts = {i: parts_of(u) for i, u in pages.items()}
    mined = brute_rules([(parts[x["doc_id"]][2], x["toxic"] == 1 or x["quality"] == 0) for x in labels if x["doc_id"] in pages and parts[x["doc_id"]][2]], 0.002, 5, 1.25, 0.05)
    rows = Q.op2_url_filters(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, tokens = parts[r["page_id"]]
        fit = [x for x in Q.URL_RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        verdict, h, p = max(fit, key=lambda x: len(x[1]) + len(x[2])) if fit else (None, None, None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, h and h + p)
        sure = max((c for t, c in mined.items() if t <= tokens), default=None)
        assert (r["mined_rule"] is None) == (sure is None)
        if sure is not None:
            assert any(c == sure and t <= tokens for t, c in mined.items() if t == frozenset(r["mined_rule"].split(" ")))
        assert r["verdict"] == (verdict or ("block" if sure is not None else "allow"))


def test_rules_are_not_chance(spark):
    """Labels that are dealt anew to the pages give no rules; labels that follow a folder do."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    labels = [(r["doc_id"], int(r["toxic"] == 1 or r["quality"] == 0)) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()]
    r, fired = random.Random(1), 0
    for _ in range(3):
        marks = [b for _, b in labels]
        r.shuffle(marks)
        dealt = spark.createDataFrame([(i, 1, b) for (i, _), b in zip(labels, marks, strict=True)], "doc_id long, quality int, toxic int")
        fired += filter_urls(pages, dealt, []).where("verdict = 'block'").count() > 0
    assert fired <= 1
    planted = spark.createDataFrame([(i, 1, int(r.random() < (0.6 if "/de/" in (urls.get(i) or "") else 0.2))) for i, _ in labels], "doc_id long, quality int, toxic int")
    got = filter_urls(pages, planted, []).where("verdict = 'block'").collect()
    assert sum("/de/" in x["url"] for x in got) > 0.9 * len(got) > 100


def test_language_scores(spark, documents):
    tokens = {i: [*words(t), None] for i, t in documents.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in Q.op4_language_scores(spark, SF).collect()}
    assert rows.keys() == tokens.keys()
    for i, ws in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws))
        assert -math.inf < r["score"] < 0
    unseen = [i for i in rows if held[i]]
    assert sum(rows[i]["score"] for i in unseen) > sum(rows[i]["base_score"] for i in unseen)
    # the same model with exact counts: quantised ones and shared ratios cost less than 0.01 a token
    pairs = Counter(p for i, ws in tokens.items() if not held[i] for p in zip([0, *ws[:-1]], ws, strict=True))
    before, after = Counter(), Counter()
    for (a, _), n in pairs.items():
        before[a] += n
        after[a] += 1
    exact = 0.0
    for i in unseen:
        for a, b in zip([0, *tokens[i][:-1]], tokens[i], strict=True):
            single, f = (counts[b] + 1) / (total + kinds + 1), 2 * after[a]
            exact += math.log10((pairs[a, b] + f * single) / (before[a] + f) if before[a] else single)
    assert abs(exact - sum(rows[i]["score"] for i in unseen)) < 0.01 * sum(len(tokens[i]) for i in unseen)


def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", graded(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = score_quality(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").collect()
    good = [r["p_tail"] for r in scored if r["grade"] == 2]
    bad = [r["p_tail"] for r in scored if r["grade"] < 2]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(good) > 50 and len(bad) > 10 and auc > 0.8
    for r in scored:
        assert 0 <= r["p_tail"] <= 1 and r["p_tail"] <= r["expected_grade"] <= 2 and r["keep"] == (r["p_tail"] >= 0.5)


def test_suffix_dedup(spark, documents):
    bodies, spans = brute_spans(documents, 400)
    _, shared = brute_spans(documents, Q.SHARED_BYTES)
    rows = Q.op7_suffix_dedup(spark, SF).collect()
    assert len(rows) == len(documents) and any(spans.values())
    for r in rows:
        body, own = bodies[r["doc_id"]], spans[r["doc_id"]]
        kept = rest(body, own)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(body), len(body) - len(kept), len(own))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert r["n_shared"] == len(body) - len(rest(body, shared[r["doc_id"]])) >= r["n_removed"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_packing(spark, documents, library):
    rows = Q.op8_best_fit_packing(spark, SF).collect()
    held, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    total = 0
    for i, t in documents.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        assert sorted(pieces[i]) == [(k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    for own in held.values():
        ends = np.cumsum([0, *(n for _, n in sorted(own))]).tolist()
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
    assert len(held) <= 1.1 * math.ceil(total / 4096) + 1


def test_token_counts(spark, documents, library):
    rows = Q.op9_token_counts(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        t = documents[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)
        runs = t.split()
        assert (r["words_within"] == len(runs)) == (n <= 2048)
        if n > 2048:
            within = lambda k: len(library.encode(" ".join(runs[:k]), add_special_tokens=False).ids) <= 2048  # noqa: B023,E731
            assert within(r["words_within"]) and not within(r["words_within"] + 1)


def test_similar_groups(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op10_ngram_jaccard(spark, SF).collect()}
    want = brute_groups(documents, 4, 85, 100)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_pipeline_stages(spark, items):
    """Each stage on all that its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == docs.columns
    before = texts(kept)
    assert before.items() <= texts(docs).items()

    single = stages["near_duplicates"](spark, kept, SF)
    now = texts(single)
    assert single.columns == docs.columns
    assert now == {i: before[i] for i, (_, c) in brute_groups(before, 5, 80, 100).items() if i == c}

    cut = stages["repeated_passages"](spark, single, SF)
    bodies, spans = brute_spans(now, corpus_pipeline.REPEATED_BYTES)
    spans = with_word_runs(bodies, spans, corpus_pipeline.REPEATED_WORDS)
    want = {}
    for i, body in bodies.items():
        tail = lambda at: at < len(body) and 0x80 <= body[at] < 0xC0  # noqa: B023,E731
        whole = []
        for a, b in spans[i]:
            while tail(a):
                a += 1
            while tail(b):
                b -= 1
            whole.append((a, b))
        text = rest(body, whole).decode()
        if text or not spans[i]:
            want[i] = text
    after = texts(cut)
    assert cut.columns == docs.columns and after == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where(F.col("doc_id").isin([i for i in want if spans[i]])).collect())

    clean = stages["decontaminated"](spark, cut, SF)
    leaks = {d for d, _ in brute_matches(after, items)}
    assert clean.columns == docs.columns and texts(clean) == {i: t for i, t in after.items() if i not in leaks}

    rows = stages["packed"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in rows} == after.keys() - leaks
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(rows)
