"""Keywords with their tie order, summaries with and without a hook, chunk counts of another vocabulary, and ingestion counts."""

from __future__ import annotations

import datetime as dt

from datalode.functions import text as X
from datalode.operators import chunks as C


def test_keywords_in_order(spark):
    texts = ["zeta alpha zeta alpha beta the gamma", "short", None, "", "the and with from", "data-set x1y data-set, 99x ab cde"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: [tuple(k) for k in r["keywords"]] for r in X.keywords(rows, 5).collect()}
    # pairs count thrice, equal weights go by first place, words before pairs
    assert got[0] == [("zeta alpha", 6), ("alpha zeta", 3), ("alpha beta", 3), ("zeta", 2), ("alpha", 2)]
    assert got[1] == got[2] == got[3] == got[4] == []
    assert got[5] == [("data-set x1y", 3), ("x1y data-set", 3), ("data-set cde", 3), ("data-set", 2), ("x1y", 1)]
    assert X.keywords(rows.limit(0)).count() == 0


def test_summaries(spark):
    rows = spark.createDataFrame([(i, f"This is text {i}. And more.") for i in range(25)] + [(25, None)], "i int, text string").coalesce(1)
    sizes = []

    def hook(texts):
        sizes.append(len(texts))
        if any(t.startswith("This is text 13.") for t in texts):
            raise ValueError("no answer")
        return ["" if t.startswith("This is text 3.") else t[-5:] for t in texts]

    plain = {r["i"]: r["summary"] for r in X.summarised(rows).collect()}
    got = {r["i"]: r["summary"] for r in X.summarised(rows, hook).collect()}
    assert plain[4] == "This is text 4." and plain[25] == ""
    # a batch that fails, and a text with nothing to say, get the first sentence
    assert {i for i in range(25) if got[i] == plain[i]} == {3, *range(10, 20)} and got[4] == "more."
    assert X.summarised(rows, lambda texts: texts[:1]).where("i = 7").first()["summary"] == plain[7]


def test_another_vocabulary(spark):
    class Letters(C.Words):
        """A vocabulary in which every letter is a token."""

        def count(self, text):
            return len(text)

        def first(self, text, n):
            return text[:n]

        def last(self, text, n):
            return text[-n:]

    elements = spark.createDataFrame([(1, 0, "paragraph", "abcdefgh"), (1, 1, "paragraph", "ij"), (1, 2, "paragraph", "x" * 30)], "doc_id int, ord int, element_type string, text string")
    got = C.typed_chunks(elements, most=10, overlap=3, least=2, tokens=Letters()).orderBy("seq").collect()
    assert [(r["text"], r["token_count"]) for r in got] == [("abcdefgh\n\nij", 12), ("x" * 10, 10)]


def test_ingestion_counts(spark):
    at = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    chunks = spark.createDataFrame([(1, "table_json", 3, False, [1.0], at, at + dt.timedelta(seconds=2)), (1, "narrative_text", 2, True, None, at + dt.timedelta(seconds=1), at + dt.timedelta(seconds=4.5))], "doc_id int, chunk_type string, page_number int, has_pii boolean, embedding array<double>, started timestamp, ended timestamp")
    got = {r["doc_id"]: r.asDict() for r in C.ingestion_summary(docs, chunks).collect()}
    assert got[1] == {"doc_id": 1, "upserted": 1, "seconds": 4.5, "chunks": 2, "pages": 3, "had_pii": True, "vision_chunks": 0, "table_chunks": 1, "status": "complete"}
    assert got[2]["status"] == "failed" and got[2]["upserted"] == 0 and got[2]["seconds"] == 0
    assert "upserted" not in C.ingestion_summary(docs, chunks.drop("embedding", "started")).columns
