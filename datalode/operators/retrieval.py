"""Retrieval for many queries at once: BM25, cosine search, rank fusion, reranking and context packing."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalode.sources.shared import small, written

#: BM25 and fusion constants (fixed values).
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
DIVIDER = "\n" + "─" * 50 + "\n"


def words(text: Column) -> Column:
    """Lower-cased runs without white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def postings(chunks: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunk_id, term, tf and the chunk's length; one row per term of a chunk. Written once: the corpus is split into words once."""
    # the words are a column of their own, else their number would be worked out again for every word
    one = chunks.select(F.col(id).alias("chunk_id"), words(F.col(text)).alias("w"))
    one = one.select("chunk_id", F.size("w").cast("long").alias("length"), F.explode("w").alias("term"))
    return written(one.groupBy("chunk_id", "length", "term").agg(F.count("*").alias("tf")).select("chunk_id", "term", "tf", "length"), "postings")


def corpus_statistics(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: number of chunks and average length, by their postings."""
    words_of_all = terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"), F.lit(0).alias("k"))
    n = chunks.agg(F.count("*").alias("n"), F.lit(0).alias("k"))
    return n.join(F.broadcast(words_of_all), "k").select("n", (F.col("words") / F.greatest("n", F.lit(1))).alias("average"))  # one row each


def inverse_frequencies(terms: DataFrame, statistics: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """term, idf: ln((n - df + .5) / (df + .5)); negative ones become epsilon times the mean over all terms."""
    df = written(terms.groupBy("term").agg(F.count("*").alias("df")), "terms")
    raw = df.withColumn("k", F.lit(0)).join(F.broadcast(statistics.withColumn("k", F.lit(0))), "k")
    raw = raw.select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"), F.lit(0).alias("k"))
    joined = raw.withColumn("k", F.lit(0)).join(F.broadcast(mean), "k")
    return joined.select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, id: str = "chunk_id", text: str = "text", query_text: str = "text") -> DataFrame:
    """query_id, chunk_id, score (9 digits) for every chunk that scores above zero.

    Query terms count as often as they occur. Postings are cut to the terms of queries before scoring."""
    terms = postings(chunks, id, text)
    statistics = written(corpus_statistics(chunks, terms), "statistics")
    asked = queries.select("query_id", F.explode(words(F.col(query_text))).alias("term"))
    asked = written(asked.groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")
    idf = inverse_frequencies(terms, statistics).join(asked.select("term").distinct(), "term", "left_semi")
    wanted = terms.join(idf, "term").withColumn("k", F.lit(0)).join(F.broadcast(statistics.withColumn("k", F.lit(0))), "k")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scored = wanted.select("chunk_id", "term", weight.alias("w")).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("times")), 9).alias("score"))
    return scored.where("score > 0")


def top_k(scored: DataFrame, k: int, score: str = "score", id: str = "chunk_id") -> DataFrame:
    """The k best of each query with ``rank`` from 1; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalised(scored: DataFrame, score: str = "score") -> DataFrame:
    """Scores by the query's largest one (by 1 where that is not above zero)."""
    top = F.max(score).over(Window.partitionBy("query_id"))
    return scored.withColumn("normalised", F.round(F.col(score) / F.when(top > 0, top).otherwise(1.0), 9))


#: Texts that an embedder gets at once (fixed value).
EMBED_BATCH = 100


def hashed_vectors(texts: list[str], dimension: int) -> list[list[float]]:
    """The default embedder: words hashed to signed places, scaled to length one; zeros without words."""
    out = np.zeros((len(texts), dimension))
    for row, text in enumerate(texts):
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            out[row, h % dimension] += 1 if h >> 31 else -1
        if text.split() and not out[row].any():  # words that cancel out
            out[row, zlib.crc32(text.encode()) % dimension] = 1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)).tolist()


def embedded(chunks: DataFrame, dimension: int, embed: Callable[[list[str], int], list[list[float]]] = hashed_vectors, text: str = "text", tries: int = 3) -> DataFrame:
    """Adds ``embedding`` by a hook that gets 100 texts at once; a batch that fails is tried again, a wrong dimension is an error.

    Null texts are empty. The hook is loaded once for each worker; rows stay where they are."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    place = chunks.columns.index(text)

    def one(texts: list[str]) -> list[list[float]]:
        for left in reversed(range(tries)):
            try:
                out = embed(texts, dimension)
                break
            except Exception:
                if not left:
                    raise
        if len(out) != len(texts) or any(len(v) != dimension for v in out):
            raise ValueError(f"the embedder must give {len(texts)} vectors of {dimension} numbers")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [t or "" for t in b.column(place).to_pylist()]
            vectors = [v for a in range(0, len(texts), EMBED_BATCH) for v in one(texts[a : a + EMBED_BATCH])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names, "embedding"])

    return chunks.mapInArrow(run, schema)


def fused(dense: DataFrame, sparse: DataFrame, k: int, hydrate_sparse: bool = False) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; the cut to ``k`` comes before sparse-only rows are dropped."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dr"))
    s = sparse.select("query_id", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sr"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    both = both.withColumn("fused_score", F.round(part("dr") + part("sr"), 9))
    cut = top_k(both, k, "fused_score").withColumn("sparse_score", F.coalesce("sparse_score", F.lit(0.0)))
    return (cut if hydrate_sparse else cut.where("dr is not null")).select("query_id", "chunk_id", "dense_score", "sparse_score", "fused_score", "rank")


def relevance_floor(found: DataFrame, floor: float, score: str = "dense_score") -> DataFrame:
    """Without rows whose score is above zero but under the floor."""
    return found.where(F.col(score).isNull() | (F.col(score) <= 0) | (F.col(score) >= floor))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of a query's different words that a text has: the default reranker."""
    q = F.array_distinct(words(query))
    return F.round(F.size(F.array_intersect(q, words(text))) / F.greatest(F.size(q), F.lit(1)), 9)


def reranked(found: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The k best of each query by ``score`` (default: the words of ``query_text`` in ``text``, then fusion)."""
    score = overlap_score(F.col("query_text"), F.col("text")) if score is None else score
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("fused_score"), "chunk_id")
    return found.withColumn("rerank_score", score).withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


@F.pandas_udf(T.StringType())
def two_digits(score: pd.Series) -> pd.Series:
    """Two digits of the exact value, halves to even, as C and SQL print them (Spark's format_string gives 0.13 for 0.125)."""
    return score.map("{:.2f}".format)


def context_header(label: Column, filename: Column, page: Column, kind: Column, score: Column) -> Column:
    """The two header lines of a packed source."""
    place = F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit("p."), page.cast("string"))).otherwise("n.p.")
    return F.concat(
        F.lit("["), label, F.lit("] — "), filename, F.lit(" ("), place, F.lit(") | "), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))),
        F.lit("\nRelevance: "), F.coalesce(F.when(score.isNotNull(), two_digits(score.cast("double"))), F.lit("null")), F.lit("\n"),
    )


def packed_context(found: DataFrame, budget: int = 4000) -> DataFrame:
    """One row per query: context, labels, total_tokens, included and excluded.

    Rows (query_id, chunk_id, final_rank, text, source_filename, page_number, chunk_type, rerank_score) are
    taken in order of rank, the first of each chunk. A section that does not fit is left out and later
    ones may still fit; labels are places among the different chunks, so they can have gaps."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("final_rank")
    place = Window.partitionBy("query_id").orderBy("final_rank")
    rows = found.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("place", F.row_number().over(place))
    label = F.concat(F.lit("Source "), F.col("place").cast("string"))
    section = F.concat(context_header(label, F.col("source_filename"), F.col("page_number"), F.col("chunk_type"), F.col("rerank_score")), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = rows.select("query_id", "place", label.alias("label"), section.alias("section")).withColumn("tokens", F.size(words(F.col("section"))).cast("long"))
    held = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "section", "tokens"))).alias("rows"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).cast("long").alias("total"), none.alias("sections"), none.alias("labels"))
    add = lambda acc, x: F.when(
        acc["total"] + x["tokens"] <= budget,
        F.struct((acc["total"] + x["tokens"]).alias("total"), F.array_append(acc["sections"], x["section"]).alias("sections"), F.array_append(acc["labels"], x["label"]).alias("labels")),
    ).otherwise(acc)
    done = held.withColumn("acc", F.aggregate("rows", start, add))
    return done.select(
        "query_id", F.array_join("acc.sections", DIVIDER).alias("context"), F.array_join("acc.labels", ",").alias("labels"), F.col("acc.total").alias("total_tokens"),
        F.size("acc.labels").cast("long").alias("included"), (F.size("rows") - F.size("acc.labels")).cast("long").alias("excluded"),
    )


def citations(found: DataFrame) -> DataFrame:
    """One citation per query and chunk: confidence in [0, 1] to 4 digits, 300 characters, page 0 as null."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("final_rank")
    rows = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select(
        "query_id", "final_rank", F.col("doc_id").alias("source_id"), "chunk_id", F.nullif(F.col("page_number"), F.lit(0)).alias("page_number"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rerank_score"))), 4).alias("confidence_score"), F.trim(F.substring("text", 1, 300)).alias("excerpt"), "source_filename",
    )
