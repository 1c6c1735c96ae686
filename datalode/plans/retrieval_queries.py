"""Retrieval queries: every benchmark item, or every 50th vector, against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.operators import retrieval as R
from datalode.operators.bm25 import bm25_top
from datalode.operators.vectors import cached_steps, nearest
from datalode.plans.registry import query, table
from datalode.sources.postings import PostingIndex
from datalode.sources.shared import scratch, written

TOKENS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '\s+'), lambda w: w <> '')"


def _bm25_sql(queries: str, documents: str = "documents") -> str:
    """CTEs up to ``sparse`` (query_id, chunk_id, score) for a query table (query_id, text)."""
    return f"""
    c AS (SELECT doc_id AS chunk_id, {TOKENS.format("text")} AS w FROM {documents}),
    st AS (SELECT count(*) AS n, avg(len(w)) AS average FROM c),
    p AS (SELECT chunk_id, term, count(*) AS tf, any_value(length) AS length
          FROM (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM c) GROUP BY ALL),
    raw AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS r FROM p, st GROUP BY term, n),
    idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS term FROM {queries}) GROUP BY ALL),
    sparse AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 9) AS score
               FROM qt JOIN p USING (term) JOIN idf USING (term), st GROUP BY ALL HAVING round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 9) > 0)"""


@query(
    "bm25_topk",
    f"""WITH q AS (SELECT item_id AS query_id, text FROM benchmark), {_bm25_sql("q")},
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sparse),
    t AS (SELECT * FROM k WHERE rank <= 20)
    SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank, round(score / max(score) OVER (PARTITION BY query_id), 9) AS normalised FROM t""",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.normalised(bm25_top(chunks, queries, 20)).select("query_id", "chunk_id", "score", "rank", "normalised")


@query(
    "growing_index",
    f"""WITH q AS (SELECT item_id AS query_id, text FROM benchmark), live AS (SELECT doc_id, text FROM documents WHERE source = (SELECT max(source) FROM documents) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    {_bm25_sql("q", "live")}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sparse)
    SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""",
)
def growing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all tenants made by three appends, less the toxic documents, asked by every benchmark item for the last tenant."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), "text")
    index = PostingIndex(spark, scratch(spark, "index"))
    for part in range(3):
        index.append(docs.where(F.col("chunk_id") % 3 <= part))  # rows that are there already are passed over
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    index.erase(docs.join(toxic, "chunk_id", "left_semi").select("tenant_id", "chunk_id"))
    tenant = docs.agg(F.max("tenant_id")).first()[0] or ""
    return index.search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10, tenant).select("query_id", "chunk_id", "score", "rank")


@query(
    "corpus_statistics",
    f"""WITH c AS (SELECT source AS tenant_id, doc_id, {TOKENS.format("text")} AS w FROM documents),
    t AS (SELECT tenant_id, count(DISTINCT term) AS terms, count(*) AS tokens FROM (SELECT tenant_id, unnest(w) AS term FROM c) GROUP BY 1)
    SELECT tenant_id, count(*) AS chunks, round(avg(len(w)), 6) AS average_length, max(len(w)) AS longest, any_value(terms) AS terms, any_value(tokens) AS tokens
    FROM c JOIN t USING (tenant_id) GROUP BY 1""",
)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tenant chunks, lengths, different terms and tokens."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), R.words(F.col("text")).alias("w"))
    chunks = chunks.withColumn("n", F.size("w").cast("long"))
    sizes = chunks.groupBy("tenant_id").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("average_length"), F.max("n").alias("longest"))
    terms = chunks.select("tenant_id", F.explode("w").alias("term")).groupBy("tenant_id", "term").agg(F.count("*").alias("tf"))
    return sizes.join(terms.groupBy("tenant_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens")), "tenant_id")


_DENSE = """
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    dense AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 9) AS score
              FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"""


def _top(name: str, of: str, k: int, order: str = "score") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order} DESC, chunk_id) AS rank FROM {of}) WHERE rank <= {k})"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors, vectors.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")


@query("dense_topk", f"WITH {_DENSE}, {_top('t', 'dense', 20)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM t")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 50th."""
    return nearest(*_vectors(spark, sf_dir), 20)


@query(
    "cache_steps",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, ts, event_type FROM embeddings JOIN events ON event_id = vec_id),
    s AS (SELECT q.vec_id AS query_id, n.vec_id AS entry_id, round(list_cosine_similarity(q.e, n.e), 9) AS score FROM v q JOIN v n
          ON q.vec_id <> n.vec_id AND n.ts <= q.ts AND q.ts < n.ts + INTERVAL 24 HOURS AND q.event_type = n.event_type)
    SELECT query_id, arg_max(entry_id, (score, -entry_id)) AS entry_id, max(score) AS score FROM s WHERE score >= 0.2 GROUP BY 1""",
)
def cache_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all entries of the request's theme that live a day from their event on, if near enough (0.2 on these data)."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "ts", F.col("event_type").alias("theme"))
    rows = written(table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(events, "vec_id"), "steps")
    entries = rows.select(F.col("vec_id").alias("entry_id"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), "theme", "embedding")
    return cached_steps(rows.withColumnRenamed("vec_id", "query_id"), entries, 0.2, with_theme=True).select("query_id", "entry_id", "score")


@query("embedding_check", "SELECT len(embedding) AS dimension, len(embedding) = 64 AS ok, count(*) AS n FROM embeddings GROUP BY ALL")
def embedding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors by dimension, and whether it is the expected one."""
    size = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").groupBy(size.alias("dimension"), (size == 64).alias("ok")).agg(F.count("*").alias("n"))


_HYBRID = f"""{_DENSE}, qd AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)),
    {_bm25_sql("qd")}, sp AS (SELECT * FROM sparse WHERE query_id <> chunk_id), {_top("d20", "dense", 20)}, {_top("s20", "sp", 20)},
    f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.score AS dense_score,
                 coalesce(s.score, 0.0) AS sparse_score, d.rank AS dr,
                 round(coalesce(1.0::DOUBLE / (60 + d.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0.0), 9) AS fused_score
          FROM d20 d FULL JOIN s20 s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
    {_top("f20", "f", 20, "fused_score")},
    fused AS (SELECT query_id, chunk_id, dense_score, sparse_score, fused_score, CAST(rank AS INTEGER) AS rank FROM f20 WHERE dr IS NOT NULL)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = docs.join(queries.select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "query_id")
    return R.fused(nearest(vectors, queries, 20), bm25_top(docs, asked, 20, distinct=True), 20)


@query("rrf_fuse", f"WITH {_HYBRID} SELECT * FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings fused; documents found by words alone are dropped after the cut."""
    return _hybrid(spark, sf_dir)


@query("relevance_floor", f"WITH {_HYBRID} SELECT * FROM fused WHERE dense_score IS NULL OR dense_score <= 0 OR dense_score >= 0.2")
def relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused rows without those of a low positive cosine."""
    return R.relevance_floor(_hybrid(spark, sf_dir), 0.2)


@query("tenant_search", f"""WITH {_DENSE}, r AS (SELECT query_id, chunk_id, score FROM dense JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = chunk_id AND a.source = b.source),
    {_top("t", "r", 5)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM t""")
def tenant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors among the documents of the query's own tenant."""
    vectors, queries = _vectors(spark, sf_dir)
    tenants = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return nearest(vectors.join(tenants, "chunk_id"), queries.join(tenants.withColumnRenamed("chunk_id", "query_id"), "query_id"), 5, group="source")


@query(
    "document_search",
    f"""WITH {_DENSE}, r AS (SELECT query_id, chunk_id, score FROM dense JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = chunk_id AND a.source = b.source
    WHERE b.lang = 'en'), {_top("t", "r", 5)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM t""",
)
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As tenant_search, restricted to selected documents (those in English)."""
    vectors, queries = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    tenants = docs.select(F.col("doc_id").alias("chunk_id"), "source")
    chosen = vectors.join(docs.where("lang = 'en'").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    return nearest(chosen.join(tenants, "chunk_id"), queries.join(tenants.withColumnRenamed("chunk_id", "query_id"), "query_id"), 5, group="source")


_FINAL = f"""{_HYBRID}, ft AS (SELECT f.*, d.text, d.source AS source_filename, d.doc_id, q.text AS query_text FROM fused f
        JOIN documents d ON d.doc_id = chunk_id JOIN documents q ON q.doc_id = query_id),
    rs AS (SELECT *, round(len(list_intersect(list_distinct({TOKENS.format("query_text")}), {TOKENS.format("text")})) / greatest(len(list_distinct({TOKENS.format("query_text")})), 1), 9) AS rerank_score FROM ft),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_score DESC, chunk_id) AS final_rank FROM rs)"""


def _final(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = written(_hybrid(spark, sf_dir), "found")  # its size is known, so texts that nothing found are not shuffled
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text")).join(found.select("query_id").distinct(), "query_id", "left_semi")
    found = found.join(docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.col("source").alias("source_filename")), "chunk_id")
    found = found.join(asked, "query_id")
    return R.reranked(found, k).withColumns({"page_number": F.lit(0), "chunk_type": F.lit("narrative_text")})


@query("rerank_topk", f"WITH {_FINAL} SELECT query_id, chunk_id, rerank_score, CAST(final_rank AS INTEGER) AS final_rank FROM rr WHERE final_rank <= 8")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 best of the fused list by the default reranker."""
    return _final(spark, sf_dir).select("query_id", "chunk_id", "rerank_score", "final_rank")


@query(
    "pack_context",
    f"""WITH {_FINAL}, s AS (SELECT query_id, final_rank, 'Source ' || final_rank AS label, '[Source ' || final_rank || '] — ' || source_filename || ' (n.p.) | Narrative Text' || chr(10) ||
        'Relevance: ' || printf('%.2f', rerank_score) || chr(10) || chr(10) || text || chr(10) AS section FROM rr WHERE final_rank <= 8),
    n AS (SELECT *, len({TOKENS.format("section")}) AS tokens FROM s),
    l AS (SELECT query_id, list({{'label': label, 'section': section, 'tokens': CAST(tokens AS BIGINT)}} ORDER BY final_rank) AS xs FROM n GROUP BY 1),
    a AS (SELECT query_id, len(xs) AS many, list_reduce(list_transform(xs, lambda x: {{'total': x.tokens, 'ls': [x.label], 'ss': [x.section]}}), lambda acc, x:
          CASE WHEN acc.total + x.total <= 4000 THEN {{'total': acc.total + x.total, 'ls': list_concat(acc.ls, x.ls), 'ss': list_concat(acc.ss, x.ss)}} ELSE acc END,
          {{'total': CAST(0 AS BIGINT), 'ls': CAST([] AS VARCHAR[]), 'ss': CAST([] AS VARCHAR[])}}) AS r FROM l)
    SELECT query_id, array_to_string(r.ss, chr(10) || repeat('─', 50) || chr(10)) AS context, array_to_string(r.ls, ',') AS labels, r.total AS total_tokens,
           CAST(len(r.ls) AS BIGINT) AS included, CAST(many - len(r.ls) AS BIGINT) AS excluded FROM a""",
)
def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of at most 4000 words for every query."""
    return R.packed_context(_final(spark, sf_dir), 4000)


@query(
    "citation_list",
    f"""WITH {_FINAL} SELECT query_id, CAST(final_rank AS INTEGER) AS final_rank, doc_id AS source_id, chunk_id, CAST(NULL AS INTEGER) AS page_number,
    round(least(1.0, greatest(0.0, rerank_score)), 4) AS confidence_score, trim(substr(text, 1, 300)) AS excerpt, source_filename FROM rr WHERE final_rank <= 8""",
)
def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every query."""
    return R.citations(_final(spark, sf_dir))
