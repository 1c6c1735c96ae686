"""Streams that hold state or keep tables: jobs, slots, budgets, limits, quarantine, incremental ingestion; and keyed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.operators import parse as P
from datalode.plans import deck_queries  # noqa: F401  its SQL is used below
from datalode.plans.registry import ORACLES, query, table
from datalode.sources.keyed import KeyedTable
from datalode.sources.shared import scratch
from datalode.streaming import jobs as J
from datalode.streaming import states
from datalode.streaming.tables import split_stream, upsert_stream

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_KIND = "CASE event_type WHEN 'view' THEN 'slide' WHEN 'click' THEN 'slide' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'end' ELSE 'queued' END"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.event_stream(spark, f"{sf_dir}/events.parque[t]")


@query(
    "stream_jobs",
    f"""WITH e AS (SELECT user_id AS job_id, ts, event_id, {_KIND} AS kind, {_K} AS slide FROM events WHERE user_id IS NOT NULL),
    p AS (SELECT *, lag(ts) OVER w AS pt, lag(kind) OVER w AS pk FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    j AS (SELECT *, sum(CASE WHEN pt IS NULL OR pk = 'end' OR ts > pt + INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM p),
    g AS (SELECT job_id, n, min(ts) AS started, max(ts) AS ended, count(*) FILTER (kind = 'slide') AS c, count(*) FILTER (kind = 'error') AS f, bool_or(kind = 'end') AS done,
                 coalesce(array_to_string(list_sort(list(slide) FILTER (kind = 'slide')), ','), '') AS slides FROM j GROUP BY 1, 2),
    o AS (SELECT *, lead(n) OVER (PARTITION BY job_id ORDER BY n) IS NOT NULL OR ended + INTERVAL 2 HOURS <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTES AS left_behind FROM g)
    SELECT job_id, started, ended, CASE WHEN NOT done THEN 'failed' WHEN f = 0 THEN 'complete' WHEN c > 0 THEN 'partial_failure' ELSE 'failed' END AS status,
           c AS slides_completed, f AS slides_failed, slides, CASE WHEN done THEN 'end' ELSE 'timeout' END AS reason FROM o WHERE done OR left_behind""",
)
def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs (one after the other for each user) as a state machine with timers: each is told when its end comes or two hours pass."""
    root = scratch(spark, "jobs")
    kind = F.when(F.col("event_type").isin("view", "click"), "slide").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "end").otherwise("queued")
    rows = _stream(spark, sf_dir).where("user_id is not null").select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("slide"))
    told = KeyedTable(spark, f"{root}/rows", states.RESULT, ["job_id", "started", "ended"])
    with states.with_rocksdb(spark):
        upsert_stream(states.job_results(rows), told, f"{root}/state")
    return told.read().withColumn("slides", F.array_join(F.transform("slides", lambda x: x.cast("string")), ","))


@query("stream_slots", f"SELECT user_id, {_K} AS slot, arg_max(event_id, (event_type <> 'error', ts, event_id)) AS event_id, bool_or(event_type <> 'error') AS ok FROM events GROUP BY ALL")
def stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of slides merged in whatever order they come; a failed slot stays until a result replaces it, and never replaces one."""
    rows = J.parsed(_stream(spark, sf_dir)).select("user_id", F.col("k").alias("slot"), "event_id", (F.col("event_type") != "error").alias("ok"), "ts")
    return J.upserted_stream(rows, ["user_id", "slot"], ["ok", "ts", "event_id"]).select("user_id", "slot", "event_id", "ok")


@query(
    "stream_rate_limit",
    """SELECT event_type AS client, time_bucket(INTERVAL 6 HOURS, ts) AS window_start, count(*) AS n, greatest(count(*) - 10, 0) AS refused FROM events
    GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""",
)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: requests of every kind of client over 10 in six hours, for windows that the watermark has closed."""
    return J.drained(J.refused(_stream(spark, sf_dir), "event_type", length="6 hours"), "limits")


_CUT = "CASE WHEN length(props) % 2 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END"


@query(
    "stream_quarantine",
    f"""WITH e AS (SELECT event_type, {_CUT} AS payload FROM events)
    SELECT CASE WHEN json_valid(payload) THEN 'good' ELSE 'bad' END AS part, event_type, count(*) AS n, CAST(sum(CASE WHEN json_valid(payload) THEN CAST(json_extract(payload, '$.k') AS BIGINT) END) AS BIGINT) AS k,
           CAST(sum(length(payload)) AS BIGINT) AS characters FROM e GROUP BY ALL""",
)
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose payload (here: cut where its length is even) is not JSON go into a quarantine with their text, all others on."""
    root = scratch(spark, "quarantine")
    payload = F.expr(_CUT)
    rows = _stream(spark, sf_dir).select("event_id", "event_type", payload.alias("payload"), F.try_parse_json(payload).alias("v"))
    rows = rows.select("event_id", "event_type", "payload", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("v").isNotNull().alias("ok"))
    good, bad = (KeyedTable(spark, f"{root}/{name}", "event_id long, event_type string, payload string, k long, ok boolean", ["event_id"]) for name in ("good", "bad"))
    split_stream(rows, good, bad, "ok", f"{root}/state")
    both = good.read().withColumn("part", F.lit("good")).unionByName(bad.read().withColumn("part", F.lit("bad")))
    return both.groupBy("part", "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.sum(F.length("payload")).alias("characters"))


@query("stream_ingest", ORACLES["chunk_paragraphs"])
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they arrive are chunked and their chunks upserted by document and place, as a digest of each document."""
    root = scratch(spark, "ingest")
    docs = spark.readStream.schema("doc_id long, text string").parquet(f"{sf_dir}/documents.parque[t]")
    chunks = KeyedTable(spark, f"{root}/rows", "doc_id long, seq long, text string", ["doc_id", "seq"], by=["doc_id"])
    upsert_stream(docs, chunks, f"{root}/state", prepare=lambda d: P.greedy_chunks(d).select("doc_id", F.col("seq").cast("long").alias("seq"), "text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return chunks.read().groupBy("doc_id").agg(F.count("*").alias("chunks"), F.md5(F.array_join(parts, "||")).alias("digest"))


@query(
    "keyed_store",
    """WITH a AS (SELECT doc_id, n_chars AS size, 'stored' AS origin FROM documents WHERE n_chars % 3 <> 0),
    n AS (SELECT doc_id, max(size) AS size, 'upserted' AS origin FROM (SELECT doc_id, unnest([n_chars, n_chars + 1]) AS size FROM documents WHERE n_chars % 5 = 0) GROUP BY 1),
    b AS (SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n),
    c AS (SELECT * FROM b UNION ALL SELECT doc_id, n_chars, 'appended' FROM documents WHERE n_chars % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM b))
    SELECT doc_id, size, origin FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def keyed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in buckets through an upsert (two rows of a key: the larger), an append (stored rows stay) and an erasure."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("size"))
    rows = lambda d, origin: d.withColumn("origin", F.lit(origin))
    store = KeyedTable(spark, scratch(spark, "store"), "doc_id long, size long, origin string", ["doc_id"])
    store.upsert(rows(docs.where("size % 3 <> 0"), "stored"))
    twice = docs.where("size % 5 = 0").select("doc_id", F.explode(F.array("size", F.col("size") + 1)).alias("size"))
    store.upsert(rows(twice, "upserted"))
    store.append(rows(docs.where("size % 2 = 0"), "appended"), ["size"])
    store.erase(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return store.read()
