"""Queries that coerce, render and route records; all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.operators import records as R
from datalode.plans.registry import query, table

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _key():
    return F.get_json_object("props", "$.k").cast("long")


@query(
    "intent_coercion",
    f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'scqa' WHEN event_type = 'click' THEN 'mece' ELSE 'pyramid_principle' END AS framework,
    least(20, greatest(3, coalesce(nullif({_K}, 0), 8))) AS estimated_slides FROM events""",
)
def intent_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown frameworks become the default; slides lie in 3 to 20, 8 where none are given."""
    asked = F.when(F.col("event_type") == "view", "scqa").when(F.col("event_type") == "click", "mece").otherwise(F.col("event_type"))
    framework = F.when(asked.isin("pyramid_principle", "scqa", "mece"), asked).otherwise("pyramid_principle")
    slides = F.least(F.lit(20), F.greatest(F.lit(3), F.coalesce(F.nullif(_key(), F.lit(0)), F.lit(8))))
    return table(spark, sf_dir, "events").select("event_id", framework.alias("framework"), slides.cast("long").alias("estimated_slides"))


@query(
    "outline_repair",
    """WITH l AS (SELECT doc_id, list_transform(list_slice(string_split(text, chr(10)), 1, 4), lambda x: substr(x, 1, 20)) AS xs FROM documents)
    SELECT doc_id, array_to_string(list_transform(CASE WHEN doc_id % 2 = 0 THEN xs ELSE list_concat(['Title'], xs) END, lambda x, i: CASE WHEN trim(x) = '' THEN 'Slide ' || i ELSE x END), '|') AS titles FROM l""",
)
def outline_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines (first lines) get a title slide where the first is none (odd ids), and missing titles are numbered."""
    xs = F.transform(F.slice(F.split("text", "\n"), 1, 4), lambda x: F.substring(x, 1, 20))
    full = F.when(F.col("doc_id") % 2 == 0, xs).otherwise(F.concat(F.array(F.lit("Title")), xs))
    named = F.transform(full, lambda x, i: F.when(F.trim(x) == "", F.concat(F.lit("Slide "), (i + 1).cast("string"))).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(named, "|").alias("titles"))


@query("prompt_render", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'As ' || role || ' (' || conv_id || '): go' ELSE 'As {role} ({id}): go' END AS prompt FROM conversations")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders filled from a map; the template as it is if one is missing."""
    known = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("role"), "role", F.lit("id"), F.col("conv_id").cast("string"))).otherwise(F.create_map(F.lit("role"), F.col("role")))
    rows = table(spark, sf_dir, "conversations").withColumn("vars", known)
    return rows.select("conv_id", "turn", R.rendered(F.lit("As {role} ({id}): go"), F.col("vars")).alias("prompt"))


@query("impact_radius", "SELECT CASE WHEN event_type = 'view' THEN 'deck' WHEN event_type = 'signup' THEN 'section' WHEN event_type = 'click' THEN 'element' ELSE 'slide' END AS radius, count(*) AS n FROM events GROUP BY 1")
def impact_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a changed field reaches; the element pattern is tried before its slide's."""
    t = F.col("event_type")
    field = F.when(t == "view", "metadata.theme").when(t == "signup", "section.title").when(t == "click", "content.bullets.3.text").otherwise("content.notes")
    radius = F.when(field.startswith("metadata."), "deck").when(field.startswith("section."), "section").when(field.rlike(r"^content\.\w+\.\d+\."), "element").otherwise("slide")
    return table(spark, sf_dir, "events").groupBy(radius.alias("radius")).agg(F.count("*").alias("n"))


@query("figure_triage", "SELECT doc_id, CASE WHEN strlen(text) < 1000 THEN 'decorative' WHEN contains(lower(substr(text, 1, 60)), 'th') THEN 'informational' ELSE 'uncertain' END AS kind FROM documents")
def figure_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small contents are decorative, those with a telling caption informational, others uncertain."""
    kind = R.figure_kind(F.octet_length("text"), F.substring("text", 1, 60), ["th"])
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


@query("flat_metadata", "SELECT doc_id, 0 AS page_number, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, '') AS section, substr(CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END, 1, 1000) AS links_to FROM documents")
def flat_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of a chunk's metadata as 0 or empty strings, links cut at 1000."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("int").alias("page_number"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("section"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("links_to"))
    return rows.select("doc_id", F.coalesce("page_number", F.lit(0)).alias("page_number"), F.coalesce("section", F.lit("")).alias("section"), F.substring(F.coalesce("links_to", F.lit("")), 1, 1000).alias("links_to"))


@query("schema_versions", f"SELECT coalesce(CASE {_K} % 3 WHEN 0 THEN '1.0.0' WHEN 1 THEN '0.9.0' END, 'none') AS version, {_K} % 3 = 1 AS rejected, count(*) AS n FROM events GROUP BY ALL")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of another version are rejected; those without one pass."""
    version = F.when(_key() % 3 == 0, "1.0.0").when(_key() % 3 == 1, "0.9.0")
    rows = table(spark, sf_dir, "events").withColumn("version", version)
    rows = rows.withColumn("rejected", R.version_rejected(F.col("version")))
    return rows.groupBy(F.coalesce("version", F.lit("none")).alias("version"), "rejected").agg(F.count("*").alias("n"))


@query("relaxation_scale", "SELECT event_id, least(1.2, greatest(0.8, round(value / 300, 4)))::DOUBLE AS font_scale, CASE WHEN value / 300 > 1.2 THEN 'clamped' ELSE '' END AS warnings FROM events")
def relaxation_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font scales held in 0.8 to 1.2 with a warning where they were larger."""
    scale = F.col("value") / 300
    return table(spark, sf_dir, "events").select("event_id", R.relaxed_scale(F.round(scale, 4)).alias("font_scale"), F.array_join(R.with_warnings(F.lit(None), F.when(scale > R.SCALES[1], F.array(F.lit("clamped")))), ",").alias("warnings"))


@query(
    "layout_telemetry",
    f"SELECT event_type AS tier, count(*) AS n, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100, count(*) FILTER (value <= 250) AS le_250, round(count(*) FILTER ({_K} % 4 = 0) / count(*), 6) AS hit_ratio FROM events GROUP BY 1",
)
def layout_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solve times by tier and the share of cache hits."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tier"), F.col("value").alias("solve_time_ms"), (_key() % 4 == 0).alias("font_cache_hit"))
    return R.solve_times(rows, ["tier"], (50, 100, 250))


@query(
    "recognised_words",
    f"WITH w AS (SELECT user_id AS page, ts, event_id, {_K} - 5 AS conf, event_type AS word FROM events) SELECT page, round(avg(conf) / 100, 3) AS confidence, avg(conf) / 100 >= 0.3 AS kept, count(*) AS words, md5(string_agg(word, ' ' ORDER BY ts, event_id)) AS text_hash FROM w WHERE conf > 0 GROUP BY 1",
)
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of each page's recognised words, and the page's text."""
    w = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "ts", "event_id", (_key() - 5).alias("confidence"), F.col("event_type").alias("word"))
    return R.recognised_pages(w, ["ts", "event_id"]).select("page", "confidence", "kept", "words", F.md5("text").alias("text_hash"))


@query("highlighted_cells", f"SELECT event_id, {_K} IN (SELECT {_K} FROM events WHERE event_type = 'error' AND value > 200) AS highlighted FROM events")
def highlighted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose key is in the highlight set."""
    rows = table(spark, sf_dir, "events").withColumn("k", _key())
    return R.highlighted(rows, rows.where("event_type = 'error' and value > 200"), ["k"]).select("event_id", "highlighted")


@query("change_symbols", "SELECT event_id, CASE WHEN value > 200 THEN '▲' WHEN value < 50 THEN '▼' ELSE '→' END || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS display FROM events")
def change_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values with the sign of their change."""
    change = F.when(F.col("value") > 200, "up").when(F.col("value") < 50, "down").otherwise("neutral")
    return table(spark, sf_dir, "events").select("event_id", R.change_display(change, F.floor("value").cast("string")).alias("display"))


@query("scatter_points", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS x, round(CAST(embedding[i] AS DOUBLE), 6) AS y FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every component of a series as a point."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v")).select("vec_id", "x", F.round(F.col("v").cast("double"), 6).alias("y"))


@query(
    "eval_case_grid",
    """WITH p AS (SELECT DISTINCT lang FROM documents), i AS (SELECT DISTINCT event_type AS industry FROM events), g AS (SELECT lang, industry, d, row_number() OVER (ORDER BY lang, industry, d) - 1 AS n FROM p, i, (SELECT unnest([5, 15, 30]) AS d))
    SELECT n, lang, industry, d AS duration_minutes, ['pyramid_principle', 'scqa', 'mece'][n % 3 + 1] AS framework FROM g WHERE n < 50""",
)
def eval_case_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases from all languages, event types and three lengths; the first fifty (few distinct values)."""
    industries = table(spark, sf_dir, "events").select(F.col("event_type").alias("industry"))
    return R.evaluation_cases(table(spark, sf_dir, "documents").select("lang"), industries, (5, 15, 30), ("pyramid_principle", "scqa", "mece"))
