"""Queries of outlines, guards, deck rules, mirroring, changes and hooks, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.operators import ingest as I
from datalode.operators import llmops as L
from datalode.operators import retrieval as R
from datalode.operators import slides as S
from datalode.plans.registry import query, table
from datalode.streaming import jobs as J

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_ASKED = "CASE event_type WHEN 'view' THEN 'healthcare' WHEN 'purchase' THEN 'legal' WHEN 'click' THEN 'hero_journey' ELSE event_type END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines"))


_L = "d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines, text FROM documents)"


@query("intents", f"SELECT event_id, CASE event_type WHEN 'click' THEN 'hero_journey' ELSE 'pyramid_principle' END AS framework, CASE event_type WHEN 'view' THEN 'healthcare' WHEN 'purchase' THEN 'legal' ELSE 'general' END AS vertical, least(20, greatest(3, coalesce(nullif({_K}, 0), 8))) AS estimated_slides FROM events")
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown frameworks and verticals become the defaults; the number of slides is held in bounds."""
    return _events(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in S.coerced_intent(F.expr(_ASKED), F.expr(_ASKED), F.col("k")).items()))


@query("request_enums", "SELECT event_id, CASE event_type WHEN 'view' THEN 'framework_invalid' WHEN 'purchase' THEN 'framework_invalid' WHEN 'click' THEN 'vertical_invalid' ELSE 'vertical_invalid,framework_invalid' END AS violations FROM events")
def request_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verticals and frameworks of requests that are none."""
    return _events(spark, sf_dir).select("event_id", F.array_join(S.request_enum_faults(F.expr(_ASKED), F.expr(_ASKED)), ",").alias("violations"))


@query("forced_routing", "SELECT user_id % 3 = 0 AS forced, CASE WHEN user_id % 3 = 0 THEN 'gpt-4-turbo' WHEN event_type = 'view' THEN 'gpt-4o' ELSE 'gpt-4o-mini' END AS model, count(*) AS n FROM events GROUP BY ALL")
def forced_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by class and plan, and a forced one (every third user) that wins over both."""
    rows = _events(spark, sf_dir).select((F.col("user_id") % 3 == 0).alias("forced"), F.when(F.col("event_type") == "view", "powerful").otherwise("fast").alias("model_class"), F.lit("pro").alias("plan"))
    out = L.routed(rows, force=F.when(F.col("forced"), "gpt-4-turbo"))
    return out.groupBy("forced", "model").agg(F.count("*").alias("n"))


_SINCE = "TIMESTAMP '2024-01-10'"


@query(
    "replay_until_end",
    f"""WITH e AS (SELECT user_id, event_id, ts, event_type FROM events WHERE ts > {_SINCE}), t AS (SELECT user_id, min((ts, event_id)) AS stop FROM e WHERE event_type = 'purchase' GROUP BY 1)
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM e LEFT JOIN t USING (user_id) WHERE stop IS NULL OR (ts, event_id) <= stop""",
)
def replay_until_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client that was away since 10 January is sent: oldest first, up to the first terminal event (a purchase)."""
    return J.replayed(table(spark, sf_dir, "events"), F.lit("2024-01-10").cast("timestamp"), ["purchase"]).select("user_id", "event_id", "place")


@query(
    "retry_or_dead",
    f"SELECT event_id, {_K} % 5 AS attempt, CASE WHEN {_K} % 5 < 3 THEN ts + to_seconds(CAST((CASE WHEN event_id % 2 = 0 THEN 30 ELSE 5 END) * pow(2, {_K} % 5) AS BIGINT)) END AS next_retry_at, {_K} % 5 >= 3 AS dead FROM events WHERE event_type = 'error'",
)
def retry_or_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of ingestion (even ids) and generation by when they are tried again; after three attempts they are dead letters."""
    rows = _events(spark, sf_dir).where("event_type = 'error'").select("event_id", (F.col("k") % 5).alias("attempt"), "ts", F.when(F.col("event_id") % 2 == 0, "ingestion").otherwise("generation").alias("job"))
    again, dead = J.retries(rows)
    return again.unionByName(dead).select("event_id", "attempt", "next_retry_at", "dead")


@query(
    "quiet_edits",
    """WITH e AS (SELECT user_id, event_type, ts, event_id, value, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 SECONDS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS s FROM e),
    b AS (SELECT user_id, event_type, min(ts) AS started, floor(arg_max(value, (ts, event_id)) / 100) AS value FROM g GROUP BY user_id, event_type, s)
    SELECT user_id, event_type, started, value::DOUBLE AS value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY started) AS before FROM b) WHERE before IS NULL OR before <> value""",
)
def quiet_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of an element that end after two quiet seconds; those that change nothing are passed over."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return J.debounced(rows, ["user_id", "event_type"], F.floor(F.col("value") / 100).cast("double"))


@query("stream_budget", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, round(sum(value), 6) AS spent FROM events GROUP BY ALL")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: daily sums of every user from the stream, final once the watermark of 25 hours has passed them; the last days follow at its end."""
    return J.daily_totals(spark, f"{sf_dir}/events.parque[t]").select("user_id", "day", F.round("spent", 6).alias("spent"))


@query("stream_upsert", f"SELECT user_id, {_K} AS k, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stream upserted batch by batch, whatever their order."""
    return J.upserted_stream(J.parsed(J.event_stream(spark, f"{sf_dir}/events.parque[t]")).where("ok"), ["user_id", "k"], ["ts", "event_id"]).select("user_id", "k", "event_id")


@query(
    "outlines",
    f"""WITH {_L}, o AS (SELECT doc_id, list_transform(lines, lambda x, i: {{'t': CASE WHEN i = 1 AND doc_id % 2 = 0 THEN 'title_slide' WHEN length(x) % 3 = 0 THEN 'table' END, 'a': nullif(trim(x), ''), 'r': CASE WHEN length(x) % 5 = 0 THEN 'action' END}}) AS o FROM d),
    f AS (SELECT doc_id, list_sum(list_transform(o, lambda s: (s.t IS NULL)::INT + (s.a IS NULL)::INT + (s.r IS NULL)::INT)) AS missing,
          CASE WHEN doc_id % 2 = 0 THEN o ELSE list_concat([{{'t': 'title_slide', 'a': 'Presentation: ' || doc_id, 'r': 'situation'}}], o) END AS o FROM o)
    SELECT doc_id, CAST(missing AS BIGINT) AS missing, md5(array_to_string(list_transform(o, lambda s, i: coalesce(s.t, 'content_bullets') || '/' || coalesce(s.a, 'Slide ' || i) || '/' || coalesce(s.r, 'content')), ';')) AS digest FROM f""",
)
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline of every document's lines, repaired, and how many fields were missing."""
    kind = lambda x, i: F.when((i == 0) & (F.col("doc_id") % 2 == 0), "title_slide").when(F.length(x) % 3 == 0, "table")
    one = lambda x, i: F.struct(kind(x, i).alias("slide_type"), F.nullif(F.trim(x), F.lit("")).alias("action_title"), F.when(F.length(x) % 5 == 0, "action").alias("narrative_role"))
    rows = _lines(spark, sf_dir).select("doc_id", F.transform("lines", one).alias("o"))
    missing = F.aggregate("o", F.lit(0), lambda n, s: n + F.size(S.missing_fields(s)))
    fixed = S.repaired_outline(F.col("o"), F.col("doc_id").cast("string"))
    text = F.array_join(F.transform(fixed, lambda s: F.concat_ws("/", s["slide_type"], s["action_title"], s["narrative_role"])), ";")
    return rows.select("doc_id", missing.cast("long").alias("missing"), F.md5(text).alias("digest"))


_ERROR = "CASE WHEN strlen(text) > 50000 THEN 'content_too_large' WHEN doc_id % 13 = 0 THEN 'content_missing' WHEN doc_id % 3 = 1 AND doc_id % 7 = 0 THEN 'chart_value_no_number' END"


@query(
    "slide_guards",
    f"""WITH {_L} SELECT doc_id, {_ERROR} AS error, CASE WHEN length(lines[1]) > 60 THEN substr(lines[1], 1, 57) || '...' ELSE lines[1] END AS action_title,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE md5(array_to_string(list_transform(lines, lambda x, i: CASE WHEN doc_id % 3 = 0 AND length(x) % 2 = 0 THEN md5(doc_id || '/' || (i - 1)) WHEN length(x) % 2 = 0 THEN '' ELSE 'own' END), ',')) END AS ids,
    CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS flags FROM d""",
)
def slide_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a slide with its lines as bullets, guarded."""
    i = F.col("doc_id")
    bullets = F.transform("lines", lambda x: F.struct(F.when(F.length(x) % 2 == 0, "").otherwise("own").alias("element_id"), x.alias("text")))
    content = F.struct(bullets.alias("bullets"), F.array(F.lit("1.5"), F.when(i % 7 == 0, "x").otherwise("-2")).alias("values"))
    kind = F.when(i % 3 == 0, "content_bullets").when(i % 3 == 1, "data_chart").otherwise("table")
    slides = _lines(spark, sf_dir).select(
        "doc_id", i.cast("string").alias("slide_id"), kind.alias("slide_type"), F.col("lines")[0].alias("action_title"), F.octet_length(F.array_join("lines", "\n")).alias("content_bytes"), F.when(i % 13 != 0, content).alias("content"),
        F.when(i % 4 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("citations"), F.array(F.lit("quote_unsourced")).alias("risk_flags"),
    )
    out = S.guarded(slides)
    ids = F.array_join(F.transform("bullets", lambda b: b["element_id"]), ",")
    return out.select("doc_id", "error", "action_title", F.md5(ids).alias("ids"), F.size("risk_flags").alias("flags"))


@query("risk_flags", f"SELECT event_id, CASE WHEN {_K} % 2 = 0 THEN 'quote_unsourced' || CASE WHEN event_type = 'view' THEN ',numerical_unverified' ELSE '' END WHEN event_type = 'view' THEN 'numerical_unverified' ELSE '' END AS flags FROM events")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk flags of slides; charts (views) always have unverified numbers."""
    kind = F.when(F.col("event_type") == "view", "data_chart").otherwise("table")
    own = F.when(F.col("k") % 2 == 0, F.array(F.lit("quote_unsourced")))
    return _events(spark, sf_dir).select("event_id", F.array_join(S.flagged(kind, own), ",").alias("flags"))


@query(
    "schema_faults",
    f"""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 9 = 0 THEN 'corrupt_record' END, CASE WHEN event_id % 9 <> 0 AND {_K} % 6 > 3 THEN 'alternatives_many' END,
    CASE WHEN event_id % 9 <> 0 AND event_type = 'error' THEN 'risk_flag_unknown' END], lambda x: x IS NOT NULL), ',') AS faults FROM events""",
)
def schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON metadata of slides, every ninth cut off: rows are kept and marked."""
    flag = F.when(F.col("event_type") == "error", "made_up").otherwise("entity_inferred")
    meta = F.to_json(F.struct(F.slice(F.array(*map(F.lit, "abcdef")), 1, (F.col("k") % 6).cast("int")).alias("alternatives"), F.array(flag).alias("flags")))
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 9 == 0, F.substring(meta, 1, 12)).otherwise(meta).alias("meta"))
    m = F.from_json("meta", "alternatives array<string>, flags array<string>, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.withColumn("m", m)
    whole = lambda c: F.when(F.col("m._corrupt_record").isNull(), c)
    return rows.select("event_id", F.array_join(S.schema_faults(whole(F.col("m.alternatives")), whole(F.col("m.flags")), F.col("m._corrupt_record")), ",").alias("faults"))


@query(
    "deck_faults",
    """WITH n AS (SELECT c_custkey AS id, c_mktsegment AS seg, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)
    SELECT id, n AS n_slides, array_to_string(list_filter([CASE WHEN id % 5 = 0 THEN 'schema_version' END, CASE WHEN id % 7 = 0 THEN 'aspect_ratio' END, CASE WHEN seg = 'BUILDING' THEN 'theme' END,
    CASE WHEN id % 11 = 0 THEN '[Deck-level] late' END, CASE WHEN n = 0 THEN 'no_slides' WHEN n > 100 THEN 'slides_many' END], lambda x: x IS NOT NULL), ',') AS faults FROM n""",
)
def deck_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deck rules, with customers as decks and their orders as slides."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    i = F.col("c_custkey")
    decks = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select(
        i.alias("id"), F.coalesce("n", F.lit(0)).alias("n_slides"), F.when(i % 5 == 0, "0.9").otherwise("1.0.0").alias("schema_version"), F.when(i % 7 == 0, "1:1").when(i % 2 == 0, "4:3").alias("aspect_ratio"),
        F.when(F.col("c_mktsegment") == "BUILDING", "plain").otherwise("modern_light").alias("theme"), F.when(i % 11 == 0, F.array(F.lit("late"))).alias("blocking_errors"),
    )
    return decks.select("id", "n_slides", F.array_join(S.deck_faults(I.THEMES), ",").alias("faults"))


@query(
    "assembled_slides",
    f"""SELECT event_id, CASE WHEN {_K} % 3 = 0 THEN 1 ELSE 2 END AS hierarchy_level, 60 AS duration, CASE WHEN event_type = 'view' THEN 'text_primary' ELSE 'balanced' END AS priority, event_type = 'error' AS failed,
    CASE least(3, {_K} % 6) WHEN 0 THEN '' WHEN 1 THEN '0.8' WHEN 2 THEN '0.8,0.7' ELSE '0.8,0.7,0.6' END AS confidences FROM events""",
)
def assembled_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides with defaults and up to three alternatives; failures stay as rows."""
    rows = _events(spark, sf_dir).select(
        "event_id", F.when(F.col("k") % 3 == 0, 1).alias("hierarchy_level"), F.lit(None).cast("int").alias("duration"), F.when(F.col("event_type") == "view", "text_primary").alias("priority"),
        F.slice(F.array(*map(F.lit, "abcdef")), 1, (F.col("k") % 6).cast("int")).alias("alternatives"), F.when(F.col("event_type") == "error", "timed out").alias("error"),
    )
    out = S.assembled(rows)
    return out.select("event_id", "hierarchy_level", "duration", "priority", "failed", F.array_join(F.transform("alternatives", lambda a: a["confidence_score"].cast("string")), ",").alias("confidences"))


@query("mixed_direction", r"SELECT doc_id, doc_id % 3 = 0 AND (doc_id % 2 = 0 OR regexp_matches(text, '[A-Za-zÀ-ɏ0-9]')) AS mixed, doc_id % 3 = 0 AND regexp_matches(text, '[A-Za-zÀ-ɏ]') AS letters FROM documents")
def mixed_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides (title and text) with both directions; every third has Hebrew, every second of those a digit."""
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("שלום "), F.when(i % 2 == 0, "7 ").otherwise(""), "text")).otherwise(F.col("text"))
    texts = F.array(F.lit(None).cast("string"), text)
    return table(spark, sf_dir, "documents").select("doc_id", S.mixed_direction(texts).alias("mixed"), S.mixed_direction(texts, digits_as_ltr=False).alias("letters"))


@query(
    "mirrored_icons",
    f"""SELECT event_id, CASE WHEN user_id % 4 = 0 AND event_type NOT IN ('view', 'click') THEN 1000 - floor(value) - 10.0 ELSE floor(value) END AS x, CASE WHEN user_id % 4 = 0 AND {_K} % 2 = 0 THEN 'right' WHEN {_K} % 2 = 0 THEN 'left' ELSE 'none' END AS anchor FROM events""",
)
def mirrored_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, icons and anchors of right-to-left slides (every fourth user): images (views) and plain icons (clicks) stay."""
    kind = F.when(F.col("event_type") == "view", "image").otherwise("icon")
    boxes = _events(spark, sf_dir).select("event_id", "user_id", kind.alias("element_type"), F.when(F.col("event_type") == "click", "search").otherwise("forward").alias("icon"), F.when(F.col("k") % 2 == 0, "left").otherwise("none").alias("anchor"), F.floor("value").cast("double").alias("x"), F.lit(10.0).alias("width"))
    return S.mirrored(boxes, F.col("user_id") % 4 == 0).select("event_id", "x", "anchor")


@query("canvas_faults", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size - 5 <= 0 THEN 'width_not_positive' END, CASE WHEN p_size * 400 > 16384 THEN 'height_over_limit' END], lambda x: x IS NOT NULL), ',') AS faults FROM part")
def canvas_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvases of sizes that cannot be drawn."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.canvas_faults(F.col("p_size") - 5, F.col("p_size") * 400), ",").alias("faults"))


_FIELD = "CASE event_type WHEN 'view' THEN 'metadata.theme' WHEN 'signup' THEN 'slide_type' WHEN 'click' THEN 'content.bullets[3].text' ELSE 'content.notes' END"


@query(
    "slides_to_solve",
    f"""WITH e AS (SELECT event_id AS id, user_id AS deck, {_K} % 10 AS section, event_type AS t FROM events WHERE event_id % 40 = 0 OR event_type = 'error'), s AS (SELECT DISTINCT user_id AS deck, {_K} AS slide, CASE WHEN {_K} % 10 = 9 THEN NULL ELSE {_K} % 10 END AS section FROM events),
    c AS (SELECT event_id AS id, user_id AS deck, {_K} AS slide, CASE event_type WHEN 'view' THEN 'deck' WHEN 'signup' THEN 'section' WHEN 'click' THEN 'element' ELSE 'slide' END AS radius FROM events),
    r AS (SELECT id, slide FROM c WHERE radius NOT IN ('deck', 'section') UNION ALL SELECT id, s.slide FROM c JOIN s USING (deck) WHERE radius = 'deck'
      UNION ALL SELECT c.id, o.slide FROM c JOIN s ON c.deck = s.deck AND c.slide = s.slide JOIN s o ON o.deck = s.deck AND o.section = s.section WHERE radius = 'section'
      UNION ALL SELECT c.id, c.slide FROM c JOIN s ON c.deck = s.deck AND c.slide = s.slide WHERE radius = 'section' AND s.section IS NULL)
    SELECT id AS change_id, count(*) AS slides, CAST(sum(slide) AS BIGINT) AS digest FROM r GROUP BY 1""",
)
def slides_to_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which slides a change makes solve again, for every event as a change."""
    e, t = _events(spark, sf_dir), F.col("event_type")
    field = F.when(t == "view", "metadata.theme").when(t == "signup", "slide_type").when(t == "click", "content.bullets[3].text").otherwise("content.notes")
    slides = e.select(F.col("user_id").alias("deck_id"), F.col("k").alias("slide_id"), F.when(F.col("k") % 10 != 9, F.col("k") % 10).alias("section_id")).distinct()
    changes = e.select(F.col("event_id").alias("change_id"), F.col("user_id").alias("deck_id"), F.col("k").alias("slide_id"), S.impact_radius(field).alias("radius"))
    return S.slides_to_solve(changes, slides).groupBy("change_id").agg(F.count("*").alias("slides"), F.sum("slide_id").alias("digest"))


@query(
    "continuation_slides",
    f"""WITH {_L}, s AS (SELECT doc_id, CAST(doc_id AS DOUBLE) AS i, len(list_slice(lines, 1, 6)) AS b, lines[1] AS t FROM d UNION ALL SELECT doc_id, doc_id + 0.5, len(lines) - 6, CASE WHEN length(lines[1]) > 60 THEN substr(lines[1], 1, 57) || '...' ELSE lines[1] END FROM d WHERE len(lines) > 6)
    SELECT doc_id, i AS slide_index, CAST(b AS INTEGER) AS bullets, md5(t) AS title FROM s""",
)
def continuation_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as slides with continuations for lines beyond six."""
    slides = _lines(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("slide_id"), F.col("doc_id").cast("double").alias("slide_index"), F.col("lines")[0].alias("action_title"), F.col("lines").alias("bullets"))
    return S.continued(slides).select("doc_id", "slide_index", F.size("bullets").alias("bullets"), F.md5("action_title").alias("title"))


@query("schema_judge", f"SELECT event_id, round(1 - ((event_id % 9 = 0)::INT + (event_id % 9 <> 0 AND {_K} % 6 > 3)::INT + (event_id % 9 <> 0 AND event_type = 'error')::INT) / 3, 4) AS score FROM events")
def schema_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema judge's score of every slide."""
    faults = F.filter(F.split("faults", ","), lambda f: f != "")
    return schema_faults(spark, sf_dir).select("event_id", S.judged(faults, 3).alias("score"))


@query("hashed_embeddings", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, len(w) > 0 AS unit FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents)")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default embedding of every document has the asked dimension and length one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    out = R.embedded(docs, dimension=64)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return out.select(F.col("chunk_id").alias("doc_id"), F.size(R.words(F.col("text"))).cast("long").alias("words"), ((F.size("embedding") == 64) & (F.abs(length - 1) < 1e-6)).alias("unit"))
