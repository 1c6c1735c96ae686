"""Queries of JSON that models and clients send: outlines, slides and decks. Their texts are put together from the given tables, alike in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.operators import schema as C
from datalode.operators import slides as S
from datalode.operators.ingest import THEMES
from datalode.plans.registry import query, table

_TITLE = "substr(regexp_replace(line, '[^A-Za-z ]', '', 'g'), 1, 40)"
#: A model's answer about a document: an outline of its lines in one of several shapes, sometimes cut off or without slides.
_ONE = """'{' || CASE WHEN length(line) % 3 = 0 THEN '' ELSE '"slide_type": "' || CASE WHEN i = 0 AND n_chars % 2 = 0 THEN 'title_slide' ELSE 'table' END || '", ' END
    || CASE WHEN length(line) % 5 = 0 THEN '' WHEN length(line) % 7 = 0 THEN '"action_title": null, ' ELSE '"action_title": "' || TITLE || '", ' END || '"n": 1' || CASE WHEN length(line) % 4 = 0 THEN '' ELSE ', "narrative_role": "action"' END || '}'"""
_SHAPE = """CASE WHEN n_chars % 11 = 0 THEN '[' || items WHEN n_chars % 13 = 0 THEN '"' || lang || '"' WHEN n_chars % 17 = 0 THEN '{"slides": []}' WHEN n_chars % 19 = 0 THEN '{"deck": [' || items || ']}'
    WHEN n_chars % 3 = 0 THEN '[' || items || ']' WHEN n_chars % 3 = 1 THEN '{"slides": [' || items || ']}' ELSE '{"title": "x", "outline": [' || items || ']}' END"""


@query(
    "outline_answers",
    f"""WITH l AS (SELECT doc_id, n_chars, lang, list_transform(string_split(text, chr(10)), lambda line, k: {_ONE.replace("i = 0", "k = 1").replace("TITLE", _TITLE)}) AS o FROM documents),
    a AS (SELECT doc_id, {_SHAPE.replace("items", "array_to_string(o, ', ')")} AS answer FROM l),
    v AS (SELECT doc_id, json_valid(answer) AS ok, CAST(CASE WHEN json_valid(answer) THEN answer ELSE 'null' END AS JSON) AS j FROM a),
    u AS (SELECT *, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN coalesce(json_extract(j, '$.slides'), json_extract(j, '$.outline')) END AS s FROM v),
    e AS (SELECT *, CASE WHEN NOT ok THEN 'invalid_json' WHEN json_type(j) NOT IN ('ARRAY', 'OBJECT') THEN 'unexpected_format' WHEN coalesce(json_array_length(s), 0) = 0 THEN 'empty_outline' END AS error FROM u),
    f AS (SELECT doc_id, error, CASE WHEN error IS NULL THEN list_transform(json_extract(s, '$[*]'), lambda x: {{'t': CASE WHEN json_exists(x, '$.slide_type') THEN coalesce(json_extract_string(x, '$.slide_type'), '') END,
        'a': CASE WHEN json_exists(x, '$.action_title') THEN coalesce(json_extract_string(x, '$.action_title'), '') END, 'r': CASE WHEN json_exists(x, '$.narrative_role') THEN coalesce(json_extract_string(x, '$.narrative_role'), '') END}}) END AS o FROM e),
    g AS (SELECT doc_id, error, list_sum(list_transform(o, lambda s: (s.t IS NULL)::INT + (s.a IS NULL)::INT + (s.r IS NULL)::INT)) AS missing,
        CASE WHEN o[1].t = 'title_slide' THEN o ELSE list_concat([{{'t': 'title_slide', 'a': 'Presentation: ' || doc_id, 'r': 'situation'}}], o) END AS o FROM f)
    SELECT doc_id, error, CAST(missing AS BIGINT) AS missing, CASE WHEN error IS NULL THEN CAST(len(o) AS BIGINT) END AS slides,
        CASE WHEN error IS NULL THEN md5(array_to_string(list_transform(o, lambda s, i: coalesce(s.t, 'content_bullets') || '/' || coalesce(s.a, 'Slide ' || i) || '/' || coalesce(s.r, 'content')), ';')) END AS digest FROM g""",
)
def outline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """models' answers as outlines: an array, or an object with slides or an outline; others are kept with their error; the outlines are repaired."""
    one = _ONE.replace("TITLE", _TITLE.replace(", 'g'", ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", F.expr(f"transform(split(text, '\\n'), (line, i) -> {one})").alias("o"))
    answer = F.expr(_SHAPE.replace("items", "array_join(o, ', ')"))
    slides, error = C.model_outline(F.col("v"))
    rows = docs.select("doc_id", F.try_parse_json(answer).alias("v")).select("doc_id", slides.alias("slides"), error.alias("error"))
    missing = F.when(F.col("error").isNull(), F.aggregate("slides", F.lit(0), lambda n, s: n + F.size(S.missing_fields(s))))
    whole = F.when(F.col("error").isNull(), S.repaired_outline(F.col("slides"), F.col("doc_id").cast("string")))
    rows = rows.select("doc_id", "error", missing.cast("long").alias("missing"), whole.alias("o"))
    text = F.array_join(F.transform("o", lambda s: F.concat_ws("/", s["slide_type"], s["action_title"], s["narrative_role"])), ";")
    return rows.select("doc_id", "error", "missing", F.when(F.col("o").isNotNull(), F.size("o").cast("long")).alias("slides"), F.md5(text).alias("digest"))


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_H = "md5(props || CAST(user_id AS STRING))"
#: A slide as JSON of an event; some are cut off.
_SLIDE = f"""substr('{{"slide_id": "' || substr({_H}, 1, CASE WHEN k < 10 THEN 7 ELSE 8 END) || '-' || substr({_H}, 9, 4) || '-' || substr({_H}, 13, 4) || '-' || substr({_H}, 17, 4) || '-' || substr({_H}, 21, 12)
    || '", "slide_type": ' || CASE event_type WHEN 'view' THEN '"table"' WHEN 'click' THEN '"content_bullets"' WHEN 'purchase' THEN '7' ELSE '"' || event_type || '"' END
    || CASE WHEN k % 11 = 0 THEN '' ELSE ', "slide_index": ' || CAST(k - 4 AS STRING) || CASE WHEN k % 10 = 3 THEN '.5' ELSE '' END END || ', "action_title": "' || repeat('ab ', CAST(k % 25 AS INT)) || '"'
    || CASE WHEN k % 13 = 0 THEN '' WHEN k % 13 = 1 THEN ', "content": null' ELSE ', "content": {{"x": []}}' END || ', "outline_context": ' || CASE WHEN k % 6 = 0 THEN '[]' ELSE '{{"hierarchy_level": ' || CAST(k % 5 AS STRING) || ', "narrative_role": "' || event_type || '"}}' END
    || ', "ai_metadata": {{"generation_confidence": ' || CAST(k % 3 AS STRING) || '.' || CAST(k AS STRING) || ', "alternative_generations": [' || repeat('{{"variant_id": ' || CASE WHEN k % 7 = 0 THEN '1' ELSE '"v"' END || ', "action_title": "t", "confidence_score": 0.5}}, ', CAST(k % 5 AS INT))
    || '{{"variant_id": "w", "confidence_score": "high"}}], "hallucination_risk_flags": ["entity_inferred", "' || event_type || '"]}}}}', 1, CASE WHEN k % 17 = 0 THEN 40 ELSE 4000 END)"""
_NUMBER = "IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def _rules(*rules: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, name in rules) + "], lambda x: x IS NOT NULL)"


_ALTERNATIVES = "json_extract(j, '$.ai_metadata.alternative_generations[*]')"
_FLAGS = "json_extract_string(j, '$.ai_metadata.hallucination_risk_flags[*]')"


@query(
    "slide_schema",
    f"""WITH t AS (SELECT event_id, {_SLIDE} AS text FROM (SELECT *, {_K} AS k FROM events)),
    v AS (SELECT event_id, json_valid(text) AS ok, CAST(CASE WHEN json_valid(text) THEN text ELSE '{{}}' END AS JSON) AS j FROM t),
    f AS (SELECT event_id, CASE WHEN NOT ok THEN ['json'] ELSE list_concat({_rules(
        ("NOT regexp_full_match(json_extract_string(j, '$.slide_id'), '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')", "slide_id: uuid"),
        ("json_type(j, '$.slide_type') <> 'VARCHAR'", "slide_type: type"),
        ("json_type(j, '$.slide_type') = 'VARCHAR' AND json_extract_string(j, '$.slide_type') NOT IN ('title_slide', 'content_bullets', 'data_chart', 'visual_split', 'table', 'section_divider')", "slide_type: enum"),
        ("NOT json_exists(j, '$.slide_index')", "slide_index: missing"),
        ("CAST(json_extract(j, '$.slide_index') AS DOUBLE) <> floor(CAST(json_extract(j, '$.slide_index') AS DOUBLE))", "slide_index: integer"),
        ("CAST(json_extract(j, '$.slide_index') AS DOUBLE) < 0", "slide_index: range"),
        ("length(json_extract_string(j, '$.action_title')) > 60", "action_title: length"),
        ("NOT json_exists(j, '$.content')", "content: missing"),
        ("json_exists(j, '$.content') AND json_type(j, '$.content') <> 'OBJECT'", "content: type"),
        ("json_type(j, '$.outline_context') <> 'OBJECT'", "outline_context: type"),
        ("json_extract_string(j, '$.outline_context.narrative_role') NOT IN ('situation', 'complication', 'resolution', 'action', 'appendix', 'transition')", "outline_context.narrative_role: enum"),
        ("CAST(json_extract(j, '$.outline_context.hierarchy_level') AS BIGINT) < 1 OR CAST(json_extract(j, '$.outline_context.hierarchy_level') AS BIGINT) > 3", "outline_context.hierarchy_level: range"),
        ("CAST(json_extract(j, '$.ai_metadata.generation_confidence') AS DOUBLE) NOT BETWEEN 0 AND 1", "ai_metadata.generation_confidence: range"),
        (f"len({_ALTERNATIVES}) > 3", "ai_metadata.alternative_generations: many"),
    )}, flatten(list_transform({_ALTERNATIVES}, lambda x, i: list_filter([
        CASE WHEN json_type(x, '$.variant_id') <> 'VARCHAR' THEN 'ai_metadata.alternative_generations.' || (i - 1) || '.variant_id: type' END,
        CASE WHEN NOT json_exists(x, '$.action_title') THEN 'ai_metadata.alternative_generations.' || (i - 1) || '.action_title: missing' END,
        CASE WHEN json_type(x, '$.confidence_score') NOT {_NUMBER} THEN 'ai_metadata.alternative_generations.' || (i - 1) || '.confidence_score: type' END], lambda r: r IS NOT NULL))),
      list_filter(list_transform({_FLAGS}, lambda x, i: CASE WHEN x NOT IN ('numerical_unverified', 'quote_unsourced', 'prediction_extrapolated', 'entity_inferred') THEN 'ai_metadata.hallucination_risk_flags.' || (i - 1) || ': enum' END), lambda x: x IS NOT NULL)) END AS fs FROM v)
    SELECT event_id, len(fs) = 0 AS valid, array_to_string(fs, '; ') AS faults FROM f""",
)
def slide_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides as JSON text against the table of fields: types, values, ranges, sizes; what fails is kept and marked."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = rows.select("event_id", F.try_parse_json(F.expr(_SLIDE)).alias("v")).select("event_id", C.checked(F.col("v")).alias("fs"))
    return rows.select("event_id", (F.size("fs") == 0).alias("valid"), F.array_join("fs", "; ").alias("faults"))


#: A deck as JSON of a user's day of events; the theme follows from the day, the ratio from the number of events.
_BULLETS = """'{"slide_index": ' || CAST(event_id AS STRING) || ', "slide_id": "' || md5(props) || '", "slide_type": "' || CASE event_type WHEN 'view' THEN 'table' WHEN 'click' THEN 'content_bullets' WHEN 'purchase' THEN 'data_chart' WHEN 'signup' THEN 'title_slide' ELSE event_type END
    || '", "action_title": "' || repeat('abc', CAST(k % 25 AS INT)) || '", "template": {"overrides": {"font_scale": ' || CASE WHEN k % 9 = 0 THEN '"big"' WHEN k % 9 = 1 THEN 'null' ELSE '1.' || CAST(k AS STRING) END || '}}, "validation_state": {"blocking_errors": [' || CASE WHEN k % 16 = 0 THEN '"e' || CAST(k AS STRING) || '"' ELSE '' END || ']}, "content": {'
    || CASE WHEN k % 2 = 0 THEN '"headline": "h", ' ELSE '' END || '"bullets": ' || CASE WHEN k % 8 = 0 THEN '"none"' ELSE '[' || repeat('{"element_id": "b", "text": "t"}, ', CAST(k % 8 AS INT)) || '{"text": ' || CASE WHEN k % 3 = 0 THEN '5' ELSE '"x"' END || '}]' END
    || ', "headers": [' || CASE WHEN k % 4 = 0 THEN '' ELSE '{"key": "a"}, {"label": "b"}' END || '], "rows": ' || CASE WHEN k % 5 = 0 THEN '[]' ELSE '[[1]]' END
    || ', "chart_type": "' || CASE WHEN k % 3 = 0 THEN 'scatter' WHEN k % 3 = 1 THEN 'bar' ELSE 'radar' END || '", "chart_data": {"categories": [' || CASE WHEN k % 6 = 0 THEN '' ELSE '"p", "q"' END || '], "series": [{"values": [1, ' || CASE WHEN k % 7 = 0 THEN '"2"' ELSE '2.5' END || ']}, {"values": [' || CASE WHEN k % 10 = 0 THEN '' ELSE '1' END || ']}]}}}'"""
_DECK = """'{"schema_version": "' || CASE WHEN n % 4 = 0 THEN '2.0' ELSE '1.0.0' END || '"' || CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN ', "aspect_ratio": "4:3"' ELSE ', "aspect_ratio": "1:1"' END || ', "metadata": {"theme": "' || CASE WHEN n % 2 = 0 THEN 'modern_light' ELSE 'none' END
    || '"}, "validation_state": {"blocking_errors": [' || CASE WHEN n % 5 = 0 THEN '"d"' ELSE '' END || ']}, "slides": [' || CASE WHEN n % 7 = 0 THEN '' ELSE items END || ']' || CASE WHEN n % 11 = 0 THEN '' ELSE '}' END"""


def _told(*rules: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in rules) + "], lambda x: x IS NOT NULL)"


_T = "json_extract_string(s, '$.slide_type')"
_MESSAGES = f"""list_concat(coalesce(json_extract_string(s, '$.validation_state.blocking_errors[*]'), []), CASE WHEN {_T} NOT IN ('title_slide', 'content_bullets', 'data_chart', 'visual_split', 'table', 'section_divider') THEN ['slide_type ' || {_T}] ELSE list_concat(
    {_told(("json_extract_string(s, '$.action_title') = ''", "'title_missing'"), ("length(json_extract_string(s, '$.action_title')) > 60", "'title_length'"), ("json_type(s, '$.template.overrides.font_scale') = 'VARCHAR'", "'font_scale_type'"), ("json_type(s, '$.template.overrides.font_scale') IN ('DOUBLE', 'UBIGINT') AND CAST(json_extract(s, '$.template.overrides.font_scale') AS VARCHAR)::DOUBLE NOT BETWEEN 0.8 AND 1.2", "'font_scale_range'"))},
    CASE {_T} WHEN 'title_slide' THEN {_told(("NOT json_exists(s, '$.content.headline')", "'headline_missing'"))}
      WHEN 'content_bullets' THEN list_concat({_told(("json_type(s, '$.content.bullets') <> 'ARRAY'", "'bullets_type'"), ("json_array_length(s, '$.content.bullets') > 6", "'bullets_many'"))},
        flatten(list_transform(json_extract(s, '$.content.bullets[*]'), lambda b, i: {_told(("NOT json_exists(b, '$.element_id')", "'bullets[' || (i - 1) || '].element_id_missing'"), ("json_type(b, '$.text') <> 'VARCHAR'", "'bullets[' || (i - 1) || '].text_type'"))})))
      WHEN 'data_chart' THEN list_concat({_told(("json_extract_string(s, '$.content.chart_type') NOT IN ('column_clustered', 'column_stacked', 'line', 'pie', 'bar', 'area', 'waterfall', 'scatter')", "'chart_type'"), ("json_array_length(s, '$.content.chart_data.categories') = 0", "'categories_missing'"))},
        flatten(list_transform(json_extract(s, '$.content.chart_data.series[*]'), lambda x, i: list_concat({_told(("json_array_length(x, '$.values') = 0", "'series[' || (i - 1) || '].values_missing'"))},
          list_filter(list_transform(json_extract(x, '$.values[*]'), lambda v, n: CASE WHEN json_type(v) = 'VARCHAR' THEN 'series[' || (i - 1) || '].values[' || (n - 1) || '].type' END), lambda m: m IS NOT NULL),
          {_told(("json_extract_string(s, '$.content.chart_type') <> 'scatter' AND json_array_length(s, '$.content.chart_data.categories') > 0 AND json_array_length(x, '$.values') <> json_array_length(s, '$.content.chart_data.categories')", "'series[' || (i - 1) || '].length'"))}))))
      WHEN 'table' THEN list_concat({_told(("json_array_length(s, '$.content.headers') = 0", "'headers_missing'"))}, list_filter(list_transform(json_extract(s, '$.content.headers[*]'), lambda h, i: CASE WHEN NOT json_exists(h, '$.key') THEN 'headers[' || (i - 1) || '].key_missing' END), lambda m: m IS NOT NULL),
        {_told(("json_array_length(s, '$.content.rows') = 0", "'rows_missing'"))}) ELSE [] END) END)"""


@query(
    "deck_messages",
    f"""WITH e AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_id, {_BULLETS} AS slide FROM (SELECT *, {_K} AS k FROM events)),
    d AS (SELECT user_id, day, count(*) AS n, array_to_string(list(slide ORDER BY event_id), ', ') AS items FROM e GROUP BY 1, 2),
    t AS (SELECT user_id, day, {_DECK} AS text FROM d),
    v AS (SELECT user_id, day, json_valid(text) AS ok, CAST(CASE WHEN json_valid(text) THEN text ELSE '{{}}' END AS JSON) AS j FROM t),
    m AS (SELECT user_id, day, CASE WHEN NOT ok THEN ['json'] ELSE list_concat({_told(("json_extract_string(j, '$.schema_version') <> '1.0.0'", "'schema_version'"), ("json_extract_string(j, '$.aspect_ratio') NOT IN ('16:9', '4:3')", "'aspect_ratio'"),
        ("json_extract_string(j, '$.metadata.theme') NOT IN ('corporate_dark', 'modern_light', 'startup_minimal', 'healthcare_clinical', 'financial_formal')", "'theme'"))},
        list_transform(json_extract_string(j, '$.validation_state.blocking_errors[*]'), lambda x: '[Deck-level] ' || x),
        CASE WHEN json_array_length(j, '$.slides') = 0 THEN ['no_slides'] ELSE list_concat(CASE WHEN json_array_length(j, '$.slides') > 100 THEN ['slides_many'] ELSE [] END,
          flatten(list_transform(json_extract(j, '$.slides[*]'), lambda s: list_transform({_MESSAGES}, lambda q: '[Slide ' || json_extract_string(s, '$.slide_index') || ' / ' || substr(json_extract_string(s, '$.slide_id'), 1, 8) || '] ' || q)))) END) END AS ms FROM v)
    SELECT user_id, day, len(ms) = 0 AS valid, CAST(len(ms) AS BIGINT) AS n, array_to_string(ms, chr(10)) AS messages FROM m""",
)
def deck_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks as JSON through the gate: whether each may be exported, and all that is wrong with it."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = rows.select("user_id", F.to_date("ts").alias("day"), "event_id", F.expr(_BULLETS).alias("slide"))
    decks = rows.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("event_id", "slide"))).alias("s"))
    text = F.expr(_DECK.replace("items", "array_join(transform(s, x -> x.slide), ', ')"))
    valid, messages = C.gated(F.col("v"), THEMES)
    out = decks.select("user_id", "day", F.try_parse_json(text).alias("v")).select("user_id", "day", valid.alias("valid"), messages.alias("m"))
    return out.select("user_id", "day", "valid", F.size("m").cast("long").alias("n"), F.array_join("m", "\n").alias("messages"))
