"""Deck, layout, parsing and stream queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datalode.operators import decks as D
from datalode.operators import parse as P
from datalode.plans.registry import query, table
from datalode.streaming import jobs as S

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


def _pick(names: tuple[str, ...], c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))


_TYPES = ("title_slide", "content_bullets", "data_chart", "visual_split", "table", "section_divider", "poster")


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slide of every document; what is missing or wrong follows from its number."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    lines = F.slice(F.split("text", "\n"), 1, 8)
    bullets = F.transform(lines, lambda x: F.struct(F.when(i % 3 != 0, F.md5(x)).alias("element_id"), F.substring(x, 1, 20).alias("text")))
    values = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.when((i % 11 == 0) & (n == 2), "x").otherwise((i + n).cast("string")))
    chart = F.struct(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (i % 4).cast("int")).alias("categories"), F.array(F.struct(F.lit("s").alias("name"), values.alias("values"))).alias("series"))
    kind = _pick(_TYPES, i)
    content = F.struct(
        F.when((kind == "title_slide") & (i % 5 != 0), "Head").alias("headline"),
        F.when((kind == "visual_split") & (i % 5 != 1), "Text").alias("supporting_text"),
        F.when((kind == "section_divider") & (i % 5 != 2), "Part").alias("section_title"),
        F.when(kind == "data_chart", _pick((*D.CHART_TYPES, "radar"), i)).alias("chart_type"),
        F.when(kind == "content_bullets", bullets).alias("bullets"),
        F.when(kind == "data_chart", chart).alias("chart_data"),
        F.when((kind == "table") & (i % 5 != 3), F.array(F.struct(F.lit("k1").alias("key")))).alias("headers"),
        F.when((kind == "table") & (i % 2 == 0), F.array(F.create_map(F.lit("k1"), F.lit("v")))).alias("rows"),
    )
    return d.select(
        F.col("source").alias("presentation_id"), i.cast("string").alias("slide_id"), (F.col("n_chars") / 2).alias("slide_index"), kind.alias("slide_type"),
        F.substring("text", 1, (i % 80).cast("int")).alias("action_title"), (i % 15 / 10).cast("double").alias("font_scale"), F.to_json(content).alias("content"), i.alias("doc_id"),
    )


_RULES = f"""s AS (SELECT doc_id, source AS presentation_id, {list(_TYPES)}[doc_id % 7 + 1] AS kind, doc_id AS i, length(substr(text, 1, doc_id % 80)) AS tl, len(list_slice(string_split(text, chr(10)), 1, 8)) AS nb,
      (doc_id % 15) / 10 AS fs FROM documents),
    v AS (SELECT doc_id, presentation_id, list_filter([
      CASE WHEN kind = 'poster' THEN 'slide_type' END, CASE WHEN kind <> 'poster' AND tl = 0 THEN 'action_title_missing' END, CASE WHEN kind <> 'poster' AND tl > 60 THEN 'action_title_long' END,
      CASE WHEN kind <> 'poster' AND (i % 15 < 8 OR i % 15 > 12) THEN 'font_scale' END, CASE WHEN kind = 'title_slide' AND i % 5 = 0 THEN 'headline' END,
      CASE WHEN kind = 'content_bullets' AND nb > 6 THEN 'bullets_many' END, CASE WHEN kind = 'content_bullets' AND i % 3 = 0 THEN 'bullet_id' END,
      CASE WHEN kind = 'data_chart' AND i % 9 = 8 THEN 'chart_type' END, CASE WHEN kind = 'data_chart' AND i % 4 = 0 THEN 'categories' END,
      CASE WHEN kind = 'data_chart' AND i % 11 = 0 THEN 'series_number' END, CASE WHEN kind = 'data_chart' AND i % 9 <> 7 AND i % 4 IN (1, 2) THEN 'series_length' END,
      CASE WHEN kind = 'table' AND i % 5 = 3 THEN 'headers' END, CASE WHEN kind = 'table' AND i % 2 = 1 THEN 'rows' END,
      CASE WHEN kind = 'visual_split' AND i % 5 = 1 THEN 'supporting_text' END, CASE WHEN kind = 'section_divider' AND i % 5 = 2 THEN 'section_title' END], lambda x: x IS NOT NULL) AS vs FROM s)"""


@query("slide_checks", f"WITH {_RULES} SELECT doc_id, array_to_string(vs, ',') AS violations FROM v")
def slide_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of every slide."""
    return D.checked_slides(_slides(spark, sf_dir)).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("deck_gate", f"WITH {_RULES} SELECT presentation_id, count(*) AS slides, CAST(sum(len(vs)) + CAST(count(*) > 100 AS INT) AS BIGINT) AS broken, sum(len(vs)) = 0 AND count(*) <= 100 AS valid FROM v GROUP BY 1")
def deck_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which presentations may be exported."""
    return D.deck_gate(_slides(spark, sf_dir))


@query("slide_types", f"""WITH {_RULES} SELECT CASE WHEN kind IN ('data_chart', 'content_bullets') THEN kind WHEN kind = 'visual_split' AND i % 5 <> 1 THEN kind WHEN kind = 'table' AND i % 5 <> 3 AND i % 2 = 0 THEN kind
    WHEN kind = 'section_divider' AND i % 5 <> 2 THEN kind WHEN kind = 'title_slide' AND i % 5 <> 0 THEN kind ELSE 'unknown' END AS inferred, count(*) AS n FROM s GROUP BY 1""")
def slide_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide types by the keys of their content."""
    return _slides(spark, sf_dir).groupBy(D.inferred_type(F.col("content")).alias("inferred")).agg(F.count("*").alias("n"))


@query("slide_reindex", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars / 2, CAST(doc_id AS VARCHAR)) - 1 AS new_index FROM documents")
def slide_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense slide indices."""
    return D.reindexed(_slides(spark, sf_dir)).select("doc_id", F.col("new_index").cast("long").alias("new_index"))


@query(
    "waterfall_base",
    f"""WITH r AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN -value ELSE value END AS v FROM events), a AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM r)
    SELECT event_id, round(least(after - v, after), 6) AS base, round(abs(v), 6) AS delta FROM a""",
)
def waterfall_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running bars of every user's values; errors count against."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("value"))
    return D.waterfall(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "base", "delta")


@query(
    "share_columns",
    """SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 9) AS width_share, round(value / greatest(max(value) OVER (PARTITION BY user_id), 1), 9) AS bar_share,
    CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 AS INTEGER) AS stripe FROM events""",
)
def share_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the sum and of the largest value, and alternating rows."""
    w = Window.partitionBy("user_id")
    stripe = F.pmod(F.row_number().over(w.orderBy("ts", "event_id")) - 1, F.lit(2))
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(v / F.sum(v).over(w), 9).alias("width_share"), F.round(v / F.greatest(F.max(v).over(w), F.lit(1.0)), 9).alias("bar_share"), stripe.alias("stripe"))


_BOXES = f"""b AS (SELECT user_id AS slide_id, event_id AS element_id, floor(value * 2) AS x, {_K} * 10.0 AS y, 20 + floor(value / 10) AS width, 10.0 + {_K} AS height, {_K} % 30 AS font_size_px,
    CASE event_type WHEN 'view' THEN 'text' WHEN 'signup' THEN 'chart' WHEN 'purchase' THEN 'image' WHEN 'click' THEN 'callout' ELSE 'footer' END AS element_type FROM events)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    kind = F.when(t == "view", "text").when(t == "signup", "chart").when(t == "purchase", "image").when(t == "click", "callout").otherwise("footer")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("slide_id"), F.col("event_id").alias("element_id"), F.floor(F.col("value") * 2).cast("double").alias("x"), (k * 10.0).alias("y"),
        (20 + F.floor(F.col("value") / 10)).cast("double").alias("width"), (k + 10.0).alias("height"), (k % 30).alias("font_size_px"), kind.alias("element_type"),
    )


@query(
    "box_overlap",
    f"""WITH {_BOXES} SELECT a.slide_id, count(*) AS pairs FROM b a JOIN b c ON a.slide_id = c.slide_id AND a.element_id < c.element_id AND a.element_type <> 'footer' AND c.element_type <> 'footer'
    AND a.x + a.width > c.x AND c.x + c.width > a.x AND a.y + a.height > c.y AND c.y + c.height > a.y GROUP BY 1""",
)
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of every slide."""
    return D.overlaps(_boxes(spark, sf_dir)).groupBy("slide_id").agg(F.count("*").alias("pairs"))


@query(
    "layout_flags",
    f"""WITH {_BOXES}, f AS (SELECT slide_id, count(*) FILTER (x < 0 OR y < 0 OR x + width > 1000 OR y + height > 1000) AS outside, count(*) FILTER (font_size_px < 12) AS small_font,
    count(*) FILTER (element_type IN ('chart', 'image', 'callout') AND least(width, height) < 33) AS small_target, min(y) AS t, 1000 - max(y + height) AS bo FROM b GROUP BY 1)
    SELECT slide_id, outside, small_font, small_target, t > 0 AND bo > 0 AND greatest(t, bo) / least(t, bo) > 4 AS unbalanced FROM f""",
)
def layout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout faults of every slide."""
    return D.layout_flags(_boxes(spark, sf_dir))


@query("mirrored_boxes", f"WITH {_BOXES} SELECT element_id, CASE WHEN slide_id % 4 = 0 AND element_type NOT IN ('chart', 'image') THEN 1000 - x - width ELSE x END AS x FROM b")
def mirrored_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of right-to-left slides (every fourth) flipped."""
    return D.mirrored(_boxes(spark, sf_dir), F.col("slide_id") % 4 == 0).select("element_id", "x")


@query(
    "reading_order",
    f"""WITH {_BOXES}, r AS (SELECT slide_id, element_id, row_number() OVER (PARTITION BY slide_id ORDER BY element_id) AS a, row_number() OVER (PARTITION BY slide_id ORDER BY y, x, element_id) AS o FROM b)
    SELECT slide_id, count(*) FILTER (a <> o) AS moved FROM r GROUP BY 1""",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose declared place differs from their place on the slide."""
    w = Window.partitionBy("slide_id")
    rows = _boxes(spark, sf_dir).withColumns({"a": F.row_number().over(w.orderBy("element_id")), "o": F.row_number().over(w.orderBy("y", "x", "element_id"))})
    return rows.groupBy("slide_id").agg(F.count_if(F.col("a") != F.col("o")).alias("moved"))


@query(
    "snapshot_diff",
    """SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS change
    FROM (SELECT user_id, event_type, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL) a FULL JOIN (SELECT user_id, event_type, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY ALL) b
    ON a.user_id = b.user_id AND a.event_type = b.event_type""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between the snapshots of two weeks."""
    events = table(spark, sf_dir, "events")
    of = lambda c: events.where(c).groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return D.snapshot_diff(of("ts < timestamp '2024-01-15'"), of("ts >= timestamp '2024-01-08'"), ["user_id", "event_type"], ["v"])


@query("last_write_slides", f"SELECT user_id, k, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS writes FROM (SELECT *, {_K} AS k FROM events) GROUP BY ALL")
def last_write_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user's slide, and how many there were."""
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id", "ts")
    last = D.last_writes(rows, ["user_id", "k"], ["ts", "event_id"]).select("user_id", "k", "event_id")
    return last.join(rows.groupBy("user_id", "k").agg(F.count("*").alias("writes")), ["user_id", "k"])


@query(
    "deck_rollup",
    """SELECT user_id AS job_id, CAST(sum(floor(value)) AS BIGINT) AS tokens, round(sum(value) / 1000, 6) AS cost_usd, count(*) AS slides, count(*) FILTER (event_type = 'error') AS failed,
    CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'complete' WHEN count(*) FILTER (event_type = 'error') < count(*) THEN 'partial_failure' ELSE 'failed' END AS status FROM events GROUP BY 1""",
)
def deck_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, cost and status of every job."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.floor("value").alias("tokens"), (F.col("value") / 1000).alias("cost_usd"), (F.col("event_type") == "error").alias("failed"))
    return D.deck_rollup(rows)


@query(
    "markdown_elements",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents), t AS (SELECT doc_id, ord, trim(line) AS line FROM l)
    SELECT doc_id, CASE WHEN regexp_matches(line, '^#{1,3}\\s') THEN 'heading' WHEN starts_with(line, '|') THEN 'table' WHEN regexp_matches(line, '^[-*+]\\s') THEN 'list_item' ELSE 'paragraph' END AS element_type, count(*) AS n, CAST(max(ord) AS BIGINT) AS last
    FROM t WHERE line <> '' GROUP BY ALL""",
)
def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elements of every document by kind."""
    out = P.markdown_elements(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.groupBy("doc_id", "element_type").agg(F.count("*").alias("n"), F.max("ord").cast("long").alias("last"))


@query("html_elements")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks of every page."""
    return P.html_elements(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("html_sections")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page with their open headings."""
    return P.section_paths(P.html_elements(table(spark, sf_dir, "pages").select("page_id", "html")).withColumnRenamed("page_id", "doc_id")).withColumn("section_path", F.array_join("section_path", " > "))


@query(
    "chunk_paragraphs",
    f"""WITH p AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: {{'t': x, 'n': len({_WORDS.format("x")})}}) AS ps FROM documents),
    i AS (SELECT doc_id, list_transform(ps, lambda x: {{'out': CAST([] AS VARCHAR[]), 'buf': [x.t], 'n': x.n, 'tail': ''}}) AS xs FROM p),
    r AS (SELECT doc_id, list_reduce(list_append(xs, {{'out': CAST([] AS VARCHAR[]), 'buf': [''], 'n': CAST(-1 AS BIGINT), 'tail': ''}}), lambda acc, x:
      CASE WHEN x.n >= 0 AND x.n <= 512 AND (acc.n + x.n <= 512 OR len(acc.buf) = 0)
      THEN {{'out': acc.out, 'buf': list_concat(acc.buf, x.buf), 'n': acc.n + x.n, 'tail': acc.tail}}
      ELSE {{'out': list_concat(CASE WHEN len(acc.buf) > 0 AND len({_WORDS.format("acc.tail || ' ' || array_to_string(acc.buf, ' ')")}) >= 50 THEN list_append(acc.out, CASE WHEN acc.tail <> '' THEN acc.tail || chr(10) || chr(10) ELSE '' END || array_to_string(acc.buf, chr(10) || chr(10))) ELSE acc.out END,
              CASE WHEN x.n > 512 THEN [array_to_string(list_slice({_WORDS.format("x.buf[1]")}, 1, 512), ' ')] ELSE CAST([] AS VARCHAR[]) END),
            'buf': CASE WHEN x.n > 512 THEN CAST([] AS VARCHAR[]) ELSE x.buf END, 'n': CASE WHEN x.n > 512 THEN CAST(0 AS BIGINT) ELSE x.n END,
            'tail': CASE WHEN x.n > 512 THEN array_to_string(list_slice({_WORDS.format("x.buf[1]")}, 449, 512), ' ')
                    WHEN len(acc.buf) > 0 AND len({_WORDS.format("acc.tail || ' ' || array_to_string(acc.buf, ' ')")}) >= 50 THEN array_to_string(list_slice({_WORDS.format("array_to_string(acc.buf, ' ')")}, -64, -1), ' ') ELSE acc.tail END}} END,
      {{'out': CAST([] AS VARCHAR[]), 'buf': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT), 'tail': ''}}).out AS chunks FROM i)
    SELECT doc_id, CAST(len(chunks) AS BIGINT) AS chunks, md5(array_to_string(chunks, '||')) AS digest FROM r WHERE len(chunks) > 0""",
)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, W4, F5, and of W2 the rules for plain lines, of A10 the count: greedy chunks of every document with overlaps, as a digest per document."""
    chunks = P.greedy_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.md5(F.array_join(parts, "||")).alias("digest"))


@query("short_pages", "SELECT doc_id, n_chars < 400 AS short, CAST(length(text) AS BIGINT) AS characters FROM documents WHERE length(text) < 400")
def short_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines add up to suspiciously few characters."""
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").where(size < 400).select("doc_id", (F.col("n_chars") < 400).alias("short"), size.alias("characters"))


@query("repeated_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) - count(DISTINCT line) AS repeats FROM l GROUP BY 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated parts of a document by hash."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id", F.sha2("line", 256)).agg(F.count("*").alias("n"))
    return lines.groupBy("doc_id").agg((F.sum("n") - F.count("*")).alias("repeats"))


@query("bidi_flags", r"SELECT doc_id, regexp_matches(text, '[\x{0590}-\x{05FF}\x{0600}-\x{06FF}]') AND regexp_matches(text, '[A-Za-z0-9]') AS mixed, length(text) - length(replace(text, 'ü', '')) AS marks FROM documents")
def bidi_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with letters of both directions."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (t.rlike(r"[֐-׿؀-ۿ]") & t.rlike("[A-Za-z0-9]")).alias("mixed"), (F.length(t) - F.length(F.replace(t, F.lit("ü"), F.lit("")))).cast("long").alias("marks"))


@query("event_replay", "SELECT user_id, count(*) AS replayed, min(ts) AS first, bool_or(event_type = 'purchase') AS ended FROM events WHERE ts > TIMESTAMP '2024-01-10' GROUP BY 1")
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client that was away since 10 January would be sent again."""
    rows = table(spark, sf_dir, "events").where("ts > timestamp '2024-01-10'")
    return rows.groupBy("user_id").agg(F.count("*").alias("replayed"), F.min("ts").alias("first"), F.bool_or(F.col("event_type") == "purchase").alias("ended"))


@query("rate_limit_1d", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 5")
def rate_limit_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: users over five events in a day."""
    return S.windowed_counts(table(spark, sf_dir, "events"), "1 day").where("n > 5").select("user_id", F.col("w.start").alias("window_start"), "n")


@query(
    "edit_debounce",
    f"""WITH e AS (SELECT user_id, ts, event_id, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
    SELECT user_id, min(ts) AS started, count(*) AS edits, arg_max(value, (ts, event_id)) AS value FROM g GROUP BY user_id, s""",
)
def edit_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that end after two quiet hours, with their last value."""
    w = F.session_window("ts", "2 hours")
    out = table(spark, sf_dir, "events").groupBy(w.alias("w"), "user_id").agg(F.min("ts").alias("started"), F.count("*").alias("edits"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return out.select("user_id", "started", "edits", "value")


@query("retry_ladder", f"SELECT event_id, CASE WHEN k % 4 < 3 THEN ts + to_seconds(CAST(30 * pow(2, k % 4) AS BIGINT)) END AS next_retry_at, k % 4 >= 3 AS exhausted FROM (SELECT *, {_K} AS k FROM events WHERE event_type = 'error')")
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When every failure is tried again; the fourth attempt is the last."""
    n = F.get_json_object("props", "$.k").cast("long") % 4
    wait = F.make_dt_interval(secs=F.lit(30) * F.pow(F.lit(2), n))
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.when(n < 3, F.col("ts") + wait).alias("next_retry_at"), (n >= 3).alias("exhausted"))


@query("stream_parse", f"SELECT event_type, count(*) AS n, CAST(sum({_K}) AS BIGINT) AS k FROM events GROUP BY 1")
def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream parsed file by file, then summed."""
    rows = S.drained(S.parsed(S.event_stream(spark, f"{sf_dir}/events.parque[t]")), "events").where("ok")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("stream_job_states", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, arg_max(event_type, (ts, event_id)) AS last, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'complete' WHEN count(*) FILTER (event_type = 'error') < count(*) THEN 'partial_failure' ELSE 'failed' END AS status FROM events GROUP BY 1")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states from the stream, merged batch by batch."""
    return S.job_states(S.event_stream(spark, f"{sf_dir}/events.parque[t]")).select("user_id", "n", "failed", "last", "status")


@query("stream_first_requests")
def stream_first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the stream without repeats of a key within a day."""
    return S.drained(S.first_requests(S.parsed(S.event_stream(spark, f"{sf_dir}/events.parque[t]"))), "first")
