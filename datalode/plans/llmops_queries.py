"""Model-operations queries over the events, labels and documents tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.operators import llmops as L
from datalode.plans.registry import query, table

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_CALLS = f"""calls AS (SELECT event_id, user_id AS tenant_id, event_type AS step, CAST(floor(value * 5000) AS BIGINT) AS input_tokens, 10 * {_K} AS output_tokens, ts, value / 50 AS duration_secs,
    CASE event_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-4-turbo' ELSE 'unknown' END AS model FROM events),
    priced AS (SELECT *, input_tokens / 1e6 * CASE model WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'gpt-4-turbo' THEN 10 ELSE 5 END
                       + output_tokens / 1e6 * CASE model WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'gpt-4-turbo' THEN 30 ELSE 15 END AS cost_usd FROM calls)"""


def _key() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, ("gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    calls = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("tenant_id"), F.col("event_type").alias("step"), F.floor(F.col("value") * 5000).alias("input_tokens"),
        (10 * _key()).alias("output_tokens"), "ts", (F.col("value") / 50).alias("duration_secs"), model.alias("model"),
    )
    return L.priced(calls)


@query("route_cost", f"WITH {_CALLS} SELECT event_id, model, round(cost_usd, 9) AS cost_usd, cost_usd > 5 AS broken FROM priced")
def route_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of every call, and whether the circuit breaker would stop it."""
    return _calls(spark, sf_dir).select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"), (F.col("cost_usd") > L.BREAKER).alias("broken"))


@query("pipeline_price_book", f"WITH {_CALLS} SELECT model, round(sum(input_tokens / 1e6 * 0.15 + output_tokens / 1e6 * 0.6), 6) AS cost_usd FROM calls GROUP BY 1")
def pipeline_price_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: spend by the second price book."""
    return L.priced(_calls(spark, sf_dir).drop("cost_usd"), "pipeline").groupBy("model").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query(
    "routing_savings",
    f"""WITH {_CALLS}, a AS (SELECT event_id, model, cost_usd AS c, input_tokens / 1e6 * 0.15 + output_tokens / 1e6 * 0.6 AS m FROM priced)
    SELECT event_id, model, round(c, 9) AS current_cost_usd, round(m, 9) AS alternative_cost_usd, round(c - m, 9) AS savings_usd, round(CAST((c - m) / greatest(c, 0.000001) * 100 AS DECIMAL(20, 6)), 1)::DOUBLE AS savings_percent FROM a""",
)
def routing_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every call would save on the small model."""
    both = L.priced(_calls(spark, sf_dir).withColumn("other", F.lit("gpt-4o-mini")), model="other", cost="m")
    c, m = F.col("cost_usd"), F.col("m")
    return both.select(
        "event_id", "model", F.round(c, 9).alias("current_cost_usd"), F.round(m, 9).alias("alternative_cost_usd"), F.round(c - m, 9).alias("savings_usd"),
        L.rounded((c - m) / F.greatest(c, F.lit(0.000001)) * 100, 1).alias("savings_percent"),
    )


@query("cost_daily", f"WITH {_CALLS} SELECT tenant_id, CAST(ts AS DATE) AS day, round(sum(cost_usd), 9) AS cost_usd, count(*) AS calls FROM priced GROUP BY ALL")
def cost_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: spend by tenant and day."""
    return L.daily_cost(_calls(spark, sf_dir))


@query(
    "tenant_report",
    f"""WITH {_CALLS}, d AS (SELECT tenant_id, CAST(ts AS DATE) AS day, sum(cost_usd) AS c FROM priced GROUP BY ALL)
    SELECT tenant_id, round(sum(c)::DECIMAL(20, 9), 4)::DOUBLE AS total_cost_usd, round((sum(c) / count(*))::DECIMAL(20, 9), 4)::DOUBLE AS daily_average_usd, round((sum(c) / count(*) * 30)::DECIMAL(20, 9), 2)::DOUBLE AS estimated_monthly_usd,
    round(greatest(0.0, 10.0 - coalesce(sum(c) FILTER (day = DATE '2024-01-15'), 0.0))::DECIMAL(20, 9), 4)::DOUBLE AS budget_remaining_today, count(*) AS active_days FROM d GROUP BY 1""",
)
def tenant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: one report per tenant as of 15 January 2024."""
    return L.tenant_report(_calls(spark, sf_dir), F.to_date(F.lit("2024-01-15")))


@query(
    "cost_rollup",
    f"""WITH {_CALLS} SELECT model, step, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd, CAST(grouping(model, step) AS BIGINT) AS level
    FROM priced GROUP BY ROLLUP (model, step)""",
)
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: tokens and spend by model and step with subtotals."""
    out = _calls(spark, sf_dir).rollup("model", "step").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.grouping_id().alias("level")
    )
    return out.select("model", "step", "input_tokens", "output_tokens", "cost_usd", "level")


@query(
    "latency_buckets",
    f"""WITH {_CALLS}, b AS (SELECT unnest([0.5, 1, 2, 5, 10, 20, 30, 60]) AS le) SELECT model, CAST(le AS DOUBLE) AS le, count(*) FILTER (duration_secs <= le) AS n FROM calls, b WHERE duration_secs > 0 GROUP BY ALL""",
)
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: cumulative histogram of call durations by model."""
    counts = [F.count_if(F.col("duration_secs") <= le).alias(str(i)) for i, le in enumerate(L.LATENCY_BUCKETS)]
    wide = _calls(spark, sf_dir).where("duration_secs > 0").groupBy("model").agg(*counts)
    rows = F.array(*(F.struct(F.lit(float(le)).alias("le"), F.col(str(i)).alias("n")) for i, le in enumerate(L.LATENCY_BUCKETS)))
    return wide.select("model", F.explode(rows).alias("b")).select("model", "b.le", "b.n")


@query("budget_status", f"WITH {_CALLS} , d AS (SELECT tenant_id, CAST(ts AS DATE) AS day, round(sum(cost_usd)::DECIMAL(20, 9), 6)::DOUBLE AS spent FROM priced GROUP BY ALL), l AS (SELECT *, CASE WHEN tenant_id % 10 = 0 THEN 100.0 ELSE 10.0 END::DOUBLE AS daily_limit FROM d) SELECT *, spent >= daily_limit AS blocked FROM l")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, T5: tenant days over their budget; every tenth tenant is an admin."""
    days = _calls(spark, sf_dir).groupBy("tenant_id", F.to_date("ts").alias("day")).agg(L.rounded(F.sum("cost_usd"), 6).alias("spent"))
    limit = F.when(F.col("tenant_id") % 10 == 0, L.ADMIN_BUDGET).otherwise(L.DAILY_BUDGET)
    return days.withColumn("daily_limit", limit).withColumn("blocked", F.col("spent") >= F.col("daily_limit"))


_TECH = ", ".join(f"'{k}'" for k in L.TECHNICAL)


@query(
    "prompt_complexity",
    f"""WITH p AS (SELECT conv_id, turn, text, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n, conv_id % 30 AS slides, turn > 1 AS grounded,
        CASE WHEN conv_id % 5 = 0 THEN 'de' ELSE 'en-US' END AS lang, list_filter([{_TECH}], lambda k: contains(lower(text), k)) AS found FROM conversations WHERE role = 'user'),
    t AS (SELECT *, least(10, CASE WHEN n > 200 THEN 3 WHEN n > 50 THEN 1 ELSE 0 END + CASE WHEN slides > 20 THEN 2 WHEN slides > 10 THEN 1 ELSE 0 END + CASE WHEN grounded THEN 3 ELSE 0 END
        + CASE WHEN len(found) > 0 THEN 2 ELSE 0 END + CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS tenths FROM p)
    SELECT conv_id, turn, round(tenths / 10.0, 2)::DOUBLE AS complexity_score, CASE WHEN tenths >= 5 THEN 'powerful' WHEN tenths >= 2 THEN 'balanced' ELSE 'fast' END AS recommended_class,
    coalesce(nullif(array_to_string(list_filter([CASE WHEN n > 200 THEN 'Long prompt (' || n || ' words)' END, CASE WHEN slides > 20 THEN 'Large deck (' || slides || ' slides)' END,
      CASE WHEN grounded THEN 'RAG-grounded (needs accurate synthesis)' END, CASE WHEN len(found) > 0 THEN 'Technical content: ' || array_to_string(found[1:3], ', ') END,
      CASE WHEN lang = 'de' THEN 'Non-English: de' END], lambda x: x IS NOT NULL), '; '), ''), 'Simple task') AS reasoning FROM t""",
)
def prompt_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of every user turn; slides, grounding and language come from its numbers."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    language = F.when(F.col("conv_id") % 5 == 0, "de").otherwise("en-US")
    return turns.select("conv_id", "turn", *(c.alias(n) for n, c in L.complexity(F.col("text"), F.col("conv_id") % 30, F.col("turn") > 1, language).items()))


@query(
    "model_routing",
    """WITH e AS (SELECT event_id, ['fast', 'balanced', 'powerful', 'huge'][event_id % 4 + 1] AS c, ['free', 'pro', 'enterprise', 'admin', 'trial'][user_id % 5 + 1] AS p FROM events),
    l AS (SELECT *, CASE c WHEN 'balanced' THEN 1 WHEN 'powerful' THEN 2 ELSE 0 END AS lc, CASE WHEN p IN ('free', 'trial') THEN 0 ELSE 2 END AS lp FROM e)
    SELECT c AS model_class, p AS plan, CASE WHEN lc <= lp AND c IN ('balanced', 'powerful') THEN 'gpt-4o' ELSE 'gpt-4o-mini' END AS model, count(*) AS n FROM l GROUP BY ALL""",
)
def model_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of every class and plan that events ask for."""
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        pick(("fast", "balanced", "powerful", "huge"), F.col("event_id")).alias("model_class"), pick(("free", "pro", "enterprise", "admin", "trial"), F.col("user_id")).alias("plan")
    )
    return L.routed(rows).groupBy("model_class", "plan", "model").agg(F.count("*").alias("n"))


@query("trace_rollup", f"WITH {_CALLS} SELECT tenant_id AS parent_id, step, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, round(sum(duration_secs), 6) AS duration, count(*) FILTER (step = 'error') AS errors FROM calls GROUP BY ALL")
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, time and errors of child calls by parent and step."""
    return _calls(spark, sf_dir).groupBy(F.col("tenant_id").alias("parent_id"), "step").agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.round(F.sum("duration_secs"), 6).alias("duration"), F.count_if(F.col("step") == "error").alias("errors")
    )


_FEEDBACK = f"""f AS (SELECT event_id, user_id AS tenant_id, {_K} AS slide_id, ts, CASE event_type WHEN 'click' THEN 'thumbs_up' WHEN 'error' THEN 'thumbs_down' WHEN 'purchase' THEN 'edit' END AS feedback_type,
    props AS original_value, event_type AS new_value, ['none', 'basic', 'full'][user_id % 3 + 1] AS consent FROM events WHERE event_type IN ('click', 'error', 'purchase'))"""


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    consent = F.element_at(F.array(*map(F.lit, ("none", "basic", "full"))), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").where(kind.isin("click", "error", "purchase")).select(
        "event_id", F.col("user_id").alias("tenant_id"), _key().alias("slide_id"), "ts", F.when(kind == "click", "thumbs_up").when(kind == "error", "thumbs_down").otherwise("edit").alias("feedback_type"),
        F.col("props").alias("original_value"), kind.alias("new_value"), consent.alias("consent"),
    )


@query(
    "feedback_stats",
    f"""WITH {_FEEDBACK}, e AS (SELECT tenant_id, slide_id, count(*) AS n FROM f WHERE feedback_type = 'edit' GROUP BY ALL),
    t AS (SELECT tenant_id, string_agg(CAST(slide_id AS VARCHAR), ',' ORDER BY r) AS most_edited FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, slide_id) AS r FROM e) WHERE r <= 5 GROUP BY 1)
    SELECT f.tenant_id, count(*) AS total, count(*) FILTER (feedback_type = 'thumbs_up') AS up, count(*) FILTER (feedback_type = 'thumbs_down') AS down, count(*) FILTER (feedback_type = 'edit') AS edits,
    round(count(*) FILTER (feedback_type = 'thumbs_up') / greatest(1, count(*) FILTER (feedback_type IN ('thumbs_up', 'thumbs_down'))), 4) AS up_rate, coalesce(any_value(most_edited), '') AS most_edited
    FROM f LEFT JOIN t ON t.tenant_id = f.tenant_id GROUP BY f.tenant_id""",
)
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of every tenant."""
    return L.feedback_stats(_feedback(spark, sf_dir))


@query(
    "feedback_consent",
    f"""WITH {_FEEDBACK} SELECT event_id, consent, CASE WHEN consent = 'basic' THEN substr(sha256(original_value), 1, 16) ELSE original_value END AS original_value,
    CASE WHEN consent = 'full' THEN new_value END AS new_value, CASE WHEN length(new_value) > length(original_value) * 1.5 THEN 'expanded' WHEN length(new_value) < length(original_value) * 0.5 THEN 'shortened' ELSE 'modified' END AS change_type
    FROM f WHERE consent <> 'none'""",
)
def feedback_consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback as consent allows, with the kind of change."""
    rows = _feedback(spark, sf_dir).withColumn("change_type", L.change_type(F.col("original_value"), F.col("new_value")))
    return L.with_consent(rows).select("event_id", "consent", "original_value", "new_value", "change_type")


@query("feedback_traces", f"WITH {_FEEDBACK}, {_CALLS} SELECT f.event_id, feedback_type, model, step FROM f JOIN calls c ON c.event_id = f.event_id")
def feedback_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback with the call that it is about."""
    return _feedback(spark, sf_dir).join(_calls(spark, sf_dir).select("event_id", "model", "step"), "event_id").select("event_id", "feedback_type", "model", "step")


_SCORES = """s AS (SELECT doc_id AS case_id, lang AS prompt_name, CAST(quality AS DOUBLE) AS schema_compliance, CAST(toxic AS DOUBLE) AS hallucination_rate, least(1.0, n_chars / 5000)::DOUBLE AS faithfulness
    FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT *, schema_compliance >= 0.9 AND hallucination_rate <= 0.2 AND faithfulness >= 0.75 AS passed FROM s)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    wide = both.select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("prompt_name"), F.col("quality").cast("double").alias("schema_compliance"), F.col("toxic").cast("double").alias("hallucination_rate"),
        F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("faithfulness"),
    )
    return L.case_results(wide.unpivot(["case_id", "prompt_name"], list(L.JUDGES), "judge", "score"))


@query("case_verdicts", f"WITH {_SCORES} SELECT case_id, prompt_name, passed, faithfulness, schema_compliance, hallucination_rate FROM c")
def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every labelled document as an evaluation case."""
    return _cases(spark, sf_dir)


_SUMMARY = f"""{_SCORES}, e AS (SELECT prompt_name, count(*) AS total, count(*) FILTER (passed) AS passed, round(avg(faithfulness), 4) AS avg_faithfulness, round(avg(schema_compliance), 4) AS avg_schema_compliance,
    round(avg(hallucination_rate), 4) AS avg_hallucination_rate, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM c GROUP BY 1)"""


@query("eval_summary", f"WITH {_SUMMARY} SELECT * FROM e")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of every prompt."""
    return L.eval_summary(_cases(spark, sf_dir))


@query(
    "eval_regression",
    f"""WITH {_SUMMARY}, g AS (SELECT prompt_name, list_filter([CASE WHEN avg_faithfulness <> 0 AND 0.85 - avg_faithfulness > 0.05 THEN 'faithfulness' END,
    CASE WHEN avg_hallucination_rate <> 0 AND avg_hallucination_rate - 0.02 > 0.05 THEN 'hallucination_rate' END], lambda x: x IS NOT NULL) AS r FROM e)
    SELECT prompt_name, array_to_string(r, ',') AS regressed, len(r) > 0 AS failed_gate FROM g""",
)
def eval_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that got worse than their baseline."""
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("prompt_name")).distinct()
    return L.regressions(L.eval_summary(_cases(spark, sf_dir)), names.withColumns({"faithfulness": F.lit(0.85), "hallucination_rate": F.lit(0.02)}))


@query(
    "cache_exact",
    """WITH r AS (SELECT event_id, sha256(props) AS prompt_hash, ts, event_type FROM events),
    w AS (SELECT prompt_hash, max(ts) AS created_at, count(*) AS writes FROM r WHERE event_type = 'purchase' GROUP BY 1)
    SELECT event_id, prompt_hash, writes FROM r JOIN w USING (prompt_hash) WHERE event_type <> 'purchase' AND ts >= created_at AND ts < created_at + INTERVAL 24 HOURS""",
)
def cache_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a live cache entry answers; purchases are the writes."""
    rows = table(spark, sf_dir, "events").withColumn("prompt_hash", F.sha2("props", 256))
    writes = rows.where("event_type = 'purchase'").select("prompt_hash", F.col("event_id").alias("entry_id"), F.create_map(F.lit("k"), "props", F.lit("_t"), "event_type").alias("result"), F.col("ts").alias("created_at"))
    return L.cache_hits(rows.where("event_type <> 'purchase'"), L.stored_cache(writes)).select("event_id", "prompt_hash", "writes")


@query("cache_hit_counts", "SELECT sha256(props) AS prompt_hash, count(*) AS hits, max(ts) AS last_hit, sha256(props) LIKE '%ab%' AS invalidated FROM events WHERE event_type = 'view' GROUP BY 1")
def cache_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every hash, and whether an invalidation by pattern would end it."""
    hits = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.sha2("props", 256).alias("prompt_hash"))
    return hits.agg(F.count("*").alias("hits"), F.max("ts").alias("last_hit")).withColumn("invalidated", F.col("prompt_hash").like("%ab%"))


@query(
    "cache_semantic",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT * FROM v ORDER BY vec_id DESC LIMIT 500),
    s AS (SELECT q.vec_id AS query_id, n.vec_id AS entry_id, round(list_cosine_similarity(q.e, n.e), 9) AS score FROM v q JOIN n ON q.vec_id <> n.vec_id),
    b AS (SELECT query_id, max(score) AS score, arg_max(entry_id, (score, -entry_id)) AS entry_id FROM s GROUP BY 1)
    SELECT query_id, entry_id, score FROM b WHERE score >= 0.3""",
)
def cache_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the newest 500 entries for every vector, if near enough (0.3 on these data)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    newest = vectors.orderBy(F.desc("query_id")).limit(500).select(F.col("query_id").alias("entry_id"), F.col("embedding").alias("e"))
    found = L.nearest_entries(vectors, newest)
    return found.where("score >= 0.3").select("query_id", "entry_id", "score")


@query(
    "idempotent_first",
    f"""WITH r AS (SELECT {_K} AS client_request_id, event_id AS job_id, ts, min(ts) OVER (PARTITION BY {_K}) AS s FROM events),
    g AS (SELECT *, CAST(floor((epoch(ts)::BIGINT - epoch(s)::BIGINT) / 86400) AS BIGINT) AS slot FROM r)
    SELECT client_request_id, slot, arg_min(job_id, (ts, job_id)) AS job_id, count(*) AS requests FROM g GROUP BY ALL""",
)
def idempotent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first job of every client request id and day, and how often it was asked for."""
    rows = table(spark, sf_dir, "events").select(_key().alias("client_request_id"), F.col("event_id").alias("job_id"), "ts")
    return L.first_submissions(rows)
