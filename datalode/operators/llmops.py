"""Cost, routing, feedback, evaluation, cache and idempotency over whole logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dollars per million input and output tokens of each price book (fixed values).
PRICES = [
    ("monitor", "gpt-4o", 5.0, 15.0),
    ("monitor", "gpt-4o-2024-08-06", 5.0, 15.0),
    ("monitor", "gpt-4o-mini", 0.15, 0.6),
    ("monitor", "gpt-4o-mini-2024-07-18", 0.15, 0.6),
    ("monitor", "text-embedding-3-small", 0.02, 0.0),
    ("monitor", "text-embedding-3-large", 0.13, 0.0),
    ("monitor", "gpt-4-turbo", 10.0, 30.0),
    ("pipeline", "gpt-4o-2024-08-06", 2.5, 10.0),
    ("pipeline", "gpt-4o-mini", 0.15, 0.6),
]
#: Prices of unknown models in each book (fixed values).
DEFAULTS = {"monitor": (5.0, 15.0), "pipeline": (0.15, 0.6)}
BREAKER, DAILY_BUDGET, ADMIN_BUDGET = 5.0, 10.0, 100.0
#: Bounds in seconds (fixed values).
LATENCY_BUCKETS = (0.5, 1, 2, 5, 10, 20, 30, 60)
#: Least or largest score that passes each judge (fixed values).
JUDGES = {"faithfulness": 0.75, "schema_compliance": 0.9, "hallucination_rate": 0.2}
#: Classes of models by rank, plans' ceilings and the model of each class (fixed values).
CLASSES = {"fast": 0, "balanced": 1, "powerful": 2}
PLAN_CEILING = {"free": "fast", "pro": "powerful", "enterprise": "powerful", "admin": "powerful"}
CLASS_MODEL = {"fast": "gpt-4o-mini", "balanced": "gpt-4o", "powerful": "gpt-4o"}
#: Words that make a prompt technical (fixed values).
TECHNICAL = ["roi", "ebitda", "cagr", "npv", "irr", "discounted", "regression", "algorithm", "architecture", "integration", "derivatives", "hedging", "arbitrage"]


def rounded(value: Column, digits: int) -> Column:
    """Money rounded half up as a decimal, so that ties do not depend on the last bits of a double."""
    return F.round(value.cast("decimal(20,9)"), digits).cast("double")


def price_book(spark: SparkSession) -> DataFrame:
    """The price dimension; a handful of rows."""
    return spark.createDataFrame(PRICES, "price_book string, model string, input_per_m double, output_per_m double")


def priced(calls: DataFrame, book: str = "monitor", model: str = "model", cost: str = "cost_usd") -> DataFrame:
    """Adds the cost of each call; unknown models have the book's default price."""
    spark = calls.sparkSession
    prices = price_book(spark).where(F.col("price_book") == book).select(F.col("model").alias("__m"), "input_per_m", "output_per_m")
    out = calls.join(F.broadcast(prices), F.col(model) == F.col("__m"), "left")
    default_in, default_out = DEFAULTS[book]
    value = F.col("input_tokens") / 1e6 * F.coalesce("input_per_m", F.lit(default_in)) + F.col("output_tokens") / 1e6 * F.coalesce("output_per_m", F.lit(default_out))
    return out.withColumn(cost, value).drop("__m", "input_per_m", "output_per_m")


def daily_cost(calls: DataFrame) -> DataFrame:
    """Spend by tenant and day (9 digits); days without calls are absent."""
    return calls.groupBy("tenant_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("cost_usd"), 9).alias("cost_usd"), F.count("*").alias("calls"))


def tenant_report(calls: DataFrame, today: Column) -> DataFrame:
    """Total, mean of active days, month at that rate, and what is left of today's budget."""
    days = calls.groupBy("tenant_id", F.to_date("ts").alias("day")).agg(F.sum("cost_usd").alias("c"))
    out = days.groupBy("tenant_id").agg(F.sum("c").alias("t"), F.count("*").alias("active_days"), F.coalesce(F.sum(F.when(F.col("day") == today, F.col("c"))), F.lit(0.0)).alias("spent"))
    mean = F.col("t") / F.greatest("active_days", F.lit(1))
    return out.select(
        "tenant_id", rounded(F.col("t"), 4).alias("total_cost_usd"), rounded(mean, 4).alias("daily_average_usd"), rounded(mean * 30, 2).alias("estimated_monthly_usd"),
        rounded(F.greatest(F.lit(0.0), DAILY_BUDGET - F.col("spent")), 4).alias("budget_remaining_today"), "active_days",
    )


def routed(rows: DataFrame, model_class: str = "model_class", plan: str = "plan", force: Column | None = None) -> DataFrame:
    """Adds ``model``: the class, not above the plan's ceiling; unknown plans are ``fast``. A ``force`` that is not null wins."""
    level = lambda c: F.coalesce(_lookup(c, CLASSES), F.lit(0))
    ceiling = F.coalesce(_lookup(F.col(plan), PLAN_CEILING), F.lit("fast"))
    own = F.when(level(F.col(model_class)) <= level(ceiling), F.col(model_class)).otherwise(ceiling)
    by_class = F.coalesce(_lookup(own, CLASS_MODEL), F.lit("gpt-4o-mini"))
    return rows.withColumn("model", by_class if force is None else F.coalesce(force, by_class))


def _lookup(c: Column, values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c]


def complexity(prompt: Column, slides: Column, grounded: Column, language: Column) -> dict[str, Column]:
    """complexity_score, recommended_class and reasoning of a task; the score is summed in tenths."""
    n = F.size(F.filter(F.split(prompt, r"\s+"), lambda w: w != ""))
    low = F.lower(prompt)
    found = F.filter(F.array(*map(F.lit, TECHNICAL)), lambda k: F.contains(low, k))
    foreign = ~language.isin("en", "en-US", "en-GB")
    tenths = (
        F.when(n > 200, 3).when(n > 50, 1).otherwise(0)
        + F.when(slides > 20, 2).when(slides > 10, 1).otherwise(0)
        + F.when(grounded, 3).otherwise(0)
        + F.when(F.size(found) > 0, 2).otherwise(0)
        + F.when(foreign, 1).otherwise(0)
    )
    tenths = F.least(tenths, F.lit(10))
    why = F.array_compact(
        F.array(
            F.when(n > 200, F.concat(F.lit("Long prompt ("), n.cast("string"), F.lit(" words)"))),
            F.when(slides > 20, F.concat(F.lit("Large deck ("), slides.cast("string"), F.lit(" slides)"))),
            F.when(grounded, F.lit("RAG-grounded (needs accurate synthesis)")),
            F.when(F.size(found) > 0, F.concat(F.lit("Technical content: "), F.array_join(F.slice(found, 1, 3), ", "))),
            F.when(foreign, F.concat(F.lit("Non-English: "), language)),
        )
    )
    return {
        "complexity_score": F.round(tenths / 10.0, 2),
        "recommended_class": F.when(tenths >= 5, "powerful").when(tenths >= 2, "balanced").otherwise("fast"),
        "reasoning": F.when(F.size(why) > 0, F.array_join(why, "; ")).otherwise("Simple task"),
    }


def feedback_stats(rows: DataFrame) -> DataFrame:
    """Counts by type, the share of thumbs up, and the five most edited slides of each tenant."""
    count = lambda kind: F.count_if(F.col("feedback_type") == kind)
    out = rows.groupBy("tenant_id").agg(F.count("*").alias("total"), count("thumbs_up").alias("up"), count("thumbs_down").alias("down"), count("edit").alias("edits"))
    out = out.withColumn("up_rate", F.round(F.col("up") / F.greatest(F.lit(1), F.col("up") + F.col("down")), 4))
    edited = rows.where("feedback_type = 'edit'").groupBy("tenant_id", "slide_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("tenant_id").orderBy(F.desc("n"), "slide_id")
    top = edited.withColumn("r", F.row_number().over(order)).where("r <= 5")
    top = top.groupBy("tenant_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "slide_id"))), lambda x: x["slide_id"].cast("string")), ",").alias("most_edited"))
    return out.join(top, "tenant_id", "left").withColumn("most_edited", F.coalesce("most_edited", F.lit("")))


def with_consent(rows: DataFrame) -> DataFrame:
    """Feedback as consent allows: none drops it, basic keeps a short hash of the original and no new value."""
    basic = F.col("consent") == "basic"
    hashed = F.when(F.coalesce("original_value", F.lit("")) != "", F.substring(F.sha2("original_value", 256), 1, 16)).otherwise(F.col("original_value"))
    return rows.where("consent in ('basic', 'full')").withColumns(
        {"original_value": F.when(basic, hashed).otherwise(F.col("original_value")), "new_value": F.when(basic, F.lit(None).cast("string")).otherwise(F.col("new_value"))}
    )


def change_type(old: Column, new: Column) -> Column:
    """deleted, added, expanded (over 1.5 times), shortened (under half) or modified."""
    o, n = F.length(F.coalesce(old, F.lit(""))), F.length(F.coalesce(new, F.lit("")))
    return F.when((o > 0) & (n == 0), "deleted").when((o == 0) & (n > 0), "added").when(n > o * 1.5, "expanded").when(n < o * 0.5, "shortened").otherwise("modified")


def verdicts(scores: DataFrame) -> DataFrame:
    """Adds ``passed`` to each judge's score (case_id, prompt_name, judge, score)."""
    low = F.col("judge") == "hallucination_rate"
    limit = _lookup(F.col("judge"), JUDGES)
    return scores.withColumn("passed", F.when(low, F.col("score") <= limit).otherwise(F.col("score") >= limit))


def case_results(scores: DataFrame) -> DataFrame:
    """One row per case: whether all its judges pass, and each judge's score."""
    cases = verdicts(scores).groupBy("case_id", "prompt_name")
    judge = lambda name: F.max(F.when(F.col("judge") == name, F.col("score"))).alias(name)
    return cases.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), *(judge(j) for j in JUDGES))


def eval_summary(cases: DataFrame) -> DataFrame:
    """Per prompt: cases, passed, failed, pass rate and mean of each judge."""
    means = [F.round(F.avg(j), 4).alias(f"avg_{j}") for j in JUDGES]
    out = cases.groupBy("prompt_name").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), *means)
    return out.withColumn("failed", F.col("total") - F.col("passed")).withColumn("pass_rate", F.round(F.col("passed") / F.greatest("total", F.lit(1)), 4))


def regressions(summary: DataFrame, baselines: DataFrame, margin: float = 0.05) -> DataFrame:
    """Summaries with messages of what got worse than its baseline; averages of zero are passed over."""
    both = summary.join(F.broadcast(baselines), "prompt_name", "left")
    faith = (F.col("avg_faithfulness") != 0) & (F.col("faithfulness") - F.col("avg_faithfulness") > margin)
    made_up = (F.col("avg_hallucination_rate") != 0) & (F.col("avg_hallucination_rate") - F.col("hallucination_rate") > margin)
    found = F.array_compact(F.array(F.when(faith, F.lit("faithfulness")), F.when(made_up, F.lit("hallucination_rate"))))
    return both.select("prompt_name", F.array_join(found, ",").alias("regressed"), (F.size(found) > 0).alias("failed_gate"))


def stored_cache(entries: DataFrame, hours: int = 24) -> DataFrame:
    """The latest entry of each hash with its expiry; payload keys that start with ``_`` go."""
    out = entries.groupBy("prompt_hash").agg(F.max_by(F.struct("result", "created_at"), F.struct("created_at", "entry_id")).alias("e"), F.count("*").alias("writes"))
    clean = F.map_filter("e.result", lambda k, v: ~k.startswith("_"))
    return out.select("prompt_hash", clean.alias("result"), F.col("e.created_at").alias("created_at"), (F.col("e.created_at") + F.expr(f"INTERVAL {hours} HOURS")).alias("expires_at"), "writes")


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with a live entry of the same hash."""
    live = (F.col("ts") >= F.col("created_at")) & (F.col("ts") < F.col("expires_at"))
    return requests.join(cache, "prompt_hash").where(live)


def nearest_entries(requests: DataFrame, entries: DataFrame, most: int = 500) -> DataFrame:
    """query_id, entry_id, score: the cache entry of the highest cosine for each request; the smaller id of equals.

    The newest ``most`` entries at most are looked at (a fixed number, the cache's own rule); they go to all tasks, and a
    request is one row of a matrix product: no join, no shuffle. An entry does not answer itself; requests whose
    vector is null, zero or of another size are left out."""
    held = entries.where("e is not null").limit(most).collect()
    ids = np.array([r["entry_id"] for r in held], np.int64)
    order = np.argsort(ids, kind="stable")
    matrix = np.array([held[i]["e"] for i in order.tolist()], np.float64).reshape(len(held), -1)
    ids, sizes = ids[order], np.linalg.norm(matrix, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).to_pylist()
            fit = np.flatnonzero([v is not None and len(v) == matrix.shape[1] and None not in v for v in lists])
            asked = b.column(0).to_numpy(zero_copy_only=False)[fit]
            rows = np.array([lists[i] for i in fit.tolist()], np.float64).reshape(len(fit), matrix.shape[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.round((rows @ matrix.T) / (np.linalg.norm(rows, axis=1)[:, None] * sizes[None, :]), 9)
            scores = np.where(np.isfinite(scores) & (asked[:, None] != ids[None, :]), scores, -np.inf)
            best = scores.argmax(axis=1) if len(ids) else np.zeros(len(fit), np.int64)
            top = scores[np.arange(len(fit)), best] if len(ids) else np.full(len(fit), -np.inf)
            some = top > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(asked[some], pa.int64()), pa.array(ids[best[some]] if len(ids) else [], pa.int64()), pa.array(top[some], pa.float64())], names=["query_id", "entry_id", "score"])

    return requests.select(F.col("query_id").cast("long"), "embedding").where("query_id is not null").mapInArrow(run, "query_id long, entry_id long, score double")


def first_submissions(rows: DataFrame, hours: int = 24) -> DataFrame:
    """For each client id and window of ``hours`` from its first request on: the first job and its repeats.

    Times count in seconds, rounded to the nearest (halves to even)."""
    start = F.min("ts").over(Window.partitionBy("client_request_id"))
    seconds = lambda c: F.rint(F.unix_micros(F.col(c).cast("timestamp")) / 1e6).cast("long")
    rows = rows.withColumn("start", start)
    slot = F.floor((seconds("ts") - seconds("start")) / (hours * 3600))
    return rows.withColumn("slot", slot).groupBy("client_request_id", "slot").agg(F.min_by("job_id", F.struct("ts", "job_id")).alias("job_id"), F.count("*").alias("requests"))
