"""Stores as tables: raw copies, logs with retention, caches, decks, dead letters, evaluation cases and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalode.sources.shared import scratch

#: Hours that entries of each kind live (fixed values).
HOURS = {"events": 2, "status": 168, "cache": 24, "intent": 1, "index": 720}


def raw_copies(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes doc_id, tenant_id and content, partitioned by tenant, and gives doc_id, tenant_id, size and source_uri.

    Files without content have no copy: their ``source_uri`` is null, and nothing fails."""
    folder = folder or scratch(files.sparkSession, "raw")
    files.where(F.coalesce(F.octet_length("content"), F.lit(0)) > 0).select("doc_id", "tenant_id", "content").write.mode("append").partitionBy("tenant_id").parquet(folder)
    kept = files.sparkSession.read.parquet(folder)
    kept = kept.select("doc_id", F.col("tenant_id").cast("string"), F.octet_length("content").alias("size"), F.col("_metadata.file_path").alias("source_uri"))
    empty = files.where(F.coalesce(F.octet_length("content"), F.lit(0)) == 0).select("doc_id", F.col("tenant_id").cast("string"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("source_uri"))
    return kept.unionByName(empty)


def appended_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """A log with new rows at its end."""
    return log.unionByName(rows)


def retained(rows: DataFrame, now: Column, kind: str, time: str = "ts") -> DataFrame:
    """Rows that are not older than their kind lives; those without a time go."""
    return rows.where(F.col(time) >= now - F.expr(f"INTERVAL {HOURS[kind]} HOURS"))


def invalidated(entries: DataFrame, pattern: str, now: Column) -> DataFrame:
    """Cache entries with ``invalidated_at`` set where their hash holds the pattern (an empty one: all)."""
    return entries.withColumn("invalidated_at", F.when(F.contains("prompt_hash", F.lit(pattern)), now))


def deck_rows(decks: DataFrame) -> DataFrame:
    """Decks (job_id, JSON ``deck`` with slides of tokens and cost_usd) as typed rows with totals."""
    slides = F.coalesce(F.from_json("deck", "slides array<struct<tokens:long,cost_usd:double>>")["slides"], F.array().cast("array<struct<tokens:long,cost_usd:double>>"))
    rows = decks.select("job_id", slides.alias("s"))
    total = lambda f, zero: F.aggregate("s", F.lit(zero), lambda a, x: a + F.coalesce(x[f], F.lit(zero)))
    return rows.select("job_id", F.size("s").cast("long").alias("slides"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))).alias("tokens"), F.round(total("cost_usd", 0.0), 4).alias("cost_usd"))


def dead_generations(rows: DataFrame) -> DataFrame:
    """Failed generations without their prompt, which only its length tells of, and errors of 500 characters at most."""
    return rows.withColumns({"prompt_length": F.length("prompt").cast("long"), "error": F.substring("error", 1, 500)}).drop("prompt")


def json_rows(rows: DataFrame, schema: str) -> DataFrame:
    """Rows written as JSON lines and read again with a schema."""
    path = scratch(rows.sparkSession, "json")
    rows.write.json(path)
    return rows.sparkSession.read.schema(schema).json(path)


def eval_cases(cases: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cases of the named prompts."""
    return cases.where(F.col("prompt_name").isin(*names))


def active_prompts(versions: DataFrame, files: DataFrame, default: str) -> DataFrame:
    """name, template: of a file, else the newest active version, else the default."""
    stored = versions.groupBy("name").agg(F.max_by(F.when(F.col("active"), F.col("template")), F.when(F.col("active"), F.col("version"))).alias("stored"))
    both = stored.join(files.select("name", F.col("template").alias("file")), "name", "full_outer")
    return both.select("name", F.coalesce("file", "stored", F.lit(default)).alias("template"))
