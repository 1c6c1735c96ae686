"""Rules of single records: figures, prompts, versions, relaxed layouts, solve times, recognised words, table cells, evaluation cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes under which a figure tells nothing, words of telling captions, and the versions that clients may ask for (fixed values).
LEAST_FIGURE, SCHEMA_VERSION = 1000, "1.0.0"
#: Bounds of font scales and of solve times in milliseconds (fixed values).
SCALES, SOLVE_BOUNDS = (0.8, 1.2), (5, 10, 25, 50, 100, 250, 500, 1000)
#: Least mean confidence of a recognised page, and signs of changes (fixed values).
LEAST_CONFIDENCE, SIGNS = 0.3, {"up": "▲", "down": "▼", "neutral": "→", "none": ""}
#: Most generated evaluation cases (fixed value).
MOST_CASES = 50


def figure_kind(bytes: Column, caption: Column, telling: Sequence[str]) -> Column:
    """decorative for null, empty and small contents; informational where the caption has a telling word; else uncertain. Case does not count."""
    low = F.lower(F.coalesce(caption, F.lit("")))
    has = F.exists(F.array(*map(F.lit, telling)), lambda w: F.contains(low, w)) if telling else F.lit(False)
    return F.when(F.coalesce(bytes, F.lit(0)) < LEAST_FIGURE, "decorative").when(has, "informational").otherwise("uncertain")


def rendered(template: Column, values: Column) -> Column:
    """A template with its ``{name}`` places filled from a map; as it is if a value is missing."""
    wanted = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    filled = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return F.when(F.forall(wanted, lambda w: F.map_contains_key(values, w)), filled).otherwise(template)


def version_rejected(asked: Column, own: str = SCHEMA_VERSION) -> Column:
    """Whether a payload asks for another schema version; null and empty ones pass."""
    return F.coalesce((asked != "") & (asked != own), F.lit(False))


def relaxed_scale(scale: Column) -> Column:
    """A font scale within its bounds; null where none is to be written."""
    return F.when(scale.isNotNull(), F.least(F.lit(SCALES[1]), F.greatest(F.lit(SCALES[0]), scale)))


def with_warnings(own: Column, more: Column) -> Column:
    """Layout warnings with new ones at their end; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(own, none), F.coalesce(more, none))


def solve_times(rows: DataFrame, by: Sequence[str], bounds: Sequence[float] = SOLVE_BOUNDS) -> DataFrame:
    """For each group: solves, how many took at most each bound (``le_``), and the share of font cache hits.

    ``rows`` has solve_time_ms and font_cache_hit."""
    le = [F.count_if(F.col("solve_time_ms") <= x).alias(f"le_{x}") for x in bounds]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *le, F.round(F.count_if("font_cache_hit") / F.count("*"), 6).alias("hit_ratio"))


def recognised_pages(words: DataFrame, order: Sequence[str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Pages of recognised words (page, word, confidence in percent): mean confidence, whether they are kept, words and text.

    Words without confidence are left out; a page of such words only has no row."""
    some = words.where("confidence > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "word"))), lambda x: x["word"]), " ")
    mean = F.avg("confidence") / 100
    return some.groupBy("page").agg(F.round(mean, 3).alias("confidence"), (mean >= least).alias("kept"), F.count("*").alias("words"), text.alias("text"))


def highlighted(cells: DataFrame, marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds whether a cell's keys (row and column) are in the highlight set."""
    mark = marked.select(*keys).distinct().withColumn("highlighted", F.lit(True))
    return cells.drop("highlighted").join(mark, list(keys), "left").withColumn("highlighted", F.coalesce("highlighted", F.lit(False)))


def change_display(change: Column, value: Column) -> Column:
    """A value behind the sign of its change; unknown and missing changes have none."""
    signs = F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv))
    sign = F.coalesce(F.try_element_at(signs, change), F.lit(""))
    return F.when(sign == "", F.coalesce(value, F.lit(""))).otherwise(F.trim(F.concat_ws(" ", sign, value)))


def evaluation_cases(first: DataFrame, second: DataFrame, durations: Sequence[int], frameworks: Sequence[str], most: int = MOST_CASES) -> DataFrame:
    """n, both columns, duration_minutes and framework of the first ``most`` combinations in order. Both tables are lists of a few values."""
    a, b = first.columns[0], second.columns[0]
    rows = first.distinct().join(F.broadcast(second.distinct().limit(most))).withColumn("duration_minutes", F.explode(F.array(*map(F.lit, durations))))
    few = rows.orderBy(a, b, "duration_minutes").limit(most)
    few = few.agg(F.array_sort(F.collect_list(F.struct(a, b, "duration_minutes"))).alias("rows")).select(F.posexplode("rows").alias("n", "c"))
    framework = F.element_at(F.array(*map(F.lit, frameworks)), F.col("n") % len(frameworks) + 1)
    return few.select(F.col("n").cast("long").alias("n"), f"c.{a}", f"c.{b}", "c.duration_minutes", framework.alias("framework"))
