"""Slide and layout rules: declarative checks over nested rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accepted values (fixed values).
SLIDE_TYPES = ("title_slide", "content_bullets", "data_chart", "visual_split", "table", "section_divider")
CHART_TYPES = ("column_clustered", "column_stacked", "line", "pie", "bar", "area", "waterfall", "scatter")
#: Which content key tells a slide's type, the first that is there (fixed values).
KEY_TYPES = (("chart_type", "data_chart"), ("bullets", "content_bullets"), ("supporting_text", "visual_split"), ("section_title", "section_divider"), ("headline", "title_slide"))

#: Schema of a slide's content; every part may be missing.
CONTENT = (
    "headline string, supporting_text string, section_title string, chart_type string, bullets array<struct<element_id:string,text:string>>,"
    " chart_data struct<categories:array<string>,series:array<struct<name:string,values:array<string>>>>, headers array<struct<key:string>>, rows array<map<string,string>>"
)


def _empty(c: Column) -> Column:
    return F.coalesce(F.length(c) == 0, F.lit(True))


def _none(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def slide_rules(slide: str = "c") -> list[tuple[str, Column]]:
    """(name, broken) of every rule of a slide with parsed content in the column ``slide``."""
    c = F.col(slide)
    kind, title = F.col("slide_type"), F.col("action_title")
    known = kind.isin(*SLIDE_TYPES)
    of = lambda name, rule: (kind == name) & rule
    series = F.coalesce(c["chart_data"]["series"], F.array())
    categories = c["chart_data"]["categories"]
    number = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
    bad_number = F.exists(series, lambda s: F.exists(s["values"], lambda v: v.isNull() | ~v.rlike(number)))
    unlike = F.exists(series, lambda s: F.coalesce(F.size(s["values"]), F.lit(0)) != F.size(categories))
    return [
        ("slide_type", F.coalesce(~known, F.lit(True))),
        ("action_title_missing", known & _empty(title)),
        ("action_title_long", known & (F.length(title) > 60)),
        ("font_scale", known & F.coalesce(~F.col("font_scale").between(0.8, 1.2), F.lit(False))),
        ("headline", of("title_slide", _empty(c["headline"]))),
        ("bullets_many", of("content_bullets", F.coalesce(F.size(c["bullets"]) > 6, F.lit(False)))),
        ("bullet_id", of("content_bullets", F.exists(F.coalesce(c["bullets"], F.array()), lambda b: _empty(b["element_id"])))),
        ("chart_type", of("data_chart", F.coalesce(~c["chart_type"].isin(*CHART_TYPES), F.lit(True)))),
        ("categories", of("data_chart", _none(categories))),
        ("series_empty", of("data_chart", F.exists(series, lambda s: _none(s["values"])))),
        ("series_number", of("data_chart", F.coalesce(bad_number, F.lit(False)))),
        ("series_length", of("data_chart", (c["chart_type"] != "scatter") & ~_none(categories) & unlike)),
        ("headers", of("table", _none(c["headers"]))),
        ("header_key", of("table", F.exists(F.coalesce(c["headers"], F.array()), lambda h: _empty(h["key"])))),
        ("rows", of("table", _none(c["rows"]))),
        ("supporting_text", of("visual_split", _empty(c["supporting_text"]))),
        ("section_title", of("section_divider", _empty(c["section_title"]))),
    ]


def checked_slides(slides: DataFrame) -> DataFrame:
    """Adds ``violations`` (names of broken rules, in their order) to slides with JSON ``content``."""
    parsed = slides.withColumn("c", F.from_json("content", CONTENT))
    names = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in slide_rules()]
    return parsed.withColumn("violations", F.array_compact(F.array(*names))).drop("c")


def deck_gate(slides: DataFrame, most: int = 100) -> DataFrame:
    """One row per presentation: slides, broken rules over all slides, and whether it may be exported."""
    checked = checked_slides(slides).groupBy("presentation_id").agg(F.count("*").alias("slides"), F.sum(F.size("violations")).alias("broken"))
    over = F.col("slides") > most
    return checked.select("presentation_id", "slides", (F.col("broken") + over.cast("int")).alias("broken"), ((F.col("broken") == 0) & ~over).alias("valid"))


def inferred_type(content: Column) -> Column:
    """A slide's type by the keys of its JSON content."""
    keys = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    out = F.lit("unknown")
    table = F.array_contains(keys, "headers") & F.array_contains(keys, "rows")
    for key, name in reversed(KEY_TYPES):
        out = F.when(F.array_contains(keys, key), name).otherwise(out)
        if key == "section_title":  # tables come right before dividers
            out = F.when(table, "table").otherwise(out)
    return out


def reindexed(slides: DataFrame, index: str = "slide_index") -> DataFrame:
    """Dense indices from 0 in order of fractional ones."""
    order = Window.partitionBy("presentation_id").orderBy(index, "slide_id")
    return slides.withColumn("new_index", F.row_number().over(order) - 1)


def waterfall(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Base and height of waterfall bars: the smaller of the sums before and after, and the step's size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    after = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("after", after)
    before = F.col("after") - F.col(value)
    return out.select(*rows.columns, F.round(F.least(before, F.col("after")), 6).alias("base"), F.round(F.abs(value), 6).alias("delta"))


#: A cell of a slide's grid is as large as its mean box, and at least this part of the largest, so a box lies in few cells.
LEAST_CELL = 1 / 16


def overlaps(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes of one slide that share area, footers left out.

    Boxes meet in the cells of a uniform grid that they touch; a pair counts in the one cell that holds the upper left corner of what
    they share. Slides may hold any number of boxes: pairs that are far apart never meet. Boxes with a null place or size overlap nothing."""
    own = boxes.where("element_type <> 'footer'").select("slide_id", "element_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height"))).dropna()
    side = lambda c: F.greatest(F.avg(c), F.max(c) * LEAST_CELL, F.lit(1e-9))
    grid = own.groupBy("slide_id").agg(side("width").alias("cw"), side("height").alias("ch"))
    at = lambda v, c: F.floor(F.col(v) / F.col(c))
    own = own.join(grid, "slide_id").withColumns({"right": F.col("x") + F.col("width"), "bottom": F.col("y") + F.col("height")})
    across = F.sequence(at("x", "cw"), F.greatest(at("x", "cw"), at("right", "cw")))
    down = F.sequence(at("y", "ch"), F.greatest(at("y", "ch"), at("bottom", "ch")))
    cells = own.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(down))
    other = cells.select("slide_id", "cx", "cy", *(F.col(c).alias(f"{c}2") for c in ("element_id", "x", "y", "right", "bottom")))
    met = cells.join(other, ["slide_id", "cx", "cy"]).where(F.col("element_id") < F.col("element_id2"))
    here = (F.col("cx") == F.floor(F.greatest("x", "x2") / F.col("cw"))) & (F.col("cy") == F.floor(F.greatest("y", "y2") / F.col("ch")))
    share = (F.col("right") > F.col("x2")) & (F.col("right2") > F.col("x")) & (F.col("bottom") > F.col("y2")) & (F.col("bottom2") > F.col("y"))
    return met.where(here & share).select("slide_id", "element_id", "element_id2")


def layout_flags(boxes: DataFrame, width: float = 1000, height: float = 1000) -> DataFrame:
    """Per slide: boxes outside the canvas, with small text, small targets, and an unbalanced top and bottom margin."""
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("width") > width) | (F.col("y") + F.col("height") > height)
    small = F.col("element_type").isin("chart", "image", "callout") & (F.least("width", "height") < 33)
    found = boxes.groupBy("slide_id").agg(
        F.count_if(out).alias("outside"), F.count_if(F.col("font_size_px") < 12).alias("small_font"), F.count_if(small).alias("small_target"),
        F.min("y").alias("top"), (height - F.max(F.col("y") + F.col("height"))).alias("bottom"),
    )
    both = (F.col("top") > 0) & (F.col("bottom") > 0)
    ratio = F.greatest("top", "bottom") / F.when(both, F.least("top", "bottom"))
    return found.select("slide_id", "outside", "small_font", "small_target", F.coalesce(ratio > 4, F.lit(False)).alias("unbalanced"))


def mirrored(boxes: DataFrame, rtl: Column, width: float = 1000) -> DataFrame:
    """Boxes of right-to-left slides flipped; charts and images stay."""
    flip = rtl & ~F.col("element_type").isin("chart", "image")
    return boxes.withColumn("x", F.when(flip, width - F.col("x") - F.col("width")).otherwise(F.col("x")))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys with ``change``: new, changed, unchanged or removed, by a hash of their content."""
    h = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*content)), 256).alias(name))
    both = h(old, "a").join(h(new, "b"), list(keys), "full_outer")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def last_writes(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; merged without sorting."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(*keys, "e.*")


def deck_rollup(slides: DataFrame) -> DataFrame:
    """Tokens, cost and status of each job: complete, partial_failure or failed."""
    out = slides.groupBy("job_id").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count("*").alias("slides"), F.count_if("failed").alias("failed"))
    done = F.col("slides") - F.col("failed")
    return out.withColumn("status", F.when(F.col("failed") == 0, "complete").when(done > 0, "partial_failure").otherwise("failed"))
