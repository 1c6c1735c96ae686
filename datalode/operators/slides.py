"""Slides from outline to export: repaired outlines, guarded contents, assembled rows, deck rules and changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that every slide of an outline must have, and what stands in for them (fixed values).
REQUIRED = ("slide_type", "action_title", "narrative_role")
DEFAULT_TYPE, DEFAULT_ROLE = "content_bullets", "content"
#: Accepted frameworks and verticals, the defaults first (fixed values).
FRAMEWORKS = ("pyramid_principle", "hero_journey", "chronological", "problem_solution", "compare_contrast")
VERTICALS = ("general", "healthcare", "financial_services", "government", "technology", "legal")
#: Largest content of a slide in bytes, longest title and most bullets (fixed values).
CONTENT_BYTES, TITLE, BULLETS = 50_000, 60, 6
#: Accepted values of decks (fixed values).
SCHEMA_VERSION, ASPECT_RATIOS = "1.0.0", ("16:9", "4:3")
#: Risk flags (fixed values).
RISK_FLAGS = ("numerical_unverified", "quote_unsourced", "prediction_extrapolated", "entity_inferred")
#: Elements and icons that are never mirrored (fixed values).
NEVER_MIRRORED = ("chart", "image", "video")
PLAIN_ICONS = (
    "search", "settings", "home", "user", "mail", "bell", "star", "heart", "share", "download", "upload", "close", "plus", "minus", "check", "info", "warning", "error",
)
#: Largest canvas side in pixels (fixed value).
MOST_PIXELS = 16384
OUTLINE = "array<struct<slide_type:string,action_title:string,narrative_role:string>>"


def coerced_intent(framework: Column, vertical: Column, slides: Column, verticals: Sequence[str] = VERTICALS) -> dict[str, Column]:
    """Unknown frameworks and verticals become the defaults; slides lie in 3 to 20, 8 where none are given."""
    return {
        "framework": F.when(framework.isin(*FRAMEWORKS), framework).otherwise(FRAMEWORKS[0]),
        "vertical": F.when(vertical.isin(*verticals), vertical).otherwise(verticals[0]),
        "estimated_slides": F.least(F.lit(20), F.greatest(F.lit(3), F.coalesce(F.nullif(slides, F.lit(0)), F.lit(8)))).cast("long"),
    }


def request_enum_faults(vertical: Column, framework: Column) -> Column:
    """Names of the optional choices of a request that are none; null and empty ones pass."""
    wrong = lambda c, known: F.coalesce((c != "") & ~c.isin(*known), F.lit(False))
    return F.array_compact(F.array(F.when(wrong(vertical, VERTICALS), F.lit("vertical_invalid")), F.when(wrong(framework, FRAMEWORKS), F.lit("framework_invalid"))))


def missing_fields(slide: Column) -> Column:
    """Required fields that a slide of an outline lacks."""
    present = F.array_compact(F.array(*(F.when(slide[f].isNotNull(), F.lit(f)) for f in REQUIRED)))
    return F.array_except(F.array(*map(F.lit, REQUIRED)), present)


def repaired_outline(outline: Column, title: Column) -> Column:
    """An outline with a title slide in front, if the first is none, and defaults for what its slides lack."""
    first = F.struct(F.lit("title_slide").alias("slide_type"), F.concat(F.lit("Presentation: "), F.coalesce(title, F.lit("Untitled"))).alias("action_title"), F.lit("situation").alias("narrative_role"))
    has = F.coalesce(F.get(outline, F.lit(0))["slide_type"] == "title_slide", F.lit(False))
    whole = F.when(has, outline).otherwise(F.concat(F.array(first), outline))
    filled = lambda s, i: F.struct(
        F.coalesce(s["slide_type"], F.lit(DEFAULT_TYPE)).alias("slide_type"), F.coalesce(s["action_title"], F.concat(F.lit("Slide "), (i + 1).cast("string"))).alias("action_title"),
        F.coalesce(s["narrative_role"], F.lit(DEFAULT_ROLE)).alias("narrative_role"),
    )
    return F.transform(whole, filled)


def cut_title(title: Column) -> Column:
    """A title of at most 60 characters; longer ones end in three dots."""
    return F.when(F.length(title) > TITLE, F.concat(F.substring(title, 1, TITLE - 3), F.lit("..."))).otherwise(title)


def guarded(slides: DataFrame) -> DataFrame:
    """Adds ``error`` (null: accepted), cuts titles, gives bullets without an id one, and clears risk flags of cited slides.

    ``slides`` has slide_id, slide_type, action_title, content_bytes, content (struct with bullets and values), citations and risk_flags.
    New ids follow from the slide's id and the bullet's place, so that a run can be repeated."""
    values = F.coalesce(F.col("content.values"), F.array().cast("array<string>"))
    not_a_number = (F.col("slide_type") == "data_chart") & F.exists(values, lambda v: F.try_to_number(v, F.lit("S999999999999D999999")).isNull() & v.try_cast("double").isNull())
    error = F.when(F.col("content_bytes") > CONTENT_BYTES, "content_too_large").when(F.col("content").isNull(), "content_missing").when(not_a_number, "chart_value_no_number")
    with_id = lambda b, i: b.withField("element_id", F.when(F.coalesce(b["element_id"], F.lit("")) != "", b["element_id"]).otherwise(F.md5(F.concat_ws("/", "slide_id", i.cast("string")))))
    bullets = F.when(F.col("slide_type") == "content_bullets", F.transform("content.bullets", with_id)).otherwise(F.col("content.bullets"))
    none = F.array().cast("array<string>")
    return slides.withColumns(
        {"error": error, "action_title": cut_title(F.col("action_title")), "bullets": bullets, "risk_flags": F.when(F.size("citations") > 0, none).otherwise(F.coalesce("risk_flags", none))}
    )


def flagged(kind: Column, flags: Column) -> Column:
    """Risk flags; charts always have unverified numbers."""
    flags = F.coalesce(flags, F.array().cast("array<string>"))
    return F.when(kind == "data_chart", F.array_union(flags, F.array(F.lit(RISK_FLAGS[0])))).otherwise(flags)


def schema_faults(alternatives: Column, flags: Column, corrupt: Column) -> Column:
    """Names of what a slide's metadata breaks; rows are kept and marked."""
    unknown = F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda f: ~f.isin(*RISK_FLAGS))
    found = [(corrupt.isNotNull(), "corrupt_record"), (F.size(alternatives) > 3, "alternatives_many"), (unknown, "risk_flag_unknown")]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in found)))


def deck_faults(themes: Sequence[str]) -> Column:
    """Names of broken rules of decks (schema_version, aspect_ratio, theme, blocking_errors, n_slides); without slides nothing after counts."""
    rules = [
        (F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True)), "schema_version"),
        (~F.coalesce("aspect_ratio", F.lit(ASPECT_RATIOS[0])).isin(*ASPECT_RATIOS), "aspect_ratio"),
        (F.coalesce(~F.col("theme").isin(*themes), F.lit(True)), "theme"),
    ]
    blocking = F.transform(F.coalesce("blocking_errors", F.array().cast("array<string>")), lambda e: F.concat(F.lit("[Deck-level] "), e))
    last = F.when(F.col("n_slides") == 0, "no_slides").when(F.col("n_slides") > 100, "slides_many")
    return F.concat(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules))), blocking, F.array_compact(F.array(last)))


def assembled(slides: DataFrame) -> DataFrame:
    """Slides with defaults and at most three alternatives of falling confidence; failed ones stay, marked.

    ``slides`` has hierarchy_level, duration, priority, alternatives (titles) and error."""
    titles = F.slice(F.coalesce("alternatives", F.array().cast("array<string>")), 1, 3)
    made = F.transform(titles, lambda t, i: F.struct(t.alias("action_title"), F.round(0.9 - (i + 1) * 0.1, 2).alias("confidence_score")))
    return slides.withColumns(
        {
            "hierarchy_level": F.coalesce("hierarchy_level", F.lit(2)), "duration": F.coalesce("duration", F.lit(60)), "priority": F.coalesce("priority", F.lit("balanced")),
            "alternatives": made, "failed": F.col("error").isNotNull(),
        }
    )


def mixed_direction(texts: Column, digits_as_ltr: bool = True) -> Column:
    """Whether some text has letters of both directions; digits count as left-to-right if asked for."""
    left = "[A-Za-zÀ-ɏ0-9]" if digits_as_ltr else "[A-Za-zÀ-ɏ]"
    return F.exists(F.filter(texts, lambda t: t.isNotNull()), lambda t: t.rlike("[֐-׿؀-ۿ]") & t.rlike(left))


def mirrored(boxes: DataFrame, rtl: Column, width: float = 1000) -> DataFrame:
    """Boxes (element_type, icon, anchor, x, width) of right-to-left slides flipped, but for exempt elements and plain icons."""
    exempt = F.col("element_type").isin(*NEVER_MIRRORED) | ((F.col("element_type") == "icon") & F.coalesce(F.col("icon").isin(*PLAIN_ICONS), F.lit(False)))
    anchor = F.when(F.col("anchor") == "left", "right").when(F.col("anchor") == "right", "left").otherwise(F.col("anchor"))
    return boxes.withColumns({"x": F.when(rtl & ~exempt, width - F.col("x") - F.col("width")).otherwise(F.col("x")), "anchor": F.when(rtl, anchor).otherwise(F.col("anchor"))})


def canvas_faults(width: Column, height: Column) -> Column:
    """Sides of a canvas that are not positive or beyond what can be drawn."""
    sides = (("width", width), ("height", height))
    rules = [F.when(c <= 0, F.lit(f"{n}_not_positive")) for n, c in sides] + [F.when(c > MOST_PIXELS, F.lit(f"{n}_over_limit")) for n, c in sides]
    return F.array_compact(F.array(*rules))


def impact_radius(field: Column) -> Column:
    """How far a changed field reaches; a bullet's text is tried before the slide's contents."""
    deck = field.startswith("metadata.theme") | field.startswith("metadata.language") | field.startswith("outline_context.narrative_framework")
    return F.when(deck, "deck").when(field == "slide_type", "section").when(field.rlike(r"content\.bullets\[[0-9]+\]\.text"), "element").otherwise("slide")


def slides_to_solve(changes: DataFrame, slides: DataFrame) -> DataFrame:
    """change_id, slide_id: the changed slide, all of its section, or all of its deck.

    ``changes`` has change_id, deck_id, slide_id and radius; ``slides`` deck_id, slide_id and section_id (null: none, the slide alone)."""
    own = changes.where("radius not in ('deck', 'section')").select("change_id", "slide_id")
    deck = changes.where("radius = 'deck'").select("change_id", "deck_id").join(slides.select("deck_id", "slide_id"), "deck_id")
    changed = changes.where("radius = 'section'").join(slides.select("deck_id", "slide_id", "section_id"), ["deck_id", "slide_id"])
    section = changed.where("section_id is not null").select("change_id", "deck_id", "section_id").join(slides.select("deck_id", "section_id", "slide_id"), ["deck_id", "section_id"])
    alone = changed.where("section_id is null").select("change_id", "slide_id")
    return own.unionByName(deck.select("change_id", "slide_id")).unionByName(section.select("change_id", "slide_id")).unionByName(alone)


def continued(slides: DataFrame, most: int = BULLETS) -> DataFrame:
    """Slides (slide_id, slide_index, action_title, bullets), each followed by a slide half an index later for bullets beyond ``most``."""
    head = slides.withColumns({"bullets": F.slice("bullets", 1, most), "parent": F.lit(None).cast("string")})
    rest = slides.where(F.size("bullets") > most).withColumns(
        {"parent": F.col("slide_id"), "slide_id": F.concat("slide_id", F.lit("+")), "slide_index": F.col("slide_index") + 0.5, "action_title": cut_title(F.col("action_title")), "bullets": F.slice("bullets", most + 1, F.size("bullets"))}
    )
    return head.unionByName(rest)


def judged(violations: Column, rules: int) -> Column:
    """The schema judge's score: the share of rules that hold."""
    return F.round(1 - F.size(violations) / rules, 4)
