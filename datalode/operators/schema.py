"""JSON of models and slides as VARIANT: outlines in their accepted shapes, and a checker compiled from one table of fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from datalode.operators.decks import CHART_TYPES
from datalode.operators.slides import ASPECT_RATIOS, REQUIRED, RISK_FLAGS, SCHEMA_VERSION, TITLE


#: Kinds of slides (fixed values).
SLIDE_TYPES = ("title_slide", "content_bullets", "data_chart", "visual_split", "table", "section_divider")


@dataclass(frozen=True)
class Field:
    """What a field of a JSON object must be. ``kind``: text, uuid, integer, number, boolean, object or list.

    Numbers lie in ``least`` to ``most``; texts and lists have at most ``most`` characters or items; ``values`` are the accepted
    ones; ``fields`` are those of an object, or of each item of a list, which are of kind ``item``. Null is not the same as missing."""

    name: str
    kind: str
    required: bool = False
    values: Sequence[object] = ()
    least: float | None = None
    most: float | None = None
    item: str | None = None
    fields: Sequence[Field] = ()


#: Fields of a slide, their types, values and bounds (fixed values).
SLIDE = (
    Field("slide_id", "uuid", required=True),
    Field("slide_type", "text", required=True, values=SLIDE_TYPES),
    Field("slide_index", "integer", required=True, least=0),
    Field("action_title", "text", required=True, most=TITLE),
    Field("content", "object", required=True),
    Field("speaker_notes", "text"),
    Field("outline_context", "object", fields=(
        Field("narrative_role", "text", values=("situation", "complication", "resolution", "action", "appendix", "transition")),
        Field("hierarchy_level", "integer", least=1, most=3),
        Field("parent_section_id", "text"),
    )),
    Field("layout_hints", "object", fields=(
        Field("priority", "text", values=("text_primary", "visual_primary", "balanced")),
        Field("density", "text", values=("minimal", "standard", "dense")),
        Field("visual_anchor", "text", values=("left", "right", "top", "bottom", "center", "none")),
        Field("suggested_grid_columns", "integer", least=1, most=3),
    )),
    Field("ai_metadata", "object", fields=(
        Field("generation_confidence", "number", least=0, most=1),
        Field("alternative_generations", "list", most=3, item="object", fields=(
            Field("variant_id", "text", required=True), Field("action_title", "text", required=True), Field("confidence_score", "number", required=True),
        )),
        Field("hallucination_risk_flags", "list", item="text", fields=(Field("", "text", values=RISK_FLAGS),)),
        Field("human_review_status", "text", values=("pending", "approved", "rejected", "modified")),
    )),
    Field("validation_state", "object", fields=(
        Field("schema_compliant", "boolean", required=True), Field("blocking_errors", "list", required=True, item="text"), Field("layout_warnings", "list", required=True, item="text"),
    )),
)

_TYPES = {
    "text": "^STRING", "uuid": "^STRING", "integer": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)", "number": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)",
    "boolean": "^BOOLEAN", "object": "^OBJECT", "list": "^ARRAY",
}
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"



def _none() -> Column:
    return F.array().cast("array<string>")


def _faults(value: Column, field: Field, path: Column) -> Column:
    """What a value (VARIANT; null: missing) breaks, as ``path: rule``."""
    say = lambda rule: F.concat(path, F.lit(f": {rule}"))
    fits = F.coalesce(F.schema_of_variant(value).rlike(_TYPES[field.kind]), F.lit(False))
    rules: list[tuple[Column, str]] = []
    if field.kind in ("text", "uuid"):
        text = F.try_variant_get(value, "$", "string")
        if field.kind == "uuid":
            rules.append((~text.rlike(_UUID), "uuid"))
        if field.values:
            rules.append((~text.isin(*field.values), "enum"))
        if field.most is not None:
            rules.append((F.length(text) > field.most, "length"))
    if field.kind in ("integer", "number"):
        number = F.try_variant_get(value, "$", "double")
        if field.kind == "integer":
            rules.append((number != F.floor(number), "integer"))
        if field.least is not None:
            rules.append((number < field.least, "range"))
        if field.most is not None:
            rules.append((number > field.most, "range"))
    own = F.array_compact(F.array(*(F.when(c, say(rule)) for c, rule in rules))) if rules else _none()
    if field.kind == "object" and field.fields:
        own = faults(value, field.fields, F.concat(path, F.lit(".")))
    if field.kind == "list":
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = field.fields[0] if field.fields and not field.fields[0].name else Field("", field.item or "text", fields=field.fields)
        of_items = F.flatten(F.transform(items, lambda x, i: _faults(x, inner, F.concat(path, F.lit("."), i.cast("string")))))
        many = F.array_compact(F.array(F.when(F.size(items) > field.most, say("many")))) if field.most is not None else _none()
        own = F.concat(many, F.coalesce(of_items, _none()))
    missing = F.array(say("missing")) if field.required else _none()
    return F.when(value.isNull(), missing).when(~fits, F.array(say("type"))).otherwise(own)


def faults(value: Column, fields: Sequence[Field] = SLIDE, before: Column | None = None) -> Column:
    """Names of all rules that a JSON object (VARIANT) breaks, as ``path: rule`` in the order of the table."""
    before = F.lit("") if before is None else before
    return F.concat(*(_faults(F.try_variant_get(value, f"$.{f.name}", "variant"), f, F.concat(before, F.lit(f.name))) for f in fields))


def checked(value: Column, fields: Sequence[Field] = SLIDE) -> Column:
    """The faults of a column of ``try_parse_json`` (of a select of its own, else each rule would parse anew); what is no
    JSON is ``json``, what is no object ``type``. Rows are kept and marked, never dropped."""
    whole = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(value.isNull(), F.array(F.lit("json"))).when(~whole, F.array(F.lit("type"))).otherwise(faults(value, fields))


def model_outline(value: Column) -> tuple[Column, Column]:
    """Slides (slide_type, action_title, narrative_role) of a model's answer (a column of ``try_parse_json``) and ``error`` (null: accepted).

    Accepted are an array of slides, or an object with it under ``slides``, else under ``outline``. Errors are ``invalid_json``,
    ``unexpected_format`` for other JSON, and ``empty_outline``; then slides are null. A field that is null counts as present, as an empty text."""
    kind = F.schema_of_variant(value)
    under = F.coalesce(F.try_variant_get(value, "$.slides", "variant"), F.try_variant_get(value, "$.outline", "variant"))
    slides = F.try_variant_get(F.when(kind.startswith("ARRAY"), value).when(kind.startswith("OBJECT"), under), "$", "array<variant>")

    def one(x: Column) -> Column:
        held = {f: F.try_variant_get(x, f"$.{f}", "variant") for f in REQUIRED}
        return F.struct(*(F.when(v.isNotNull(), F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))).alias(f) for f, v in held.items()))

    error = F.when(value.isNull(), "invalid_json").when(~kind.rlike("^(ARRAY|OBJECT)"), "unexpected_format").when(F.coalesce(F.size(slides), F.lit(0)) < 1, "empty_outline")
    return F.when(error.isNull(), F.transform(slides, one)), error


# -- the gate before export ------------------------------------------------------------------------

#: Bounds of decks (fixed values).
MOST_SLIDES, FONT_SCALE = 100, (0.8, 1.2)


def _text(v: Column, path: str) -> Column:
    """A text, or an empty one for what is missing, null or empty."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _items(v: Column, path: str) -> Column:
    """The items of a list; none for what is missing or no list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _told(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in rules)))


def _each(items: Column, name: str, rules) -> Column:
    """Messages about the items of a list, with their places."""
    place = lambda i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
    return F.flatten(F.transform(items, lambda x, i: _told([(c, F.concat(place(i), F.lit(m))) for c, m in rules(x)])))


def _content_messages(slide: Column, kind: Column) -> Column:
    """What a slide's content breaks by the rules of its type."""
    get = lambda path: F.try_variant_get(slide, path, "variant")
    bullets, headers, rows = get("$.content.bullets"), _items(slide, "$.content.headers"), _items(slide, "$.content.rows")
    listed = bullets.isNull() | _kind(bullets).startswith("ARRAY")
    text = lambda x: F.try_variant_get(x, "$.text", "variant")
    of_bullets = F.concat(
        _told([(~listed, "bullets_type"), (F.size(_items(slide, "$.content.bullets")) > 6, "bullets_many")]),
        _each(_items(slide, "$.content.bullets"), "bullets", lambda x: [(_text(x, "$.element_id") == "", ".element_id_missing"), (text(x).isNotNull() & (_kind(text(x)) != "STRING"), ".text_type")]),
    )
    chart = F.coalesce(_text(slide, "$.content.chart_type"), F.lit(""))
    categories, series = F.size(_items(slide, "$.content.chart_data.categories")), _items(slide, "$.content.chart_data.series")
    number = lambda v: _kind(v).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE|BOOLEAN)")
    of_series = F.flatten(
        F.transform(
            series,
            lambda x, i: F.concat(
                _told([(F.size(_items(x, "$.values")) == 0, F.concat(F.lit("series["), i.cast("string"), F.lit("].values_missing")))]),
                F.array_compact(F.transform(_items(x, "$.values"), lambda v, n: F.when(~number(v), F.concat(F.lit("series["), i.cast("string"), F.lit("].values["), n.cast("string"), F.lit("].type"))))),
                _told([((chart != "scatter") & (categories > 0) & (F.size(_items(x, "$.values")) != categories), F.concat(F.lit("series["), i.cast("string"), F.lit("].length")))]),
            ),
        )
    )
    of_chart = F.concat(_told([(~chart.isin(*CHART_TYPES), "chart_type"), (categories == 0, "categories_missing")]), of_series)
    of_table = F.concat(_told([(F.size(headers) == 0, "headers_missing")]), _each(headers, "headers", lambda x: [(_text(x, "$.key") == "", ".key_missing")]), _told([(F.size(rows) == 0, "rows_missing")]))
    needs = {"title_slide": "headline", "visual_split": "supporting_text", "section_divider": "section_title"}
    out = F.when(kind == "content_bullets", of_bullets).when(kind == "data_chart", of_chart).when(kind == "table", of_table)
    for name, field in needs.items():
        out = out.when(kind == name, _told([(_text(slide, f"$.content.{field}") == "", f"{field}_missing")]))
    return F.coalesce(out, _none())


def _slide_messages(slide: Column) -> Column:
    """All messages about a slide, each with the slide's index and id."""
    kind, title = _text(slide, "$.slide_type"), _text(slide, "$.action_title")
    scale = F.try_variant_get(slide, "$.template.overrides.font_scale", "variant")
    held = scale.isNotNull() & (_kind(scale) != "VOID")
    factor = F.try_variant_get(scale, "$", "string").try_cast("double")
    blocking = F.transform(_items(slide, "$.validation_state.blocking_errors"), lambda e: F.try_variant_get(e, "$", "string"))
    title_rules = [(title == "", "title_missing"), (F.length(title) > TITLE, "title_length")]
    scale_rules = [(held & factor.isNull(), "font_scale_type"), (held & ~factor.between(*FONT_SCALE), "font_scale_range")]
    known = kind.isin(*SLIDE_TYPES)
    own = F.when(known, F.concat(_told(title_rules), _told(scale_rules), _content_messages(slide, kind))).otherwise(F.array(F.concat(F.lit("slide_type "), kind)))
    index = F.coalesce(F.try_variant_get(slide, "$.slide_index", "string"), F.lit("?"))
    id = F.substring(F.coalesce(F.try_variant_get(slide, "$.slide_id", "string"), F.lit("unknown")), 1, 8)
    return F.transform(F.concat(blocking, own), lambda m: F.concat(F.lit("[Slide "), index, F.lit(" / "), id, F.lit("] "), m))


def gated(deck: Column, themes: Sequence[str]) -> tuple[Column, Column]:
    """``valid`` and all ``messages`` of a deck (VARIANT): those of the deck, then those of its slides in order.

    A deck without slides is told so and no more; a slide of an unknown type is not looked into. Null decks are invalid."""
    slides = _items(deck, "$.slides")
    ratio = F.try_variant_get(deck, "$.aspect_ratio", "variant")
    blocking = F.transform(_items(deck, "$.validation_state.blocking_errors"), lambda e: F.concat(F.lit("[Deck-level] "), F.try_variant_get(e, "$", "string")))
    first = _told([
        (_text(deck, "$.schema_version") != SCHEMA_VERSION, "schema_version"),
        (ratio.isNotNull() & ~_text(deck, "$.aspect_ratio").isin(*ASPECT_RATIOS), "aspect_ratio"),
        (~_text(deck, "$.metadata.theme").isin(*themes), "theme"),
    ])
    many = _told([(F.size(slides) > MOST_SLIDES, "slides_many")])
    rest = F.when(F.size(slides) == 0, F.array(F.lit("no_slides"))).otherwise(F.concat(many, F.flatten(F.transform(slides, _slide_messages))))
    messages = F.when(deck.isNull(), F.array(F.lit("json"))).otherwise(F.concat(first, blocking, rest))
    return F.size(messages) == 0, messages
