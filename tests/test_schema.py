"""JSON of slides, outlines and decks: what is accepted, what is told, and that nothing is dropped."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from datalode.operators import schema as C
from datalode.operators.ingest import THEMES

GOOD = {"slide_id": "0b0e3b60-7c3b-4c3a-9c55-0123456789aF", "slide_type": "table", "slide_index": 0, "action_title": "x" * 60, "content": {}}


def variants(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.try_parse_json("t").alias("v"))


def faults_of(spark, *values):
    texts = [v if isinstance(v, str) or v is None else json.dumps(v) for v in values]
    return [r["f"] for r in variants(spark, texts).select("i", C.checked(F.col("v")).alias("f")).orderBy("i").collect()]


def test_slides_against_the_table_of_fields(spark):
    meta = lambda **kw: GOOD | {"ai_metadata": kw}
    item = {"variant_id": "a", "action_title": "b", "confidence_score": 0.5}
    cases = {
        (): [GOOD, GOOD | {"slide_index": 3.0, "other": [1]}, meta(alternative_generations=[item] * 3, hallucination_risk_flags=[], generation_confidence=1)],
        ("json",): [None, "", "{", "{'a': 1}"],
        ("type",): ["[]", "3", '"x"', "null"],
        ("slide_id: uuid",): [GOOD | {"slide_id": "0b0e3b60"}],
        ("slide_id: type",): [GOOD | {"slide_id": None}],
        ("slide_type: enum",): [GOOD | {"slide_type": "Table"}],
        ("slide_index: integer",): [GOOD | {"slide_index": 1.5}],
        ("slide_index: range",): [GOOD | {"slide_index": -1}],
        ("slide_index: type",): [GOOD | {"slide_index": "1"}],
        ("action_title: length",): [GOOD | {"action_title": "x" * 61}],
        ("speaker_notes: type", "layout_hints.density: enum", "layout_hints.suggested_grid_columns: range"): [GOOD | {"speaker_notes": None, "layout_hints": {"density": "x", "suggested_grid_columns": 4}}],
        ("ai_metadata.generation_confidence: range", "ai_metadata.alternative_generations: many", "ai_metadata.alternative_generations.3: type"): [meta(generation_confidence=1.01, alternative_generations=[item] * 3 + [4])],
        ("ai_metadata.alternative_generations.1.variant_id: missing", "ai_metadata.alternative_generations.1.confidence_score: type"): [meta(alternative_generations=[item, {"action_title": "b", "confidence_score": True}])],
        ("ai_metadata.hallucination_risk_flags.0: enum", "ai_metadata.hallucination_risk_flags.1: type"): [meta(hallucination_risk_flags=["made_up", 1, "entity_inferred"])],
        ("validation_state.schema_compliant: type", "validation_state.blocking_errors: missing", "validation_state.layout_warnings.0: type"): [GOOD | {"validation_state": {"schema_compliant": 1, "layout_warnings": [2]}}],
    }
    flat = [(want, v) for want, values in cases.items() for v in values]
    assert faults_of(spark, *(v for _, v in flat)) == [list(want) for want, _ in flat]
    assert faults_of(spark, {}) == [[f"{f.name}: missing" for f in C.SLIDE if f.required]]


def test_outlines_of_models(spark):
    slide = {"slide_type": "table", "action_title": None}
    texts = [[slide], {"slides": [slide, {}]}, {"outline": [{"narrative_role": 5}]}, {"slides": None, "outline": [slide]}, {"slides": []}, {"deck": [slide]}, [], "x", 4, None]
    rows = variants(spark, [*(json.dumps(t) for t in texts), "[{", None])
    slides, error = C.model_outline(F.col("v"))
    got = [(r["error"], r["slides"] and [tuple(s) for s in r["slides"]]) for r in rows.select("i", slides.alias("slides"), error.alias("error")).orderBy("i").collect()]
    one = ("table", "", None)
    assert got[:3] == [(None, [one]), (None, [one, (None, None, None)]), (None, [(None, None, "5")])]
    assert [e for e, _ in got[3:]] == ["empty_outline"] * 4 + ["unexpected_format"] * 3 + ["invalid_json"] * 2


def test_decks_at_the_gate(spark):
    slide = lambda kind, content=None, **kw: {"slide_id": "0123456789", "slide_index": 4, "slide_type": kind, "action_title": "t", "content": content or {}} | kw
    deck = {"schema_version": "1.0.0", "metadata": {"theme": THEMES[0]}}
    bullets = [{"element_id": "a", "text": "b"}] * 6
    chart = {"chart_type": "bar", "chart_data": {"categories": ["a", "b"], "series": [{"values": [1, 2.5]}]}}
    good = [slide("title_slide", {"headline": "h"}), slide("content_bullets", {"bullets": bullets}), slide("content_bullets"), slide("data_chart", chart), slide("table", {"headers": [{"key": "k"}], "rows": [[1]]}), slide("visual_split", {"supporting_text": "x"}), slide("section_divider", {"section_title": "x"})]
    bad = [
        slide("poem"), slide("title_slide", action_title="", template={"overrides": {"font_scale": 1.3}}), slide("content_bullets", {"bullets": bullets + [{"text": 3}]}), slide("content_bullets", {"bullets": {}}),
        slide("data_chart", {"chart_type": "radar", "chart_data": {"categories": ["a"], "series": [{"values": []}, {"values": ["1"]}]}}), slide("data_chart", chart | {"chart_data": {"series": [{"values": [1, 2]}]}}),
        slide("table", {"headers": [{"label": "k"}]}), slide("visual_split", validation_state={"blocking_errors": ["stop"]}), slide("section_divider", template={"overrides": {"font_scale": "wide"}}),
    ]
    decks = [deck | {"slides": good}, deck | {"slides": bad}, deck | {"slides": []}, {"aspect_ratio": "2:1", "validation_state": {"blocking_errors": ["x"]}}, deck | {"slides": good[:1] * 101}]
    valid, messages = C.gated(F.col("v"), THEMES)
    got = variants(spark, [*map(json.dumps, decks), "{", None]).select("i", valid.alias("valid"), messages.alias("m")).orderBy("i").collect()
    at = "[Slide 4 / 01234567] "
    assert [(r["valid"], len(r["m"])) for r in got][0] == (True, 0)
    assert got[1]["m"] == [at + m for m in [
        "slide_type poem", "title_missing", "font_scale_range", "headline_missing", "bullets_many", "bullets[6].element_id_missing", "bullets[6].text_type", "bullets_type", "chart_type", "series[0].values_missing", "series[0].length", "series[1].values[0].type",
        "categories_missing", "headers[0].key_missing", "rows_missing", "stop", "supporting_text_missing", "font_scale_type", "section_title_missing",
    ]]
    assert [r["m"] for r in got[2:]] == [["no_slides"], ["schema_version", "aspect_ratio", "theme", "[Deck-level] x", "no_slides"], ["slides_many"], ["json"], ["json"]]
