"""Rules of single records at their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from datalode.operators import records as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_columns(spark):
    text = lambda x: F.lit(x).cast("string")
    kinds = [R.figure_kind(F.lit(n), text(c), ["chart"]) for n, c in ((None, "chart"), (999, "chart"), (1000, "A Chart of x"), (5000, None), (5000, "logo"))]
    assert one(spark, *kinds) == ("decorative", "decorative", "informational", "uncertain", "uncertain")
    values = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("{a}"))
    assert one(spark, *(R.rendered(F.lit(t), values) for t in ("{a}-{a}", "none", "{a} {missing}", "{}"))) == ("1-1", "none", "{a} {missing}", "{}")
    assert one(spark, *(R.version_rejected(text(v)) for v in (None, "", "1.0.0", "0.9"))) == (False, False, False, True)
    assert one(spark, *(R.relaxed_scale(F.lit(x).cast("double")) for x in (None, 0.1, 1.0, 7.0))) == (None, 0.8, 1.0, 1.2)
    none = F.lit(None).cast("array<string>")
    assert one(spark, R.with_warnings(none, none), R.with_warnings(F.array(F.lit("a")), F.array(F.lit("b")))) == ([], ["a", "b"])
    shown = [R.change_display(text(c), text(v)) for c, v in (("up", "3"), ("none", "3"), (None, "3"), ("odd", "3"), ("down", None), ("neutral", ""))]
    assert one(spark, *shown) == ("▲ 3", "3", "3", "3", "▼", "→")


def test_tables(spark):
    words = spark.createDataFrame([("p", 2, "b", 90), ("p", 1, "a", 30), ("p", 3, "c", 0), ("q", 1, "x", 29), ("r", 1, "y", -1)], "page string, i int, word string, confidence int")
    got = {r["page"]: tuple(r)[1:] for r in R.recognised_pages(words, ["i"]).collect()}
    assert got == {"p": (0.6, True, 2, "a b"), "q": (0.29, False, 1, "x")}
    cells = spark.createDataFrame([("r1", "a"), ("r1", "b"), (None, "a")], "row string, key string")
    marked = cells.where("row = 'r1' and key = 'a'").union(cells.where("row = 'r1' and key = 'a'"))
    assert sorted((r["row"] or "", r["key"], r["highlighted"]) for r in R.highlighted(cells, marked, ["row", "key"]).collect()) == [("", "a", False), ("r1", "a", True), ("r1", "b", False)]
    times = spark.createDataFrame([("1", 5.0, True), ("1", 5.1, False), ("2", 2000.0, True)], "tier string, solve_time_ms double, font_cache_hit boolean")
    row = R.solve_times(times, ["tier"]).where("tier = '1'").first()
    assert (row["n"], row["le_5"], row["le_10"], row["le_1000"], row["hit_ratio"]) == (2, 1, 2, 2, 0.5)
    a, b = spark.createDataFrame([(x,) for x in "zyxz"], "prompt string"), spark.createDataFrame([(x,) for x in "ba"], "industry string")
    cases = R.evaluation_cases(a, b, (5, 10), ("f", "g", "h"), most=7).orderBy("n").collect()
    assert [tuple(c) for c in cases[:3]] == [(0, "x", "a", 5, "f"), (1, "x", "a", 10, "g"), (2, "x", "b", 5, "h")] and len(cases) == 7 and tuple(cases[6]) == (6, "y", "b", 5, "f")
