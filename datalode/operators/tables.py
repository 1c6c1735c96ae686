"""Tables from Markdown or grids, and their descriptions. A row is an array of (key, value) in the order of its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a description tells of (fixed value).
DESCRIBED_ROWS = 15
_ROW = "array<struct<key:string,value:string>>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _record(keys: Column, values: Column) -> Column:
    """Keys with their values; of keys that repeat the last value stands at the first place."""
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    last = lambda p, k: F.element_at(F.filter(p, lambda x: x["key"] == k), -1)
    once = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(once, pairs).otherwise(F.transform(F.array_distinct(keys), lambda k: last(pairs, k)))


def _table(headers: Column, rows: Column) -> Column:
    """A struct of headers and the rows that are not blank; null without such rows."""
    filled = F.filter(rows, lambda r: F.exists(r, lambda x: x["value"] != ""))
    return _with(filled, lambda r: F.when(F.size(r) > 0, F.struct(headers.alias("headers"), r.alias("rows"))))


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(line, r"^\s*\|", ""), r"\|\s*$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def markdown_table(markdown: Column) -> Column:
    """A Markdown table as struct(headers, rows); null with fewer than two lines or without rows.

    The second line is always taken for the separator; short rows are filled with empty cells, blank ones are dropped."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))

    def row(headers: Column, line: Column) -> Column:
        return _with(_cells(line), lambda cells: _record(headers, F.transform(headers, lambda h, i: F.coalesce(F.get(cells, i), F.lit("")))))

    def read(lines: Column) -> Column:
        data = F.filter(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), lambda x: ~x.rlike(r"^[-|: ]*$"))
        return F.when(F.size(lines) >= 2, _with(_cells(F.get(lines, F.lit(0))), lambda headers: _table(headers, F.transform(data, lambda line: row(headers, line)))))

    return _with(lines, read)


def grid_table(grid: Column) -> Column:
    """An array of rows of cells as struct(headers, rows): blank headers and cells beyond them are ``col_i``, empty rows go."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    numbered = lambda i: F.concat(F.lit("col_"), i.cast("string"))

    def row(headers: Column, cells: Column) -> Column:
        return _record(F.transform(cells, lambda c, i: F.coalesce(F.get(headers, i), numbered(i))), F.transform(cells, text))

    def read(grid: Column) -> Column:
        headers = F.transform(F.get(grid, F.lit(0)), lambda c, i: F.when(text(c) == "", numbered(i)).otherwise(text(c)))
        return _with(headers, lambda h: _table(h, F.transform(F.slice(grid, 2, F.greatest(F.size(grid), F.lit(1))), lambda cells: row(h, cells))))

    return F.when(F.size(grid) >= 2, _with(grid, read))


def table_description(table: Column, caption: Column | None = None, most: int = DESCRIBED_ROWS) -> Column:
    """Caption, columns, the cells of the first rows and how many rows are not shown."""
    return _with(table, lambda t: _described(t, caption, most))


def _described(table: Column, caption: Column | None, most: int) -> Column:
    rows = F.coalesce(table["rows"], F.array().cast(f"array<{_ROW}>"))
    headers = F.coalesce(table["headers"], F.array().cast("array<string>"))
    caption = F.lit(None).cast("string") if caption is None else caption
    cells = lambda r: F.filter(r, lambda x: F.trim(x["value"]) != "")
    told = F.filter(F.transform(F.slice(rows, 1, most), cells), lambda r: F.size(r) > 0)
    each = F.transform(told, lambda r: F.array_join(F.transform(r, lambda x: F.concat(x["key"], F.lit(": "), x["value"])), ". "))
    more = F.size(rows) - most
    parts = F.array_compact(
        F.array(
            F.when(caption != "", F.concat(F.lit("Table: "), caption, F.lit("."))),
            F.when(F.size(headers) > 0, F.concat(F.lit("Columns: "), F.array_join(headers, ", "), F.lit("."))),
            F.when(F.size(each) > 0, F.array_join(each, " | ")),
            F.when(more > 0, F.concat(F.lit("(Table continues — "), more.cast("string"), F.lit(" more rows not shown.)"))),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("Table with no extractable text content.")
