"""Texts to elements and chunks: Markdown, HTML, tables and the greedy chunker."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalode.operators.retrieval import words
from datalode.sources.shared import small

_TAGS = {"h1": ("heading", 1), "h2": ("heading", 2), "h3": ("heading", 3), "p": ("paragraph", None), "li": ("list_item", None), "title": ("title", None), "td": ("cell", None), "th": ("cell", None)}


def markdown_elements(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line that is not blank: ord, element_type, text and heading_level."""
    lines = docs.select(F.col(id).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("ord", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    level = F.length(F.regexp_extract("line", r"^(#{1,3})\s", 1))
    kind = F.when(level > 0, "heading").when(F.col("line").startswith("|"), "table").when(F.col("line").rlike(r"^[-*+]\s"), "list_item").otherwise("paragraph")
    body = F.when(level > 0, F.regexp_replace("line", r"^#{1,3}\s+", "")).when(kind == "list_item", F.regexp_replace("line", r"^[-*+]\s+", "")).otherwise(F.col("line"))
    return lines.select("doc_id", "ord", kind.alias("element_type"), body.alias("text"), F.when(level > 0, level).alias("heading_level"))


class _Blocks(HTMLParser):
    """Blocks of a page in order; script, style and comments are left out."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, int | None, str]] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.skip = 0

    def _flush(self) -> None:
        joined = " ".join("".join(self.text).split())
        if joined and self.stack:
            self.out.append((*_TAGS[self.stack[-1]], joined))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag in _TAGS:
            self._flush()
            if tag in ("p", "li") and self.stack and self.stack[-1] == tag:
                self.stack.pop()
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
        if tag in self.stack:
            self._flush()
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def html_elements(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per block of a page: ord, element_type, heading_level and text."""
    kind = pages.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for i, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parser = _Blocks()
                parser.feed(page or "")
                parser.close()
                parser._flush()
                rows += [(i, n, k, level, t) for n, (k, level, t) in enumerate(parser.out)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "ord", "element_type", "heading_level", "text"])

    return pages.select(id, html).mapInArrow(run, f"page_id {kind}, ord int, element_type string, heading_level int, text string")


def section_paths(elements: DataFrame) -> DataFrame:
    """Adds ``section_path``: the open headings of each element, a heading itself included."""
    rows = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "element_type", "text", "heading_level"))).alias("rows"))
    none = F.array().cast("array<string>")
    kind = "array<struct<ord:int,element_type:string,text:string,heading_level:int,section_path:array<string>>>"
    start = F.struct(none.alias("path"), F.lit(None).cast(kind).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        path = F.when(x["heading_level"].isNull(), acc["path"]).otherwise(F.array_append(F.slice(acc["path"], F.lit(1), x["heading_level"] - 1), x["text"]))
        row = F.struct(x["ord"].alias("ord"), x["element_type"].alias("element_type"), x["text"].alias("text"), x["heading_level"].alias("heading_level"), path.alias("section_path"))
        return F.struct(path.alias("path"), F.concat(F.coalesce(acc["out"], F.array().cast(kind)), F.array(row)).alias("out"))

    return rows.select("doc_id", F.explode(F.aggregate("rows", start, add)["out"]).alias("e")).select("doc_id", "e.*")


def greedy_chunks(docs: DataFrame, most: int = 512, overlap: int = 64, least: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of a document's paragraphs (lines): chunk_id, seq, text, token_count.

    Paragraphs are gathered up to ``most`` tokens (white-space words). A longer one ends the gathering and
    is cut as a chunk of its own. Each gathered chunk begins with the last ``overlap`` tokens of the one
    before; gathered chunks under ``least`` tokens are dropped and leave the overlap as it was.
    """
    own = F.transform(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda p: p != ""), lambda p: F.struct(p.alias("t"), F.size(_split(p)).alias("n")))
    start = F.struct(
        F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"), F.lit("").alias("tail"),
    )

    def flushed(acc: Column) -> tuple[Column, Column]:
        joined = F.array_join(acc["buf"], "\n\n")
        whole = F.when(acc["tail"] != "", F.concat(acc["tail"], F.lit("\n\n"), joined)).otherwise(joined)
        keep = (F.size(acc["buf"]) > 0) & (F.size(_split(whole)) >= least)
        tail = _tail(joined, overlap)
        return F.when(keep, F.array_append(acc["out"], whole)).otherwise(acc["out"]), F.when(keep, tail).otherwise(acc["tail"])

    def add(acc: Column, p: Column) -> Column:
        out, tail = flushed(acc)
        none = F.array().cast("array<string>")
        cut = F.array_join(F.slice(_split(p["t"]), 1, most), " ")
        long = F.struct(F.array_append(out, cut).alias("out"), none.alias("buf"), F.lit(0).alias("n"), _tail(cut, overlap).alias("tail"))
        full = F.struct(out.alias("out"), F.array(p["t"]).alias("buf"), p["n"].alias("n"), tail.alias("tail"))
        more = F.struct(acc["out"].alias("out"), F.array_append(acc["buf"], p["t"]).alias("buf"), (acc["n"] + p["n"]).alias("n"), acc["tail"].alias("tail"))
        return F.when(p["n"] > most, long).when((acc["n"] + p["n"] > most) & (F.size(acc["buf"]) > 0), full).otherwise(more)

    made = docs.select(F.col(id).alias("doc_id"), F.aggregate(own, start, add, lambda acc: flushed(acc)[0]).alias("chunks"))
    rows = made.select("doc_id", F.posexplode("chunks").alias("seq", "text"))
    return rows.select("doc_id", "seq", F.concat(F.col("doc_id").cast("string"), F.format_string("_c%04d", "seq")).alias("chunk_id"), "text", F.size(words(F.col("text"))).cast("long").alias("token_count"))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _tail(text: Column, n: int) -> Column:
    w = _split(text)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")
