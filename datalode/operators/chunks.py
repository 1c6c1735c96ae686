"""Chunks of typed elements: headings, tables and gathered paragraphs with overlaps; figure chunks and summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of chunks of the elements that are gathered or cut (fixed values).
KINDS = {"paragraph": "narrative_text", "list_item": "list_item", "caption": "caption", "footnote": "footnote"}
#: Elements that never become text chunks (fixed values).
SKIPPED = ("page_header", "page_footer", "figure")
SCHEMA = "doc_id {id}, seq int, chunk_id string, chunk_type string, text string, page_number int, headers_path string, token_count long"


class Words:
    """Counts and cuts texts by runs without white space. Another vocabulary needs the same three methods."""

    def count(self, text: str) -> int:
        return len(text.split())

    def first(self, text: str, n: int) -> str:
        """The first ``n`` tokens; a text of no more stays as it is."""
        words = text.split()
        return text if len(words) <= n else " ".join(words[:n])

    def last(self, text: str, n: int) -> str:
        words = text.split()
        return text if len(words) <= n else " ".join(words[len(words) - n :])


class Gatherer:
    """Takes the elements of one document in order."""

    def __init__(self, most: int, overlap: int, least: int, tokens: Words) -> None:
        self.most, self.overlap, self.least, self.count, self.of = most, overlap, least, tokens.count, tokens
        self.out: list[tuple[str, str, int, str]] = []
        self.parts: list[str] = []
        self.tokens = 0
        self.tail = ""
        self.page, self.path = 1, ""

    def end(self) -> None:
        """Makes a chunk of what was gathered, unless it is too small; a small one leaves the overlap as it was."""
        own = "\n\n".join(self.parts)
        whole = f"{self.tail}\n\n{own}" if self.tail else own
        if self.parts and self.count(whole) >= self.least:
            self._add("narrative_text", whole)
            self.tail = self._last(own)
        self.parts, self.tokens = [], 0

    def _add(self, kind: str, text: str) -> None:
        self.out.append((kind, text, self.page, self.path))

    def _last(self, text: str) -> str:
        return self.of.last(text, self.overlap)

    def _cut(self, text: str) -> str:
        return self.of.first(text, self.most)

    def take(self, kind: str, text: str | None, page: int | None, path: str | None, table: str | None, told: str | None) -> None:
        text = (text or "").strip()
        self.page = self.page if page is None else page
        if kind in SKIPPED or not text:
            return
        if kind == "heading":
            self.end()
            self.tail, self.path = "", path or ""
            self._add("heading", text)
        elif kind == "table":
            self.end()
            self.tail = ""
            if table is not None:
                self._add("table_json", self._cut(table))
                self._add("table_desc", told or "")
            elif "|" in text:
                self._add("table_desc", text)
        elif self.count(text) > self.most:
            self.end()
            cut = self._cut(text)
            self._add(KINDS.get(kind, "narrative_text"), cut)
            self.tail = self._last(cut)
        else:
            if self.parts and self.tokens + self.count(text) > self.most:
                self.end()
            self.parts.append(text)
            self.tokens += self.count(text)


def typed_chunks(elements: DataFrame, most: int = 512, overlap: int = 64, least: int = 50, tokens: Words | None = None) -> DataFrame:
    """Chunks of every document: doc_id, seq, chunk_id, chunk_type, text, page_number, headers_path, token_count.

    ``elements`` has doc_id, ord, element_type and text, and may have page_number, section_path (array), table_json and
    table_text. Page headers, footers, figures and blank elements are skipped. A heading ends the gathering and is a chunk of its own, however small;
    a table with a structure gives two chunks, one without gives its Markdown; a longer element than ``most`` is cut. Gathered chunks begin
    with the last ``overlap`` tokens of the one before, unless a heading or table lies between. ``tokens`` counts and cuts (default: ``Words``); it is
    sent to the tasks. A document is one group: its size is bounded by the document.
    """
    kind = elements.schema["doc_id"].dataType.simpleString()
    has = lambda c, t: F.col(c) if c in elements.columns else F.lit(None).cast(t)
    path = F.array_join("section_path", " > ") if "section_path" in elements.columns else F.lit("")
    of = tokens or Words()
    rows = elements.select("doc_id", "ord", "element_type", "text", has("page_number", "int").cast("int").alias("page"), path.alias("path"), has("table_json", "string").alias("table"), has("table_text", "string").alias("told"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        g = Gatherer(most, overlap, least, of)
        for row in zip(*(table.column(c).to_pylist() for c in ("element_type", "text", "page", "path", "table", "told")), strict=True):
            g.take(*row)
        g.end()
        id, n = table.column("doc_id")[0], len(g.out)
        kinds, texts, pages, paths = zip(*g.out, strict=True) if g.out else ((), (), (), ())
        return pa.table(
            {
                "doc_id": pa.array([id.as_py()] * n, table.schema.field("doc_id").type),
                "seq": pa.array(range(n), pa.int32()),
                "chunk_id": pa.array([f"{id.as_py()}_c{i:04d}" for i in range(n)], pa.string()),
                "chunk_type": pa.array(kinds, pa.string()),
                "text": pa.array(texts, pa.string()),
                "page_number": pa.array(pages, pa.int32()),
                "headers_path": pa.array(paths, pa.string()),
                "token_count": pa.array([of.count(t) for t in texts], pa.int64()),
            }
        )

    return rows.groupBy("doc_id").applyInArrow(run, SCHEMA.format(id=kind))


def table_json(table: Column, caption: Column | None = None) -> Column:
    """A table (headers, rows of keys and values) as JSON with a caption."""
    caption = F.lit(None).cast("string") if caption is None else caption
    rows = F.transform(table["rows"], lambda r: F.map_from_entries(r))
    return F.when(table.isNotNull(), F.to_json(F.struct(table["headers"].alias("headers"), rows.alias("rows"), caption.alias("caption")), {"ignoreNullFields": "false"}))


def figure_type(description: Column) -> Column:
    """chart_description for charts and images of tables, else image_description; letter case does not count."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.when(F.contains(low, F.lit("[chart")) | F.contains(low, F.lit("[table image")), "chart_description").otherwise("image_description")


def with_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Text chunks and figure descriptions (doc_id, chunk_id, description) as one table of chunks."""
    own = figures.select("doc_id", "chunk_id", figure_type(F.col("description")).alias("chunk_type"), F.col("description").alias("text"))
    return chunks.select("doc_id", "chunk_id", "chunk_type", "text").unionByName(own)


def ingestion_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: chunks, pages, had_pii, vision and table chunks and status; a document without chunks has failed.

    ``chunks`` has doc_id, chunk_type, page_number and has_pii. With a column ``embedding`` there is ``upserted``, the chunks that have one; with
    ``started`` and ``ended`` there is ``seconds``, from the first start to the last end."""
    more = {}
    if "embedding" in chunks.columns:
        more["upserted"] = F.count_if(F.col("embedding").isNotNull())
    if {"started", "ended"} <= set(chunks.columns):
        more["seconds"] = (F.unix_micros(F.max(F.col("ended").cast("timestamp"))) - F.unix_micros(F.min(F.col("started").cast("timestamp")))) / 1e6
    own = chunks.groupBy("doc_id").agg(
        *(c.alias(n) for n, c in more.items()),
        F.count("*").alias("chunks"), F.max("page_number").alias("pages"), F.bool_or("has_pii").alias("had_pii"),
        F.count_if(F.col("chunk_type").isin("chart_description", "image_description")).alias("vision_chunks"), F.count_if(F.col("chunk_type").startswith("table")).alias("table_chunks"),
    )
    out = docs.select("doc_id").join(own, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("chunks", "pages", "vision_chunks", "table_chunks", *more)}
    return out.withColumns({**zero, "had_pii": F.coalesce("had_pii", F.lit(False)), "status": F.when(F.col("chunks").isNull(), "failed").otherwise("complete")})


def short_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, page_number and characters of pages with fewer than ``least`` characters over all their elements."""
    return pages.groupBy("doc_id", "page_number").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters")).where(F.col("characters") < least)


def repeated_figures(figures: DataFrame) -> DataFrame:
    """Figures (doc_id, ord, content) whose content came before in the same document, by the first 20 digits of its hash."""
    key = F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 20)
    rows = figures.select("doc_id", "ord", key.alias("figure_hash"))
    first = rows.groupBy("doc_id", "figure_hash").agg(F.min("ord").alias("first"))
    return rows.join(first, ["doc_id", "figure_hash"]).select("doc_id", "ord", "figure_hash", (F.col("ord") > F.col("first")).alias("repeated"))
