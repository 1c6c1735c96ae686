"""Markdown end to end: documents whose lines are headings, items, table rows and paragraphs, to elements and typed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.operators import chunks as C
from datalode.operators import parse as P
from datalode.plans.registry import query, table

#: A document's line as a line of Markdown, by its length; the same in both dialects.
_LINE = """CASE WHEN length(line) % 11 = 0 THEN repeat('#', CAST(1 + length(line) % 4 AS INT)) || ' ' || substr(line, 1, 30) WHEN length(line) % 7 = 0 THEN '- ' || line WHEN length(line) % 13 = 0 THEN '| ' || line || ' |'
    WHEN length(line) % 17 = 0 THEN '   ' WHEN length(line) % 19 = 0 THEN '#' || line ELSE line END"""


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def _last(text: str) -> str:
    return f"CASE WHEN len({_words(text)}) <= 64 THEN {text} ELSE array_to_string(list_slice({_words(text)}, -64, -1), ' ') END"


_OWN = "array_to_string(acc.parts, chr(10) || chr(10))"
_WHOLE = f"(CASE WHEN acc.tail <> '' THEN acc.tail || chr(10) || chr(10) || {_OWN} ELSE {_OWN} END)"
_ENOUGH = f"(len(acc.parts) > 0 AND len({_words(_WHOLE)}) >= 50)"
_OUT = f"(CASE WHEN {_ENOUGH} THEN list_append(acc.out, {{'kind': 'narrative_text', 'path': acc.path, 'text': {_WHOLE}}}) ELSE acc.out END)"
_TAIL = f"(CASE WHEN {_ENOUGH} THEN {_last(_OWN)} ELSE acc.tail END)"
_CUT = f"array_to_string(list_slice({_words('x.text')}, 1, 512), ' ')"


def _state(out: str, parts: str, n: str, tail: str, path: str) -> str:
    return f"{{'kind': '', 'text': '', 'path': {path}, 'out': {out}, 'parts': {parts}, 'n': CAST({n} AS BIGINT), 'tail': {tail}}}"


_NO_PARTS = "CAST([] AS VARCHAR[])"
_STEP = f"""CASE x.kind WHEN 'end' THEN {_state(_OUT, _NO_PARTS, "0", _TAIL, "acc.path")}
    WHEN 'heading' THEN {_state(f"list_append({_OUT}, {{'kind': 'heading', 'path': x.path, 'text': x.text}})", _NO_PARTS, "0", "''", "x.path")}
    WHEN 'table' THEN {_state(f"list_append({_OUT}, {{'kind': 'table_desc', 'path': acc.path, 'text': x.text}})", _NO_PARTS, "0", "''", "acc.path")}
    ELSE CASE WHEN x.n > 512 THEN {_state(f"list_append({_OUT}, {{'kind': CASE x.kind WHEN 'paragraph' THEN 'narrative_text' ELSE x.kind END, 'path': acc.path, 'text': {_CUT}}})", _NO_PARTS, "0", _last(_CUT), "acc.path")}
      WHEN len(acc.parts) > 0 AND acc.n + x.n > 512 THEN {_state(_OUT, "[x.text]", "x.n", _TAIL, "acc.path")}
      ELSE {_state("acc.out", "list_append(acc.parts, x.text)", "acc.n + x.n", "acc.tail", "acc.path")} END END"""

#: Lines as elements (kind, level, text), in order.
_ELEMENTS = rf"""m AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda line: {_LINE})) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
    t AS (SELECT doc_id, ord, trim(line) AS line FROM m),
    e AS (SELECT doc_id, ord, CASE WHEN regexp_matches(line, '^#{{1,3}}\s') THEN 'heading' WHEN starts_with(line, '|') THEN 'table' WHEN regexp_matches(line, '^[-*+]\s') THEN 'list_item' ELSE 'paragraph' END AS kind,
      length(regexp_extract(line, '^(#{{1,3}})\s', 1)) AS level, regexp_replace(regexp_replace(line, '^#{{1,3}}\s+', ''), '^[-*+]\s+', '') AS text FROM t WHERE line <> '')"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(F.expr(f"transform(split(text, '\\n'), line -> {_LINE})"), "\n").alias("text"))


@query("markdown_texts", f"""WITH {_ELEMENTS} SELECT doc_id, count(*) AS n, md5(string_agg(ord || '/' || kind || '/' || level || '/' || text, ';' ORDER BY ord)) AS digest FROM e GROUP BY 1""")
def markdown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, level and text of every element of every document."""
    rows = P.markdown_elements(_markdown(spark, sf_dir)).select("doc_id", "ord", F.concat_ws("/", "ord", "element_type", F.coalesce("heading_level", F.lit(0)), "text").alias("e"))
    own = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "e"))).alias("es"))
    return own.select("doc_id", "n", F.md5(F.array_join(F.transform("es", lambda x: x["e"]), ";")).alias("digest"))


@query(
    "markdown_chunks",
    f"""WITH {_ELEMENTS}, l AS (SELECT doc_id, list({{'kind': kind, 'level': level, 'text': trim(text), 'n': len({_words("text")})}} ORDER BY ord) AS es FROM e GROUP BY 1),
    p AS (SELECT doc_id, list_reduce(list_transform(es, lambda x: {{'kind': x.kind, 'level': x.level, 'text': x.text, 'n': x.n, 'stack': CAST([] AS VARCHAR[]), 'done': CAST([] AS STRUCT(kind VARCHAR, path VARCHAR, "text" VARCHAR, n BIGINT)[])}}),
      lambda acc, x: {{'kind': x.kind, 'level': x.level, 'text': x.text, 'n': x.n, 'stack': CASE WHEN x.level > 0 THEN list_append(list_slice(acc.stack, 1, x.level - 1), x.text) ELSE acc.stack END,
        'done': list_append(acc.done, {{'kind': x.kind, 'path': array_to_string(CASE WHEN x.level > 0 THEN list_append(list_slice(acc.stack, 1, x.level - 1), x.text) ELSE acc.stack END, ' > '), 'text': x.text, 'n': x.n}})}},
      {{'kind': '', 'level': CAST(0 AS BIGINT), 'text': '', 'n': CAST(0 AS BIGINT), 'stack': CAST([] AS VARCHAR[]), 'done': CAST([] AS STRUCT(kind VARCHAR, path VARCHAR, "text" VARCHAR, n BIGINT)[])}}).done AS es FROM l),
    c AS (SELECT doc_id, list_reduce(list_transform(list_append(es, {{'kind': 'end', 'path': '', 'text': '', 'n': 0}}), lambda x: {{'kind': x.kind, 'text': x.text, 'path': x.path, 'out': CAST([] AS STRUCT(kind VARCHAR, path VARCHAR, "text" VARCHAR)[]), 'parts': {_NO_PARTS}, 'n': x.n, 'tail': ''}}),
      lambda acc, x: {_STEP}, {{'kind': '', 'text': '', 'path': '', 'out': CAST([] AS STRUCT(kind VARCHAR, path VARCHAR, "text" VARCHAR)[]), 'parts': {_NO_PARTS}, 'n': CAST(0 AS BIGINT), 'tail': ''}}).out AS cs FROM p)
    SELECT doc_id, CAST(len(cs) AS BIGINT) AS chunks, CAST(len(list_filter(cs, lambda k: k.kind = 'heading')) AS BIGINT) AS headings, md5(array_to_string(list_transform(cs, lambda k, i: printf('%s_c%04d', CAST(doc_id AS VARCHAR), i - 1) || '/' || k.kind || '/' || k.path || '/' || k.text), ';')) AS digest FROM c WHERE len(cs) > 0""",
)
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document as Markdown: headings, tables and gathered text with overlaps and open headings."""
    chunks = C.typed_chunks(P.section_paths(P.markdown_elements(_markdown(spark, sf_dir))))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("/", "chunk_id", "chunk_type", "headers_path", "text").alias("e"))))
    own = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "heading").alias("headings"), parts.alias("es"))
    return own.select("doc_id", "chunks", "headings", F.md5(F.array_join(F.transform("es", lambda x: x["e"]), ";")).alias("digest"))
