"""Queries of the text gate, redaction, deduplication and document stores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.functions import names as N
from datalode.functions import text as X
from datalode.operators import ingest as I
from datalode.plans.registry import query, table


def _replace_sql(column: str, rules: list[X.Rule]) -> str:
    for r in rules:
        column = f"regexp_replace({column}, '{r.pattern}', '{r.replacement}', 'g')"
    return column


def _count_sql(column: str, rules: list[X.Rule]) -> str:
    parts = []
    for r in rules:
        parts.append(f"len(regexp_extract_all({column}, '{r.pattern}'))")
        column = f"regexp_replace({column}, '{r.pattern}', '{r.replacement}', 'g')"
    return " + ".join(parts)


def _types_sql(column: str, rules: list[X.Rule]) -> str:
    parts = []
    for r in rules:
        parts.append(f"CASE WHEN regexp_matches({column}, '{r.pattern}') THEN '{r.name}' END")
        column = f"regexp_replace({column}, '{r.pattern}', '{r.replacement}', 'g')"
    return f"coalesce(array_to_string(list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), ','), '')"


_PROMPTS = "(SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user')"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))


@query(
    "file_gate",
    """WITH f AS (SELECT doc_id, source || '/ü ' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '.exe' END AS filename,
        strlen(text) AS size, source AS tenant_id, text FROM documents)
    SELECT doc_id, regexp_replace(filename, '[^A-Za-z0-9._ -]', '_', 'g') AS safe_name, replace(substr(regexp_replace(filename, '[^A-Za-z0-9 _-]', '_', 'g'), 1, 80), ' ', '_') AS export_name,
        round(size / 1048576.0, 3) AS size_mb, sha256(tenant_id || text) AS doc_hash,
        CASE WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'too_large' WHEN doc_id % 4 = 3 THEN 'unsupported' END AS reject_reason FROM f""",
)
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, type and name checks of every document as an upload."""
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".csv", ".exe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/ü "), "doc_id", ending).alias("filename"), F.col("text").cast("binary").alias("content"), F.col("source").alias("tenant_id"))
    out = I.gate(files, most=20_000)
    return out.select("doc_id", "safe_name", X.export_filename(F.col("filename")).alias("export_name"), "size_mb", "doc_hash", "reject_reason")


@query(
    "prompt_sanitize",
    f"""SELECT conv_id, turn, substr(regexp_replace({_replace_sql("trim(prompt)", X.INJECTION)}, '\\s{{3,}}', ' ', 'g'), 1, 2000) AS cleaned,
    trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g')) AS normal FROM {_PROMPTS}""",
)
def prompt_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn sanitised and normalised."""
    return _prompts(spark, sf_dir).select("conv_id", "turn", X.sanitised(F.col("prompt")).alias("cleaned"), X.normal_prompt(F.col("prompt")).alias("normal"))


@query(
    "client_fingerprint",
    f"""SELECT conv_id, turn, substr(sha256(CASE WHEN conv_id % 2 = 0 THEN 'client-' || conv_id ELSE lower(trim(prompt)) || '::modern_light' END), 1, 32) AS key FROM {_PROMPTS}""",
)
def client_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: idempotency keys; every second conversation brings a client id."""
    client = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("client-"), "conv_id"))
    return _prompts(spark, sf_dir).select("conv_id", "turn", X.fingerprint(client, F.col("prompt"), F.lit("modern_light")).alias("key"))


@query(
    "request_validation",
    f"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(prompt) < 10 THEN 'prompt_too_short' END, CASE WHEN length(prompt) > 2000 THEN 'prompt_too_long' END,
    CASE WHEN conv_id % 7 = 6 THEN 'theme_invalid' END], lambda x: x IS NOT NULL), ',') AS violations FROM {_PROMPTS}""",
)
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of every prompt; a theme is taken from the conversation's number."""
    themes = ("corporate_dark", "modern_light", "startup_minimal", "healthcare_clinical", "financial_formal", "modern_light", "neon")
    theme = F.element_at(F.array(*map(F.lit, themes)), (F.col("conv_id") % 7 + 1).cast("int"))
    out = _prompts(spark, sf_dir).withColumn("theme", theme)
    return out.select("conv_id", "turn", F.array_join(I.request_violations(F.col("prompt"), F.col("theme")), ",").alias("violations"))


@query(
    "pii_secrets",
    f"SELECT doc_id, CAST({_count_sql('text', X.SECRETS)} AS BIGINT) AS n, sha256({_replace_sql('text', X.SECRETS)}) AS redacted FROM documents",
)
def pii_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    out = X.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", X.SECRETS)
    return out.select("doc_id", "n", F.sha2("redacted", 256).alias("redacted"))


@query(
    "pii_redact",
    f"""SELECT doc_id, CAST({_count_sql('text', X.SECRETS + X.ENTITIES)} AS BIGINT) AS n, {_types_sql('text', X.SECRETS + X.ENTITIES)} AS types,
    sha256({_replace_sql('text', X.SECRETS + X.ENTITIES)}) AS redacted, CAST({_count_sql(_replace_sql('text', X.SECRETS + X.ENTITIES), X.ENTITIES)} AS BIGINT) AS left_over FROM documents""",
)
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities redacted, their types, and what a second look still finds."""
    out = X.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", X.SECRETS + X.ENTITIES)
    again = X.redacted(out.select("doc_id", "n", "types", "redacted"), "redacted", X.ENTITIES, "second", "left_over", "left_types")
    return again.select("doc_id", "n", F.array_join("types", ",").alias("types"), F.sha2("redacted", 256).alias("redacted"), "left_over")


@query(
    "pii_tokens",
    r"""WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS value FROM documents)
    SELECT '<EMAIL_ADDRESS_' || substr(sha256(value), 1, 8) || '>' AS token, value, count(*) AS documents FROM m GROUP BY ALL""",
)
def pii_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token of every e-mail address and how many documents hold it."""
    pairs = table(spark, sf_dir, "documents").select(F.explode(X.token_values(F.col("text"), X.ENTITIES[:1])).alias("p"))
    return pairs.groupBy("p.token", "p.value").agg(F.count("*").alias("documents"))


_EMAIL = X.ENTITIES[0].pattern


@query(
    "pii_tokenised",
    f"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS vs, string_split(regexp_replace(text, '{_EMAIL}', chr(1), 'g'), chr(1)) AS bs FROM documents)
    SELECT doc_id, len(vs) AS n, sha256(array_to_string(list_transform(bs, lambda b, i: b || CASE WHEN i <= len(vs) THEN '<EMAIL_ADDRESS_' || substr(sha256(vs[i]), 1, 8) || '>' ELSE '' END), '')) AS tokenised FROM m""",
)
def pii_tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its e-mail addresses as tokens."""
    docs = table(spark, sf_dir, "documents")
    n = F.regexp_count("text", F.lit(_EMAIL)).cast("long")
    return docs.select("doc_id", n.alias("n"), F.sha2(X.tokenised(F.col("text"), X.ENTITIES[:1]), 256).alias("tokenised"))


@query(
    "pii_log_redact",
    f"SELECT doc_id, CAST({_count_sql('text', X.LOG_PII)} AS BIGINT) AS n, sha256({_replace_sql('text', X.LOG_PII)}) AS redacted FROM documents",
)
def pii_log_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for logs over every document."""
    out = X.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", X.LOG_PII)
    return out.select("doc_id", "n", F.sha2("redacted", 256).alias("redacted"))


_TRACE = _replace_sql("substr(text, 1, 2000)", X.TRACE_PII)


@query("trace_sampling", f"SELECT conv_id || '-' || turn AS trace_id, role, {_TRACE} AS text FROM conversations WHERE CAST('0x' || substr(md5(conv_id || '-' || turn), 1, 8) AS BIGINT) % 1000 < 100")
def trace_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all turns by a hash of their key, redacted for traces after a cut at 2000."""
    turns = table(spark, sf_dir, "conversations").withColumn("trace_id", F.concat_ws("-", "conv_id", "turn"))
    sampled = turns.where(X.sampled(F.col("trace_id"), 0.1))
    return sampled.select("trace_id", "role", X.replaced(F.substring("text", 1, 2000), X.TRACE_PII).alias("text"))


@query(
    "content_dedupe",
    """WITH d AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n, min(doc_id) OVER (PARTITION BY text) AS first FROM documents),
    t AS (SELECT doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS m FROM documents)
    SELECT doc_id, first AS existing_id, n > 1 AS duplicate, m > 1 AS duplicate_in_tenant FROM d JOIN t USING (doc_id)""",
)
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies over all tenants and within a tenant."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), X.tenant_hash(F.col("source"), F.col("text")).alias("th"))
    return I.marked_duplicates(docs, "h", "existing_id", "duplicate").join(
        I.marked_duplicates(docs, "th", "tenant_first", "duplicate_in_tenant").select("doc_id", "duplicate_in_tenant"), "doc_id"
    ).select("doc_id", "existing_id", "duplicate", "duplicate_in_tenant")


@query("new_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))")
def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that neither by id nor by content are among the labelled (already stored) ones."""
    docs = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    stored = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "h")
    return I.not_stored(docs, stored, ["doc_id", "h"]).select("doc_id", "source")


@query(
    "chunk_upsert",
    """WITH new AS (SELECT vec_id AS chunk_id, e, substr(text, 1, 1000) AS text FROM (SELECT vec_id, embedding AS e FROM embeddings) JOIN documents ON doc_id = vec_id WHERE vec_id % 3 = 0),
    old AS (SELECT doc_id AS chunk_id, substr(text, 1, 1000) AS text FROM documents)
    SELECT chunk_id, md5(text) AS text_hash, CAST('old' AS VARCHAR) AS origin FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT chunk_id, md5(text), 'new' FROM new""",
)
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: chunks with a vector replace stored ones of the same id; rows without a vector are left out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring("text", 1, 1000).alias("text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).alias("embedding"))
    new = docs.join(vectors, "chunk_id").where("embedding is not null").select("chunk_id", "text").withColumn("origin", F.lit("new"))
    return I.upserted(docs.withColumn("origin", F.lit("old")), new, ["chunk_id"]).select("chunk_id", F.md5("text").alias("text_hash"), "origin")


@query("gdpr_erase", "SELECT source AS tenant_id, count(*) AS kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def gdpr_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that remain after the toxic ones asked to be erased."""
    asked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return I.erased(table(spark, sf_dir, "documents"), asked, ["doc_id"]).groupBy(F.col("source").alias("tenant_id")).agg(F.count("*").alias("kept"))


@query("document_status", "SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY 1")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest status of every key."""
    return I.latest(table(spark, sf_dir, "events").withColumnRenamed("user_id", "doc_id"), ["doc_id"], "event_type", ["ts", "event_id"]).withColumnsRenamed({"value_": "status", "at_": "updated_at"})


@query(
    "dead_letters",
    """SELECT event_id, substr(props, 1, 500) AS error, ts AS failed_at FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n <= 1000""",
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 1000 failures with their error cut at 500."""
    bad = table(spark, sf_dir, "events").where("event_type = 'error'")
    return I.newest(bad, ["ts", "event_id"], 1000).select("event_id", F.substring("props", 1, 500).alias("error"), F.col("ts").alias("failed_at"))


@query("tenant_view", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def tenant_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tenants that a profile table lists (those with a toxic label), as a semi join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    profiles = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("source").distinct()
    return docs.join(profiles, "source", "left_semi").select("doc_id", "source")


@query("profile_defaults", "SELECT c_custkey AS id, split_part(lower(c_name) || '@example.com', '@', 1) AS display_name, 'free' AS plan, 'user' AS role FROM customer")
def profile_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default profile of every customer by the local part of an e-mail address."""
    email = F.concat(F.lower("c_name"), F.lit("@example.com"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.split_part(email, F.lit("@"), F.lit(1)).alias("display_name"), F.lit("free").alias("plan"), F.lit("user").alias("role"))


def _topic_sql(column: str) -> str:
    ranks = [f"({' + '.join(f'CAST(contains({column}, \'{w}\') AS INT)' for w in words)})" for words in X.TOPICS.values()]
    names = list(X.TOPICS)
    best = f"greatest({', '.join(ranks)})"
    return f"CASE WHEN {best} = 0 THEN 'general' {' '.join(f'WHEN {r} = {best} THEN \'{n}\'' for r, n in zip(ranks, names, strict=True))} END"


@query("topic_label", f"SELECT doc_id, {_topic_sql('lower(text)')} AS topic FROM documents")
def topic_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for every document."""
    return table(spark, sf_dir, "documents").select("doc_id", X.topic(F.col("text")).alias("topic"))


_ENDS = " ".join(f"WHEN instr(text, {e}) - 1 > 10 AND instr(text, {e}) - 1 < 100 THEN trim(substr(text, 1, instr(text, {e})))" for e in ("'. '", "'! '", "'? '", "'.' || chr(10)", "'!' || chr(10)", "'?' || chr(10)"))


@query("first_sentence", f"SELECT doc_id, CASE {_ENDS} ELSE rtrim(substr(text, 1, 100)) || CASE WHEN length(text) > 100 THEN '…' ELSE '' END END AS summary FROM documents")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default summary of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("summary"))


@query(
    "keywords_top10",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: x <> '') AS all_w, length(text) AS n FROM documents),
    k AS (SELECT doc_id, list_transform(all_w, lambda x: CASE WHEN regexp_full_match(x, '[a-z][a-z0-9-]{{2,}}') THEN x END) AS ws FROM w WHERE n >= 10),
    u AS (SELECT doc_id, list_filter(ws, lambda x: x IS NOT NULL) AS ws FROM k),
    s AS (SELECT doc_id, p.term AS term, 1 AS weight, p.i AS spot FROM (SELECT doc_id, unnest(list_transform(ws, lambda x, i: {{'term': x, 'i': i}})) AS p FROM u) UNION ALL
          SELECT doc_id, p[1] || ' ' || p[2], 3, CAST(p[3] AS BIGINT) FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1], CAST(i AS VARCHAR)])) AS p FROM u) WHERE p[1] NOT IN ({", ".join(f"'{w}'" for w in X.STOPWORDS)}) AND p[2] NOT IN ({", ".join(f"'{w}'" for w in X.STOPWORDS)})),
    c AS (SELECT doc_id, term, CAST(sum(weight) AS BIGINT) AS n, min(spot) AS spot FROM s WHERE term NOT IN ({", ".join(f"'{w}'" for w in X.STOPWORDS)}) GROUP BY doc_id, term)
    SELECT doc_id, term, n, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, contains(term, ' '), spot) AS r FROM c) WHERE r <= 10""",
)
def keywords_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten heaviest keywords of every document."""
    docs = X.keywords(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode("keywords").alias("i", "k")).select("doc_id", "k.term", "k.n", (F.col("i") + 1).alias("place"))


@query("language_profile", """SELECT doc_id, lang || '-XX' AS tag, CASE WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE 'en' END AS profile FROM documents""")
def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tag, then its first part, then the default."""
    profiles = spark.createDataFrame([("en", "ltr"), ("de", "ltr"), ("fr", "ltr"), ("ar", "rtl")], "tag string, direction string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("-XX")).alias("tag"))
    return I.profile_of(docs, profiles, "en").select("doc_id", "tag", "profile")


_NAME_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"


@query(
    "pii_names",
    rf"""WITH d AS (SELECT doc_id, text, {_NAME_WORDS} AS w, string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS a FROM documents),
    n AS (SELECT DISTINCT array_to_string(list_slice(w, 1, CASE WHEN length(text) % 2 = 0 THEN 2 ELSE 3 END), ' ') AS gram FROM d WHERE len(w) >= 3),
    m AS (SELECT doc_id, list_transform(w, lambda x, i: x || CASE WHEN regexp_full_match(a[i + 1], '[ \t\r\n]+') THEN '' ELSE chr(1) END) AS w FROM d),
    g AS (SELECT doc_id, s, k, rtrim(array_to_string(list_slice(w, s + 1, s + k), ' '), chr(1)) AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM m), (VALUES (2), (3)) v(k) WHERE s + k <= len(w)),
    h AS (SELECT doc_id, list({{'e': s + k, 's': s}} ORDER BY s, k DESC) AS hits FROM g JOIN n USING (gram) GROUP BY 1),
    t AS (SELECT doc_id, list_reduce(hits, lambda acc, x: CASE WHEN x.s >= acc[len(acc)].e THEN list_append(acc, x) ELSE acc END, [{{'e': CAST(0 AS BIGINT), 's': CAST(-1 AS BIGINT)}}])[2:] AS spans FROM (SELECT doc_id, list_transform(hits, lambda x: x) AS hits FROM h))
    SELECT d.doc_id, CAST(coalesce(len(spans), 0) AS BIGINT) AS n_names, md5(CASE WHEN spans IS NULL THEN text ELSE array_to_string(list_concat(flatten(list_transform(w, lambda x, i:
        CASE WHEN len(list_filter(spans, lambda p: p.s = i - 1)) > 0 THEN [a[i], '<PERSON>'] WHEN len(list_filter(spans, lambda p: p.s < i - 1 AND i - 1 < p.e)) > 0 THEN [] ELSE [a[i], x] END)), [a[len(a)]]), '') END) AS digest
    FROM d LEFT JOIN t USING (doc_id)""",
)
def pii_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a table (here: the first two or three words of every document) redacted in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all("text", F.lit(f"({N.WORD})"), F.lit(1))
    names = docs.select("text", words.alias("w")).where(F.size("w") >= 3).select(F.array_join(F.slice("w", 1, F.when(F.length("text") % 2 == 0, 2).otherwise(3)), " ").alias("name"))
    return N.without_names(docs, names).select("doc_id", "n_names", F.md5("redacted").alias("digest"))


@query(
    "entity_spans",
    r"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '@[a-z]+'))) AS v, text FROM documents)
    SELECT doc_id, count(*) AS n, CAST(sum(instr(text, v) - 1) AS BIGINT) AS starts, CAST(sum(length(v)) AS BIGINT) AS characters FROM m GROUP BY 1""",
)
def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detector (here: signs and letters after an at sign, each value at its first place) finds in every document."""

    def detect(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        found = [{m: t.index(m) for m in re.findall("@[a-z]+", t)} for t in texts]
        return [[("HANDLE", at, at + len(v)) for v, at in one.items()] for one in found]

    rows = X.entities(table(spark, sf_dir, "documents").select("doc_id", "text"), detect=detect).where(F.size("entities") > 0).select("doc_id", F.explode("entities").alias("e"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("e.start").cast("long").alias("starts"), F.sum(F.col("e.end") - F.col("e.start")).cast("long").alias("characters"))


@query("summaries", "SELECT doc_id, coalesce(lang, '') || ':' || trim(length(text) || ':' || substr(text, 1, 5)) AS summary FROM documents")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summariser that gets texts in batches of ten (here: language, length and a beginning)."""

    def summarise(texts: list[str]) -> list[str]:
        assert len(texts) <= X.SUMMARY_BATCH
        return [f"{len(t.partition('|')[2])}:{t.partition('|')[2][:5]}" for t in texts]

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), "text").alias("text"))
    return X.summarised(rows, summarise).select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), "summary").alias("summary"))
