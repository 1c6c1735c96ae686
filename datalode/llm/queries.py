"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from datalode.llm.decontaminate import mark_contaminated
from datalode.llm.html import extract_text
from datalode.llm.jaccard import similar_groups
from datalode.llm.lexical import ranked_search
from datalode.llm.licenses import PHRASES, TEMPLATES, scan_licenses
from datalode.llm.lm import language_scores
from datalode.llm.packing import best_fit_pack
from datalode.llm.quality import graded, score_quality
from datalode.llm.spelling import spelling_variants
from datalode.llm.suffixes import remove_repeats
from datalode.llm.tokens import token_counts
from datalode.llm.topk import exact_top_k
from datalode.llm.urls import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its most similar window."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contaminated(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return marked.select("doc_id", F.col("m.item").alias("item_id"), "m.similarity", "m.start_word", "m.n_words")


#: Listed URL rules: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(pages, _table(spark, sf_dir, "labels"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined_tokens", " ").alias("mined_rule"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    out = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = "list_filter(regexp_split_to_array(lower({}), '" + _GAP + "'), lambda x: x <> '')"


def _license_sql() -> str:
    """Every short line, and every run of as many words as the longest template has, against every template; and every phrase at every word."""
    words = [t.lower().replace(".", " ").split() for _, t in TEMPLATES]
    most, vocabulary = max(map(len, words)), ", ".join(sorted({f"'{w}'" for t in words for w in t}))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', '{t}')" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
    WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, coalesce(text, '') AS text FROM documents),
    p(phrase, label, n) AS (VALUES {phrases}),
    b AS (SELECT doc_id, label, s - 1 AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d) x JOIN p
          ON array_to_string(list_slice(w, s, s + n - 1), ' ') = phrase),
    bl AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS ls FROM b GROUP BY 1),
    t AS (SELECT i, label, list_distinct({_WORDS.format("t")}) AS tw FROM (VALUES {templates}) v(i, label, t)),
    ps AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    wv AS (SELECT DISTINCT doc_id, list_sort(list_distinct(lw)) AS lw FROM (SELECT doc_id, list(word) OVER (PARTITION BY doc_id ORDER BY p RANGE BETWEEN CURRENT ROW AND {most - 1} FOLLOWING) AS lw FROM ps WHERE word IN ({vocabulary}))),
    ln AS (SELECT doc_id, list_distinct(lw) AS lw FROM (SELECT doc_id, {_WORDS.format("line")} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) y) WHERE len(lw) <= {most}),
    m AS (SELECT doc_id, label, len(list_intersect(lw, tw)) / len(tw) AS score FROM (SELECT * FROM ln UNION ALL SELECT * FROM wv) x, t WHERE len(list_intersect(lw, tw)) >= 0.85 * len(tw)),
    ml AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) AS ls FROM m GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(array_to_string(list_sort(bl.ls), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl.ls, []), coalesce(ml.ls, [])))), ','), '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(ml.score, 0.0)::DOUBLE END AS score
    FROM d LEFT JOIN bl USING (doc_id) LEFT JOIN ml USING (doc_id)"""


ORACLES["op5_license_scan"] = _license_sql()


def op4_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of those whose crc32(doc_id) mod 7 is not 2."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_scores(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector with all others."""
    return exact_top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLES["op3_exact_top_k"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and the probability of the highest grade for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", graded(F.col("quality"), F.col("toxic")).alias("grade"))
    return score_quality(docs, labels).select("doc_id", "expected_grade", "p_tail", "keep")


#: Bytes of a string that op7 tells of, if it occurs elsewhere too, though it does not remove it.
SHARED_BYTES = 256


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start twice or more in the corpus.

    ``n_shared`` is the number of bytes that lie in a string of 256 bytes that starts elsewhere too, removed or not."""
    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, shorter=SHARED_BYTES)
    covered = lambda spans: F.aggregate(spans, F.lit(0), lambda n, s: n + s["b"] - s["a"]).cast("long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counts = [size.alias("n_bytes"), covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2("kept", 256).alias("kept_sha256"), covered("shared").alias("n_shared"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    packed = best_fit_pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by its prefix counts, whether they are over 2048, and how many whole words 2048 tokens hold (``words_within``)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, budgets=(2048,))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # the count of the longest prefix is that of the text; the same counts tell how many whole words the limit holds
    n = F.coalesce(F.try_element_at("run_tokens", F.lit(-1)).cast("long"), F.lit(0).cast("long"))
    return counted.select("doc_id", size.alias("n_bytes"), n.alias("n_tokens"), (n > 2048).alias("over_limit"), F.col("cuts")[0].alias("words_within"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_groups(docs, words=4, share=(85, 100)).select("doc_id", "n_shingles", "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents that score highest for each benchmark item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, _table(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES["op11_ranked_search"] = f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ts FROM documents),
    c AS (SELECT count(*) AS N, sum(len(ts)) AS L FROM d WHERE len(ts) > 0),
    tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c.N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
    s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * CAST(100 - 90 + (90 * tf.n * c.N) // c.L AS BIGINT)))) AS BIGINT) AS score
          FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the words that are one edit apart, and the more frequent form of each."""
    return spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


# crc32 step by step over the bytes; near words share what is left when a letter is blanked or deleted
ORACLES["op12_spelling_variants"] = """
    WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) v(i))),
    occ AS (SELECT doc_id, run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
    h AS (SELECT run, n, xor(4294967295, list_reduce(
              flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)),
              lambda s, b: xor(t[CAST(xor(s % 256, b) AS BIGINT) + 1], s // 256), 4294967295)) AS h
          FROM occ, crc WHERE length(run) >= 5),
    w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n
          FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h)
          WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
    cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS blank
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    one AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.blank = b.blank AND a.word <> b.word
            UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN w b ON a.less = b.word
            UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN w b ON a.less = b.word),
    best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM one GROUP BY 1),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN most END AS form_n,
                 CASE WHEN most >= 2 * w.n THEN (SELECT min(other) FROM one o WHERE o.word = w.word AND o.other_n = most) END AS form
          FROM w LEFT JOIN best USING (word)),
    up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f l ON up.root = l.word WHERE l.form IS NULL"""
for _name, _text in (("UPPER", _UPPER), ("LOWER", _UPPER.lower())):
    ORACLES["op12_spelling_variants"] = ORACLES["op12_spelling_variants"].replace(_name, _text, 1)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES |= {
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_html_extraction": op13_html_extraction,
    "pipeline": corpus_pipeline.run,
    "op1_decontamination": op1_decontamination,
    "op3_exact_top_k": op3_exact_top_k,
    "op6_quality_classifier": op6_quality_classifier,
    "op2_url_filters": op2_url_filters,
    "op5_license_scan": op5_license_scan,
    "op4_language_scores": op4_language_scores,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_best_fit_packing": op8_best_fit_packing, "op9_token_counts": op9_token_counts}
