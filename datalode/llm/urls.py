"""URL filters: listed rules first, then combinations of URL tokens that FP-growth mines from labels."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII letters only: other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "verdict:block"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule (verdict, host, path) that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def url_tokens(url: str, host: str, path: str) -> Column:
    """Tokens of a URL: scheme, host, all parts of the host and of the path, file ending, all query keys, fragment."""
    labels = F.split(F.col(host), r"\.")
    folders = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    query = F.regexp_extract(F.col(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: x != "")
    ending = F.regexp_extract(F.col(path), r"\.([A-Za-z]{1,5})$", 1)
    some = lambda kind, c: F.when(c != "", F.concat(F.lit(kind + ":"), c))
    one = F.array(
        some("scheme", F.split_part(F.col(url), F.lit("://"), F.lit(1))),
        some("host", F.col(host)),
        some("site", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")),
        some("zone", F.element_at(labels, -1)),
        some("ending", ending),
        F.when(F.col(url).contains("#"), F.lit("fragment")),
    )
    parts = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != "")
    many = F.concat(F.transform(parts, lambda x: F.concat(F.lit("part:"), x)), F.transform(folders, lambda x: F.concat(F.lit("folder:"), x)), F.transform(keys, lambda x: F.concat(F.lit("key:"), x)))
    tokens = F.array_distinct(F.filter(F.concat(one, many), lambda x: x.isNotNull()))
    return F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(F.coalesce(tokens, F.array().cast("array<string>")))


def token_classes(lists: DataFrame, least: float) -> DataFrame:
    """Each ``token`` of ``least`` rows or more, and the first of the tokens that lie in the same rows (``kind``).

    ``lists`` has the different ``tokens`` and their number of rows ``n``."""
    one = lists.select(F.explode("tokens").alias("token"), "n", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), "tokens").alias("h2"))
    often = one.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).where(F.col("n") >= least)
    same = often.groupBy("n", "h1", "h2").agg(F.collect_list("token").alias("tokens"), F.min("token").alias("kind"))
    return same.select(F.explode("tokens").alias("token"), "kind")


def lower_bound(share: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval of a share that was seen in ``n`` rows."""
    around = share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return around / (1 + z * z / n)


def mined_rules(labelled: DataFrame, support: float, confidence: float, least: int, lift: float, z: float | None, error: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Token combinations (``tokens``, ``confidence``, ``support``) that mean block, and what stands for each token (``token``, ``kind``).

    ``labelled`` has ``tokens`` and ``bad``. A rule holds for at least ``least`` bad rows and the share ``support`` of all rows; its share of
    bad rows is at least ``confidence`` and ``lift`` times that of all rows, and the lower end of its interval (``z`` deviations) is over that of all rows.
    Without ``z`` the deviations follow from ``error``, shared out to all combinations that are frequent among bad rows (Bonferroni): where
    labels do not depend on URLs, the chance that there is any rule at all is about ``error``.
    A rule with a shorter one inside it that is at least as sure
    is left out. So tokens that lie in the same rows never meet in a rule and take each other's place in it; one stands for all. Rarer tokens than
    the support are dropped before. The number of combinations grows with the tokens that are frequent together in different rows.
    """
    lists = labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    count, share = labelled.agg(F.count("*"), F.coalesce(F.try_divide(F.count_if("bad"), F.count("*")), F.lit(0.0))).first()
    support = min(1.0, max(support, least / max(1, count)))
    kinds = token_classes(lists, support * count).persist()  # at most a URL's mean number of tokens / support
    one = lists.select("tokens", "n", "n_bad", F.explode("tokens").alias("token")).join(F.broadcast(kinds), "token", "left")
    rows = one.groupBy("tokens", "n", "n_bad").agg(F.collect_set("kind").alias("items"))
    # as many rows again as before, a thousand at a time
    rows = rows.select("items", "n", "n_bad", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(1000))).alias("first"))
    rows = rows.select("items", "n_bad", F.explode(F.sequence("first", F.least(F.col("first") + 999, F.col("n") - 1))).alias("i"))
    baskets = rows.select(F.when(F.col("i") < F.col("n_bad"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min(1.0, max(confidence, lift * share * (1 - 1e-12)))).fit(baskets)
    sets = model.freqItemsets.persist()  # rules and their number come from it
    if z is None:
        tried = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).count()
        z = NormalDist().inv_cdf(1 - error / max(1, tried))
    rules = model.associationRules.where(F.lit(count >= least) & (F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK))
    rows_of = F.round(F.col("support") * count / F.col("confidence"))
    rules = rules.where(lower_bound(F.col("confidence"), rows_of, z) > share)
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    inner = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("t"), F.col("confidence").alias("c"))
    # a rule is redundant if one that shares a token lies inside it and is as sure
    longer = rules.withColumn("token", F.explode("tokens"))
    inside = (F.size("t") < F.size("tokens")) & (F.size(F.array_except("t", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))
    redundant = longer.join(inner, "token").where(inside).select("tokens").distinct()
    return rules.join(redundant, "tokens", "left_anti"), kinds


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id: str = "page_id",
    label_id: str = "doc_id",
    bad: Column | None = None,
    url: str = "url",
    support: float = 0.002,
    confidence: float = 0.0,
    least: int = 5,
    lift: float = 1.25,
    z: float | None = None,
    error: float = 0.05,
) -> DataFrame:
    """Adds host, path, rule, verdict, mined_tokens and mined_confidence to every page.

    The verdict is that of the longest listed rule that fits; else ``block`` if a mined combination is
    among the URL's tokens, else ``allow``. Combinations are learnt from pages whose id has a label (a
    page with several labels counts once for each, a repeated page too). Null labels count as not bad. What makes a rule
    is told by ``mined_rules``; with ``confidence`` it must be that sure besides. Mined rules are matched
    by an index on their least frequent token, over different URLs. Of several that fit the surest names the page,
    of equally sure ones the last in the order of their tokens. All rows stay, those without an id or repeated too; null or odd URLs have
    empty host and path and are allowed. Empty tables of pages or labels give no rows or no mined rules. Columns of these names are replaced.
    """
    added = ["host", "path", "rule", "verdict", "mined_tokens", "mined_confidence"]
    pages = pages.drop(*added)
    host, path = host_and_path(url)
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0) if bad is None else bad
    parts = pages.select(F.col(id).alias("__id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    parts = parts.withColumn("tokens", url_tokens("url", "host", "path"))
    marks = labels.select(F.col(label_id).alias("__id"), F.coalesce(bad, F.lit(False)).alias("bad"))
    mined, kinds = mined_rules(parts.join(marks, "__id").where(F.size("tokens") > 0).select("tokens", "bad"), support, confidence, least, lift, z, error)

    urls = parts.where(F.col("url").isNotNull() & (F.size("tokens") > 0)).select("url", "tokens").distinct()
    each = mined.select("tokens", "confidence", F.explode("tokens").alias("kind"))
    asked = kinds.join(each.select("kind").distinct(), "kind", "left_semi")
    # of the tokens that take each other's place the last names the rule
    one = urls.select("url", F.explode("tokens").alias("token")).join(F.broadcast(asked), "token").groupBy("url", "kind").agg(F.max("token").alias("token"))
    often = one.groupBy("kind").agg(F.count("*").alias("n"))
    rarest = each.join(often, "kind").groupBy("tokens", "confidence").agg(F.min_by("kind", F.struct("n", "kind")).alias("kind"))
    held = one.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("kind", "token"))).alias("held"))
    hits = held.select("url", "held", F.explode(F.map_keys("held")).alias("kind")).join(rarest, "kind")
    hits = hits.where(F.size(F.array_except("tokens", F.map_keys("held"))) == 0)
    hits = hits.select("url", F.array_sort(F.transform("tokens", lambda x: F.col("held")[x])).alias("mined_tokens"), F.col("confidence").alias("mined_confidence"))
    best = hits.groupBy("url").agg(F.max(F.struct("mined_confidence", "mined_tokens")).alias("m"))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = listed("host", "path", rules)
    # pages without a URL match nothing; they are spread by their ids
    key = F.coalesce(F.col(url), F.concat(F.lit(" "), F.xxhash64(id)))
    out = out.withColumns({"rule": rule, "__listed": verdict, "__url": key}).join(best.withColumnRenamed("url", "__url"), "__url", "left")
    mined_verdict = F.when(F.col("m").isNotNull(), "block").otherwise("allow")
    out = out.withColumns({"verdict": F.coalesce("__listed", mined_verdict), "mined_tokens": F.col("m.mined_tokens"), "mined_confidence": F.col("m.mined_confidence")})
    return out.drop("m", "__url", "__listed")
