"""License scans: phrases at word positions, and an exact containment join of text blocks with templates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: every ASCII sign but digits and small letters (texts are lower-cased before).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices and their labels (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License version 3"),
    ("gpl-3", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License version 3"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("bsd-3", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]


def small(text: Column) -> Column:
    """A-Z as a-z; other letters, also those whose small form is an ASCII letter, stay as they are."""
    # the Kelvin sign and the capital I with a dot are the only two others whose small form begins with an ASCII letter
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(small(text), GAP, " ")), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def phrase_columns(text: Column, phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base_labels of a text."""
    any_of = "|".join(GAP.join(p.split()) for p in phrases)
    has = small(text).rlike(any_of)
    s = F.col("__spaced")
    places, firsts, lasts, labels = [], [], [], []
    for p, label in phrases.items():
        held = f" {p} "
        at = F.instr(s, held)
        back = F.instr(F.reverse(s), held[::-1])
        places.append(F.regexp_count(s, F.lit(f" {p}(?= )")))
        firsts.append(F.when(at > 0, _spaces(F.substring(s, F.lit(1), at - 1))))
        lasts.append(F.when(at > 0, _spaces(F.substring(s, F.lit(1), F.length(s) - back - len(held) + 1))))
        labels.append(F.when(at > 0, F.lit(label)))
    many = len(phrases) > 1
    none = F.lit(None).cast("long")
    return {
        "__spaced": F.when(has, _spaced(text)).otherwise(" "),
        "n_words": F.regexp_count(small(text), F.lit(WORD)).cast("long"),
        "n_base": F.when(has, sum(places[1:], places[0])).otherwise(0).cast("long"),
        "first_word": F.when(has, F.least(*firsts) if many else firsts[0]).otherwise(none).cast("long"),
        "last_word": F.when(has, F.greatest(*lasts) if many else lasts[0]).otherwise(none).cast("long"),
        "base_set": F.when(has, F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))).otherwise(F.array().cast("array<string>")),
    }


def template_blocks(texts: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """Lines (``t1``, ``t2`` of their text, ``block`` to ``last``) that hold the share ``threshold`` of a template's words.

    A block is one line of no more words than the longest template has, or a run of so many words: within a
    longer line, or, for notices that are wrapped, over two lines or more. ``texts`` has t1, t2 and text. Words are ordered by how often the whole corpus has them. A block must
    hold a word of a template's prefix; it must have enough words of the templates, and from the first
    common word on enough must follow on both sides.
    """
    most = max((len(t.replace(".", " ").split()) for _, t in templates), default=1)
    sets = [(label, sorted(set(" ".join(t.lower().replace(".", " ").split()).split()))) for label, t in templates]
    vocabulary = sorted({w for _, t in sets for w in t})
    words = F.filter(F.split(small(F.col("text")), GAP), lambda w: w.isin(vocabulary))
    counted = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = {r["word"]: r["n"] for r in counted.collect()}  # at most a row for each word of the templates
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    rows, prefix = [], set()
    for number, (label, t) in enumerate(sets):
        ranks = sorted(order[w] for w in t)
        least = math.ceil(threshold * len(ranks) - 1e-9)
        rows += [(number, label, ranks, least, i, r) for i, r in enumerate(ranks[: len(ranks) - least + 1])]
        prefix |= set(ranks[: len(ranks) - least + 1])
    index = texts.sparkSession.createDataFrame(rows, "template int, label string, ranks array<int>, least int, i int, rank int")
    rank_of = F.create_map(*(F.lit(x) for w, i in order.items() for x in (w, i)))
    seen = [w for w in vocabulary if order[w] in prefix and often.get(w, 0)]
    some = texts.where(small(F.col("text")).rlike("|".join(seen) if seen else "$^"))
    lines = some.select("t1", "t2", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    lines = lines.where(small(F.col("line")).rlike("|".join(seen) if seen else "$^") & (F.regexp_count(small(F.col("line")), F.lit(WORD)) <= most))
    held = F.filter(F.array_distinct(F.split(small(F.col("line")), GAP)), lambda w: w.isin(vocabulary))
    lines = lines.select("t1", "t2", "block", F.col("block").alias("last"), F.array_sort(F.transform(held, lambda w: rank_of[w])).alias("own"))
    fewest = min((r[3] for r in rows), default=1)
    lines = lines.unionByName(_runs(some, vocabulary, rank_of, [order[w] for w in seen], most, fewest))
    lines = lines.where(F.size("own") >= fewest)
    each = lines.select("*", F.posexplode("own").alias("j", "rank"))
    found = each.join(F.broadcast(index), "rank").where(F.size("own") >= F.col("least"))
    follow = 1 + F.least(F.size("ranks") - F.col("i") - 1, F.size("own") - F.col("j") - 1)
    found = found.where(follow >= F.col("least") - F.least("i", "j"))
    both = F.size(F.array_intersect("own", "ranks"))
    found = found.where(both >= F.col("least"))
    found = found.select("t1", "t2", "block", "last", "label", (both / F.size("ranks")).alias("score"))
    # of the blocks that end, then of those that begin at a line, the shortest of the best
    found = found.groupBy("t1", "t2", "label", "last").agg(F.max(F.struct("score", "block")).alias("b"))
    found = found.select("t1", "t2", "label", "last", "b.score", "b.block").groupBy("t1", "t2", "label", "block")
    return found.agg(F.max(F.struct("score", (-F.col("last")).alias("back"))).alias("b")).select("t1", "t2", "block", (-F.col("b.back")).alias("last"), "label", "b.score")


def _runs(texts: DataFrame, vocabulary: Sequence[str], rank_of: Column, rare: Sequence[int], most: int, fewest: int) -> DataFrame:
    """Runs of ``most`` words over two lines or more, or within a longer line, from each word of the vocabulary on, that hold a rare one."""
    per_line = lambda line, k: F.transform(F.filter(F.split(small(line), GAP), lambda w: w != ""), lambda w: F.struct(w.alias("word"), k.alias("line")))
    sizes = F.transform(F.split("text", "\n"), lambda line: F.regexp_count(small(line), F.lit(WORD)))
    words = texts.select("t1", "t2", F.flatten(F.transform(F.split("text", "\n"), per_line)).alias("words"), sizes.alias("sizes"))
    own = F.transform("words", lambda x, i: F.when(x["word"].isin(list(vocabulary)), F.struct(i.alias("at"), x["line"].alias("line"), rank_of[x["word"]].alias("rank"))))
    words = words.select("t1", "t2", "sizes", F.filter(own, lambda x: x.isNotNull()).alias("own"))
    words = words.where(F.size(F.array_distinct(F.transform("own", lambda x: x["rank"]))) >= fewest)
    run = F.transform("own", lambda x, j: F.filter(F.slice(F.col("own"), j + 1, F.lit(most)), lambda y: y["at"] < x["at"] + most))
    beyond = lambda r: (r[0]["line"] < F.element_at(r, -1)["line"]) | (F.element_at("sizes", r[0]["line"] + 1) > most)
    wrapped = lambda r: (F.size(r) >= fewest) & beyond(r) & F.exists(r, lambda y: y["rank"].isin(list(rare)))
    words = words.select("t1", "t2", F.explode(F.filter(run, wrapped)).alias("run"))
    ranks = F.array_sort(F.array_distinct(F.transform("run", lambda y: y["rank"])))
    return words.select("t1", "t2", F.col("run")[0]["line"].alias("block"), F.element_at("run", -1)["line"].alias("last"), ranks.alias("own"))


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    threshold: float = 0.85,
) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and blocks to every row.

    ``blocks`` lists the lines (from 0), and the runs of words by their lines (``block`` to ``last``), that hold enough of a
    template, with label and score; a run may begin or end a line beside its notice. ``score`` is
    1 if a phrase occurs, else the best of the blocks, else 0. A null text is empty: no words, no labels,
    null positions, empty strings. Repeated rows get equal results, equal scores are listed in the order of blocks; texts of any length
    are taken whole; an empty table gives no rows. Columns of these names are replaced.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    docs = docs.drop(*added)
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(whole.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    found = template_blocks(texts, templates, threshold).groupBy("t1", "t2").agg(
        F.array_sort(F.collect_set(F.struct("block", "last", "label", "score"))).alias("blocks")
    )
    columns = phrase_columns(whole, phrases)
    out = docs.withColumns({"__spaced": columns.pop("__spaced"), "__t1": F.xxhash64(whole), "__t2": F.xxhash64(F.lit(1), whole)}).withColumns(columns)
    out = out.join(found.withColumnsRenamed({"t1": "__t1", "t2": "__t2"}), ["__t1", "__t2"], "left")
    of_blocks = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    best = F.when(F.size("base_set") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["score"])), F.lit(0.0)))
    out = out.withColumns(
        {"base_labels": F.array_join("base_set", ","), "labels": F.array_join(F.array_sort(F.array_union("base_set", of_blocks)), ","), "score": best}
    )
    return out.drop("__spaced", "__t1", "__t2", "base_set")
