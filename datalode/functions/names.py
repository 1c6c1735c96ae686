"""Names from a table, found in texts as runs of words: longest first, from left to right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of a name or a text: letters and digits. Between the words of a name there is white space only.
WORD, SPACE = r"[\p{L}\p{N}]+", r"^[ \t\r\n]+$"
_BREAK = "\u0001"
#: Slots of the hashes that tell which runs of words may be names; what goes to all tasks is bounded by them.
SLOTS = 1 << 24


def text_words(text: Column) -> Column:
    """The words of a text; those that something else than white space follows end with a sign that no word has."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    after = F.split(text, WORD)
    return F.zip_with(words, F.slice(after, 2, F.size(words)), lambda w, s: F.when(s.rlike(SPACE), w).otherwise(F.concat(w, F.lit(_BREAK))))


def may_be_names(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Runs whose ``gram`` has the slot of a known one: all names and few others, told before anything is shuffled."""
    slot = F.pmod(F.xxhash64("gram"), F.lit(SLOTS)).alias("slot")
    return runs.select("*", slot).join(F.broadcast(known.select(slot).distinct()), "slot", "left_semi").drop("slot")


def name_spans(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """t1, t2 (hashes of a text) and its ``spans``: the first word and the number of words of every name in it, for texts that have one.

    Runs of as many words as some name has meet the names in a join, so the table of names may be of any size; runs that cannot be names are left out before it. Where names
    overlap the first one wins, of those that begin at one word the longest. Case counts. Copies of a text are looked at once."""
    known = names.select(F.array_join(F.regexp_extract_all(F.col(name), F.lit(f"({WORD})"), F.lit(1)), " ").alias("gram")).where("gram <> ''").distinct()
    sizes = sorted(r[0] for r in known.select(F.size(F.split("gram", " "))).distinct().collect())  # as many as names have lengths
    keyed = texts.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(text).alias("text")).dropDuplicates(["t1", "t2"])
    words = keyed.select("t1", "t2", text_words(F.col("text")).alias("w"))

    def runs(n: int) -> Column:
        gram = lambda i: F.rtrim(F.array_join(F.slice("w", i + 1, n), " "), F.lit(_BREAK))
        made = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), gram(i).alias("gram")))
        return F.when(F.size("w") >= n, made).otherwise(F.array().cast("array<struct<start:int,n:int,gram:string>>"))

    each = words.select("t1", "t2", F.explode(F.concat(*map(runs, sizes))).alias("r")) if sizes else words.select("t1", "t2", F.lit(None).cast("struct<start:int,n:int,gram:string>").alias("r")).limit(0)
    found = may_be_names(each.select("t1", "t2", "r.start", "r.n", "r.gram"), known).join(known, "gram").groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("less")))).alias("all"))
    none = F.array().cast("array<struct<start:int,n:int>>")
    first = F.struct(F.lit(0).alias("end"), none.alias("spans"))
    take = lambda acc, x: F.when(
        x["start"] >= acc["end"], F.struct((x["start"] - x["less"]).alias("end"), F.array_append(acc["spans"], F.struct(x["start"].alias("start"), (-x["less"]).alias("n"))).alias("spans"))
    ).otherwise(acc)
    return found.select("t1", "t2", F.aggregate("all", first, take)["spans"].alias("spans"))


def without_names(rows: DataFrame, names: DataFrame, text: str = "text", name: str = "name", out: str = "redacted", token: str = "<PERSON>") -> DataFrame:
    """Adds the text with each name as a token, and ``n_names``; null texts stay null and have none."""
    spans = name_spans(rows, names, text, name)
    found = rows.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}).join(spans, ["t1", "t2"], "left")
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    found = found.withColumns({"__w": words, "__a": F.split(text, WORD)})
    # the words and what stands before each; a name is its token in place of its first word, and nothing for the rest of it
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["start"] + s["n"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.size("__w")))
    plain = lambda a, b: F.array_join(F.zip_with(F.slice("__a", a + 1, b - a), F.slice("__w", a + 1, b - a), lambda x, w: F.concat(x, w)), "")
    parts = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.concat(plain(p["a"], p["b"]), F.when(p["b"] < F.size("__w"), F.concat(F.element_at("__a", p["b"] + 1), F.lit(token))).otherwise("")))
    new = F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.concat(F.array_join(parts, ""), F.element_at("__a", -1)))
    count = F.when(F.col("spans").isNull(), F.lit(0)).otherwise(F.size("spans")).cast("long")
    return found.withColumns({out: new, "n_names": count}).drop("t1", "t2", "__w", "__a", "spans")
