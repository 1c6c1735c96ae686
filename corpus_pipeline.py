"""From raw documents to packed training sequences, in five stages of the ``llm`` operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.llm.common import written
from datalode.llm.decontaminate import mark_contaminated
from datalode.llm.jaccard import similar_groups
from datalode.llm.packing import best_fit_pack
from datalode.llm.quality import graded, score_quality
from datalode.llm.suffixes import remove_repeats

#: Bytes of a passage that may not occur twice: some forty words of usual length.
REPEATED_BYTES = 256
#: Words of a passage that may not occur twice, however short they are.
REPEATED_WORDS = 51


def beside(docs: DataFrame, added: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``step``, also those that have the name of a column that the step adds."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in added}
    out = step(docs.withColumnsRenamed(own))
    return out.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is a half or more; all without any usable label.

    Null and empty texts are judged as texts without words, long ones whole; repeated rows alike; no rows give none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grades = labels.select("doc_id", graded(F.col("quality"), F.col("toxic")).alias("grade"))
    return beside(docs, ["expected_grade", "p_tail", "keep"], lambda d: score_quality(d, grades).where("keep"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    A row is judged by its own id and text, also where an id repeats with other texts. Rows without an id all stay; rows that repeat
    id and text are one document, of which any stays. Null, empty and blank texts are no copies of each other; long ones
    are compared whole; no rows give none."""
    # a row's key orders by id, those without one last; texts of one id are told apart by their hash
    key = F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    groups = similar_groups(docs.select(key.alias("key"), "text"), id="key", words=5, share=(80, 100))
    others = written(groups.where((F.col("key") != F.col("component_id")) & (F.col("key.none") == 0)).select("key").distinct(), "near-copies")
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    single = named.withColumn("__key", key).join(others.withColumnRenamed("key", "__key"), "__key", "left_anti")
    return single.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur elsewhere too; a document that loses everything goes.

    Every place of a passage loses it, also in repeated rows. Null and empty texts stay as they are. Where there is a
    column ``n_chars`` it follows the text. No rows give none."""

    def step(d: DataFrame) -> DataFrame:
        out = remove_repeats(d, length=REPEATED_BYTES, characters=True, words=REPEATED_WORDS)
        out = out.where((F.size("spans") == 0) | (F.octet_length("kept") > 0))
        out = out.withColumn("text", F.when(F.size("spans") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text")))
        if "n_chars" in d.columns:
            size = F.char_length("text").cast(d.schema["n_chars"].dataType)
            out = out.withColumn("n_chars", F.when(F.size("spans") > 0, size).otherwise(F.col("n_chars")))
        return out

    return beside(docs, ["spans", "kept", "shared"], step)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows the same; no rows give none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return beside(docs, ["matches"], lambda d: mark_contaminated(d, items).where(F.size("matches") == 0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences of 4096 tokens. A null or empty text is its end alone; repeated rows are packed each; no rows give none."""
    out = best_fit_pack(docs.select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

#: The classifier, the joins of near copies and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
