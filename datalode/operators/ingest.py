"""Uploads, stores and duplicates: gates and keyed snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalode.functions import text as X

#: Accepted file endings and the largest upload (fixed values).
ENDINGS = ("pdf", "docx", "pptx", "xlsx", "txt", "md", "csv")
MOST_BYTES = 50 * 1024 * 1024
THEMES = ("corporate_dark", "modern_light", "startup_minimal", "healthcare_clinical", "financial_formal")


def gate(files: DataFrame, most: int = MOST_BYTES, endings: Sequence[str] = ENDINGS) -> DataFrame:
    """Adds safe_name, size_mb, doc_hash and reject_reason (null: accepted) to uploads.

    ``files`` has filename, content and tenant_id; checks run in the order empty, too_large, unsupported."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    ending = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(size == 0, "empty").when(size > most, "too_large").when(~ending.isin(*endings), "unsupported")
    return files.withColumns(
        {
            "safe_name": X.safe_filename(F.col("filename")),
            "size_mb": F.round(size / 1048576.0, 3),
            "doc_hash": X.tenant_hash(F.col("tenant_id"), F.col("content")),
            "reject_reason": reason,
        }
    )


def split_gate(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined ones of a gated table."""
    return files.where("reject_reason is null"), files.where("reject_reason is not null")


def request_violations(prompt: Column, theme: Column) -> Column:
    """Names of the rules that a request breaks."""
    return F.array_compact(
        F.array(
            F.when(F.length(prompt) < 10, F.lit("prompt_too_short")),
            F.when(F.length(prompt) > 2000, F.lit("prompt_too_long")),
            F.when(~theme.isin(*THEMES), F.lit("theme_invalid")),
        )
    )


def marked_duplicates(docs: DataFrame, key: str, first: str, flag: str, id: str = "doc_id") -> DataFrame:
    """The smallest id of each key, and whether a row is another one. Keys are pre-aggregated, rows not sorted."""
    least = docs.groupBy(key).agg(F.min(id).alias(first))
    return docs.join(least, key).withColumn(flag, F.col(id) != F.col(first))


def not_stored(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of which no key is stored yet."""
    for k in keys:
        new = new.join(stored.select(k).distinct(), k, "left_anti")
    return new


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """A snapshot in which new rows replace old ones of the same key; of several new rows of a key the highest by ``order``, then by all columns.

    For stores that are too large to be written anew see ``sources.keyed.KeyedTable``."""
    rest = [c for c in new.columns if c not in keys]
    place = F.struct(*order, *(c for c in rest if c not in order))
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("__e")).select(*keys, "__e.*").select(*new.columns) if rest else new.distinct()
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def appended(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A snapshot in which old rows win, and of new rows of a key the first."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__e")).select(*keys, "__e.*")
    return old.unionByName(first.join(old.select(*keys), list(keys), "left_anti"))


def erased(rows: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that no erasure request names."""
    return rows.join(asked.select(*keys).distinct(), list(keys), "left_anti")


def erased_everywhere(stores: Mapping[str, DataFrame], documents: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """Every store without the documents that requests (doc_id, tenant_id) name; only a document's own tenant may ask."""
    own = documents.join(asked.select("doc_id", "tenant_id").distinct(), ["doc_id", "tenant_id"], "left_semi")
    return {name: erased(rows, own, ["doc_id"]) for name, rows in stores.items()}


def latest(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """For each key the last value (``value_``) and its time (``at_``)."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value_"), F.max(order[0]).alias("at_"))


def newest(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n last rows."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def profile_of(rows: DataFrame, profiles: DataFrame, default: str, tag: str = "tag") -> DataFrame:
    """Adds ``profile``: the exact tag if listed, else its first part, else the default. Profiles are few."""
    listed = F.broadcast(profiles.select(F.col("tag").alias("__t"), F.col("tag").alias("__exact")))
    short = F.broadcast(profiles.select(F.col("tag").alias("__s"), F.col("tag").alias("__short")))
    out = rows.join(listed, F.col(tag) == F.col("__t"), "left").join(short, F.split_part(F.col(tag), F.lit("-"), F.lit(1)) == F.col("__s"), "left")
    return out.withColumn("profile", F.coalesce("__exact", "__short", F.lit(default))).drop("__t", "__s", "__exact", "__short")
