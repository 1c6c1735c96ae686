"""Tables of keyed rows in hash buckets: changes rewrite the buckets that they touch, a manifest says which files are the table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table. A bucket should hold some hundred MB: take the expected size by that.
BUCKETS = 64


def files(spark: SparkSession, root: str):
    """Hadoop's path class, and the file system of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def newest_state(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """Number and content of the newest manifest under a folder."""
    path, fs = files(spark, root)
    folder = path(f"{root}/manifests")
    if not fs.exists(folder):
        return None
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=None)
    if number is None:
        return None
    stream = fs.open(path(f"{root}/manifests/{number}.json"))
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_state(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Renames a manifest into place; fails if another writer has taken the number."""
    path, fs = files(spark, root)
    final, draft = path(f"{root}/manifests/{number}.json"), path(f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has committed state {number} of {root}")


@dataclass(frozen=True)
class Manifest:
    """One state of a table: its number, the folder of each bucket that has rows, and what the writer noted."""

    number: int
    buckets: dict[int, str]
    notes: dict


class KeyedTable:
    """A table whose rows lie by the hash of ``by`` (default: the keys) in a fixed number of buckets.

    A commit writes the touched buckets in a folder of its own, ``data/<number>-<random>/bucket=<b>``, and then renames a manifest into
    place; until then the table is as it was, so a job that is lost in between leaves files but changes nothing. Readers
    take the newest manifest and see that state also while a writer works. There is one writer at a time: a
    second one finds the number taken and fails. Old versions stay until ``vacuum``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, keys: Sequence[str], by: Sequence[str] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.by = list(by or keys)
        if not set(self.by) <= set(self.keys):
            raise ValueError("buckets are told by keys")
        now = self.manifest()
        self.buckets = now.notes["__buckets"] if now else buckets

    # -- files -----------------------------------------------------------------------------------

    def manifest(self) -> Manifest | None:
        """The newest manifest; null for a table that has none yet."""
        found = newest_state(self.spark, self.root)
        return Manifest(found[0], {int(b): v for b, v in found[1]["buckets"].items()}, found[1]["notes"]) if found else None

    def _commit(self, number: int, buckets: dict[int, str], notes: dict) -> Manifest:
        commit_state(self.spark, self.root, number, {"buckets": buckets, "notes": notes | {"__buckets": self.buckets}})
        return Manifest(number, buckets, notes)

    def vacuum(self) -> None:
        """Deletes versions that the newest manifest does not use. No reader of an older state may be at work."""
        now = self.manifest()
        path, fs = files(self.spark, self.root)
        folder = path(f"{self.root}/data")
        if now and fs.exists(folder):
            for version in fs.listStatus(folder):
                used = {f"bucket={b}" for b, v in now.buckets.items() if v == version.getPath().getName()}
                for bucket in fs.listStatus(version.getPath()):
                    if bucket.getPath().getName() not in used:
                        fs.delete(bucket.getPath(), True)

    # -- reading ---------------------------------------------------------------------------------

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _paths(self, now: Manifest | None, some: Sequence[int] | None = None) -> list[str]:
        held = now.buckets if now else {}
        return [f"{self.root}/data/{v}/bucket={b}" for b, v in sorted(held.items()) if some is None or b in some]

    def read(self, some: Sequence[int] | None = None, now: Manifest | None = None) -> DataFrame:
        """The rows, of some buckets only if they are given."""
        paths = self._paths(now or self.manifest(), None if some is None else set(some))
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def matching(self, asked: DataFrame) -> DataFrame:
        """The rows whose ``by`` columns occur in a table, from its buckets only."""
        return self.read(self._touched(asked)).join(asked.select(*self.by).distinct(), self.by, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # no more than there are buckets

    # -- changes ---------------------------------------------------------------------------------

    def _change(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], notes: dict | None) -> Manifest:
        """Replaces the buckets that ``rows`` touch by what ``merge`` makes of their old rows."""
        now = self.manifest()
        number = now.number + 1 if now else 1
        held, kept = dict(now.buckets) if now else {}, {k: v for k, v in now.notes.items() if k != "__buckets"} if now else {}
        touched = self._touched(rows)
        if touched:
            new = merge(self.read(touched, now) if now else self.spark.createDataFrame([], self.schema))
            # as many tasks as buckets are touched; each writes whole buckets
            dealt = new.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket")
            folder = f"{number}-{uuid.uuid4().hex}"
            dealt.write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
            path, fs = files(self.spark, self.root)
            written = {s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/data/{folder}"))}
            for b in touched:
                held.pop(b, None)
                if f"bucket={b}" in written:
                    held[b] = folder
        return self._commit(number, held, kept | (notes or {}))

    def _one_per_key(self, rows: DataFrame, order: Column) -> DataFrame:
        rest = [f.name for f in self.schema if f.name not in self.keys]
        if not rest:
            return rows.select(*self.keys).distinct()
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("__e"))
        return best.select(*self.keys, "__e.*").select(*self.schema.names)

    def upsert(self, rows: DataFrame, order: Sequence[str] = (), notes: dict | None = None) -> Manifest:
        """New rows replace old ones of their key. With ``order``, columns of the table, the highest row of a key stays, old or new; of
        equal ones, and without an order, a new one: then of several new rows of a key the largest by all columns."""
        rows = rows.select(*self.schema.names)
        rest = [f.name for f in self.schema if f.name not in self.keys and f.name not in order]
        both = lambda old: old.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
        place = F.struct(*order, F.col("__new"), *rest)
        return self._change(rows, lambda old: self._one_per_key(both(old), place), notes)

    def append(self, rows: DataFrame, order: Sequence[str], notes: dict | None = None) -> Manifest:
        """Old rows stay as they are; of new rows of a key that is not there the first by ``order`` is added."""
        rows = rows.select(*self.schema.names)
        rest = [f.name for f in self.schema if f.name not in self.keys]
        first = rows.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__e")).select(*self.keys, "__e.*") if rest else rows.distinct()
        return self._change(rows, lambda old: old.unionByName(first.join(old.select(*self.keys), self.keys, "left_anti")), notes)

    def erase(self, asked: DataFrame, notes: dict | None = None) -> Manifest:
        """Removes all rows whose ``by`` columns (the keys, if not told otherwise) occur in ``asked``."""
        asked = asked.select(*self.by).distinct()
        return self._change(asked, lambda old: old.join(asked, self.by, "left_anti"), notes)

    def change(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], notes: dict | None = None) -> Manifest:
        """Replaces the touched buckets by what a function makes of their old rows, which must keep the schema."""
        return self._change(rows, lambda old: merge(old).select(*self.schema.names), notes)
