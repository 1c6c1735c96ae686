"""A BM25 index that grows: immutable segments of postings, tombstones for what is erased, merges by size tiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalode.operators import bm25
from datalode.sources.keyed import KeyedTable, commit_state, newest_state

#: Segments of one tier that are merged into one of the next.
MERGED = 4
COUNTS = "tenant_id string, term string, df long"
SIZES = "tenant_id string, words long"
GONE = "segment string, tenant_id string, chunk_id long"
GONE_OF_BLOCKS = "segment string, block long, gone array<long>"


class PostingIndex:
    """Segments under a folder, named by manifests: what is appended, erased or merged is there when its manifest is.

    A segment has its postings, sorted by term, and its counts: documents of each term, chunks and words of each tenant. An erasure
    writes the chunks that go (``gone``, and by block ``blocks``) and their counts as a difference, from the segments that hold them; others
    are not read, and no posting is taken apart. Statistics are the sum of all counts less the differences. Which segment holds a chunk is kept in a
    keyed table of its own. A folder has one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.places = KeyedTable(spark, f"{self.root}/places", "tenant_id string, chunk_id long, segment string", ["tenant_id", "chunk_id"], buckets=buckets)

    def state(self) -> tuple[int, dict]:
        """Number of the newest manifest; its segments by name with their chunks, its erasures with their segments, and what merged segments became."""
        return newest_state(self.spark, self.root) or (0, {"segments": {}, "erasures": {}, "merged": {}})

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        paths = [f"{self.root}/{name}/{kind}" for name in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write_segment(self, postings: DataFrame) -> tuple[str, int]:
        """Writes postings and their counts as a new segment: its name and its chunks."""
        name = f"segment-{uuid.uuid4().hex}"
        postings.sortWithinPartitions("tenant_id", "term").write.parquet(f"{self.root}/{name}/postings")
        rows = self._read("postings", [name], bm25.POSTINGS)
        bm25.term_counts(rows).write.parquet(f"{self.root}/{name}/counts")
        bm25.chunk_words(rows).write.parquet(f"{self.root}/{name}/sizes")
        return name, rows.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def append(self, chunks: DataFrame, id: str = "chunk_id", text: str = "text", tenant: str = "tenant_id") -> None:
        """Adds chunks (tenant, id, text) that are not there; those that are stay as they are. Of new rows of a chunk the one of the smallest text counts."""
        rows = chunks.where(F.col(id).isNotNull()).select(F.coalesce(F.col(tenant).cast("string"), F.lit("")).alias("tenant_id"), F.col(id).cast("long").alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        rows = rows.groupBy("tenant_id", "chunk_id").agg(F.min("text").alias("text"))
        number, now = self.state()
        live = self._live_places(rows, now)
        name, size = self._write_segment(bm25.block_postings(rows.join(live, ["tenant_id", "chunk_id"], "left_anti"), tenant="tenant_id"))
        if not size:
            return
        held = self._read("postings", [name], bm25.POSTINGS).where("term = ''").select("tenant_id", F.explode("ids").alias("chunk_id"))
        self.places.upsert(held.withColumn("segment", F.lit(name)))
        commit_state(self.spark, self.root, number + 1, now | {"segments": now["segments"] | {name: size}})
        self._merge_full_tiers()

    def _live_places(self, rows: DataFrame, now: dict) -> DataFrame:
        """The asked chunks that are there, with their segment. A place of a commit that was lost counts for nothing; one of
        a merged segment is that of what it became."""
        found = self.places.matching(rows)
        if now["merged"]:
            became = F.create_map(*(F.lit(x) for kv in now["merged"].items() for x in kv))
            found = found.withColumn("segment", F.coalesce(F.try_element_at(became, F.col("segment")), F.col("segment")))
        return found.where(F.col("segment").isin(list(now["segments"])))

    def erase(self, asked: DataFrame) -> None:
        """Erases chunks (tenant_id, chunk_id); what is not there is passed over."""
        number, now = self.state()
        if not now["segments"]:
            return
        asked = asked.select(F.coalesce(F.col("tenant_id").cast("string"), F.lit("")).alias("tenant_id"), F.col("chunk_id").cast("long").alias("chunk_id")).distinct()
        name = f"erasure-{uuid.uuid4().hex}"
        found = self._live_places(asked, now)
        found.select("segment", "tenant_id", "chunk_id").write.parquet(f"{self.root}/{name}/gone")
        gone = self._read("gone", [name], GONE)
        touched = sorted(r[0] for r in gone.select("segment").distinct().collect())
        if not touched:
            return
        self._write_difference(name, touched)
        commit_state(self.spark, self.root, number + 1, now | {"erasures": now["erasures"] | {name: touched}})
        # places go last: a writer that is lost in between leaves chunks that do not come again, never ones that are there twice
        self.places.change(gone, lambda old: old.join(gone.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_anti"))

    def _live(self, name: str, erasures: list[str]) -> DataFrame:
        """Postings of a segment without what is gone. Those of blocks that lost nothing stay as they are."""
        rows = self._read("postings", [name], bm25.POSTINGS)
        if not erasures:
            return rows
        gone = self._read("blocks", erasures, GONE_OF_BLOCKS).where(F.col("segment") == name)
        gone = gone.groupBy("block").agg(F.flatten(F.collect_list("gone")).alias("gone"))
        each = F.arrays_zip("ids", "tfs", "lengths")
        left = F.when(F.arrays_overlap("ids", "gone"), F.filter(each, lambda e: ~F.array_contains("gone", e["ids"]))).otherwise(each)
        rows = rows.join(gone, "block", "left").select("tenant_id", "block", "term", left.alias("e"))
        return rows.where(F.size("e") > 0).select("tenant_id", "block", "term", F.size("e").alias("n"), *(F.col(f"e.{c}").alias(c) for c in ("ids", "tfs", "lengths")))

    def _merge_full_tiers(self) -> None:
        """Where MERGED segments have chunks of one order of size, they become one without what is gone; the rest is not read."""
        number, now = self.state()
        tiers: dict[int, list[str]] = {}
        for name, size in now["segments"].items():
            tiers.setdefault(max(size, 1).bit_length() // 2, []).append(name)
        for names in tiers.values():
            if len(names) >= MERGED:
                self._merge(sorted(names), number, now)
                return self._merge_full_tiers()
        return None

    def _merge(self, names: list[str], number: int, now: dict) -> None:
        touching = [e for e, touched in now["erasures"].items() if set(touched) & set(names)]
        # block numbers of unlike segments may be equal
        rows = [self._live(n, touching).withColumn("block", F.xxhash64(F.lit(n), "block")) for n in names]
        merged = rows[0]
        for r in rows[1:]:
            merged = merged.unionByName(r)
        name, size = self._write_segment(merged)
        became = {old: name if new in names else new for old, new in now["merged"].items()} | dict.fromkeys(names, name)
        segments = {n: s for n, s in now["segments"].items() if n not in names} | {name: size}
        erasures = {}
        for e, touched in now["erasures"].items():
            left = [t for t in touched if t not in names]
            if left == touched:
                erasures[e] = touched
            elif left:  # what is gone from the segments that stay is counted anew
                erasures |= self._split(e, left)
        commit_state(self.spark, self.root, number + 1, {"segments": segments, "erasures": erasures, "merged": became})

    def _split(self, erasure: str, segments: list[str]) -> dict[str, list[str]]:
        name = f"erasure-{uuid.uuid4().hex}"
        self._read("gone", [erasure], GONE).where(F.col("segment").isin(segments)).write.parquet(f"{self.root}/{name}/gone")
        self._write_difference(name, segments)
        return {name: segments}

    def _write_difference(self, erasure: str, segments: list[str]) -> None:
        """The counts of the chunks that an erasure takes from its segments. A chunk may have been in other segments before, which do not count."""
        gone = self._read("gone", [erasure], GONE)
        for i, segment in enumerate(segments):
            own = gone.where(F.col("segment") == segment).select("tenant_id", "chunk_id")
            mode = "append" if i else "errorifexists"
            postings = self._read("postings", [segment], bm25.POSTINGS)
            # the empty term has every chunk of a block
            all_chunks = postings.where("term = ''").select("tenant_id", "block", F.explode(F.arrays_zip("ids", "lengths")).alias("e"))
            hit = all_chunks.select("tenant_id", "block", F.col("e.ids").alias("chunk_id"), F.col("e.lengths").alias("length")).join(own, ["tenant_id", "chunk_id"], "left_semi")
            hit.groupBy("tenant_id").agg(F.sum("length").cast("long").alias("words")).write.mode(mode).parquet(f"{self.root}/{erasure}/sizes")
            blocks = hit.groupBy("block").agg(F.collect_list("chunk_id").alias("gone")).select(F.lit(segment).alias("segment"), "block", "gone")
            blocks.write.mode(mode).parquet(f"{self.root}/{erasure}/blocks")
            lost = self._read("blocks", [erasure], GONE_OF_BLOCKS).where(F.col("segment") == segment)
            less = postings.join(lost, "block").select("tenant_id", "term", F.size(F.array_intersect("ids", "gone")).alias("n")).where("n > 0")
            less.groupBy("tenant_id", "term").agg(F.sum("n").cast("long").alias("df")).write.mode(mode).parquet(f"{self.root}/{erasure}/counts")

    # -- reading ---------------------------------------------------------------------------------

    def counts(self, now: dict | None = None) -> DataFrame:
        """tenant_id, term and df over all segments; the empty term's df is the number of chunks."""
        now = now or self.state()[1]
        less = self._read("counts", list(now["erasures"]), COUNTS).withColumn("df", -F.col("df"))
        return self._read("counts", list(now["segments"]), COUNTS).unionByName(less).groupBy("tenant_id", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def sizes(self, now: dict | None = None) -> DataFrame:
        """tenant_id and the words of its chunks."""
        now = now or self.state()[1]
        less = self._read("sizes", list(now["erasures"]), SIZES).withColumn("words", -F.col("words"))
        return self._read("sizes", list(now["segments"]), SIZES).unionByName(less).groupBy("tenant_id").agg(F.sum("words").alias("words"))

    def postings(self, now: dict | None = None) -> DataFrame:
        """All postings without what is gone."""
        now = now or self.state()[1]
        out = self._read("postings", [], bm25.POSTINGS)
        for name in now["segments"]:
            erasures = [e for e, touched in now["erasures"].items() if name in touched]
            out = out.unionByName(self._live(name, erasures).withColumn("block", F.xxhash64(F.lit(name), "block")))
        return out

    def search(self, queries: DataFrame, k: int, tenant: str = "") -> DataFrame:
        """The k best chunks of a tenant for each query (query_id, text)."""
        now = self.state()[1]
        own = F.col("tenant_id") == tenant
        idf = bm25.frequencies(self.counts(now).where(own), self.sizes(now).where(own))
        return bm25.search(self.postings(now).where(own & (F.col("term") != "")), idf, queries, k)
