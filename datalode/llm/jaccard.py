"""Exact similarity join of texts by word shingles, with token-combination prefixes.

Tokens (hashed shingles) are classed by how often they occur in the corpus: once, seldom, often. Seldom
tokens come first in the common order. A text may lack ``missing`` of its tokens and still be similar, so
its prefix is cut where it is worth ``missing + 1``: a seldom token is worth one, of the often ones each
after the first in its class of neighbouring hashes. Seldom tokens of the prefix are indexed alone, often
ones as pairs within their class, so a passage that many texts share makes no candidates by itself. Two
similar texts share an indexed entry. Candidates are verified on their whole sets. Only tokens of some hashes
are counted (a few times as many as a prefix holds); the others come last in the order, as often ones do.

Texts with equal sets are one node. Each node is first compared with one hub (of an entry's nodes the
one with the smallest share of tokens that no other text has); after that only entries with nodes of different
components are left, so large groups of copies cost one comparison per copy. Links between nodes of one component
could not change the result.

What is left of an entry's nodes is dealt out by size, since similar sets have similar sizes: small groups, whose members are compared with each other, and
families of texts that are all near a hub of their size but not near enough. Their tokens tell nothing, as all
have most of them; what tells them apart is where they differ from the hub. Each is compared with its hub once
and stands for the set of its differences: A and B differ in exactly those that only one of them has. Of two
similar ones that no component holds yet at least one is not similar to the hub, so they have differences in
common, and enough of them for a prefix over the rarest: the prefixes of the one with fewer differences are
joined with all differences of the other. A pair's number of common differences decides it exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalode.llm.blocks import Exchange, block, blocks_of, planes, values_of
from datalode.llm.common import chunks_of, mix, prepare, run_hashes, word_hashes, written
from datalode.llm.components import components

#: Occurrences in the corpus beyond which a token is frequent.
OFTEN = 16
#: Bits of a token's hash that its count is kept by.
BITS = 44
#: Bits of a token that one level of lists splits by.
SPLIT = 7
#: Tokens that are counted, as a multiple of those that a similar text may lack.
COUNTED = 4
#: Frequent tokens in a class, about.
CLASS_TOKENS = 4
#: Members of a hub that one group compares with it.
FAN = 1000

_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of a chunk."""
    _, rows, hashes = word_hashes(data, offsets)
    h, r, _ = run_hashes(hashes, rows, words)
    return h, r


def _table_shingles(table: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the shingles of a block, by row."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, _, data, offsets in chunks_of(table.column("text")):
        h, r = shingles(data, offsets, words)
        hashes.append(h)
        rows.append(r + first)
    return np.concatenate(hashes), np.concatenate(rows)


def counted(hashes: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which tokens are counted in the corpus. The lowest bits choose, which ``BITS`` leaves out."""
    num, den = share
    return (hashes & np.uint64(255)) < np.uint64(min(256, -(-256 * COUNTED * (den - num) // den)))


def _send(words: int, share: tuple[int, int], exchange: Exchange):
    """What each block says of its tokens to each range."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, _ = _table_shingles(table, words)
        return exchange.rows(key[0].as_py(), {"tokens": np.unique(h[counted(h, share)] >> np.uint64(64 - BITS), return_counts=True)})

    return run


def _answer(exchange: Exchange, often: int):
    """For each list: 0 for tokens that occur once, 1 for seldom ones, 2 for frequent ones."""

    def run(table: pa.Table) -> pa.Table:
        _, total, place, ends = exchange.joined(table, "tokens")
        kind = np.where(total > often, 2, np.where(total > 1, 1, 0)).astype(np.uint64)[place]
        return pa.table({"part": table.column("part"), "source": table.column("source"), "tokens_values": pa.array([planes(x) for x in np.split(kind, ends)], pa.binary())})

    return run


def entries(tokens: np.ndarray, kind: np.ndarray, missing: int, least: int, most: int) -> np.ndarray:
    """What a text of the sorted ``tokens`` is indexed under; similar texts have ``least`` to ``most`` tokens.

    No other text has the tokens that occur once: with more than ``missing`` of them nothing is similar.
    Where only an equal set would be similar there is nothing to index: equal sets are one node."""
    if not missing and most == len(tokens) or np.count_nonzero(kind == 0) > missing:
        return tokens[:0]
    rare = kind < 2
    alone, need = tokens[rare], missing + 1
    if len(alone) >= need:
        return alone[:need][kind[rare][:need] == 1]
    out = [alone[kind[rare] == 1]]
    often, need = tokens[~rare], need - len(alone)
    for size in range(least.bit_length(), most.bit_length() + 1):
        classes = np.uint64(max(1, (1 << (size - 1)) // CLASS_TOKENS))
        of = ((often >> np.uint64(32)) * classes) >> np.uint64(32)
        new = np.append(True, of[1:] != of[:-1])
        worth = np.cumsum(~new)
        cut = int(np.searchsorted(worth, need)) + 1
        f, first = often[:cut], np.append(np.flatnonzero(new[:cut]), min(cut, len(often)))
        with np.errstate(over="ignore"):
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    out.append(mix(f[a:b][i] * _A + f[a:b][j] * _B + np.uint64(size) * _C))
    return np.concatenate(out)


def _index(words: int, share: tuple[int, int]):
    """Set size, node and entries of each text of a block; the text stays with those that have entries."""
    num, den = share

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        h, r = _table_shingles(docs, words)
        known = counted(h, share)
        _, place = np.unique(h[known] >> np.uint64(64 - BITS), return_inverse=True)
        kind = np.full(len(h), 2, np.uint8)
        kind[known] = values_of(told.sort_by("part"), "tokens").astype(np.uint8)[place]
        at = np.searchsorted(r, np.arange(docs.num_rows + 1))
        sizes, alone, nodes, index = [], [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            tokens, first = np.unique(h[a:b], return_index=True)
            n = len(tokens)
            missing = (den - num) * n // den
            own = kind[a:b][first]
            found = entries(tokens, own, missing, -(-num * n // den), den * n // num)
            sizes.append(n)
            alone.append(int(np.count_nonzero(own == 0)))
            nodes.append(hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest() if n else None)
            index.append(found.view(np.int64) if len(found) else None)
        texts = pa.array([t if e is not None else None for t, e in zip(docs.column("text").to_pylist(), index, strict=True)], pa.string())
        held = {"n": pa.array(sizes, pa.int64()), "alone": pa.array(alone, pa.int64()), "node": pa.array(nodes, pa.binary()), "entries": pa.array(index, pa.list_(pa.int64()))}
        return pa.table({"id": docs.column("id"), "text": texts, **held})

    return run


def _compare(words: int, share: tuple[int, int], differ: bool):
    """Rows come by group, the hub's text first; gives the members that are similar to it.

    With ``differ`` it gives all members, with both sizes and the tokens that only the hub or only the member has."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, np.zeros(0, np.uint64)
        for b in batches:
            hubs, salts, nodes = (b.column(i).to_pylist() for i in range(3))
            sets: list[np.ndarray] = []
            for _, _, data, offsets in chunks_of(b.column(3)):
                h, r = shingles(data, offsets, words)
                cuts = np.searchsorted(r, np.arange(len(offsets)))
                sets += [np.unique(h[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            out = []
            for hub, salt, node, s in zip(hubs, salts, nodes, sets, strict=True):
                if node is None:
                    group, own = (hub, salt), s
                elif (hub, salt) == group:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    same = den * both >= num * (len(own) + len(s) - both)
                    if differ:
                        out.append((hub, node, same, len(own), len(s), np.setxor1d(own, s, assume_unique=True).view(np.int64)))
                    elif same:
                        out.append((hub, node))
            kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))[: 6 if differ else 2]
            columns = zip(*out, strict=True) if out else ((),) * len(kinds)
            names = ["a", "b", "same", "hub_n", "n", "differences"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int, share: tuple[int, int], differ: bool = False) -> DataFrame:
    """Those pairs (a, b) whose texts (by node) are similar; with ``differ`` all, with ``same``, sizes and differences.

    Large groups of one ``a`` are split."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = written(pairs, "pairs")  # all joins with texts are merge joins, so that plans are alike at every size
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"))
    members = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), "fans").cast("int").alias("salt"), F.col("b").alias("node"))
    hubs = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.col("a").alias("node"))
    asked = members.withColumn("hub", F.lit(False)).unionByName(hubs.withColumn("hub", F.lit(True)))  # one join, so that texts are shuffled once
    rows = asked.join(texts.hint("merge"), "node").select("a", "salt", F.when(~F.col("hub"), F.col("node")).alias("node"), "text")
    rows = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("node").asc_nulls_first())
    columns = "a binary, b binary" + ", same boolean, hub_n long, n long, differences array<long>" * differ
    return rows.mapInArrow(_compare(words, share, differ), columns)


#: Members of a group up to which each is compared with each.
FEW = 8


def by_size(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Members (hub ``a``, ``n``) with each ``class`` of sizes that they belong to; similar ones have one in common.

    A class spans a little more than the ratio of the sizes of similar sets; each set is in its own and in the next."""
    num, den = share
    own = F.floor(F.log("n") / (1.0001 * max(math.log(den / num), 1e-6)))
    return members.withColumn("class", F.explode(F.array(own, own + 1)))


def few_pairs(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of members of the same small group (hub ``a``, ``class``, member ``b``, ``label``, ``n``, ``alone``) that may be similar."""
    num, den = share
    other = members.select("a", "class", *(F.col(c).alias(f"{c}2") for c in ("b", "label", "n", "alone")))
    # tokens that no other text has are not in common
    most = F.least(F.col("n") - F.col("alone"), F.col("n2") - F.col("alone2"))
    maybe = (F.col("b") < F.col("b2")) & (F.col("label") != F.col("label2")) & ((den + num) * most >= num * (F.col("n") + F.col("n2")))
    return members.join(other, ["a", "class"]).where(maybe).select(F.col("b").alias("a"), F.col("b2").alias("b")).distinct()


#: Words of 64 bits that hold the parity of a set of differences.
PARITY = 4


def close_members(compared: DataFrame, labels: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of similar members of a hub that have different labels, by their differences from the hub.

    ``compared``: hub ``a``, member ``b``, ``same`` (similar), ``hub_n``, ``n`` and ``differences``. With s = den + num
    and d = den - num, members x and y are similar if 2 * s * common >= s * (|x| + |y|) - d * (x.n + y.n).
    """
    num, den = share
    s, d = den + num, den - num
    held = compared.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    mixed = held.groupBy("a").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("a")
    held = written(held.join(mixed, "a", "left_semi").withColumn("size", F.size("differences").cast("long")), "differences-mixed")
    each = held.select("a", "b", F.explode("differences").alias("token"))
    often = each.groupBy("a", "token").agg(F.count("*").alias("c")).where("c > 1")
    some = F.lit(None).cast("long")
    parity = [F.bit_xor(F.when(F.col("token").bitwiseAND(F.lit(PARITY - 1)) == i, F.expr("shiftleft(1L, cast(shiftright(token, 2) & 63 as int))")).otherwise(F.lit(0))).alias(f"p{i}") for i in range(PARITY)]
    own = each.join(often, ["a", "token"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("own"), *parity)
    # what a partner with as many differences or more adds to 2 * s * common at least
    size, n, hub_n = F.col("size"), F.col("n"), F.col("hub_n")
    partner = F.greatest(2 * num * size - d * hub_n, s * size - d * F.floor(n * den / num), F.when(F.col("same"), d * hub_n + 1).otherwise(some))
    least = F.greatest(F.ceil((s * size - d * n + partner) / (2 * s)), F.lit(1))
    columns = ["a", "b", "label", "size", "n", *(f"p{i}" for i in range(PARITY))]
    own = held.drop("differences").join(own, ["a", "b"]).select(*columns, "own", F.size("own").alias("k"), (F.size("own") - least + 1).alias("prefix"))
    own = written(own, "differences-shared")
    rows = own.select(*columns, "k", "prefix", F.posexplode("own").alias("at", "x")).withColumn("token", F.col("x.token")).drop("x")
    first = rows.where("at < prefix").drop("prefix")
    other = rows.drop("prefix").select("a", "token", *(F.col(c).alias(f"{c}2") for c in rows.columns if c not in ("a", "token", "prefix")))
    fewer = (F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("b") < F.col("b2")))
    need = s * (F.col("size") + F.col("size2")) - d * (F.col("n") + F.col("n2"))  # of 2 * s * common
    most = F.least("at", "at2") + 1 + F.least(F.col("k") - F.col("at") - 1, F.col("k2") - F.col("at2") - 1)
    odd = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}2"))) for i in range(1, PARITY)), F.bit_count(F.col("p0").bitwiseXOR(F.col("p02"))))
    maybe = fewer & (F.col("label") != F.col("label2")) & (2 * s * most >= need) & (s * (F.col("k") + F.col("k2") - odd) >= need)
    pairs = written(first.join(other, ["a", "token"]).where(maybe).select("a", "b", "b2").distinct(), "pairs-of-members")
    sets = own.select("a", "b", "size", "n", F.transform("own", lambda x: x["token"]).alias("tokens"))
    pairs = pairs.join(sets.hint("merge"), ["a", "b"]).join(sets.select("a", *(F.col(c).alias(f"{c}2") for c in sets.columns[1:])).hint("merge"), ["a", "b2"])
    pairs = pairs.where(2 * s * F.size(F.array_intersect("tokens", "tokens2")) >= need)
    return pairs.select(F.col("b").alias("a"), F.col("b2").alias("b")).distinct()


def first_of(node: str) -> Column:
    """The hub of a group: the smallest share of tokens that only it has, so that copies with edits link to their original."""
    return F.min_by(node, F.struct(F.col("alone") / F.col("n"), F.col(node)))


def similar_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (80, 100), often: int = OFTEN
) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``node`` (its set's hash).

    Two documents are linked when share[1] * common >= share[0] * all different shingles of ``words`` words
    (A-Z as a-z, split at ASCII white space). A text of fewer words is one shingle. A null, empty or blank
    text has none, is linked with nothing and its own component. ``component_id`` is the smallest id that
    links reach; null ids count as larger than all others. Repeated rows are linked with each other.
    Long texts are compared whole; an empty table gives no rows; columns of other names are not used.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    count = blocks_of(docs, "text")
    docs = docs.withColumn("block", block(count, "id", "text"))
    exchange = Exchange(("tokens",), (BITS,), Exchange.levels_of(count, SPLIT), counts=True, split=SPLIT)
    sent = docs.groupBy("block").applyInArrow(_send(words, share, exchange), exchange.schema)
    told = exchange.told(sent, lambda rows: rows.groupBy("part").applyInArrow(_answer(exchange, often), exchange.answers)).withColumnRenamed("source", "block")
    columns = T.StructType([docs.schema["id"], *T.StructType.fromDDL("text string, n long, alone long, node binary, entries array<long>")])
    sets = written(docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_index(words, share), columns), "sets")

    nodes = sets.where("entries is not null").groupBy("node").agg(F.min(F.struct("id", "n", "alone", "entries")).alias("s"))
    index = nodes.select("node", "s.n", "s.alone", F.explode(F.array_distinct("s.entries")).alias("entry"))
    shared = index.groupBy("entry").agg(F.count("*").alias("c"), first_of("node").alias("hub")).where("c > 1")
    index = written(index.join(shared.select("entry", "hub").hint("merge"), "entry"), "index")
    # one text per node that shares an entry
    asked = index.select("node").distinct()
    texts = sets.where("entries is not null").join(asked.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "text")).alias("s"))
    texts = written(texts.select("node", "s.text"), "texts")

    links = None
    labels = None
    for _ in range(2):
        seen = _labelled(index, labels)
        tries = seen.where("hub_label != label").groupBy("node", "hub").agg(F.count("*").alias("c"))
        best = tries.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("m")).select(F.col("m.hub").alias("a"), F.col("node").alias("b"))
        found = written(verified(best, texts, words, share), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    seen = _labelled(index, labels)
    mixed = seen.groupBy("entry").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("entry")
    left = seen.join(mixed, "entry", "left_semi").select(F.col("hub").alias("a"), F.col("node").alias("b"), "label", "n", "alone")
    left = written(by_size(left.distinct(), share), "members")  # a hub is a member of its own group
    groups = left.groupBy("a", "class").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y"), first_of("b").alias("hub"))
    groups = written(groups.where("x != y").select("a", "class", "c", "hub"), "groups")
    few = left.join(groups.where(F.col("c") <= FEW).select("a", "class"), ["a", "class"], "left_semi")
    many = left.join(groups.where(F.col("c") > FEW).select("a", "class", "hub"), ["a", "class"])
    many = many.where("hub != b").select(F.col("hub").alias("a"), "b").distinct()
    compared = written(verified(many, texts, words, share, differ=True), "differences")
    found = written(verified(few_pairs(few, share), texts, words, share), "links")
    links = links.unionByName(found).unionByName(compared.where("same").select("a", "b"))
    close = written(close_members(compared, components(links), share), "links")
    labels = components(links.unionByName(close))

    out = sets.select("id", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = out.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    out = out.join(least, "label", "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "node")


def _labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The index with the components of nodes and hubs so far."""
    if labels is None:
        return index.withColumns({"label": F.col("node"), "hub_label": F.col("hub")})
    index = index.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    hubs = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    return index.join(hubs, "hub", "left").withColumn("hub_label", F.coalesce("hub_label", "hub"))
