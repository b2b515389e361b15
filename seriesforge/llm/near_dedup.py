"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

A document is the set of its distinct word shingles. SuperMinHash gives every
shingle a random permutation of the signature's slots and offers it to them in
that order, rank by rank; a document stops as soon as no later rank can lower
any slot. Slots are cut into bands; documents that share a band meet in a
bucket. Sizes of bands follow from the threshold, so that a pair at the
threshold is missed with probability MISS at most.

Scale: equal sets collapse first, so a group of exact copies is one candidate.
Inside a bucket documents are compared with its most central member, never all
with all; confirmed links join components. Buckets that then still hold
several components are finished exactly: their documents are joined on the
rarest shingles of their sets (of two sets at the threshold, these prefixes
must meet), which skips passages that many documents share. Links are
confirmed on the full sets. No bucket, group, link or component list is
collected, in a task or on the driver. Hot keys (a very common shingle, bucket
or set) are split: their one row is broadcast, their number being bounded. The
partners of one document, on either side of a pair, are dealt to parts, and so
are the documents that meet on one rare shingle. Tables that only the
search needs are deleted when it ends.

Defined results: a null text counts as empty; a document without words is its
own group; a row without id stands in no link, but is dropped if its set is
that of another row; repeated rows with one id are one document, which each of
its texts may link; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import Scratch, looked_up, map_rows, mixed, shingle_hashes, staged, table, texts_of, word_hashes
from seriesforge.operators.graph import components

#: Slots to a band.
ROWS = 5
#: Most that the chance may be to overlook a pair at the threshold.
MISS = 1e-7
#: Shingles handled at once in a task.
AT_ONCE = 120_000
RANK = np.uint64(48)
#: Partners of one document, or documents of one shingle, that meet in one group.
PARTNERS = 500


def bands_for(percent: int, rows: int = ROWS) -> int:
    p = (percent / 100) ** rows
    return math.ceil(math.log(MISS) / math.log(1 - p))


def super_min_hash(elements: np.ndarray, owner: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures of ``docs`` sets at once; element i belongs to set owner[i].

    A slot's value is (rank << 48) + 48 random bits; the smallest stays.
    """
    out = np.full(docs * slots, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 48) - 1)
    order = None
    for rank in range(slots):
        x = mixed(elements + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = (rank + (x >> RANK) % np.uint64(slots - rank)).astype(np.int64)
        value = (x & low) | (np.uint64(rank) << RANK)
        if order is None:
            slot = k
        else:
            at = np.arange(len(k))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, rank]
        np.minimum.at(out, owner * slots + slot, value)
        open_sets = out.reshape(docs, slots).max(axis=1) >= np.uint64(rank + 1) << RANK
        live = open_sets[owner]
        left = int(live.sum())
        if not left:
            break
        if order is None:
            elements, owner, k = elements[live], owner[live], k[live]
            order = np.tile(np.arange(slots, dtype=np.uint16 if slots > 256 else np.uint8), (left, 1))
            order[np.arange(left), k] = 0
        elif left < 0.7 * len(live):
            elements, owner, order = elements[live], owner[live], order[live]
    return out.reshape(docs, slots)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower and bytes.split know ASCII only, as the rule asks."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), words))


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1)) * np.uint64(0xD6E8FEB86659FD93)
    cut = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        key = mixed(key + cut[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits), bands; the last two null for empty sets."""
    bands = bands_for(percent)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, words) for x in texts_of(b["text"])]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        best = np.full((len(sets), bands * ROWS), np.iinfo(np.uint64).max, np.uint64)
        # Long sets are cut: the slots of a set are the smallest of its parts'.
        parts = [(k, s[i : i + AT_ONCE]) for k, s in enumerate(sets) for i in range(0, len(s), AT_ONCE)]
        while parts:
            now, n = [], 0
            while parts and (not now or n + len(parts[-1][1]) <= AT_ONCE):
                now.append(parts.pop())
                n += len(now[-1][1])
            sig = super_min_hash(np.concatenate([x for _, x in now]), np.repeat(np.arange(len(now)), [len(x) for _, x in now]), len(now), bands * ROWS)
            for (k, _), row in zip(now, sig, strict=True):
                np.minimum(best[k], row, out=best[k])
        found = [row if len(s) else None for s, row in zip(sets, band_keys(best, bands, ROWS), strict=True)]
        return pa.RecordBatch.from_arrays(
            [b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_key", "bands"],
        )

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "text", batch, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def set_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set): the whole sets of the given ids, one row each."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b["id"], pa.array([shingle_set(x, words).tobytes() for x in texts_of(b["text"])], pa.binary())], ["id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return map_rows(texts, "text", batch, "id long, set binary")


def _beside(pairs: DataFrame, sets: DataFrame, key: str, other: str, held: Scratch) -> DataFrame:
    """``pairs`` with ``set_<key>``: the partners of one document are dealt to parts, and its set with them."""
    parts = held.put(pairs.groupBy(key).agg(F.count("*").alias("pairs")).withColumn("parts", F.ceil(F.col("pairs") / PARTNERS)))
    dealt = looked_up(pairs, parts, key, "pairs").withColumn("part", F.pmod(F.xxhash64(other), F.col("parts"))).drop("pairs", "parts")
    own = sets.select(F.col("id").alias(key), F.col("set").alias(f"set_{key}")).join(parts, key)
    return dealt.join(own.select(key, f"set_{key}", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), [key, "part"]).drop("part")


def linked(pairs: DataFrame, sets: DataFrame, percent: int, held: Scratch) -> DataFrame:
    """Those pairs (a, b) whose full sets meet the threshold."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b["set_a"].to_pylist(), b["set_b"].to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            n = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * n >= percent * (len(p) + len(q) - n))
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = held.put(pairs)  # counted for either side before it is joined
    joined = _beside(_beside(pairs, sets, "b", "a", held), sets, "a", "b", held)
    return map_rows(joined.select("a", "b", "set_a", "set_b"), "set_b", batch, "a long, b long")


def _fits(x: str, y: str, percent: int) -> F.Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Per bucket, its most central document with each other one outside its component."""
    weight = rows.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = rows.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n", "component")).alias("hub"), F.count("*").alias("rows"))
    pairs = looked_up(rows, staged(hubs), "bucket", "rows").where("component != hub.component")
    pairs = pairs.select("id", "n", (-F.col("hub.minus")).alias("hub_id"), F.col("hub.n").alias("hub_n"))
    return pairs.where(_fits("n", "hub_n", percent)).select(F.col("hub_id").alias("a"), F.col("id").alias("b")).distinct()


def prefix_pairs(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Every pair of different components that may reach the threshold: their rarest shingles meet.

    Shingles are put in one order for all sets: first those that a single
    component holds, then by rarity. Sets at the threshold share a shingle among
    the first n - threshold * n + 1 of each, and what follows their first common
    one must suffice for the overlap. Shingles of a single component join
    nothing, so only their number is kept.
    """

    def explode(b: pa.RecordBatch) -> pa.RecordBatch:
        held = [np.frombuffer(x, np.int64) for x in b["set"].to_pylist()]
        take = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
        return pa.RecordBatch.from_arrays([b["id"].take(take), b["component"].take(take), pa.array(np.concatenate([*held, np.zeros(0, np.int64)]))], ["id", "component", "shingle"])

    here = scratch.put(rows.select("id", "component", "n").distinct())
    held = map_rows(sets.join(here, "id").select("id", "component", "set"), "set", explode, "id long, component long, shingle long")
    often = held.groupBy("shingle").agg(F.count("*").alias("often"), F.min("component").alias("p"), F.max("component").alias("q")).where("p != q")
    shared = looked_up(held, scratch.put(often.select("shingle", "often")), "shingle", "often").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    first = shared.join(here, "id").select("id", "component", "n", alone.alias("alone"), F.slice("shared", F.lit(1), F.greatest(length, F.lit(0)).cast("int")).alias("shared"))
    first = first.select("id", "component", "n", "alone", F.posexplode("shared").alias("at", "x"))
    # ``left``: the most that this set can share from here on.
    first = scratch.put(first.select("id", "component", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), "x.shingle"))
    several = first.groupBy("shingle").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("rows")).where("p != q")
    first = scratch.put(looked_up(first, scratch.put(several.select("shingle", "rows")), "shingle", "rows").withColumn("parts", F.ceil(F.col("rows") / PARTNERS)))
    # One side is dealt to parts of a shingle, the other meets each of them.
    every = first.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    other = first.select(F.col("shingle").alias("shingle_b"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part_b"), F.col("id").alias("b"), F.col("component").alias("component_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    enough = (100 + percent) * F.least("left", "left_b") >= percent * (F.col("n") + F.col("n_b"))
    pairs = every.join(other, (F.col("shingle") == F.col("shingle_b")) & (F.col("part") == F.col("part_b")) & (F.col("component") < F.col("component_b")) & enough)
    return pairs.select(F.col("id").alias("a"), "b").distinct()


def mixed_rows(rows: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Rows of buckets that hold several components, with those components and the bucket's size."""
    if labels is not None:
        rows = rows.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = rows.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("size")).where("p != q")
    return looked_up(rows.drop("size"), scratch.put(several.select("bucket", "size")), "bucket", "size").select("bucket", "id", "n", "component", "size")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    signatures = staged(signed(docs, words, percent))
    classes = signatures.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x"), F.count("*").alias("rows"))
    rows = classes.select(F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), F.explode("x.bands").alias("bucket"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(mixed_rows(rows.withColumn("component", F.col("id")), None, scratch))
    labels = None
    if not rows.isEmpty():
        ids = rows.select("id").distinct()
        sets = scratch.put(set_table(docs, ids, words).distinct())
        links = scratch.put(linked(star_pairs(rows, percent), sets, percent, scratch))
        labels = components(links)
        rest = scratch.put(mixed_rows(rows, labels, scratch))
        if not rest.isEmpty():
            more = scratch.put(linked(prefix_pairs(rest, sets, percent, scratch), sets, percent, scratch))
            if not more.isEmpty():
                labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.select("set_key", F.col("x.doc_id").alias("id"), "rows")
    if labels is not None:
        named = named.join(labels, "id", "left").withColumn("id", F.coalesce("component", "id"))
    named = staged(named.select("set_key", F.col("id").alias("component_id"), "rows"))
    scratch.clear()
    out = signatures.select("doc_id", "n_shingles", "set_key")
    out = looked_up(out.where("set_key is not null"), named, "set_key", "rows", "left").drop("rows").unionByName(out.where("set_key is null").withColumn("component_id", F.lit(None).cast("long")))
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)
