"""Packing of documents into fixed-length sequences by cutting-stock column generation.

Every document is tokenised once; its full 2048-token pieces are sequences of
their own and the remainder is an item to pack. Item lengths are counted in
classes of GRAIN tokens (a histogram of at most 256 numbers, whatever the input).
A linear program over packing patterns covers that histogram; new patterns come
from an unbounded-knapsack dynamic program over its dual prices. Patterns are
rounded down, the rest is filled largest first, and documents, ranked inside
their class, take the places of the patterns.

Only the histogram reaches the driver and only the pattern table (bounded by
the classes) is broadcast. Ranks come from windows over hash buckets of bounded
size plus prefix sums of bucket counts by groups of buckets, so no class, however
large, meets in one task. Tokens are counted once and staged; a lost executor repeats little.

Defined results: a null text counts as empty and yields the end id alone; null
and equal ids are packed like other rows, ties among them in any order; an empty table
gives an empty result; further columns,
whatever their names, are ignored. Items never share tokens
and every token lies in exactly one piece.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesforge.llm.common import map_rows, staged, table

LENGTH = 2048
END_ID = 1
#: Tokens to a class of lengths.
GRAIN = 8
#: Rows to a ranking bucket, about.
BUCKET_ROWS = 20_000
#: Groups of buckets whose sums are added up first.
GROUPS = 512
#: The program counts as solved this near to its bound, or after so many rounds of pricing.
GAP = 5e-4
MOST_ROUNDS = 30
MOST_COLUMNS = 2_500
#: Parts of words that a worker remembers, those met last.
CACHE_PARTS = 150_000
#: Bytes of text tokenised at once in a task.
TEXT_BYTES = 8 << 20
#: Small letters that no normaliser changes, and ASCII marks but the apostrophe.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u012f\u0131-\u017f"
MARKS = r"!-&(-/:-@\[-`{-~"
#: Parts of a word that the vocabulary's splitter keeps apart: letters, single digits, marks. An apostrophe may begin
#: a part with letters, and other characters may be composed anew, so words with them go through the whole tokenizer.
PARTS = re.compile(rf"[{LETTERS}]+|[0-9]|[{MARKS}]+")

#: Byte-level models write bytes that print as themselves and the others, in order, from 256 on; the space stays as it separates.
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)) if b != 32}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def part_tokenizer(path: str):
    """The vocabulary's model over parts between single spaces, and which ids end a part."""
    from tokenizers import pre_tokenizers

    t = type(tokenizer(path)).from_file(path)
    t.normalizer = None
    t.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    ends = np.zeros(t.get_vocab_size(), bool)
    ends[[i for x, i in t.get_vocab().items() if x.endswith("</w>")]] = True
    return t, ends


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Rows:
    """Rows of numbers, each of its own length, one after the other."""

    def __init__(self, values: np.ndarray, size: np.ndarray) -> None:
        self.values, self.size, self.first = values, size, np.cumsum(size) - size

    def take(self, at: np.ndarray) -> Rows:
        size = self.size[at]
        begin = self.first[at] - np.cumsum(size) + size
        return Rows(self.values[np.repeat(begin, size) + np.arange(size.sum())], size)

    def then(self, other: Rows) -> Rows:
        return Rows(np.r_[self.values, other.values], np.r_[self.size, other.size])


def rows_of(lists: list[list[int]]) -> Rows:
    return Rows(np.array([x for row in lists for x in row], "<u4"), np.array([len(row) for row in lists], np.int64))


_known: dict[str, tuple[pa.Array, Rows]] = {}


def part_ids(parts: pa.Array, path: str) -> Rows:
    """The ids of distinct parts, none for an empty one: remembered ones, and all new ones encoded at once, where ids that end a part tell them apart."""
    words, rows = _known.get(path, (pa.array([""], parts.type), rows_of([[]])))
    place = pc.fill_null(pc.index_in(parts, value_set=words), -1).to_numpy().astype(np.int64)
    missing = np.flatnonzero(place < 0)
    missing = missing[np.argsort(~pc.string_is_ascii(parts.take(pa.array(missing))).to_numpy(zero_copy_only=False), kind="stable")]
    new = parts.take(pa.array(missing))
    if len(new):
        t, ends = part_tokenizer(path)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, len(new), 1000), len(new)], pa.int32()), new.cast(pa.string())), " ").to_pylist()
        lines = [x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_CHARACTERS) for x in lines]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in t.encode_batch_fast(lines, add_special_tokens=False)])
        rows = rows.then(Rows(ids, np.diff(np.flatnonzero(ends[ids]), prepend=-1)))
    place[missing] = len(words) + np.arange(len(new))
    # Remembered next: the empty part, those of now, those before them.
    used = np.zeros(len(words), bool)
    used[0] = used[place[place < len(words)]] = True
    now = np.flatnonzero(place)
    kept = np.r_[0, place[now], np.flatnonzero(~used)][: max(CACHE_PARTS, len(now) + 1)]
    _known[path] = pa.concat_arrays([words, new]).take(pa.array(kept)), rows.take(kept)
    return rows.take(place)


def word_ids(words: pa.Array, path: str) -> Rows:
    """The ids of distinct words of text in small ASCII letters; no part of a word crosses white space."""
    plain = pc.match_substring_regex(words, f"^[{LETTERS}]+[{MARKS}]*$")
    simple = words.filter(plain)
    core = pc.replace_substring_regex(simple, f"[{MARKS}]+$", "")
    tail = pc.replace_substring_regex(simple, f"^[{LETTERS}]+", "")
    others = words.filter(pc.invert(plain)).to_pylist()
    split = [PARTS.findall(low) if sum(map(len, PARTS.findall(low := w.lower()))) == len(low) else None for w in others]
    whole = [w for w, parts in zip(others, split, strict=True) if parts is None]
    more = pa.array([p for parts in split if parts for p in parts], words.type)
    coded = pa.concat_arrays([core, tail, more]).dictionary_encode()
    ids = part_ids(coded.dictionary, path).then(rows_of([e.ids for e in tokenizer(path).encode_batch_fast(whole, add_special_tokens=False)]))
    # Each word as the parts it is made of: words that were encoded whole follow the parts.
    code = coded.indices.to_numpy().astype(np.int64)
    n, is_plain = len(simple), plain.to_numpy(zero_copy_only=False)
    size = np.empty(len(words), np.int64)
    size[is_plain] = 2
    size[~is_plain] = [1 if parts is None else len(parts) for parts in split]
    made = np.empty(size.sum(), np.int64)
    own = np.repeat(is_plain, size)
    made[own] = np.stack([code[:n], code[n : 2 * n]], axis=1).ravel()
    at = np.repeat([parts is None for parts in split], size[~is_plain]) if split else np.zeros(0, bool)
    rest = np.empty(len(at), np.int64)
    rest[at] = len(coded.dictionary) + np.arange(len(whole))
    rest[~at] = code[2 * n :]
    made[~own] = rest
    parts = ids.take(made)
    return Rows(parts.values, np.diff(np.r_[0, np.cumsum(parts.size)][np.r_[0, np.cumsum(size)]]))


def text_ids(column: pa.Array, path: str) -> Rows:
    """The ids of each text, without the end id.

    This vocabulary lower-cases, drops white space and never joins across it, so the distinct words of
    the texts are encoded once and their ids dealt to all places.
    """
    texts = pc.fill_null(column, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy()
    coded = pc.ascii_lower(split.values).dictionary_encode()  # of whole arrays: this function goes wrong on slices
    ids = word_ids(coded.dictionary, path).take(coded.indices.to_numpy())
    ends = np.r_[0, np.cumsum(ids.size)][bounds]
    rows = Rows(ids.values, np.diff(ends))
    # Special tokens are matched before case is folded: such texts go through the whole tokenizer.
    own = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
    if len(own):
        n = len(rows.size)
        rows = rows.then(rows_of([tokenizer(path).encode(texts[i].as_py(), add_special_tokens=False).ids for i in own.tolist()]))
        at = np.arange(n)
        at[own] = n + np.arange(len(own))
        rows = rows.take(at)
    return rows


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, doc_tokens, and the crc32 of each 2048-token piece and the remainder."""
    path = path or vocabulary()
    end = np.array([END_ID], "<u4").tobytes()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = text_ids(b["text"], path)
        held, crcs = memoryview(rows.values.tobytes()), []
        for first, size in zip(rows.first.tolist(), rows.size.tolist(), strict=True):
            cuts = [zlib.crc32(held[4 * (first + i) : 4 * (first + min(i + LENGTH, size))]) for i in range(0, size + 1, LENGTH)]
            crcs.append([*cuts[:-1], zlib.crc32(end, cuts[-1])])
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows.size + 1, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "text", batch, "doc_id long, doc_tokens long, crcs array<long>", TEXT_BYTES)


# The linear program, over class counts only.


def priced(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size, the dearest pattern that holds it: (values, patterns as rows).

    One knapsack dynamic program over the room serves them all.
    """
    value, took = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        k = int(np.searchsorted(sizes, w, "right"))
        value[w] = value[w - 1]
        if k:
            v = prices[:k] + value[w - sizes[:k]]
            i = int(np.argmax(v))
            if v[i] > value[w] + 1e-12:
                value[w], took[w] = v[i], i
    patterns = np.eye(len(sizes), dtype=np.int64)
    for row, size in zip(patterns, sizes, strict=True):
        w = room - size
        while w > 0:
            if took[w] < 0:
                w -= 1
            else:
                row[took[w]] += 1
                w -= sizes[took[w]]
    return prices + value[room - sizes], patterns


def relaxed(columns: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least number of patterns (columns) that cover the demand, fractional: (numbers, duals).

    A primal-dual interior-point method; its central duals keep column
    generation from swinging between extreme prices.
    """
    a = np.hstack([columns, -np.eye(len(demand))])
    c = np.r_[np.ones(columns.shape[1]), np.zeros(len(demand))]
    scale = demand.mean()
    b = demand / scale
    x, z = np.full(len(c), max(1.0, b.max())), np.ones(len(c))
    y = np.full(len(demand), 0.0)
    for _ in range(60):
        rp, rd, mu = b - a @ x, c - a.T @ y - z, x @ z / len(c)
        if mu < 1e-9 * max(1, c @ x) and abs(rp).max() < 1e-7:
            break
        d = x / z
        normal = (a * d) @ a.T + 1e-12 * np.eye(len(b))

        def step(comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            dy = np.linalg.solve(normal, rp + a @ (d * rd - comp / z))  # noqa: B023
            dz = rd - a.T @ dy  # noqa: B023
            return (comp - x * dz) / z, dy, dz  # noqa: B023

        def most(v: np.ndarray, dv: np.ndarray) -> float:
            down = dv < 0
            return float(min(1.0, 0.99 * (v[down] / -dv[down]).min())) if down.any() else 1.0

        dx, dy, dz = step(-x * z)
        ahead = ((x + most(x, dx) * dx) @ (z + most(z, dz) * dz)) / len(c)
        dx, dy, dz = step((ahead / mu) ** 3 * mu - x * z - dx * dz)
        p, q = most(x, dx), most(z, dz)
        x, y, z = x + p * dx, y + q * dy, z + q * dz
    return x[: columns.shape[1]] * scale, y


def filled(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns made largest first, each as often as the items allow."""
    out, left = [], left.copy()
    while left.any():
        row, space = np.zeros_like(left), room
        for i in range(len(sizes) - 1, -1, -1):
            row[i] = min(left[i], space // sizes[i])
            space -= row[i] * sizes[i]
        used = row > 0
        n = int((left[used] // row[used]).min())
        out.append((row, n))
        left -= n * row
    return out


def cover(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional numbers, by column generation."""
    rows = np.unique(np.vstack([np.diag(room // sizes), *(row for row, _ in filled(sizes, demand, room))]), axis=0)
    bound, x = 0.0, np.zeros(len(rows))
    for _ in range(MOST_ROUNDS):
        x, duals = relaxed(rows.T.astype(float), demand.astype(float))
        duals = np.maximum(duals, 0)
        values, new = priced(sizes, duals, room)
        bound = max(bound, float(duals @ demand) / max(1.0, values.max()))
        new = new[values > 1 + 1e-6]
        if x.sum() <= bound * (1 + GAP) or not len(new):
            break
        if len(rows) > MOST_COLUMNS:
            rows = rows[np.argsort(-x)[: MOST_COLUMNS // 2]]
        grown = np.unique(np.vstack([rows, new]), axis=0)
        if len(grown) == len(rows):
            break
        rows = grown
    return (rows, x) if len(x) == len(rows) else (rows, relaxed(rows.T.astype(float), demand.astype(float))[0])


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(items of each class, number of sequences) covering the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes])
    patterns, x = cover(sizes, left, room)
    out = []
    for p in np.lexsort((np.arange(len(x)), -x)):
        row = patterns[p]
        used = row > 0
        n = int(min(np.floor(x[p] + 1e-6), (left[used] // row[used]).min()))
        if n > 0:
            out.append((row, n))
            left = left - n * row
    out += filled(sizes, left, room)
    return [({int(s): int(k) for s, k in zip(sizes, row, strict=True) if k}, n) for row, n in out]


def places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per class and pattern: class, first rank, end rank, first sequence, items a sequence, first place in it."""
    out, rank, sequence = [], {}, 0
    for items, n in patterns:
        place = 0
        for size in sorted(items, reverse=True):
            k, start = items[size], rank.get(size, 0)
            out.append((size, start, start + k * n, sequence, k, place))
            rank[size] = start + k * n
            place += k
        sequence += n
    return out


def first_ranks(counts: DataFrame, groups: int) -> DataFrame:
    """``before``, added to rows (size, bucket, n): what the buckets before hold of the size.

    Sums go by groups of buckets, at most GROUPS of them, then inside a group.
    """
    counts = counts.withColumn("part", (F.col("bucket") % groups).cast("int"))
    by_part = counts.groupBy("size", "part").agg(F.sum("n").alias("n"))
    earlier = lambda *key: W.partitionBy("size", *key[:-1]).orderBy(key[-1]).rowsBetween(W.unboundedPreceding, -1)
    by_part = by_part.select("size", "part", F.coalesce(F.sum("n").over(earlier("part")), F.lit(0)).alias("earlier_parts"))
    inside = counts.withColumn("inside", F.coalesce(F.sum("n").over(earlier("part", "bucket")), F.lit(0)))
    return inside.join(by_part, ["size", "part"]).select("size", "bucket", "n", (F.col("inside") + F.col("earlier_parts")).alias("before"))


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ids = staged(encoded(docs, path))
    rest = F.col("doc_tokens") % LENGTH
    items = ids.withColumn("size", F.ceil(rest / GRAIN).cast("int")).withColumn("full", F.floor(F.col("doc_tokens") / LENGTH))
    # At most LENGTH / GRAIN + 1 rows.
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    patterns = plan({k: v for k, v in counts.items() if k}, LENGTH // GRAIN)
    packed_sequences = sum(n for _, n in patterns)
    buckets = max(256, rows // BUCKET_ROWS)
    # Staged rows keep their partition, so repeated ids spread over the buckets like others.
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(buckets)))

    # Rank inside (class, bucket) and full pieces before the row inside the bucket; then what other buckets hold before.
    order = [F.col("doc_id"), F.col("doc_tokens"), F.col("crcs")]
    inside = items.withColumn("fulls", F.sum("full").over(W.partitionBy("bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("full"))
    inside = inside.withColumn("rank", F.row_number().over(W.partitionBy("bucket", "size").orderBy(*order)) - 1)
    by_class = first_ranks(items.groupBy("size", "bucket").agg(F.count("*").alias("n")), GROUPS)
    by_bucket = first_ranks(items.groupBy("bucket").agg(F.sum("full").alias("n")).select(F.lit(0).alias("size"), "bucket", "n"), GROUPS)

    # The places that a class's ranks in a bucket can take: one or a few of its patterns.
    schema = "size int, spots array<struct<from_rank:long,to_rank:long,sequence:long,each:long,place:long>>"
    spots: dict[int, list[tuple[int, ...]]] = {}
    for size, *spot in places(patterns):
        spots.setdefault(size, []).append(tuple(spot))
    by_class = by_class.join(F.broadcast(spark.createDataFrame(sorted(spots.items()), schema)), "size", "left")  # bounded by the classes, not by the rows
    by_class = by_class.withColumn("spots", F.filter("spots", lambda s: (s["from_rank"] < F.col("before") + F.col("n")) & (s["to_rank"] > F.col("before")))).drop("n")
    ranked = inside.join(by_class, ["size", "bucket"]).join(by_bucket.select("bucket", F.col("before").alias("fulls_before")), "bucket").withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("first_full", F.col("fulls") + F.col("fulls_before") + packed_sequences)

    piece = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    at = F.col("rank") - F.col("spot.from_rank")
    tails = (
        ranked.where("size > 0")
        .withColumn("spot", F.get(F.filter("spots", lambda s: (F.col("rank") >= s["from_rank"]) & (F.col("rank") < s["to_rank"])), F.lit(0)))
        .withColumn("sequence_id", F.col("spot.sequence") + F.floor(at / F.col("spot.each")))
        .withColumn("place", F.col("spot.place") + at % F.col("spot.each"))
        .withColumn("start", F.col("full") * LENGTH)
        .withColumn("length", rest)
        .withColumn("ids_crc32", F.element_at("crcs", -1))
    )
    earlier = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    tails = tails.select(*piece, F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
    fulls = ranked.where("full > 0").select(
        "doc_id", "doc_tokens", "first_full", F.posexplode(F.slice("crcs", F.lit(1), F.col("full").cast("int"))).alias("i", "ids_crc32")
    )
    fulls = fulls.select("doc_id", (F.col("i") * F.lit(LENGTH).cast("long")).alias("start"), F.lit(LENGTH).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first_full") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return tails.unionByName(fulls)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
