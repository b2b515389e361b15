"""Line deduplication: lines that many documents share stay in one of them.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
Keys of at least ``LEAST_CHARS`` code points that ``LEAST_DOCS`` documents hold
lose their lines everywhere but in the document of the largest id.

1. Tasks put the key hashes of their documents into two Bloom filters, one of
   hashes seen once and one of hashes seen again, and hand them on as compressed
   segments. Segments of all tasks meet by place: what was seen twice in one
   task, or in two tasks, is set in the twice-seen filter of the corpus.
2. That filter is broadcast. Only documents that hold a line it knows go on with
   their text, and only such lines are shuffled, as 256-bit hashes with their
   places; all other documents are finished in that task.
3. Suspected lines are counted exactly, so false positives of the filters change
   nothing. What is confirmed finds its lines: keys that hold a large part of
   all lines are broadcast, of which there can be few, the others joined.
4. The places to drop come back to the documents that hold them.

Filters have ``BITS_A_LINE`` bits for every line of the corpus, up to 2^29 bits
(64 MB to broadcast). Beyond some 30 million lines they fill up: then more lines
are suspected and shuffled (48 bytes each), and the result is the same.

Defined results: null and empty texts are one empty line; each row counts as a
document, repeated rows and ids too; where the largest id has several rows, all
of them keep the line; a null id is smaller than any other, and rows without id
keep lines that no row with an id holds; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import looked_up, release, slices, stored, table, texts_of

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Bits of each filter for a line, and hash functions.
BITS_A_LINE, PROBES = 16, 3
#: Filters have at least and at most 2 to these powers of bits.
LEAST_POWER, MOST_POWER = 20, 29
#: Bits of a segment.
SEGMENT = 1 << 20


def keys_of(text: bytes) -> list[bytes]:
    """The key of every line, in order; b"" where the line is too short to have one."""
    out = [k if len(k) >= LEAST_CHARS else b"" for k in (line.strip() for line in text.lower().split(b"\n"))]
    return [k if k.isascii() or len(k) >= 4 * LEAST_CHARS or sum(c & 0xC0 != 0x80 for c in k) >= LEAST_CHARS else b"" for k in out]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def probes(hashes: np.ndarray, power: int) -> np.ndarray:
    """Places of each hash in a filter of 2^power bits: (probes, hashes)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64((1 << power) - 1) for i in range(PROBES)]).astype(np.int64)


def held_by(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def put(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, (places >> 3).ravel(), (1 << (places & 7)).astype(np.uint8).ravel())


class Seen:
    """The once-seen and the twice-seen filter of one task."""

    def __init__(self, power: int) -> None:
        self.power = power
        self.once, self.twice = (np.zeros(1 << (power - 3), np.uint8) for _ in range(2))

    def add(self, hashes: np.ndarray) -> None:
        """Different documents' hashes; those that repeat among them count as seen twice."""
        different, times = np.unique(hashes, return_counts=True)
        places = probes(different, self.power)
        put(self.twice, places[:, (times > 1) | held_by(self.once, places)])
        put(self.once, places)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        pack, size = zstandard.ZstdCompressor(level=1).compress, min(SEGMENT, 1 << self.power) >> 3
        for i in range(0, len(self.once), size):
            once = self.once[i : i + size]
            if once.any():
                yield i // size, pack(once.tobytes()), pack(self.twice[i : i + size].tobytes())


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment's twice-seen bits of the corpus, from those of all tasks, batch by batch."""
    once = twice = None
    open_ = zstandard.ZstdDecompressor().decompress
    place = 0
    for rows in batches:
        for place, a, b in zip(rows["segment"].to_pylist(), rows["once"].to_pylist(), rows["twice"].to_pylist()):
            a, b = (np.frombuffer(open_(x), np.uint8) for x in (a, b))
            if once is None:
                once, twice = np.zeros_like(a), np.zeros_like(b)
            twice |= b | (once & a)
            once |= a
    if twice is not None and twice.any():
        bits = zstandard.ZstdCompressor(level=1).compress(twice.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([bits], pa.binary())], ["segment", "twice"])


def power_for(lines: int) -> int:
    """Of a filter that holds so many lines."""
    return min(MOST_POWER, max(LEAST_POWER, (max(lines, 1) * BITS_A_LINE - 1).bit_length()))


def twice_seen(docs: DataFrame, power: int) -> bytes:
    """The twice-seen filter of the corpus, compressed; ``docs`` has ``text`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(power)
        for part in slices(batches, "text"):
            seen.add(hashes_of([k for text in texts_of(part["text"]) for k in set(keys_of(text)) if k]))
        for place, once, twice in seen.segments():
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], ["segment", "once", "twice"])
        del seen
        release()

    parts = docs.mapInArrow(run, "segment int, once binary, twice binary").groupBy("segment").applyInArrow(_met, "segment int, twice binary")
    bits, size = np.zeros(1 << (power - 3), np.uint8), min(SEGMENT, 1 << power) >> 3
    for place, twice in parts.collect():  # as many rows as segments, 64 MB at most
        bits[place * size : (place + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(twice)), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


def _suspects(spark: SparkSession, docs: DataFrame, packed: bytes) -> DataFrame:
    """Per document: id, t (a hash of its text), lines, sha (of the whole text); with suspected lines also these and the text."""
    shared = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint8)
        for part in slices(batches, "text"):
            texts, lines, found = texts_of(part["text"]), [], []
            keys = [keys_of(t) for t in texts]
            known = held_by(bits, probes(hashes_of([k for ks in keys for k in ks]), int(len(bits) * 8).bit_length() - 1))
            at = 0
            for ks in keys:
                own: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(known[at : at + len(ks)]):
                    if ks[i]:
                        own.setdefault(ks[i], []).append(int(i))
                at += len(ks)
                lines.append(len(ks))
                found.append([{"key": hashlib.sha256(k).digest(), "at": v} for k, v in own.items()] or None)
            kind = pa.list_(pa.struct([("key", pa.binary()), ("at", pa.list_(pa.int32()))]))
            columns = [part["id"], part["t"], pa.array(lines, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(found, kind)]
            held = pa.array([t if f else None for t, f in zip(texts, found)], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, held], ["id", "t", "n_lines", "sha", "found", "text"])
            del part
        del bits
        release()

    return docs.mapInArrow(run, "id long, t long, n_lines long, sha string, found array<struct<key:binary,at:array<int>>>, text binary")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines at the places given."""
    for part in slices(batches, "text"):
        drops = [set(x or ()) for x in part["drops"].to_pylist()]
        texts = [b"\n".join(line for i, line in enumerate(t.split(b"\n")) if i not in d) for t, d in zip(texts_of(part["text"]), drops)]
        columns = [part["id"], part["n_lines"], pa.array(map(len, drops), pa.int64()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_lines", "n_dropped", "text"])
    release()


def _judged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents without suspected lines, and those with them and their ``drops``, if any."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    breaks = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(breaks + 1)).first()[0] or 0
    packed = twice_seen(docs.select("text"), power_for(lines))
    rows = stored(_suspects(docs.sparkSession, docs.withColumn("t", F.xxhash64("text")), packed))
    found = rows.where(F.col("found").isNotNull()).select("id", "t", F.explode("found").alias("f")).select("id", "t", "f.key", "f.at")
    shared = stored(found.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= LEAST_DOCS))
    drops = looked_up(found, shared, "key", "n").where(~F.col("id").eqNullSafe(F.col("keep")))
    drops = drops.groupBy(F.col("id").alias("d_id"), F.col("t").alias("d_t")).agg(F.flatten(F.collect_list("at")).alias("drops"))
    some = rows.where(F.col("found").isNotNull()).drop("found")
    some = some.join(drops, some["id"].eqNullSafe(drops["d_id"]) & (some["t"] == drops["d_t"]), "left")
    return rows.where(F.col("found").isNull()), some.select("id", "n_lines", "sha", "text", "drops")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that lose lines: id, n_lines, n_dropped, text (the lines that stay)."""
    out = _judged(docs, id_col, text_col)[1].where(F.col("drops").isNotNull()).select("id", "n_lines", "text", "drops").mapInArrow(_without, "id long, n_lines long, n_dropped long, text binary")
    return out.withColumn("text", F.col("text").cast("string")).withColumnRenamed("id", id_col)


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_lines, n_dropped, kept_sha256 of the lines that stay."""
    whole, some = _judged(docs, id_col, text_col)
    done = whole.unionByName(some.where(F.col("drops").isNull()), allowMissingColumns=True).select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("sha").alias("kept_sha256"))
    cut = some.where(F.col("drops").isNotNull()).select("id", "n_lines", "text", "drops").mapInArrow(_without, "id long, n_lines long, n_dropped long, text binary")
    cut = cut.select("id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    return done.unionByName(cut).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, (s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keep) AS gone FROM k LEFT JOIN s USING (key)) GROUP BY row, doc_id
"""
