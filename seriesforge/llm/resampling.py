"""Importance resampling towards a target: exactly a share of the documents, drawn by hashed n-gram weights.

Words and pairs of words fall into ``BUCKETS`` buckets by CRC-32. A bucket's gain
compares its share of the target's features with its share of the corpus'; a
document's weight is the floored mean of its features' gains, and Gumbel noise
of its id makes the highest scores a draw without replacement.

1. Tasks count buckets over whole texts (an array of 10,000 counts a task); the
   sums, of fixed size, become the array of gains.
2. Tasks score every document with that array.
3. Scores are whole numbers between bounds that gains and noise set (some 10^5
   of them at most), so a histogram of fixed size says at which score the draw
   ends and cuts all higher scores into ranges of about ``RANGE`` documents.
4. Tasks sort their eligible documents at or above that score into runs, cut by
   range. A range's runs meet and are merged by a tournament tree, which emits
   ranks from the number of documents in the ranges above; the last range stops
   at the exact count. No task holds more than one range: a score's share of all
   documents is bounded by the noise, whatever the texts are.

Defined results: null texts have no features; a null id has the noise of ``7:``
and comes last among ties; repeated rows are drawn as documents of their own;
documents of fewer than ``LEAST_WORDS`` words are never drawn but count in the
corpus; without a target all weights follow from T = 0; an empty table gives an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import release, slices, stored, table, texts_of, word_table

BUCKETS = 10_000
#: Percent of the eligible documents that are drawn.
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Documents of a range, about.
RANGE = 100_000
#: Documents of a sorted run, and bytes of a text that are split into words at once.
RUN, PIECE = 200_000, 1 << 20

#: ASCII digits and letters and everything beyond ASCII make words.
WORDS = word_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``PIECE`` bytes; each list but the first begins with the last word before it."""
    text, at = text.translate(WORDS), 0
    last: list[bytes] = []
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        words = last + text[at:end].split()
        if len(words) > len(last):
            yield words
            last = words[-1:]
        at = end


def buckets_of(text: bytes) -> tuple[np.ndarray, int]:
    """Bucket of every feature, and the number of words."""
    found, count = [], 0
    for i, words in enumerate(pieces(text)):
        alone = list(map(crc32, words))
        pairs = list(map(crc32, words[1:], map(crc32, repeat(b" "), alone)))  # CRC-32 goes on where the word before and a space left it
        found += [np.array(alone[min(i, 1) :], np.int64), np.array(pairs, np.int64)]
        count += len(words) - min(i, 1)
    return (np.concatenate(found) % BUCKETS if found else np.empty(0, np.int64)), count


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features of all rows' ``text``, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, "text"):
            for text in texts_of(part["text"]):
                counts += np.bincount(buckets_of(text)[0], minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())], ["bucket", "n"])
        release()

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares), by bucket."""
    s, t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per document: n_features, weight, score, and whether it can be drawn; ``docs`` has doc_id, h (32 bits of its noise), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for h, text in zip(part["h"].to_pylist(), texts_of(part["text"])):
                found, words = buckets_of(text)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
                rows.append((len(found), weight, weight + noise, words >= LEAST_WORDS))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_features", "weight", "score", "eligible"])
        release()

    return docs.mapInArrow(run, SCORED)


class Tournament:
    """The least head of k sorted runs, and the next: a tree of matches in which the winner's leaf alone is played again."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.leaves = runs, 1 << max(len(runs) - 1, 0).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (self.leaves - len(runs))
        self.won = [0] * self.leaves + list(range(self.leaves))
        for at in range(self.leaves - 1, 0, -1):
            self._play(at)

    def _play(self, at: int) -> None:
        a, b = self.won[2 * at], self.won[2 * at + 1]
        x, y = self.heads[a], self.heads[b]
        self.won[at] = b if x is None or y is not None and y < x else a

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[(who := self.won[1])]) is not None:
            yield head
            self.heads[who] = next(self.runs[who], None)
            at = (self.leaves + who) // 2
            while at:
                self._play(at)
                at //= 2


def runs_of(rows: DataFrame, tops: np.ndarray) -> DataFrame:
    """Sorted runs of each task's rows, cut by range: scores from tops[i] up, and below tops[i - 1], are in range i."""

    def cut(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort()
        where = np.searchsorted(-tops, [r[0] for r in rows])
        for i in np.unique(where):
            a, b = np.searchsorted(where, [i, i + 1])
            less, nameless, ids, features, weights = zip(*rows[a:b])
            columns = [[less], [nameless], [ids], [features], [weights]]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds))], ["range", "less", "nameless", "ids", "features", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in batches:
            score, ids = part["score"].to_pylist(), part["doc_id"].to_pylist()
            held += [(-s, d is None, d or 0, n, w) for s, d, n, w in zip(score, ids, part["n_features"].to_pylist(), part["weight"].to_pylist())]
            if len(held) >= RUN:
                yield from cut(held)
                held = []
        if held:
            yield from cut(held)
        release()

    schema = "range int, less array<long>, nameless array<boolean>, ids array<long>, features array<long>, weights array<long>"
    return rows.select("doc_id", "n_features", "weight", "score").mapInArrow(run, schema)


def drawn(rows: DataFrame, percent: int = PERCENT, size: int = RANGE) -> DataFrame:
    """Scored rows with the rank of those that are drawn."""
    rows = stored(rows)
    counts = sorted(((-s, n) for s, n in rows.where("eligible").groupBy("score").agg(F.count("*")).collect()))  # as many rows as scores, some 10^5 at most
    draw = percent * sum(n for _, n in counts) // 100
    # Ranges from the highest score down: the rows above each, and its lowest score.
    tops, above, before, open_ = [], [], 0, 0
    for less, n in counts:
        if before >= draw:
            break
        if not open_:
            above.append(before)
            tops.append(-less)
        tops[-1], before, open_ = -less, before + n, open_ + n
        open_ = 0 if open_ >= size else open_
    none = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if not tops:
        return rows.select(*columns, none)

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [list(zip(*run)) for b in batches for run in zip(*(b[c].to_pylist() for c in ("less", "nameless", "ids", "features", "weights")))]
        at, out = above[key[0].as_py()], []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*columns, "rank"])

        for less, nameless, doc, features, weight in Tournament([iter(r) for r in runs]):
            at += 1
            out.append((None if nameless else doc, features, weight, -less, at if at <= draw else None))
            if len(out) == 50_000:
                yield batch()
                out = []
        if out:
            yield batch()

    high = F.col("eligible") & (F.col("score") >= tops[-1])
    top = runs_of(rows.where(high), np.array(tops)).groupBy("range").applyInArrow(merged, "doc_id long, n_features long, weight long, score long, rank long")
    return rows.where(~high).select(*columns, none).unionByName(top)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null if not drawn)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), h.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gain = gains(bucket_counts(docs), bucket_counts(target.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    return drawn(scored(docs, gain), percent).withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL goes bit by bit: a byte is added to the register before the first of its eight shifts.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
fb AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION SELECT f FROM fb)),
k AS (SELECT f, xor(list_reduce(list_transform(range(4 * len(h)), lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(h, i // 4 + 1, 2))::BIGINT ELSE 0 END),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295), 4294967295) % 10000 AS bucket FROM u),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN k USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM fb) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
r AS (SELECT row, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n + n) % n)) // n, 0) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (row)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM c LEFT JOIN o USING (row)
"""
