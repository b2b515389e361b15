"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of terms: trigrams of character shapes (letter cases, digits,
the marks themselves), letter trigrams, and classes of a few statistics
(repetition, share of marks, length). Terms are weighted by log count and
inverse document frequency, and a truncated singular-value decomposition of the
labelled texts turns them into short vectors. Every document is compared with
every labelled vector, block by block, by cosine, and its nearest ones vote,
weighted by their similarity and the rarity of their label.

Fitting uses a bounded sample: at most FIT_ROWS labelled rows of each label, of
at most FIT_CHARS characters. The model (labelled vectors, projection: a few
MB, fixed) travels with the task code. Documents are scored whole and in place:
no shuffle, no hot group. Labels, language, source and id are no inputs.

Defined results: a null text counts as empty; an empty text is scored by its
statistics; without labelled rows every score is 0.5; with one label, that
label; repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import crc_mod, map_rows, sampled, table, texts_of

FIT_ROWS = 1_500
FIT_CHARS = 50_000
DIMENSIONS = 64
NEIGHBOURS = 25
#: Similarities are raised to this power as weights of votes.
SHARPNESS = 8
THRESHOLD = 0.3
SHAPES, TRIGRAMS, BINS, STATISTICS = 2048, 1024, 12, 8
TERMS = SHAPES + TRIGRAMS + BINS * STATISTICS
#: Texts counted at once in a task.
AT_ONCE = 400


@lru_cache(maxsize=1)
def shape_of() -> np.ndarray:
    """A class for every code point below 0x3000: marks are their own, letters by case, others by kind."""
    out = np.zeros(0x3000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c == "\n" else 5 if c.isspace() else 6 + i % 58
    return out


def _class(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, BINS - 1).astype(np.int64)


def statistics(texts: list[str], shapes: list[np.ndarray]) -> np.ndarray:
    """Classes of STATISTICS numbers of each text."""
    rows = []
    for t, s in zip(texts, shapes, strict=True):
        words, lines = t.split(), [x for x in t.split("\n") if x]
        n, k = max(len(s), 1), np.bincount(s, minlength=64)
        marks = int(k[6:].sum())
        rows.append(
            (
                np.log2(len(words) + 1),
                len(set(words)) / max(len(words), 1) * 11.99,
                len(set(lines)) / max(len(lines), 1) * 11.99,
                k[1] / max(k[1] + k[2], 1) * 23.99,
                marks / n * 40,
                k[3] / n * 60,
                n / max(len(words), 1) - 1,
                int(k[6:].max()) / max(marks, 1) * 11.99,
            )
        )
    return _class(np.array(rows).reshape(-1, STATISTICS))


def counts(texts: list[str]) -> np.ndarray:
    """Terms of each text, as a dense block of log counts."""
    n = len(texts)
    held = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    low = np.concatenate([*(np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts), np.zeros(0, np.uint32)]).astype(np.uint64)
    table_of = shape_of()
    shapes = [np.where(h < 0x3000, table_of[np.minimum(h, 0x2FFF)], 2) for h in held]
    out = np.zeros((n, TERMS), np.float32)
    sizes = [len(h) for h in held]
    s, who = np.concatenate([*shapes, np.zeros(0, np.uint8)]).astype(np.int64), np.repeat(np.arange(n), sizes)
    if len(s) > 2:
        inner = who[2:] == who[:-2]
        tri = ((s[:-2] * 64 + s[1:-1]) * 64 + s[2:]) * 2654435761 % 4294967296 >> 21
        out[:, :SHAPES] = np.bincount((who[2:] * SHAPES + tri)[inner], minlength=n * SHAPES).reshape(n, SHAPES)
    who = np.repeat(np.arange(n), [len(t.lower()) for t in texts])
    if len(low) > 2:
        inner = who[2:] == who[:-2]
        h = ((low[:-2] * np.uint64(0x9E3779B97F4A7C15) + low[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + low[2:]) * np.uint64(0x165667B19E3779F9)
        tri = (h >> np.uint64(54)).astype(np.int64)
        out[:, SHAPES : SHAPES + TRIGRAMS] = np.bincount((who[2:] * TRIGRAMS + tri)[inner], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    np.log1p(out, out=out)
    # Each family of terms weighs the same whatever the text's length.
    for a, b, weight in ((0, SHAPES, 1.0), (SHAPES, SHAPES + TRIGRAMS, 0.3)):
        out[:, a:b] *= weight / np.maximum(np.linalg.norm(out[:, a:b], axis=1, keepdims=True), 1e-9)
    at = SHAPES + TRIGRAMS + np.arange(STATISTICS) * BINS + statistics(texts, shapes)
    np.put_along_axis(out, at, 0.3, axis=1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    weight: np.ndarray  # of each term
    projection: np.ndarray  # terms to latent dimensions
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    prior: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        out = []
        for i in range(0, len(texts), AT_ONCE):
            like = _unit((counts(texts[i : i + AT_ONCE]) * self.weight) @ self.projection) @ self.vectors.T
            k = min(NEIGHBOURS, like.shape[1])
            near = np.argpartition(-like, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(like, near, axis=1), 1e-3) ** SHARPNESS
            share = (self.labels == 1).mean()
            votes *= np.where(self.labels[near] == 1, 1 / max(share, 1e-9), 1 / max(1 - share, 1e-9))  # the sample holds as many of each label as it can
            ones, all_votes = (votes * self.labels[near]).sum(axis=1), votes.sum(axis=1)
            out.append(ones / all_votes)
        return np.concatenate([*out, np.zeros(0)])


def train(rows: list[tuple[str, int]]) -> Model:
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or len(set(labels.tolist())) == 1:
        return Model(np.ones(TERMS), np.zeros((TERMS, 0)), np.zeros((0, 0)), labels, float(labels.mean()) if len(rows) else 0.5)
    x = np.vstack([counts([t for t, _ in rows[i : i + AT_ONCE]]) for i in range(0, len(rows), AT_ONCE)])
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    x *= weight
    rng = np.random.default_rng(3)
    q = x.T @ (x @ rng.standard_normal((TERMS, DIMENSIONS + 16)).astype(np.float32))
    for _ in range(3):
        q = x.T @ (x @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ v.T)[:, :DIMENSIONS].astype(np.float32)
    return Model(weight, projection, _unit(x @ projection), labels, float(labels.mean()))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of a bounded sample of labelled documents, as many of each label as there are up to FIT_ROWS."""
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    sample = sampled(known.where("quality = 0"), FIT_ROWS).unionByName(sampled(known.where("quality = 1"), FIT_ROWS))
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= FIT_CHARS).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("x")).collect()  # an id counts once: 2 * FIT_ROWS at most
    return train(sorted((r["x"]["text"], r["x"]["quality"]) for r in rows))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: label 1 likelier)."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = model.scores([x.decode("utf-8", "replace") for x in texts_of(b["text"])])
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.clip(found, 0, 1), pa.float64())], ["doc_id", "score"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "text", batch, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5)
    model = fitted(docs, table(spark, sf_dir, "labels").where(fold != 0))
    out = scored(docs, model)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
