"""Language identification: a linear-chain conditional random field over words.

A word's emission scores add up hashed weights of its letter trigrams with its
borders (which include its affixes), longer affixes and the word itself (the
lexicon); learned transitions tie neighbouring words. Forward-backward gives
every word its probability of each language, so code-switched text is labelled
word by word; a document gets the language with the largest mean.

Training uses a bounded sample of labelled rows (TRAIN_ROWS, each of at most
TRAIN_CHARS characters) and splices runs of words from different documents, so
that transitions see switches. The model (a few MB, fixed) travels with the
task code; documents are scanned whole, in place: no shuffle, no hot group.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
as is everything when no labelled row exists; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import crc_mod, map_rows, mixed, sampled, table, texts_of

TRAIN_ROWS = 800
TRAIN_CHARS = 20_000
BITS = 17
EPOCHS = 3
RATE = 0.2
#: Words in a padded block of forward-backward.
BLOCK_WORDS = 150_000
#: Bytes of text at once in a task; features and scores take some fifty times as much.
AT_ONCE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts in one array, a 0 after each, and where each begins."""
    held = [np.frombuffer(t.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    ends = np.cumsum([0, *(len(h) + 1 for h in held)])
    flat = np.zeros(ends[-1], np.uint32)
    for h, a in zip(held, ends, strict=False):
        flat[a : a + len(h)] = h
    return flat, ends


@dataclass
class Features:
    """Hashed features of the words of some texts: rows of the weight table."""

    trigram: np.ndarray  # one for each letter
    start: np.ndarray  # of each word, among the letters
    prefix: np.ndarray  # one for each word, as below
    suffix: np.ndarray
    word: np.ndarray
    words_of: np.ndarray  # number of words of each text


def features(texts: list[bytes], bits: int = BITS) -> Features:
    flat, ends = points(texts)
    alpha = letters()[np.minimum(flat, 0x10FFFF)]
    c = np.where(alpha, flat, 0).astype(np.uint64)
    padded = np.r_[np.zeros(2, np.uint64), c, np.zeros(2, np.uint64)]
    at = np.flatnonzero(alpha)
    first = at[np.r_[True, np.diff(at) > 1]] if len(at) else at
    last = at[np.r_[np.diff(at) > 1, True]] if len(at) else at
    shift = np.uint64(64 - bits)
    p1, p2, p3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    tri = ((padded[at + 1] * p1 + padded[at + 2]) * p2 + padded[at + 3]) * p3
    tri ^= tri >> np.uint64(29)
    tri *= p1
    start = np.searchsorted(at, first)
    size = last - first + 1
    # Affixes of up to four letters; shorter words bring their border along.
    four = lambda i: mixed(((padded[i] * p1 + padded[i + 1]) * p2 + padded[i + 2]) * p3 + padded[i + 3])
    prefix = mixed(four(first + 2) + np.uint64(1))
    suffix = mixed(four(np.maximum(last - 1, 0)) + np.uint64(2))
    place = (at - np.repeat(first, size)).astype(np.uint64)
    word = np.add.reduceat((c[at] + np.uint64(1)) * mixed(place + np.uint64(11)), start) if len(at) else np.zeros(0, np.uint64)
    word = mixed(word + np.uint64(3))
    count = np.searchsorted(first, ends[1:]) - np.searchsorted(first, ends[:-1])
    index = lambda h: (h >> shift).astype(np.int32)
    return Features(index(tri), start, index(prefix), index(suffix), index(word), count)


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # (2 ** bits, languages)
    transition: np.ndarray  # log weights
    begin: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        w = self.weights
        if not len(f.start):
            return np.zeros((0, len(self.names)), np.float32)
        return np.add.reduceat(w[f.trigram], f.start, axis=0) + w[f.prefix] + w[f.suffix] + 2 * w[f.word]


def blocks(counts: np.ndarray) -> list[np.ndarray]:
    """Texts of like length together, so that padded blocks stay near BLOCK_WORDS."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    out, i = [], 0
    while i < len(order):
        n = max(1, BLOCK_WORDS // int(counts[order[i]]))
        out.append(order[i : i + n])
        i += n
    return out


def forward_backward(model: Model, emission: np.ndarray, counts: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals of each word's languages; ``pairs`` gathers expected transitions.

    Texts run in step, longest first, so that those still running are a prefix.
    """
    out = np.zeros_like(emission)
    offset = np.cumsum(counts) - counts
    a, b = np.exp(model.transition).astype(np.float32), np.exp(model.begin).astype(np.float32)
    for ids in blocks(counts):
        n = counts[ids]
        steps, k = int(n[0]), emission.shape[1]
        running = np.searchsorted(-n, -np.arange(steps), "left")  # texts longer than t
        take = offset[ids][None, :] + np.minimum(np.arange(steps)[:, None], n[None, :] - 1)
        e = emission[take]
        e = np.exp(np.maximum(e - e.max(axis=2, keepdims=True), -30)).astype(np.float32)
        alpha = np.zeros((steps, len(ids), k), np.float32)
        for t in range(steps):
            r = running[t]
            x = (b if t == 0 else alpha[t - 1, :r] @ a) * e[t, :r]
            alpha[t, :r] = x / x.sum(axis=1, keepdims=True)
        beta = np.ones((len(ids), k), np.float32)
        for t in range(steps - 1, -1, -1):
            r = running[t]
            m = alpha[t, :r] * beta[:r]
            m /= m.sum(axis=1, keepdims=True)
            alpha[t, :r], before = m, alpha[t - 1, :r].copy() if t else None
            back = e[t, :r] * beta[:r]
            if t and pairs is not None:
                joint = before[:, :, None] * a[None] * back[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = back @ a.T
            beta[:r] = back / back.sum(axis=1, keepdims=True)
        for j, (i, m) in enumerate(zip(offset[ids], n, strict=True)):
            out[i : i + m] = alpha[:m, j]
    return out


def spliced(rows: list[tuple[bytes, int]], rng: np.random.Generator) -> list[tuple[list[bytes], np.ndarray]]:
    """Training texts: documents, some of them with runs of words from another one spliced in."""
    out = []
    words = [t.split() for t, _ in rows]
    for i in rng.permutation(len(rows)):
        own, label = words[i], np.full(len(words[i]), rows[i][1])
        j = int(rng.integers(len(rows)))
        if rng.random() < 0.4 and own and words[j] and rows[j][1] != rows[i][1]:
            at, a = int(rng.integers(len(own) + 1)), int(rng.integers(len(words[j])))
            run = words[j][a : a + int(rng.integers(5, 60))]
            own = own[:at] + run + own[at:]
            label = np.r_[label[:at], np.full(len(run), rows[j][1]), label[at:]]
        out.append((own, label))
    return out


def train(rows: list[tuple[bytes, str]], bits: int = BITS) -> Model:
    """Weights by AdaGrad steps on the conditional likelihood of spliced texts."""
    names = sorted({x for _, x in rows})
    k, rng = len(names), np.random.default_rng(5)
    code = {x: i for i, x in enumerate(names)}
    model = Model(names, np.zeros((1 << bits, k), np.float32), np.zeros((k, k)), np.zeros(k))
    seen, seen_a, seen_b = np.full((1 << bits, k), 1e-2, np.float32), np.full((k, k), 1.0), np.full(k, 1.0)
    for _ in range(EPOCHS if k > 1 else 0):
        texts = spliced([(t, code[x]) for t, x in rows], rng)
        for s in range(0, len(texts), 32):
            part = texts[s : s + 32]
            f = features([b" ".join(w) for w, _ in part], bits)
            # A token may hold several words, or none: each word takes its token's label.
            gold = np.concatenate([np.repeat(y, features(w, bits).words_of) if len(w) else np.zeros(0, int) for w, y in part]).astype(int)
            if not len(gold):
                continue
            pairs = np.zeros((k, k))
            p = forward_backward(model, model.emissions(f), f.words_of, pairs)
            offset = np.cumsum(f.words_of) - f.words_of
            error = p.copy()
            error[np.arange(len(gold)), gold] -= 1
            error /= np.sqrt(len(gold))
            size = np.diff(np.r_[f.start, len(f.trigram)])
            index = np.concatenate([f.trigram, f.prefix, f.suffix, f.word])
            grad = np.concatenate([np.repeat(error, size, axis=0), error, error, 2 * error])
            g = np.stack([np.bincount(index, grad[:, j], 1 << bits) for j in range(k)], axis=1).astype(np.float32)
            seen += g * g
            model.weights -= RATE * g / np.sqrt(seen)
            inner = np.ones(len(gold), bool)
            inner[offset[f.words_of > 0]] = False
            follow = np.flatnonzero(inner)
            counted = np.zeros((k, k))
            np.add.at(counted, (gold[follow - 1], gold[follow]), 1)
            ga = (pairs - counted) / np.sqrt(len(gold))
            gb = p[offset[f.words_of > 0]].sum(axis=0) - np.bincount(gold[offset[f.words_of > 0]], minlength=k)
            seen_a += ga * ga
            seen_b += gb * gb
            model.transition -= RATE * ga / np.sqrt(seen_a)
            model.begin -= RATE * gb / np.sqrt(seen_b)
    return model


def fitted(labelled: DataFrame) -> Model:
    """A model of a bounded sample of rows with text and lang."""
    rows = sampled(labelled.where("lang is not null").select("doc_id", "lang", "text"), TRAIN_ROWS).where(F.char_length("text") <= TRAIN_CHARS).collect()
    return train([(r["text"].encode("utf-8", "replace"), r["lang"]) for r in rows])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_words, n_switches (between neighbouring words), certainty.

    ``score`` is the mean probability of the language found, so it falls in mixed
    text; ``certainty``, the mean of each word's best, does not.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        f = features(texts_of(b["text"]))
        names, scores, switches, certain = [], [], [], []
        if model.names:
            p = forward_backward(model, model.emissions(f), f.words_of) if len(model.names) > 1 else np.ones((len(f.start), 1))
            best, most = p.argmax(axis=1), p.max(axis=1)
            at = 0
            for n in f.words_of:
                certain.append(min(1.0, float(most[at : at + n].mean())) if n else 0.0)
                mean = p[at : at + n].mean(axis=0) if n else None
                names.append(model.names[int(mean.argmax())] if n else UNKNOWN)
                scores.append(min(1.0, float(mean.max())) if n else 0.0)
                switches.append(int((np.diff(best[at : at + n]) != 0).sum()))
                at += n
        else:
            names, scores, switches, certain = ([x] * b.num_rows for x in (UNKNOWN, 0.0, 0, 0.0))
        return pa.RecordBatch.from_arrays(
            [b["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(f.words_of, pa.int64()), pa.array(switches, pa.int64()), pa.array(certain, pa.float64())],
            ["doc_id", "lang_pred", "score", "n_words", "n_switches", "certainty"],
        )

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "text", batch, "doc_id long, lang_pred string, score double, n_words long, n_switches long, certainty double", AT_ONCE)


def labelled_words(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id and runs of words of one language: array of (lang, words)."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        f = features(texts_of(b["text"]))
        best = forward_backward(model, model.emissions(f), f.words_of).argmax(axis=1)
        out, at = [], 0
        for n in f.words_of:
            own = best[at : at + n]
            cut = np.flatnonzero(np.r_[True, np.diff(own) != 0, True]) if n else np.zeros(1, int)
            out.append([{"lang": model.names[own[i]], "words": int(j - i)} for i, j in zip(cut, cut[1:], strict=False)])
            at += n
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))], ["doc_id", "runs"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "text", batch, "doc_id long, runs array<struct<lang:string,words:long>>", AT_ONCE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod("doc_id", 3)
    model = fitted(docs.where(fold != 1))
    return identified(docs, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
