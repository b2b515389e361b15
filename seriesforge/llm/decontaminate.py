"""Benchmark decontamination: passages of benchmark items inside documents.

An item is in a document if some run of the document's words is within
``floor((1 - similarity) * words)`` word edits of it. Three steps find it:

1. Places. With d edits, one of the d + 1 untouched runs of an item holds at
   least (words - d) / (d + 1) words, so a match shares runs of that many words
   (q, three at most) with the item. Each edit spoils q of the item's
   words - q + 1 runs, so words - q + 1 - q * d of them stand in the match, and
   as edits alone shift them, their starting points lie within d words. Both
   bounds lose no match. Embedding every window of every item size instead
   would take hundreds of random steps for each word of the corpus.
2. CGK embedding and bit sampling. Item-sized windows at these places and the
   item go through the same random walks, which turn edit distance into Hamming
   distance. Draws of a few steps are compared; one equal draw is a collision.
   How many steps a draw has follows from the item's size: as many as still
   find RECALL of copies with all allowed edits: four at 20 words, two at 45,
   where of unrelated windows 3 and 63 in 100 collide too. From LONGEST words on
   a fifth of edits keeps walks apart so often that no draw of more than one
   step finds all copies, and one step is met by chance in every window. There
   the embedding could reject nothing, and places go to the next step at once.
3. An exact edit distance over the region decides.

Scale: items are the query set. They are read in blocks of bounded size, each
block travels with the task code, and documents are scanned whole, in place:
no shuffle, so no hot source or group. Several blocks are staged one by one. A
task holds a bounded number of alignments, however common an opening is.

Defined results: null and empty texts and items match nothing; items under five
words match only unedited; a word is a run of letters and digits of any script,
compared in lower case; several occurrences count once, at the nearest one (of
equally near ones, the first); a null id is returned as it is and no document
without id is dropped; repeated rows give repeated results; an empty table
gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import map_rows, mixed, shingle_hashes, staged, table, texts_of, word_hashes

SIMILARITY = 0.8
#: Bytes of item text in a block; one block at a time is held in a task.
BLOCK_BYTES = 16 << 20
#: Share of true matches at the most edits allowed that random walks and samples are to find, measured on so many copies.
RECALL = 0.999
TRIALS = 256
#: Random walks of each window, draws of steps from each walk, and most steps to a draw; fewer are taken where RECALL asks for it.
WALKS = 8
SAMPLES = 256
MOST_POSITIONS = 4
#: Items of so many words are not embedded.
LONGEST = 60
#: Aligned runs, and words of windows, that a task holds at once.
AT_ONCE = 1 << 20
WINDOW_WORDS = 1 << 15
#: Places that a task gathers before it embeds them.
MOST_PLACES = 4_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> np.ndarray:
    return word_hashes(WORD.findall(text.decode("utf-8", "replace").lower().encode()))


def allowed_edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def nearest(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least word edits between the item and any run of the region, and where that run ends."""
    index = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, w in enumerate(item):
        new = np.minimum(row + 1, np.r_[i + 1, row[:-1] + (region != w)])
        row = index + np.minimum.accumulate(new - index)
    end = int(np.argmin(row))
    return int(row[end]), end


def walked(windows: np.ndarray, length: np.ndarray, steps: int) -> np.ndarray:
    """CGK embeddings: for each window and walk, the words that the walk stands on, step by step; 0 behind the end.

    ``windows`` holds a row of word hashes for each window, ``length`` how many of them count. Step j of a walk moves
    on to the next word or stays, by a random bit of (walk, j, word): equal words make equal moves.
    """
    rows = np.arange(len(windows))[:, None]
    at = np.zeros((len(windows), WALKS), np.int64)
    out = np.zeros((steps, len(windows), WALKS), np.uint64)
    seeds = mixed(np.arange(1, WALKS + 1, dtype=np.uint64))
    for j in range(steps):
        word = np.where(at < length[:, None], windows[rows, np.minimum(at, windows.shape[1] - 1)], np.uint64(0))
        out[j] = word
        at += (mixed(word + seeds + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63)).astype(np.int64)
    return out


def sampled_steps(steps: int, positions: int) -> np.ndarray:
    """SAMPLES draws of that many steps."""
    return np.random.default_rng([7, steps, positions]).integers(0, steps, (SAMPLES, positions))


def collide(a: np.ndarray, b: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Whether any draw of any walk sees the same words in both embeddings, per window."""
    same = (a == b) & (a != 0)
    return same[draws].all(axis=1).any(axis=(0, 2))


def measured_size(words: int) -> int:
    """The size, of every tenth part more, that stands for items of so many words."""
    return words if words < 20 else round(20 * 1.1 ** np.ceil(np.log(words / 20) / np.log(1.1) - 1e-9))


@lru_cache(maxsize=1024)
def positions_for(words: int, edits: int) -> int:
    """Most steps to a draw with which TRIALS items of that size, changed by as many random edits, collide at least as often as RECALL."""
    rng = np.random.default_rng([words, edits])
    item = np.arange(1, words + 1, dtype=np.uint64)
    copies = np.zeros((TRIALS, words), np.uint64)
    length = np.zeros(TRIALS, np.int64)
    for k in range(TRIALS):
        kind = np.zeros(words, int)
        kind[rng.permutation(words)[:edits]] = k % 4 or rng.integers(1, 4, edits)  # changes, losses, additions alone, and all of them
        own = [x for i, w in enumerate(item.tolist()) for x in ((w,), (words + 1 + i,), (), (w, 2 * words + 1 + i))[kind[i]]]
        own = own[int(rng.integers(0, 1 + edits // 8)) :][:words]  # proposed places may be some words off
        copies[k, : len(own)], length[k] = own, len(own)
    steps = 3 * words
    mine = walked(mixed(item)[None], np.array([words]), steps)
    theirs = walked(mixed(copies), length, steps)
    for positions in range(MOST_POSITIONS, 1, -1):
        if collide(mine, theirs, sampled_steps(steps, positions)).mean() >= RECALL:
            return positions
    return 1


class Block:
    """A block of items with its index of word runs and the embeddings of its items."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float) -> None:
        self.similarity = similarity
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.edits = [allowed_edits(len(w), similarity) for w in self.words]
        self.allowed, self.sizes = np.array(self.edits, int), np.array([len(w) for w in self.words], int)
        self.positions = {int(n): positions_for(m := measured_size(int(n)), allowed_edits(m, similarity)) for n in np.unique(self.sizes) if 0 < n < LONGEST}
        self.least = np.ones(len(items), int)  # of an item's runs that stand in every match
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (w, d) in enumerate(zip(self.words, self.edits, strict=True)):
            n = len(w)
            if n:
                size = min(3, -(-(n - d) // (d + 1)))
                self.least[k] = max(1, n - size + 1 - size * d)
                runs[size] += [(int(h), k, o) for o, h in enumerate(shingle_hashes(w, size))]
        # For each length of runs: their hashes, (hash number, item) in one sorted number, places in items, a bit for each hash.
        self.runs = {}
        for size, found in runs.items():
            found.sort()
            hashes, number = np.unique(np.array([x[0] for x in found], np.uint64), return_inverse=True)
            seen = np.zeros(1 << 20, bool)
            seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            key = number * len(items) + np.array([x[1] for x in found])
            self.runs[size] = hashes, key, np.array([x[2] for x in found]), seen

    @staticmethod
    @lru_cache(maxsize=256)
    def _embedded(words: bytes) -> np.ndarray:
        w = np.frombuffer(words, np.uint64)
        return walked(w[None], np.array([len(w)]), 3 * len(w))

    def places(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(run length, places in the text, numbers of the runs found there)."""
        out = []
        for size, (hashes, _, _, seen) in self.runs.items():
            if len(words) >= size:
                h = shingle_hashes(words, size)
                place = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                number = np.minimum(np.searchsorted(hashes, h[place]), len(hashes) - 1)
                real = hashes[number] == h[place]
                if real.any():
                    out.append((size, place[real], number[real]))
        return out

    def starts(self, found: list[tuple[int, np.ndarray, np.ndarray]], low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, where it may start in the text) of the items low to high: as many of its runs as every match has stand aligned there.

        At most about AT_ONCE alignments are held: beyond, the items are halved, and one item's text is cut with overlaps.
        """
        count, ends = len(self.ids), []
        for size, _, number in found:
            key = self.runs[size][1]
            ends.append((np.searchsorted(key, number * count + low), np.searchsorted(key, number * count + high)))
        total = sum(int((b - a).sum()) for a, b in ends)
        if not total:
            return
        if total > AT_ONCE and high - low > 1:
            yield from self.starts(found, low, (low + high) // 2)
            yield from self.starts(found, (low + high) // 2, high)
            return
        span = self.sizes[low] + 2 * self.allowed[low] + 3
        if total > AT_ONCE and (last := max(int(p[-1]) for _, p, _ in found)) > 4 * span:
            first = min(int(p[0]) for _, p, _ in found)
            step = max(int(2 * span), (last - first) // 2)
            for begin in range(first, last + 1, step):
                yield from self.starts([(s, p[m], k[m]) for s, p, k in found if (m := (p >= begin) & (p < begin + step + span)).any()], low, high)
            return
        item, start = [], []
        for (size, place, _), (a, b) in zip(found, ends, strict=True):
            n = b - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            item.append(self.runs[size][1][at] % count)
            start.append(np.repeat(place, n) - self.runs[size][2][at])
        item, start = np.concatenate(item), np.concatenate(start)
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        # Of a true match's alignments, the least number lies within the allowed edits of each other.
        last = np.arange(len(item)) + self.least[item] - 1
        at = np.minimum(last, len(item) - 1)
        full = (last < len(item)) & (item[at] == item) & (start[at] - start <= self.allowed[item])
        item, start = item[full], start[full]
        cuts = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(item[a]), np.unique(start[a:b])

    def alike(self, places: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each (item, words of a text, starts in it), whether an item-sized window at one of the starts collides with the item."""
        out = np.zeros(len(places), bool)
        rows, place = [], []
        for k, (item, words, starts) in enumerate(places):
            n, near = len(self.words[item]), max(1, self.edits[item] // 64)  # starts nearer to each other stand for the same place
            at = np.unique(starts // near * near)[:, None] + np.arange(n)
            rows += list(np.where((at >= 0) & (at < len(words)), words[np.clip(at, 0, len(words) - 1)], np.uint64(0)))
            place += [k] * len(at)
        length = np.array([len(r) for r in rows])
        windows = np.zeros((len(rows), length.max()), np.uint64)
        windows[np.arange(windows.shape[1]) < length[:, None]] = np.concatenate(rows)
        theirs, place = walked(windows, length, 3 * windows.shape[1]), np.array(place)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            draws = sampled_steps(3 * int(n), self.positions[int(n)])
            for some in np.array_split(own, -(-len(own) // 64)):
                mine = np.concatenate([self._embedded(self.words[places[k][0]].tobytes()) for k in place[some]], axis=1)
                out[place[some[collide(mine, theirs[: 3 * n, some], draws)]]] = True
        return out

    def hits(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, word at which the passage ends)."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        held: list[tuple[int, int, np.ndarray]] = []

        def judged() -> None:
            held.sort(key=lambda x: len(self.words[x[1]]))  # alike sizes are embedded together
            while held:
                some, size = [], 0
                while held and (not some or size < WINDOW_WORDS):
                    some.append(held.pop())
                    size += len(some[-1][2]) * len(self.words[some[0][1]])
                short = [(i, docs[d], x) for d, i, x in some if len(self.words[i]) < LONGEST]
                alike = iter(self.alike(short) if short else ())
                for doc, item, starts in some:
                    found = len(self.words[item]) >= LONGEST or next(alike)
                    if found:
                        d, low = self.edits[item], max(0, int(starts[0]) - self.edits[item])
                        n, end = nearest(self.words[item], docs[doc][low : max(0, int(starts[-1]) + len(self.words[item]) + 2 * d)])
                        if n <= d:
                            best[doc, item] = min(best.get((doc, item), (n, end + low)), (n, end + low))

        for doc, words in enumerate(docs):
            for item, starts in self.starts(self.places(words), 0, len(self.ids)):
                cuts = [0, *(np.flatnonzero(np.diff(starts) > len(self.words[item])) + 1).tolist(), len(starts)]
                held += [(doc, item, starts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                if len(held) > MOST_PLACES:
                    judged()
        judged()
        return [(doc, item, n, end) for (doc, item), (n, end) in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document and item found in it: doc_id, item_id, edits, item_words, similarity, end_word."""
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-int(size) // BLOCK_BYTES) or 1
    schema = "doc_id long, item_id long, edits long, item_words long, similarity double, end_word long"
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about BLOCK_BYTES
        index = Block([(r[0], r[1].encode()) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))], similarity)

        def batch(b: pa.RecordBatch, index: Block = index) -> pa.RecordBatch:
            found = index.hits([words_of(x) for x in texts_of(b["text"])])
            ids = b["doc_id"].to_pylist()
            n = [len(index.words[i]) for _, i, _, _ in found]
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[d] for d, _, _, _ in found], pa.int64()),
                    "item_id": pa.array([index.ids[i] for _, i, _, _ in found], pa.int64()),
                    "edits": pa.array([e for _, _, e, _ in found], pa.int64()),
                    "item_words": pa.array(n, pa.int64()),
                    "similarity": pa.array([1 - f[2] / m for f, m in zip(found, n, strict=True)], pa.float64()),
                    "end_word": pa.array([e for _, _, _, e in found], pa.int64()),
                }
            )

        part = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", batch, schema)
        if blocks > 1:
            part = staged(part)  # the driver keeps no block longer than its turn
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, with their columns."""
    hit = contaminated(docs, items, similarity).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long") == hit["hit_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
