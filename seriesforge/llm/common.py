"""What the operators of this subpackage share: Arrow batches, word hashing, folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.staging import Scratch, new_path, staged  # noqa: F401 - used by the operators beside this module

#: A key that holds at least this part of all rows is hot; there are at most as many of them as this number says.
HOT_PART = 2_000
#: Keys of fewer rows are never hot.
HOT_ROWS = 1_000
#: Bytes of text that a Python worker handles at once, whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``most`` bytes of the column."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def release() -> None:
    """Gives the memory of a finished task back: workers live on, and what they keep adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other allocators do without
    if trim:
        trim(0)


def map_rows(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """``fn`` on every slice of the rows, as Arrow data inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, most):
            yield fn(part)
            del part
        release()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a fresh array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words; with fewer words, of the whole sequence; empty for none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mixed(out + hashes[i : n - size + 1 + i] + np.uint64(0x9E3779B97F4A7C15 * (size + 1) % 2**64))
    return out


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sampled(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, chosen by hashes of their key.

    A share of the hashes that holds about three times as many is cut out first,
    so that all tasks together, however many, send a bounded number on.
    """
    share = min(1.0, 3 * rows / max(df.count(), 1))
    part = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    return part.orderBy(F.xxhash64(F.lit("order"), key), key).limit(rows)


def looked_up(rows: DataFrame, per_key: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a staged table of one row for each key, whose ``count`` says how many rows hold it.

    Hot keys, of a bounded number, are broadcast, so no task reads all rows of one; other keys are small against a task.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) >= max(HOT_ROWS, total // HOT_PART)
    hot, others = F.broadcast(per_key.where(is_hot)), per_key.where(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(others, key, how))


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read from there: smaller than a checkpoint, and columns are read alone."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_table(letters: bytes) -> bytes:
    """A table for ``bytes.translate``: these ASCII letters, A-Z lower-cased, and all beyond ASCII stay; the rest becomes a space."""
    return bytes(c + 32 if 65 <= c <= 90 and c in letters else c if c >= 128 or c in letters else 32 for c in range(256))
