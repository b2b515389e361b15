"""Vectors kept in order unless one like them was kept before, decided block by block.

The greedy rule is sequential: a row falls if a kept earlier row lies near. So
rows are decided in blocks of their order. A block of each key is folded in one
task; the rows it keeps, a bounded number of bytes, are broadcast, and all later
rows of the key that lie near one of them fall at once, in all tasks side by
side. What is left makes the next block. Every round decides at least a block
of each key, so there are at most as many rounds as blocks, and no table of
pairs is ever made.

Keys of no more rows than a block need no round at all: one grouped fold decides
them. Longer keys, of which there are at most rows / block, share rounds; they
are dealt to batches by hash, so that what one round broadcasts stays below
``MOST_BYTES``.

Distances are sums of absolute differences in the order of the elements, divided
by their number; each sum is taken in that order, so results do not depend on
blocks. Rows without a vector, empty vectors and vectors with nulls lie near
nothing and stay; vectors of different lengths never lie near each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesforge.functions.ranking import positioned
from seriesforge.functions.staging import new_path, staged

#: Rows of a key that one task folds.
BLOCK = 2048
#: Positions counted as one when a block is cut; at most a block.
BUCKET = 256
#: Kept rows that a round broadcasts, in bytes.
MOST_BYTES = 32 << 20
#: Long keys up to this number are told to all tasks; beyond, they are joined.
LONG_KEYS = 100_000


def matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors as columns: (elements, rows)."""
    rows = len(vectors)
    return np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).T)


def near(columns: np.ndarray, one: np.ndarray, least: float) -> np.ndarray:
    """Which columns lie at most ``least`` from one of them."""
    return np.add.reduce(np.abs(columns - one[:, None]), axis=0) / len(one) <= least


def folded(columns: np.ndarray, least: float) -> np.ndarray:
    """Which columns the greedy rule keeps, in their order."""
    keep, alive = np.zeros(columns.shape[1], bool), np.arange(columns.shape[1])
    while len(alive):
        first, alive = alive[0], alive[1:]
        keep[first] = True
        alive = alive[~near(columns[:, alive], columns[:, first], least)]
    return keep


def far_from_all(columns: np.ndarray, kept: np.ndarray, least: float) -> np.ndarray:
    """Places of the columns that lie near none of the kept ones."""
    alive = np.arange(columns.shape[1])
    for one in kept:
        if not len(alive):
            break
        alive = alive[~near(columns[:, alive], one, least)]
    return alive


def _alike(a: list[str], b: DataFrame) -> Column:
    out = F.lit(True)
    for k in a:
        out = out & F.col(k).eqNullSafe(b[f"_of_{k}"])
    return out


def _block(rows: DataFrame, keys: list[str], block: int) -> tuple[list, int]:
    """The last bucket of every key's next block, and the most rows that any key has left."""
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    counts = counts.withColumn("_sum", F.sum("_n").over(w.orderBy("_bucket"))).withColumn("_all", F.sum("_n").over(w))
    ends = counts.where(F.col("_sum") <= block).groupBy(*keys).agg(F.max("_bucket").alias("_end"), F.max("_all").alias("_all")).collect()  # the long keys of a batch
    return ends, max((r["_all"] for r in ends), default=0)


def kept_in_order(df: DataFrame, key: list[str], order: list[str], vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """Rows whose vector lies more than ``least`` from every kept earlier one of their key."""
    spark = df.sparkSession
    held = df.withColumn("_vector", F.col(vector).cast("array<double>"))
    rows = positioned(held, [*key, *order, "_vector"], "_position").withColumn("_bucket", F.floor(F.col("_position") / min(BUCKET, block)))
    usable = F.coalesce((F.size("_vector") > 0) & ~F.exists("_vector", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    keys = [*key, "_dim"]
    some = rows.where(usable).withColumn("_dim", F.size("_vector")).select(*keys, "_position", "_bucket", "_vector")
    schema = some.schema
    path = new_path(spark)

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by("_position").combine_chunks()
        return group.filter(pa.array(folded(matrix(group["_vector"].combine_chunks()), least)))

    def write(out: DataFrame) -> None:
        out.select("_position").write.mode("append").parquet(path)

    sizes = some.groupBy(*keys).agg(F.count("*").alias("_all"))
    long_keys = staged(sizes.where(F.col("_all") > block))
    n, dim = long_keys.agg(F.count("*"), F.max("_dim")).first()
    named = long_keys.select(*(F.col(k).alias(f"_of_{k}") for k in keys))
    told = F.broadcast(named) if n <= LONG_KEYS else named
    write(some.join(told, _alike(keys, named), "left_anti").groupBy(*keys).applyInArrow(fold, schema))
    batches = max(1, math.ceil(n * block * (dim or 0) * 8 / MOST_BYTES)) if n else 0
    batch = F.pmod(F.xxhash64(*keys), F.lit(max(batches, 1)))
    for i in range(batches):
        left = staged(some.where(batch == i).join(told, _alike(keys, named), "left_semi"))
        while True:
            ends, most = _block(left, keys, block)
            if not ends:
                break
            upto = spark.createDataFrame([tuple(r[k] for k in [*keys, "_end"]) for r in ends], ", ".join(f"`_of_{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in keys) + ", _end long")
            marked = left.join(F.broadcast(upto), _alike(keys, upto)).drop(*(f"_of_{k}" for k in keys))
            kept = staged(marked.where("_bucket <= _end").drop("_end").groupBy(*keys).applyInArrow(fold, schema))
            write(kept)
            if most <= block:
                break
            seen: dict[tuple, np.ndarray] = {}
            for r in kept.select(*keys, "_vector").toLocalIterator():  # MOST_BYTES at most
                seen.setdefault(tuple(r[k] for k in keys), []).append(r["_vector"])
            shared = spark.sparkContext.broadcast({k: np.array(v) for k, v in seen.items()})

            def later(parts):
                for part in parts:
                    owner = list(zip(*(part[k].to_pylist() for k in keys)))
                    stay = np.zeros(part.num_rows, bool)
                    for k in set(owner):
                        own = np.flatnonzero([o == k for o in owner])
                        stay[own[far_from_all(matrix(part["_vector"].take(pa.array(own))), shared.value[k], least)]] = True
                    yield part.filter(pa.array(stay))

            left = staged(marked.where("_bucket > _end").drop("_end").mapInArrow(later, schema))
    chosen = spark.read.schema("_position long").parquet(path)
    out = rows.where(usable).join(chosen, "_position", "left_semi").unionByName(rows.where(~usable))
    return out.drop("_vector", "_position", "_bucket")
