"""Sharding by a permutation-filled lookup table.

Shards take turns claiming free slots of a prime-sized table, each in its own
preference order, so every shard owns the same number of slots give or take
one, and taking a shard away moves few of the others' slots. The table is a
constant of the query (a fixed 65,537 small integers), so placing a row is one
array access inside whole-stage code: no shuffle, no Python, nothing that grows
with the data. A hot source is spread, as the key is the document id.

Defined results: a null key goes where the empty string goes; equal keys go to
one shard; an empty table gives an empty result; further columns are carried, but
columns named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import table

#: Slots of the table; prime, and far more than shards so that shares differ little.
SLOTS = 65_537
SHARDS = 64


@lru_cache(maxsize=8)
def claimed(names: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """The slot table: at each slot the index of the shard that owns it."""
    if not names or len(names) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, and at least as many as shards")
    digest = [hashlib.md5(x.encode()).digest() for x in names]
    position = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    owner, free = [-1] * slots, slots
    while True:
        for i in range(len(names)):
            while owner[position[i]] >= 0:
                position[i] = (position[i] + skip[i]) % slots
            owner[position[i]] = i
            free -= 1
            if not free:
                return tuple(owner)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5, modulo the table's size; DuckDB can say the same."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def placed(df: DataFrame, key: str, names: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """The rows with ``slot`` and ``shard``."""
    owners = F.split(F.lit(",".join(map(str, claimed(names, slots)))), ",").cast("array<int>")
    return df.withColumn("slot", slot_of(F.col(key), slots)).withColumn("shard", F.get(owners, F.col("slot").cast("int")))


def write_shards(df: DataFrame, key: str, names: tuple[str, ...], path: str, slots: int = SLOTS) -> None:
    """One folder a shard; rows are dealt by shard and key, so no task gets a whole shard."""
    out = placed(df, key, names, slots)
    out.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(n))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return placed(docs, "doc_id", shard_names())


def oracle() -> str:
    """Placement in SQL; the table itself is tested apart, slot by slot."""
    owners = ",".join(map(str, claimed(shard_names())))
    return f"""
WITH t AS (SELECT [{owners}]::INT[] AS owners),
s AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, owners[slot + 1] AS shard FROM s, t
"""
