"""Exact quantiles and per-key lookups that no key, however many rows it holds, brings into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesforge.functions.staging import staged

#: A key that holds at least this part of all rows is hot; there are at most as many of them as this number says.
HOT_PART = 2_000
#: Keys of fewer rows are never hot.
HOT_ROWS = 1_000


def same_key(key: list[str], a: DataFrame, b: DataFrame) -> Column:
    """Whether keys are equal, null ones too."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key], F.lit(True))


def with_key_values(rows: DataFrame, per_key: DataFrame, key: list[str], count: str) -> DataFrame:
    """``rows`` with the columns of ``per_key``, a staged table of one row for each key, whose ``count`` says how many rows hold it.

    Rows of hot keys, of a bounded number, find theirs in a broadcast; other keys are small against a task.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) >= max(HOT_ROWS, total // HOT_PART)
    named = per_key.select(*(F.col(k).alias(f"_key_{k}") for k in key), *(c for c in per_key.columns if c not in key))
    found = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key], F.lit(True))
    held = lambda left, right: left.join(right, found).drop(*(f"_key_{k}" for k in key))
    hot = F.broadcast(named.where(is_hot))
    others = rows.join(hot.select(*(f"_key_{k}" for k in key)), found, "left_anti")
    return held(rows, hot).unionByName(held(others, named.where(~is_hot)))


def exact_quantiles(df: DataFrame, key: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key, the quantiles of its values by name, between two values in proportion; keys without a value are left out.

    Different values are counted, sorted in ranges of all keys together and
    staged; counts of a key's ranges, of which there are as many as shuffle
    partitions, say which values hold the ranks that are asked for.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    rows = staged(counted.orderBy(*key, "_v").withColumn("_range", F.spark_partition_id()))
    rows = rows.withColumn("_sum", F.sum("_n").over(W.partitionBy("_range", *key).orderBy("_v")))
    of_key = W.partitionBy(*key)
    ranges = rows.groupBy("_range", *key).agg(F.sum("_n").alias("_of"))
    ranges = ranges.withColumn("_before", F.sum("_of").over(of_key.orderBy("_range")) - F.col("_of")).withColumn("_all", F.sum("_of").over(of_key)).drop("_of")
    named = ranges.select(*(F.col(c).alias(f"_of_{c}") for c in ["_range", *key]), "_before", "_all")
    found = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ["_range", *key]])
    rows = rows.join(named, found)
    first, last = F.col("_before") + F.col("_sum") - F.col("_n"), F.col("_before") + F.col("_sum") - 1
    parts = {}
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_all") - 1)
        low, high = F.floor(at), F.ceil(at)
        weight = F.when(low.between(first, last), 1.0 - (at - low)).otherwise(0.0) + F.when((high > low) & high.between(first, last), at - low).otherwise(0.0)
        parts[name] = F.sum(F.when(weight > 0, weight * F.col("_v"))).alias(name)
    return rows.groupBy(*key).agg(*parts.values())
