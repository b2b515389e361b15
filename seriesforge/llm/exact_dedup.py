"""Exact deduplication: one row of every group of equal texts stays.

Texts are equal when they are identical after deleting ASCII white space. Each
row gets a 128-bit content hash (half of its SHA-256). Only texts whose hash
occurs more than once go on: a bit table of fixed size, set where hashes repeat
and broadcast, picks them out of the documents, and they are grouped by hash
*and* bytes, so two texts that only share a hash never merge. Copies collapse
inside each map task before anything is shuffled.

Rows then find their group by hash. The few groups that hold more than a fixed
share of all rows are broadcast (their number is bounded by that share), so no
task reads a hot group; all other groups are small against a task.

Defined results: a null text counts as empty; empty texts form one group; ties
go to the smallest id, a null one last; repeated rows with one id count as rows
of the group; an empty table gives an empty result; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import looked_up, staged, table

#: ASCII white space, deleted before texts are compared.
SPACE = " \t\n\x0b\x0c\r"
#: Bits of the table of repeated hashes: 8 MB, whatever the input.
BITS = 1 << 26


def _normal(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def _bit(norm: Column) -> Column:
    return F.pmod(F.xxhash64(norm), F.lit(BITS)) + 1


def repeated_texts(docs: DataFrame, rows: DataFrame, text: Column) -> DataFrame:
    """Rows of docs whose bit is that of a repeated hash: id, n, norm."""
    bits = rows.groupBy("h", "bit").agg(F.count("*").alias("n")).where("n > 1").distinct()
    bits = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    held = docs.select(F.col("id"), F.char_length(text).alias("n"), _normal(text).alias("norm"))
    held = held.withColumn("bucket", F.bitmap_bucket_number(_bit(F.col("norm")))).withColumn("at", F.bitmap_bit_position(_bit(F.col("norm"))))
    byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.join(F.broadcast(bits), "bucket").where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1).select("id", "n", "norm")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.

    The row with the most code points in its original text stays, then the
    smallest id.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sha = lambda norm: F.unhex(F.sha2(norm, 256))
    rows = docs.select("id", _normal(F.col("text")).alias("norm")).select("id", sha("norm").alias("sha"), _bit(F.col("norm")).alias("bit"))
    rows = staged(rows.withColumn("h", F.substring("sha", 1, 16)))
    # The key holds the bytes: equal keys are equal texts.
    classes = repeated_texts(docs, rows, F.col("text")).withColumn("sha", sha("norm")).groupBy(F.substring("sha", 1, 16).alias("h"), "norm").agg(
        F.min(F.struct((-F.col("n")).alias("less"), F.col("id").isNull(), F.col("id").alias("id"))).alias("best"),
        F.count("*").alias("group_size"),
        F.first("sha").alias("sha"),
    )
    # Rows find their class by all 256 bits; should two different texts ever
    # share them, the job fails instead of merging them.
    by_hash = classes.groupBy("sha").agg(F.first("best.id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count("*").alias("texts"))
    by_hash = staged(by_hash.where("group_size > 1 or texts > 1").withColumn("found", F.lit(True)))
    rows = looked_up(rows.select("id", "sha"), by_hash, "sha", "group_size", "left")
    keep_id = F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("id"))
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.col("texts") > 1, F.raise_error("different texts share all hashes").cast("long")).otherwise(keep_id).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns; of rows with the same id and equal texts, one."""
    keep = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    held = docs.withColumn("_sha", F.sha2(_normal(F.coalesce(F.col(text_col), F.lit(""))), 256))
    held = held.join(keep, held[id_col].eqNullSafe(keep["_keep_id"]) & (held["_sha"] == keep["_keep_sha"]), "left_semi")
    return held.dropDuplicates([id_col, "_sha"]).drop("_sha")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM k WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
