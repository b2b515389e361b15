"""Scores of regressions and models over feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.quantiles import with_key_values
from seriesforge.functions.staging import staged
from seriesforge.operators.diverse import kept_in_order
from seriesforge.operators.forest import grown, predictions


def regression_metrics(df: DataFrame, group: str) -> DataFrame:
    """One row: R2 (mean over outputs), MAE (over all), RMSE (root of the mean over outputs of MSE).

    Rows are (output, y, p). Sums alone decide, so one pass over the rows does;
    sums of squares are taken around each output's mean, found first.
    """
    means = staged(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg("y").alias("_m"), F.count("*").alias("_rows")))
    rows = with_key_values(df, means, [group], "_rows")
    e = F.col("y") - F.col("p")
    per = rows.groupBy(group).agg(F.sum(e * e).alias("sse"), F.sum((F.col("y") - F.col("_m")) ** 2).alias("sst"), F.sum(F.abs(e)).alias("sae"), F.count("*").alias("n"))
    return per.agg(
        F.avg(1 - F.col("sse") / F.col("sst")).alias("r2"), (F.sum("sae") / F.sum("n")).alias("mae"), F.sqrt(F.avg(F.col("sse") / F.col("n"))).alias("rmse")
    )


def principal_components(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Adds ``pc``: the first components of the centred vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = Pipeline(stages=[StandardScaler(withStd=False, withMean=True, inputCol="_v", outputCol="_c"), PCA(k=k, inputCol="_c", outputCol="_p")]).fit(rows)
    return model.transform(rows).withColumn("pc", vector_to_array("_p")).drop("_v", "_c", "_p")


def forest_predictions(train: DataFrame, test: DataFrame, vector: str, targets: list[str], trees: int = 100, seed: int = 42) -> DataFrame:
    """``test`` with a prediction for every target, from one forest for all of them."""
    return predictions(test, vector, targets, grown(train, vector, targets, trees, seed=seed))


def shape_error(a: F.Column, b: F.Column) -> F.Column:
    """Mean absolute difference of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def near_shapes(df: DataFrame, order: str, vector: str, most: float, key: list[str] | None = None) -> DataFrame:
    """(a, b) with a < b: vectors of one key at most ``most`` apart.

    Two vectors' means, and their distances from a third vector, differ by no
    more than the two are apart. So vectors meet only in cells of that width of
    the mean and of the distance from a pivot (the first vector of all), their
    own or those beside it, and a second pivot (the vector farthest from the
    first) rules out pairs before they are compared.
    """
    keys = key or []
    v = F.col(vector).cast("array<double>")
    rows = df.select(*keys, F.col(order).cast("long").alias("_id"), v.alias("_v"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).alias("_m"))
    first = rows.agg(F.min_by("_v", "_id").alias("v")).head()["v"]
    if first is None:
        return rows.select(F.col("_id").alias("a"), F.col("_id").alias("b")).where("false")
    away = lambda pivot: shape_error(F.col("_v"), F.array(*map(F.lit, pivot)))
    last = rows.agg(F.max_by("_v", F.struct(away(first), "_id")).alias("v")).head()["v"]
    slack = most * (1 + 1e-9) + 1e-12  # sums round
    rows = rows.withColumn("_q", away(last)).withColumn("_i", F.floor(F.col("_m") / slack)).withColumn("_j", F.floor(away(first) / slack))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    left = rows.withColumn("_s", around).select(*keys, F.col("_id").alias("a"), F.col("_v").alias("_va"), F.col("_q").alias("_qa"), (F.col("_i") + F.col("_s.i")).alias("_i"), (F.col("_j") + F.col("_s.j")).alias("_j"))
    right = rows.select(*keys, F.col("_id").alias("b"), F.col("_v").alias("_vb"), F.col("_q").alias("_qb"), "_i", "_j")
    pairs = left.join(right, [*keys, "_i", "_j"]).where(F.col("a") < F.col("b")).where(F.abs(F.col("_qa") - F.col("_qb")) <= slack)
    return pairs.where(shape_error(F.col("_va"), F.col("_vb")) <= most).select("a", "b")


def unique_in_order(df: DataFrame, key: list[str], order: str, vector: str, least: float) -> DataFrame:
    """Rows whose vector lies more than ``least`` from every kept earlier one of their key: key, order."""
    return kept_in_order(df.select(*key, order, vector), key, [order], vector, least).select(*key, order)
