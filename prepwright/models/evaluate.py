"""Scores of predictions, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.kinds import as_double, col
from prepwright.operators.encode import _numbered
from prepwright.session import cut_lineage


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for every pair of the labels seen on either side.

    The matrix is made of rows: labels are numbered, and each meets all numbers. Only the
    number of labels reaches the driver.
    """
    pairs = cut_lineage(df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted")).agg(F.count("*").alias("n")))
    seen = pairs.select(F.col("actual").alias("l")).union(pairs.select("predicted")).where("l is not null").distinct()
    codes = cut_lineage(_numbered(seen.withColumn("_o", F.col("l")), "_o", "l"))
    size = codes.count()
    grid = codes.select(F.col("l").alias("actual"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(size - 1, 0)).cast("long"))).alias("_code")).join(
        codes.withColumnRenamed("l", "predicted"), "_code").select("actual", "predicted", F.lit(0).cast("long").alias("n"))
    return pairs.where("actual is not null and predicted is not null").unionByName(grid).groupBy(
        "actual", "predicted").agg(F.sum("n").alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((col(actual) == col(predicted)).cast("double")).alias("accuracy"))


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    gap = as_double(actual) - as_double(predicted)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def r2(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """1 - residual over total sum of squares."""
    gap = as_double(actual) - as_double(predicted)
    row = df.agg(F.sum(gap * gap).alias("res"), (F.var_pop(as_double(actual)) * F.count(col(actual))).alias("tot"))
    return row.select((1 - F.try_divide("res", "tot")).alias("r2"))
