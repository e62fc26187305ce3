"""Repeatable samples and train/test splits, exact in size and independent of partitioning.

Rows are ordered by md5(seed | key). The wanted number of smallest hashes is found as a
threshold per class: counts by hash prefix combine map-side, a window over those bounded
counts finds the prefix that holds the threshold, and only that prefix is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.kinds import col
from prepwright.session import attach

ROWS_PER_PREFIX = 1_000


def hash_of(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string")))


def _prefix_digits(rows: int) -> int:
    """Hex digits that leave about ROWS_PER_PREFIX rows per prefix; at most 16**5 prefixes."""
    return min(5, max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_PREFIX, 16)) if rows > ROWS_PER_PREFIX else 1))


def fit_thresholds(df: DataFrame, label: Column, key: str, seed: int, quota: Column) -> DataFrame:
    """(label, hash, key) of the last row to take per label; ``quota`` is computed from ``_n``."""
    rows = df.select(label.alias("_label"), hash_of(key, seed).alias("_h"), col(key).alias("_k"))
    digits = _prefix_digits(df.count())
    rows = rows.withColumn("_prefix", F.substring("_h", 1, digits))
    counts = rows.groupBy("_label", "_prefix").agg(F.count("*").alias("_c"))
    by_label = W.partitionBy("_label")
    counts = counts.withColumns({
        "_n": F.sum("_c").over(by_label),
        "_before": F.sum("_c").over(by_label.orderBy("_prefix")) - F.col("_c")})
    edge = counts.withColumn("_need", quota - F.col("_before")).where(
        (F.col("_need") > 0) & (F.col("_need") <= F.col("_c"))).select(
        "_label", F.col("_prefix").alias("_edge"), "_need")
    near = attach(rows, edge, ["_label"]).where(F.col("_prefix") == F.col("_edge"))
    rank = F.row_number().over(by_label.orderBy("_h", "_k"))
    return near.withColumn("_r", rank).where(F.col("_r") == F.col("_need")).select("_label", "_h", "_k")


def _within(df: DataFrame, label: Column, key: str, seed: int, last: DataFrame, flag: str) -> DataFrame:
    last = last.select("_label", F.struct("_h", "_k").alias("_last"))
    marked = attach(df.withColumn("_label", label), last, ["_label"])
    mine = F.struct(hash_of(key, seed).alias("_h"), col(key).alias("_k"))
    return marked.select(*map(col, df.columns),
                         F.coalesce(mine <= F.col("_last"), F.lit(False)).alias(flag))


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows; all rows if there are no more, or n is not positive."""
    kinds.require(df, key)
    if n <= 0:
        return df
    one = F.lit(0)
    last = fit_thresholds(df, one, key, seed, F.least(F.lit(n), F.col("_n")))
    return _within(df, one, key, seed, last, "_picked").where("_picked").drop("_picked")


def first_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First n rows in a stated order; no limit if n is not positive."""
    kinds.require(df, *order_by)
    return df.orderBy(*map(col, order_by)).limit(n) if n > 0 else df


def stratified_split(df: DataFrame, target: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * class size) rows of every class."""
    kinds.require(df, target, key)
    label = F.coalesce(F.concat(F.lit("="), col(target).cast("string")), F.lit(""))
    # The product is rounded first so that 0.2 * 10 stays 2.
    quota = F.ceil(F.round(F.col("_n") * F.lit(share), 9))
    return _within(df, label, key, seed, fit_thresholds(df, label, key, seed, quota), "is_test")


def random_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * rows) of all rows."""
    kinds.require(df, key)
    one, quota = F.lit(0), F.ceil(F.round(F.col("_n") * F.lit(share), 9))
    return _within(df, one, key, seed, fit_thresholds(df, one, key, seed, quota), "is_test")
