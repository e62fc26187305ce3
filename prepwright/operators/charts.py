"""The bounded aggregates and samples that charts draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.kinds import as_double, col
from prepwright.operators import profile
from prepwright.operators.quantiles import group_quantiles
from prepwright.operators.sampling import sample
from prepwright.session import attach


def histogram_data(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n) in left-closed equal bins, or (value, n) for a text column."""
    kinds.require(df, column)
    df = kinds.nan_to_null(df)
    if column not in kinds.numeric(df):
        return df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).agg(
            F.count("*").alias("n"))
    span = profile.fit_ranges(df, [column])[column]
    low, width = (0.0, 1.0) if span is None else (span[0], (span[1] - span[0]) / bins or 1.0)
    place = F.least(F.floor((as_double(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = df.where(col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n")


def box_data(df: DataFrame, y: str, group: str | None = None) -> DataFrame:
    """(grp, n, q25, q50, q75, whisker_lo, whisker_hi, outliers) per group.

    Quartiles of all groups are located together, so a large group needs no task of its own.
    """
    kinds.require(df, y)
    df = kinds.nan_to_null(df)
    key = col(group).cast("string") if group else F.lit("all")
    df = df.select(key.alias("grp"), as_double(y).alias("y")).where("y is not null and grp is not null")
    box = group_quantiles(df, "grp", "y", [0.25, 0.5, 0.75]).selectExpr("grp", "q[0] as q25", "q[1] as q50", "q[2] as q75").selectExpr(
        "*", "q25 - 1.5D * (q75 - q25) as _lo", "q75 + 1.5D * (q75 - q25) as _hi")
    inside = (F.col("y") >= F.col("_lo")) & (F.col("y") <= F.col("_hi"))
    return attach(df, box, ["grp"]).groupBy("grp", "q25", "q50", "q75").agg(
        F.count("*").alias("n"), F.min(F.when(inside, F.col("y"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("y"))).alias("whisker_hi"), F.count_if(~inside).alias("outliers"))


def bar_data(df: DataFrame, x: str, y: str, top_k: int | None = None) -> DataFrame:
    """(x, total): sum of y per x, largest first, all bars unless ``top_k`` is given."""
    kinds.require(df, x, y)
    totals = kinds.nan_to_null(df).groupBy(col(x).alias("x")).agg(F.sum(as_double(y)).alias("total"))
    totals = totals.orderBy(F.desc("total"), "x")
    return totals.limit(top_k) if top_k else totals


def line_data(df: DataFrame, x: str, y: str, unit: str = "day") -> DataFrame:
    """(x, y): mean of y per time unit, or per x value if x is not a time, in order of x."""
    kinds.require(df, x, y)
    key = F.date_trunc(unit, col(x)) if x in kinds.datetime(df) else col(x)
    return kinds.nan_to_null(df).groupBy(key.alias("x")).agg(
        F.avg(as_double(y)).alias("y"), F.count("*").alias("n")).orderBy("x")


def scatter_data(df: DataFrame, x: str, y: str, key: str, points: int = 0) -> DataFrame:
    """All points, or a repeatable sample of ``points``."""
    kinds.require(df, x, y)
    return sample(df, points, key).select(col(key), col(x), col(y))


def heatmap_data(df: DataFrame) -> DataFrame:
    if not kinds.numeric(df):
        raise ValueError("a heatmap takes one number column or more")
    return profile.correlation_matrix(df).withColumn("corr", F.round("corr", 2) + F.lit(0.0))


def pair_data(df: DataFrame, columns: list[str], key: str, points: int = 0) -> DataFrame:
    """All rows of the columns, or a repeatable sample of ``points``."""
    if not columns:
        raise ValueError("a pair plot takes one column or more")
    return sample(df, points, key).select(col(key), *[col(c) for c in columns if c != key])


def chart_data(df: DataFrame, kind: str, x: str, y: str | None = None, key: str | None = None,
               strict: bool = True) -> DataFrame:
    """Data of a named chart; an unknown kind is an error, or a scatter if not ``strict``."""
    kind = kind.lower().split()[0] if kind.strip() else kind
    if kind == "histogram":
        return histogram_data(df, x)
    if kind == "bar":
        return bar_data(df, x, y)
    if kind == "line":
        return line_data(df, x, y)
    if kind == "box":
        return box_data(df, y or x, x if y else None)
    if kind == "heatmap" and not strict:
        return heatmap_data(df)
    if kind == "scatter" or not strict:
        return scatter_data(df, x, y, key or x)
    raise ValueError(f"no chart is named {kind!r}")
