"""Generated features: date parts, logs, z-scores and group means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.kinds import as_double, col
from prepwright.session import attach


def date_parts(df: DataFrame) -> DataFrame:
    """Year, month, day and weekday (Monday = 0) of every datetime column."""
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": F.weekday}
    return df.withColumns({f"{c}_{p}": make(col(c)) for c in kinds.datetime(df) for p, make in parts.items()})


def log_features(df: DataFrame) -> DataFrame:
    """ln(1 + x) for columns that are positive on every row; a missing value is not."""
    df = kinds.nan_to_null(df)
    names = kinds.numeric(df)
    if not names:
        return df
    row = df.agg(*[F.every(F.coalesce(as_double(c) > 0, F.lit(False))).alias(f"p{i}")
                   for i, c in enumerate(names)]).first()
    return df.withColumns({f"{c}_log": F.log1p(as_double(c)) for i, c in enumerate(names) if row[i]})


def zscore_features(df: DataFrame) -> DataFrame:
    """(x - mean) / sample deviation for columns that vary."""
    df = kinds.nan_to_null(df)
    names = kinds.numeric(df)
    if not names:
        return df
    row = df.agg(*[a for i, c in enumerate(names) for a in (
        F.avg(as_double(c)).alias(f"m{i}"), F.stddev_samp(as_double(c)).alias(f"s{i}"),
        (F.max(as_double(c)) > F.min(as_double(c))).alias(f"v{i}"))]).first()
    return df.withColumns({
        f"{c}_z": (as_double(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"])
        for i, c in enumerate(names) if row[f"v{i}"] and row[f"s{i}"]})


def group_means(df: DataFrame, key: str | None = None) -> DataFrame:
    """Mean of every numeric column per value of the first text column.

    The means are aggregated map-side and joined back, so a value holding a large share
    of the rows is never gathered in one window partition. A missing key gets no mean.
    """
    df = kinds.nan_to_null(df)
    key = key or next(iter(kinds.text(df)), None)
    names = kinds.numeric(df)
    if key is None or not names:
        return df
    means = df.where(col(key).isNotNull()).groupBy(col(key)).agg(
        *[F.avg(as_double(c)).alias(f"{key}_{c}_grpmean") for c in names])
    return attach(df, means, [key]).select(*map(col, df.columns), *[col(f"{key}_{c}_grpmean") for c in names])


def basic_features(df: DataFrame) -> DataFrame:
    """Date parts, logs, z-scores and group means; each step sees the columns before it."""
    return df.transform(date_parts).transform(log_features) \
        .transform(zscore_features).transform(group_means)
