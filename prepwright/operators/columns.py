"""Projections and row filters."""

from __future__ import annotations

import operator
from decimal import ROUND_FLOOR, Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepwright import kinds
from prepwright.kinds import as_double, col
from prepwright.operators.profile import correlated_pairs, fit_fences
from prepwright.session import attach

def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; unknown names are ignored."""
    return df.drop(*columns) if columns else df


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def sanitize_names(df: DataFrame) -> DataFrame:
    """Trim column names and replace blanks by underscores."""
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def _same(key, dtype: T.DataType) -> bool:
    """Whether a mapping's key can equal a value of the type: numbers equal numbers, text equals text."""
    number = isinstance(key, (int, float, Decimal)) and not isinstance(key, bool)
    if isinstance(dtype, T.IntegralType):
        return number and key == key // 1
    if isinstance(dtype, T.NumericType):
        return number
    if isinstance(dtype, T.StringType):
        return isinstance(key, str)
    return key is not None


def _mapped_type(dtype: T.DataType, targets: list) -> T.DataType:
    """The column's type if it can hold all targets, else double for numbers, else text."""
    targets = [t for t in targets if t is not None]
    numbers = all(isinstance(t, (int, float, Decimal)) and not isinstance(t, bool) for t in targets)
    if isinstance(dtype, T.NumericType):
        if not numbers:
            return T.StringType()
        whole = all(t == t // 1 and abs(t) < 1 << 31 for t in targets)
        return dtype if whole or not isinstance(dtype, T.IntegralType) else T.DoubleType()
    return dtype if isinstance(dtype, (T.StringType, T.BooleanType)) and all(
        isinstance(t, str if isinstance(dtype, T.StringType) else bool) for t in targets) or not targets else T.StringType()


def map_values(df: DataFrame, mapping: dict[str, dict]) -> DataFrame:
    """Replace exact values, all at once; unmatched values and unknown columns are kept.

    A value may become missing or of another type; the column then turns into text, or
    into double if all are numbers. The pairs are a table with one row per value, whatever
    their number. Keys that are no value of the column's type match nothing.
    """
    for name, pairs in mapping.items():
        if name not in df.columns:
            continue
        dtype = df.schema[name].dataType
        pairs = {k: v for k, v in pairs.items() if _same(k, dtype)}
        if not pairs:
            continue
        to = _mapped_type(dtype, list(pairs.values()))
        rows = [(str(k), None if v is None else str(v)) for k, v in pairs.items()]
        found, was = "_found", "_was"
        while {found, was} & set(df.columns):
            found, was = "_" + found, "_" + was
        dim = df.sparkSession.createDataFrame(rows, "k string, v string").select(
            F.col("k").try_cast("decimal(38,0)" if isinstance(dtype, T.IntegralType) else dtype).try_cast(dtype).alias(name),
            F.struct(F.col("v").cast(to).alias("to")).alias(found)).where(col(name).isNotNull()).dropDuplicates([name])
        order = df.columns
        df = attach(df, dim, [name]).withColumn(
            name, F.when(col(found).isNotNull(), F.col(found)["to"]).otherwise(col(name).cast(to))).select(*map(col, order))
    return df


def map_by_table(df: DataFrame, name: str, dim: DataFrame) -> DataFrame:
    """Replace values of a column through a (name, _to) table with one row per value."""
    order = df.columns
    return attach(df, dim, [name]).withColumn(name, F.coalesce("_to", col(name))).select(*map(col, order))


def drop_correlated(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Drop the second member of every pair correlated at or above the threshold."""
    second = correlated_pairs(df, threshold).select("col_b").distinct().collect()
    return df.drop(*[r["col_b"] for r in second])


# ---- filters ------------------------------------------------------------------------


# The comparison operators.
COMPARISONS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def _against_whole(c: Column, sign: str, value: Decimal, dtype: T.DataType) -> Column:
    """Compare a column of whole numbers with any number, in the column's own type so that it can be pushed down."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[dtype.simpleString()]
    whole = value.to_integral_value(ROUND_FLOOR) if value.is_finite() else value
    if sign in ("==", "!=") and (whole != value or not -(1 << bits - 1) <= whole < 1 << bits - 1):
        return F.lit(sign == "!=")
    if not -(1 << bits - 1) <= whole < 1 << bits - 1:
        return c.isNotNull() if (whole > 0) == (sign in ("<", "<=")) else F.lit(False)
    if whole != value:   # between two whole numbers
        sign = {">=": ">", "<": "<="}.get(sign, sign)
    return COMPARISONS[sign](c, F.lit(int(whole)).cast(dtype))


def filter_rows(df: DataFrame, column: str, sign: str, value: str) -> DataFrame:
    """Keep rows satisfying ``column sign value``.

    Numeric columns compare as numbers, whole and decimal ones exactly, others by their own
    type; ``!=`` keeps missing values, which NaN is too, and all else drops them; ``contains``
    is a case-sensitive regular-expression search.
    """
    kinds.require(df, column)
    c, dtype = col(column), df.schema[column].dataType
    if sign == "contains":
        return df.where(F.coalesce(c.cast("string").rlike(str(value)), F.lit(False)))
    if sign not in COMPARISONS:
        raise ValueError(f"no comparison is named {sign!r}")
    if not isinstance(dtype, T.NumericType):
        fits = COMPARISONS[sign](c, F.lit(value).cast(dtype))
        return df.where(fits | c.isNull() if sign == "!=" else fits)
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        raise ValueError(f"{column} is compared with numbers only, not with {value!r}") from None
    if number.is_nan():
        return df.where(F.lit(sign == "!="))
    if isinstance(dtype, T.IntegralType):
        fits = _against_whole(c, sign, number, dtype)
    elif isinstance(dtype, T.DecimalType) and number.is_finite():
        fits = COMPARISONS[sign](c, F.lit(number))
    else:
        fits = COMPARISONS[sign](c, F.lit(float(number)))
        if sign in (">", ">="):
            fits = fits & ~F.isnan(c)   # Spark takes NaN for the largest number
    return df.where(fits | c.isNull() if sign == "!=" else fits)


def drop_missing(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(how, subset=subset)


def iqr_outlier_rows(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows strictly outside the interquartile fence of one column."""
    kinds.require(df, column)
    fence = fit_fences(kinds.nan_to_null(df), [column], factor).get(column)
    if fence is None:
        return df.where(F.lit(False))
    return df.where(((col(column) < F.lit(fence[0])) | (col(column) > F.lit(fence[1]))) & ~F.isnan(as_double(column)))


def zscore_outlier_rows(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows more than ``threshold`` population deviations from the mean."""
    kinds.require(df, column)
    mean, sd = kinds.nan_to_null(df).agg(F.avg(as_double(column)), F.stddev_pop(as_double(column))).first()
    if sd is None or sd < 1e-8:
        return df.where(F.lit(False))
    return df.where((F.abs((as_double(column) - F.lit(mean)) / F.lit(sd)) > threshold) & ~F.isnan(as_double(column)))
