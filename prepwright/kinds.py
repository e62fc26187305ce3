"""Column kinds, shared by every operator, and the one missing-value convention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col(q(name))


def q(name: str) -> str:
    """Quoted name for SQL text. Fits over many columns are written as SQL text: building
    hundreds of Column objects costs far more round trips than parsing one list."""
    return "`" + name.replace("`", "``") + "`"


def num(name: str) -> str:
    return f"cast({q(name)} as double)"


def lit(value: float | None) -> str:
    """SQL text of a double."""
    if value is None:
        return "cast(null as double)"
    value = float(value)
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


def text_lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pick(schema: T.StructType, *types: type) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, types)]


def numeric(df: DataFrame) -> list[str]:
    return _pick(df.schema, T.NumericType)


def integral(df: DataFrame) -> list[str]:
    return _pick(df.schema, T.IntegralType)


def text(df: DataFrame) -> list[str]:
    return _pick(df.schema, T.StringType)


def datetime(df: DataFrame) -> list[str]:
    return _pick(df.schema, T.TimestampType, T.TimestampNTZType, T.DateType)


def categorical(df: DataFrame) -> list[str]:
    """Everything that is not numeric."""
    nums = set(numeric(df))
    return [c for c in df.columns if c not in nums]


def comparable(df: DataFrame) -> list[str]:
    """Columns that can take part in grouping and distinct counts."""
    maps = set(_pick(df.schema, T.MapType, T.VariantType))
    return [c for c in df.columns if c not in maps]


def flat(df: DataFrame) -> list[str]:
    """Columns of single values: all but arrays, structs, maps and variants."""
    nested = set(_pick(df.schema, T.ArrayType, T.StructType, T.MapType, T.VariantType))
    return [c for c in df.columns if c not in nested]


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"the table has no column {name!r}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; keep one marker so aggregates skip it."""
    floats = set(_pick(df.schema, T.FloatType, T.DoubleType))
    return df.selectExpr(*[f"nanvl({q(c)}, null) as {q(c)}" if c in floats else q(c) for c in df.columns]) \
        if floats else df


def as_double(name: str) -> Column:
    return col(name).cast("double")


def rows_of(df: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn one aggregated row into one output row per struct, without an action."""
    return df.select(F.inline(F.array(*structs)))
