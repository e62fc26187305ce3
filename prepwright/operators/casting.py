"""Type conversion; values that do not convert become missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.functions.numbers import DATETIME_FORMATS, parse_number, parse_timestamp
from prepwright.kinds import as_double, col
from prepwright.operators.encode import sorted_codes


def cast_numeric(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        return df
    value = parse_number(col(column)) if column in kinds.text(df) else as_double(column)
    return df.withColumn(column, value)


def cast_datetime(df: DataFrame, column: str, formats: list[str] | None = None,
                  single_format: bool = False) -> DataFrame:
    """Text to timestamp.

    Without ``formats`` any usual date is read, else the first format that fits a value; with
    ``single_format`` the one format that fits most values of the column (earliest on ties).
    """
    if column not in df.columns or column in kinds.datetime(df):
        return df
    value = col(column).cast("string")
    if single_format:
        formats = formats or DATETIME_FORMATS
        hits = df.agg(*[F.count(parse_timestamp(value, [f])).alias(f"h{i}") for i, f in enumerate(formats)]).first()
        formats = [formats[max(range(len(formats)), key=lambda i: hits[i])]]
    return df.withColumn(column, parse_timestamp(value, formats))


def cast_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, col(column).cast("string")) if column in df.columns else df


def cast_category(df: DataFrame, column: str) -> DataFrame:
    """Text plus an integer code by sorted value, missing = -1."""
    return sorted_codes(cast_text(df, column), column) if column in df.columns else df


def convert_column(df: DataFrame, column: str, target: str) -> DataFrame:
    """Single conversion; an unsupported target is an error, an unknown column is not."""
    if column not in df.columns:
        return df
    if target not in ("numeric", "string", "category"):
        raise ValueError(f"columns are not converted to {target!r}")
    return convert_types(df, {column: "text" if target == "string" else target})


def convert_types(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Column -> numeric | datetime | category | text; other targets are ignored."""
    casts = {"numeric": cast_numeric, "datetime": cast_datetime, "category": cast_category, "text": cast_text}
    for column, target in mapping.items():
        if target in casts:
            df = casts[target](df, column)
    return df


def fit_types(df: DataFrame, share: float = 0.9) -> dict[str, str]:
    """Target per text column of which at least ``share`` of all rows convert."""
    names = kinds.text(df)
    if not names:
        return {}
    # No number and no date is without a digit, and to look for one costs far less than all shapes.
    likely = df.select(*[F.when(col(c).rlike("[0-9]"), col(c)).alias(f"w{i}") for i, c in enumerate(names)])
    row = likely.agg(F.count("*").alias("n"), *[a for i in range(len(names)) for a in (
        F.count(parse_number(F.col(f"w{i}"))).alias(f"n{i}"), F.count(parse_timestamp(F.col(f"w{i}"))).alias(f"t{i}"))]).first()
    if not row["n"]:
        return {}
    found = {}
    for i, c in enumerate(names):
        if row[f"n{i}"] / row["n"] >= share:
            found[c] = "numeric"
        elif row[f"t{i}"] / row["n"] >= share:
            found[c] = "datetime"
    return found


def fix_types(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Convert text columns that are mostly numbers or mostly dates, all in one projection."""
    return convert_types(df, fit_types(df, share))
