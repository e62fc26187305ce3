"""Missing-value repair: one fit (scalars per column), then a pure projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.kinds import as_double, col
from prepwright.operators.profile import fit_missing, fit_modes
from prepwright.operators.quantiles import fit_median


def fit_fill(df: DataFrame, plan: dict[str, str]) -> dict[str, object]:
    """Fill value per column for a plan of column -> mean | median | mode.

    Mean and median apply to numeric columns; for others the most frequent value is used.
    Columns without missing or without any present value are left out.
    """
    nums = set(kinds.numeric(df))
    gaps = fit_missing(df.select(*[col(c) for c in plan]))
    todo = {c: how if c in nums else "mode" for c, how in plan.items() if gaps[c]}
    means = [c for c, how in todo.items() if how == "mean"]
    fills: dict[str, object] = {}
    if means:
        row = df.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(means)]).first()
        fills.update({c: row[i] for i, c in enumerate(means)})
    medians = [c for c, how in todo.items() if how == "median"]
    if medians:
        fills.update(fit_median(df, {c: as_double(c) for c in medians}))
    modes = [c for c, how in todo.items() if how == "mode"]
    if modes:
        fills.update(fit_modes(df, modes))
    return {c: v for c, v in fills.items() if v is not None}


def apply_fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Filled numeric columns become double; other columns keep their type."""
    nums = set(kinds.numeric(df))
    return df.withColumns({
        c: F.coalesce(as_double(c), F.lit(float(v))) if c in nums
        else F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType))
        for c, v in fills.items()}) if fills else df


def impute(df: DataFrame, how: str, columns: list[str] | None = None, text: str = "mode") -> DataFrame:
    """Fill missing values by mean, median or mode, or drop incomplete rows.

    ``text="mode"`` fills non-numeric columns by their most frequent value under mean and
    median; ``text="skip"`` leaves them missing. Gaps in arrays, structs and maps stay.
    """
    df = kinds.nan_to_null(df)
    if how == "none":
        return df
    if how == "drop":
        return df.na.drop("any", subset=columns)
    if how not in ("mean", "median", "mode"):
        raise ValueError(f"gaps are not filled by {how!r}")
    chosen = [c for c in (kinds.flat(df) if columns is None else columns) if c in kinds.flat(df)]
    if how != "mode" and text == "skip":
        chosen = [c for c in chosen if c in set(kinds.numeric(df))]
    return apply_fill(df, fit_fill(df, {c: how for c in chosen})) if chosen else df


def impute_custom(df: DataFrame, value) -> DataFrame:
    """Fill by a scalar or a column -> value dict; columns of another type are skipped."""
    return kinds.nan_to_null(df).na.fill(value)


def impute_per_column(df: DataFrame, actions: dict[str, str]) -> DataFrame:
    """Per-column action: None, Mean, Median, Mode or Drop; all fits share their scans. Gaps in nested columns stay."""
    df = kinds.nan_to_null(df)
    dropped = [c for c, a in actions.items() if a == "Drop"]
    fits = {c: a.lower() for c, a in actions.items() if a not in ("Drop", "None") and c in kinds.flat(df)}
    df = apply_fill(df, fit_fill(df, fits)) if fits else df
    return df.drop(*dropped)


def impute_adaptive(df: DataFrame) -> DataFrame:
    """Most frequent value for non-numeric columns, median for numeric ones. Gaps in arrays, structs and maps stay."""
    df = kinds.nan_to_null(df)
    return apply_fill(df, fit_fill(df, {c: "median" for c in kinds.flat(df)}))
