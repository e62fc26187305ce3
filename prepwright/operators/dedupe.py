"""Exact duplicate removal. Near-duplicate rows are in ``fuzzy``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.kinds import col


def drop_exact(df: DataFrame) -> DataFrame:
    """One row of every set of equal rows; missing equals missing, be it NULL or NaN."""
    return kinds.nan_to_null(df).dropDuplicates(kinds.comparable(df))


def keep_first(df: DataFrame, subset: list[str], order_by: list[str]) -> DataFrame:
    """The first row per key in the given order.

    A struct minimum combines map-side, so a key holding a large share of the rows never
    gathers in one task. Every comparable column breaks ties, which fixes the choice.
    """
    kinds.require(df, *subset, *order_by)
    names = order_by + [c for c in kinds.comparable(df) if c not in order_by]
    rest = [c for c in df.columns if c not in names]
    first = F.min(F.struct(*[col(c) for c in names])) if not rest else F.min_by(
        F.struct(*[col(c) for c in names + rest]), F.struct(*[col(c) for c in names]))
    picked = df.groupBy(*[col(c).alias(f"_k{i}") for i, c in enumerate(subset)]).agg(first.alias("_row"))
    return picked.select(*[F.col("_row")[c].alias(c) for c in df.columns])
