"""Quality score, diagnostics and complexity: one-row results over shared aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.kinds import col
from prepwright.operators import profile
from prepwright.operators.fuzzy import fuzzy_groups

# Largest penalty per quality dimension, 100 points in all.
CAP_MISSING = 35
CAP_DUPLICATES = 20
CAP_OUTLIERS = 25
CAP_CATEGORIES = 20


def side_by_side(frames: list[DataFrame]) -> DataFrame:
    """Merge one-row numeric frames into a single row, without a join."""
    names = [c for f in frames for c in f.columns]
    facts = None
    for f in frames:
        rows = kinds.rows_of(f, [F.struct(F.lit(c).alias("fact"), col(c).cast("double").alias("value"))
                                 for c in f.columns])
        facts = rows if facts is None else facts.union(rows)
    return facts.agg(*[F.max(F.when(F.col("fact") == c, F.col("value"))).alias(c) for c in names])


def _capped(ratio: Column, cap: int) -> Column:
    return F.round(F.least(F.lit(float(cap)), ratio * 100), 2)


def quality_score(df: DataFrame, order_by: list[str] | None = None, threshold: float = 85) -> DataFrame:
    """Score 0..100, label and the four penalties.

    ``order_by`` fixes the arrival order that fuzzy category groups depend on.
    """
    df = kinds.nan_to_null(df)
    words, nums = kinds.text(df), kinds.numeric(df)
    groups = fuzzy_groups(df, words, threshold, order_by).agg(F.count("*").alias("fuzzy_groups"))
    values = profile.text_summary(df, words).agg(
        (F.coalesce(F.sum("n_distinct"), F.lit(0)) + F.lit(len(words)) - F.count("*")).alias("category_values"))
    outliers = profile.outlier_counts(df).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("outliers"))
    row = side_by_side([
        profile.overview(df).select("n_rows", "n_cols", "missing_cells"),
        profile.duplicate_counts(df).select("duplicate_rows"), outliers, groups, values])

    def share(part: str, whole: Column) -> Column:
        return F.col(part) / F.greatest(whole, F.lit(1.0))

    row = row.select(
        _capped(share("missing_cells", F.col("n_rows") * F.col("n_cols")), CAP_MISSING).alias("missing_values"),
        _capped(share("duplicate_rows", F.col("n_rows")), CAP_DUPLICATES).alias("duplicates"),
        _capped(share("outliers", F.col("n_rows") * len(nums)), CAP_OUTLIERS).alias("outliers"),
        _capped(share("fuzzy_groups", F.col("category_values")), CAP_CATEGORIES).alias("inconsistent_categories"))
    total = sum((F.col(c) for c in row.columns), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - total)), 2)
    return row.select(score.alias("score"),
                      F.concat(F.lit("Data Quality Score: "), F.bround(score, 0).cast("long").cast("string"),
                               F.lit("/100")).alias("label"), *row.columns)


def diagnose(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: size, missing and duplicate ratio, largest correlation, kinds, balance."""
    df = kinds.nan_to_null(df)
    frames = [profile.overview(df).select("n_rows", "n_cols", "missing_cells"),
              profile.duplicate_counts(df).select("duplicate_rows"), profile.max_correlation(df)]
    if target is not None and target in df.columns:
        frames.append(profile.target_balance(df, target))
    row = side_by_side(frames)
    balance = F.col("target_balance") if "target_balance" in row.columns else F.lit(None).cast("double")
    return row.select(
        F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"),
        (F.col("missing_cells") / F.greatest(F.col("n_rows") * F.col("n_cols"), F.lit(1.0))).alias("missing_ratio"),
        (F.col("duplicate_rows") / F.greatest(F.col("n_rows"), F.lit(1.0))).alias("duplicate_ratio"),
        "correlation_max", balance.alias("target_balance"),
        F.lit(",".join(kinds.numeric(df))).alias("numeric_cols"),
        F.lit(",".join(kinds.categorical(df))).alias("categorical_cols"))


def complexity(diagnosis: DataFrame) -> DataFrame:
    """Complexity index 0..10 and its label from a diagnosis row."""
    # Weights, caps and label bounds of the index.
    parts = (F.least(F.lit(3.0), F.col("missing_ratio") * 10)
             + F.least(F.lit(2.5), F.col("n_cols") / 20)
             + F.least(F.lit(2.5), F.col("correlation_max") * 2.5)
             + F.coalesce(F.least(F.lit(2.0), (1 - F.col("target_balance")) * 2.0), F.lit(0.0)))
    score = F.round(F.least(F.lit(10.0), parts), 2)
    label = F.when(score < 3.5, "Low Complexity").when(score < 7.0, "Medium Complexity").otherwise("High Complexity")
    return diagnosis.select(score.alias("score"), label.alias("label"))


def health(diagnosis: DataFrame) -> DataFrame:
    """Four health dimensions in 0..1 with a status each."""
    values = {"Completeness": 1 - F.col("missing_ratio"), "Consistency": 1 - F.col("duplicate_ratio"),
              "Redundancy": 1 - F.least(F.lit(1.0), F.col("correlation_max")),
              "Balance": F.coalesce("target_balance", F.lit(1.0))}
    rows = kinds.rows_of(diagnosis, [F.struct(F.lit(k).alias("dimension"), v.alias("value"))
                                     for k, v in values.items()])
    return rows.withColumn("status", F.when(F.col("value") >= 0.8, "ok").when(
        F.col("value") >= 0.5, "warn").otherwise("error"))


def infer_task(df: DataFrame, target: str) -> str:
    """Text or fewer than 20 distinct values: classification; else regression."""
    kinds.require(df, target)
    if target in kinds.text(df):
        return "classification"
    few = kinds.nan_to_null(df).select(col(target)).na.drop().distinct().limit(20).count() < 20
    return "classification" if few else "regression"
