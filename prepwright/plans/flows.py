"""End-to-end compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.functions.text import standardize
from prepwright.kinds import col
from prepwright.operators import casting, columns, dedupe, encode, fuzzy, impute, profile, quality, rules
from prepwright.session import cut_lineage


def standardize_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: standardize(col(c).cast("string")) for c in names if c in df.columns})


def clean(df: DataFrame, actions: dict[str, str], drop_duplicates: bool = True) -> DataFrame:
    """Per-column repair, then type correction, then exact deduplication."""
    out = casting.fix_types(impute.impute_per_column(df, actions))
    return dedupe.drop_exact(out) if drop_duplicates else out


def clean_selected(df: DataFrame, names: list[str], how: str) -> DataFrame:
    """One repair (mean, median, mode or drop_rows) on chosen columns, then type correction."""
    return casting.fix_types(impute.impute(df, "drop" if how == "drop_rows" else how, names))


def adaptive_clean(df: DataFrame) -> DataFrame:
    """Repair what the diagnosis found: gaps, duplicates, then types."""
    found = {r["issue"] for r in rules.issues(quality.diagnose(df)).select("issue").collect()}
    if "missing" in found:
        df = impute.impute_adaptive(df)
    if "duplicate" in found:
        df = dedupe.drop_exact(df)
    return casting.fix_types(df)


def correct_text(df: DataFrame, names: list[str] | None = None, threshold: float = 85,
                 order_by: list[str] | None = None) -> DataFrame:
    """Replace spelling variants by their group's canonical value in all text columns."""
    names = kinds.text(df) if names is None else names
    if not names:
        return df
    members = cut_lineage(fuzzy.group_members(df, names, threshold, order_by))
    hit = {r["column"] for r in members.select("column").distinct().collect()}
    for c in names:
        if c in hit:
            df = fuzzy.apply_groups(df, c, members)
    return df


def auto_prepare(df: DataFrame, order_by: list[str] | None = None,
                 sparse: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned, corrected, engineered) with the default choices of every stage.

    Text columns in ``sparse`` and those with more values than a table should have columns are encoded in one column.
    """
    nums = set(kinds.numeric(df))
    cleaned = cut_lineage(clean(df, {c: "Median" if c in nums else "Mode" for c in kinds.flat(df)}))
    corrected = cut_lineage(correct_text(cleaned, order_by=order_by))
    return cleaned, corrected, encode.standard_scale(encode.one_hot(corrected, sparse=sparse))


def engineer(df: DataFrame, sparse: list[str] | None = None) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """Encode, drop low variance, scale: (table, dropped, correlated pairs, advice).

    Correlation does not depend on scale, so pairs are taken before scaling.
    """
    encoded = encode.one_hot(kinds.nan_to_null(df), sparse=sparse)
    kept, dropped = encode.drop_low_variance(encoded)
    pairs = profile.correlated_pairs(kept, 0.9)
    return encode.standard_scale(kept), dropped, pairs, rules.advise_features(kept, dropped, pairs)


def choose_features(df: DataFrame, encoding: bool = True, drop_correlated: bool = False, scaling: str = "standard",
                    label_columns: list[str] | None = None, order_by: str | None = None,
                    sparse: list[str] | None = None) -> DataFrame:
    """Feature choices of the interactive flow, applied in order."""
    if scaling not in ("none", "standard", "minmax"):
        raise ValueError(f"Unknown scaling: {scaling}")
    if encoding:
        df = encode.one_hot(df, sparse=sparse)
    for c in label_columns or []:
        df = encode.label_codes(df, c, order_by).drop(c).withColumnRenamed(f"{c}_code", c)
    if drop_correlated:
        df = columns.drop_correlated(df)
    if scaling == "none":
        return df
    return encode.standard_scale(df) if scaling == "standard" else encode.minmax_scale(df)


def run_actions(df: DataFrame, actions: list[dict]) -> DataFrame:
    """Apply declarative steps {type: fill | convert | standardize, ...}; others do nothing."""
    for step in actions:
        kind = step.get("type")
        if kind == "fill":
            df = impute.impute(df, step.get("strategy", "median"), text="skip")
        elif kind == "convert":
            df = casting.convert_types(df, {step.get("col"): step.get("to")})
        elif kind == "standardize":
            df = standardize_columns(df, [step.get("col")])
    return df


def diagnosis(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """Diagnosis row, issues, complexity and health; the last three are computed from the stored row."""
    row = cut_lineage(quality.diagnose(df, target))
    return {"diagnosis": row, "issues": rules.issues(row), "complexity": quality.complexity(row),
            "health": quality.health(row)}


def report(df: DataFrame, target: str | None = None, scores: DataFrame | None = None,
           order_by: list[str] | None = None) -> DataFrame:
    """One nested row: summary, complexity, health, issues and model scores.

    Every part holds a handful of rows, so the parts are fitted and put together here.
    """
    parts = diagnosis(df, target)
    shape = parts["diagnosis"].first()
    index, health = parts["complexity"].first(), quality.quality_score(df, order_by).first()
    found = [r.asDict() for r in parts["issues"].orderBy("rank").collect()]
    ranked = [] if scores is None else [
        r.asDict() for r in scores.orderBy("rank").select("rank", "model", "metric", "train_score", "test_score").collect()]
    row = {
        "dataset_summary": {"rows": shape["n_rows"], "columns": shape["n_cols"]},
        "dataset_complexity_index": index.asDict(), "data_health": health.asDict(), "issues": found,
        "model_performance": ranked}
    return df.sparkSession.createDataFrame([row], """
        dataset_summary struct<rows: long, columns: long>,
        dataset_complexity_index struct<score: double, label: string>,
        data_health struct<score: double, label: string, missing_values: double, duplicates: double,
                           outliers: double, inconsistent_categories: double>,
        issues array<struct<rank: int, issue: string, severity: string, value: double, confidence: double,
                            recommendation: string>>,
        model_performance array<struct<rank: int, model: string, metric: string, train_score: double,
                                       test_score: double>>""")


def report_json(full: DataFrame) -> DataFrame:
    return full.select(F.to_json(F.struct(*[col(c) for c in full.columns]), {"ignoreNullFields": "false"}).alias("report"))
