"""One-pass column statistics. Every table here is long: one row per column or pair."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepwright import kinds
from prepwright.functions.numbers import adjusted_skew
from prepwright.kinds import as_double, col, lit, num, q, rows_of, text_lit
from prepwright.operators.quantiles import cells, fit_quantiles, per_range

# Aggregates are split so one generated method never covers a very wide frame.
COLUMNS_PER_PASS = 60
# Of several measures a column; with more the generated method is too long to be compiled.
MEASURES_PER_PASS = 90
# Column pairs whose sums a task holds at once (48 MB), cut into blocks of columns.
PAIRS_PER_SCAN = 1 << 20
COLUMNS_PER_BLOCK = 128
PAIR_SUMS = ("n", "x", "y", "xx", "yy", "xy")

NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _batches(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def per_column(df: DataFrame, columns: list[str], measures: dict, schema: str) -> DataFrame:
    """Aggregate ``measures`` (name -> column name -> SQL text) for each column, as rows."""
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    frames = []
    for batch in _batches(columns, max(1, min(COLUMNS_PER_PASS, MEASURES_PER_PASS // len(measures)))):
        row = df.selectExpr(*[f"{make(c)} as {m}{i}" for i, c in enumerate(batch) for m, make in measures.items()])
        cells = ", ".join("struct({} as column, {})".format(
            text_lit(c), ", ".join(f"{m}{i} as `{m}`" for m in measures)) for i, c in enumerate(batch))
        frames.append(row.selectExpr(f"inline(array({cells}))"))
    return _union(frames)


def seconds_text(df: DataFrame, name: str) -> str:
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, {NTZ_EPOCH}, {q(name)}) / 1e6D"
    return f"unix_micros(cast({q(name)} as timestamp)) / 1e6D"


def epoch_seconds(df: DataFrame, name: str) -> Column:
    return F.expr(seconds_text(df, name))


# ---- shape and missing values ------------------------------------------------------


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and columns with missing values, in one row."""
    df = kinds.nan_to_null(df)
    gaps = [f"(count(*) - count({q(c)}))" for c in df.columns]
    return df.selectExpr(
        "count(*) as n_rows", f"{len(df.columns)}L as n_cols", f"{' + '.join(['0L', *gaps])} as missing_cells",
        f"cast({' + '.join(['0', *[f'if({g} > 0, 1, 0)' for g in gaps]])} as bigint) as missing_columns")


def feature_types(df: DataFrame) -> DataFrame:
    """(column, kind) rows from the schema: numeric or categorical, with datetime flagged."""
    nums, dates = set(kinds.numeric(df)), set(kinds.datetime(df))
    rows = [(c, "numeric" if c in nums else "categorical", c in dates) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, is_datetime boolean")


def shape_and_types(df: DataFrame) -> DataFrame:
    """Shape plus one row per column with its kind and storage type."""
    nums, dates = set(kinds.numeric(df)), set(kinds.datetime(df))
    structs = [F.struct(F.lit(f.name).alias("column"),
                        F.lit("numeric" if f.name in nums else "datetime" if f.name in dates else "text"
                              if isinstance(f.dataType, T.StringType) else "other").alias("kind"),
                        F.col("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"))
               for f in df.schema]
    return rows_of(df.agg(F.count("*").alias("n_rows")), structs)


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing_count, n, ratio) with the exact ratio."""
    df = kinds.nan_to_null(df)
    out = per_column(df, df.columns, {
        "missing_count": lambda c: f"count(*) - count({q(c)})",
        "n": lambda c: "count(*)"}, "column string, missing_count long, n long")
    return out.withColumn("ratio", F.col("missing_count") / F.greatest(F.col("n"), F.lit(1)))


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and ratio (4 digits) per column, most missing first."""
    return missing_counts(df).select("column", "missing_count", F.round("ratio", 4).alias("missing_ratio")) \
        .orderBy(F.desc("missing_count"), "column")


def top_missing(df: DataFrame, k: int = 3) -> DataFrame:
    return missing_counts(df).select("column", F.col("ratio").alias("missing_ratio")) \
        .orderBy(F.desc("missing_ratio"), "column").limit(k)


def fit_missing(df: DataFrame) -> dict[str, int]:
    """Missing count per column, on the driver: one number per column."""
    df = kinds.nan_to_null(df)
    counts: dict[str, int] = {}
    for batch in _batches(df.columns, 4 * COLUMNS_PER_PASS):
        row = df.selectExpr(*[f"count(*) - count({q(c)}) as m{i}" for i, c in enumerate(batch)]).first()
        counts.update({c: row[i] for i, c in enumerate(batch)})
    return counts


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; equal rows combine map-side.

    Rows travel as 128 bits of hash: at a million million rows two different ones meet with
    a chance of about one in 10**15.
    """
    cells = [col(c) for c in kinds.comparable(df)]
    # NULL is skipped by the hash, so where a row has NULLs is part of it.
    gaps = F.concat(F.lit(""), *[F.when(c.isNull(), "0").otherwise("1") for c in cells])
    groups = kinds.nan_to_null(df).groupBy(F.xxhash64(gaps, *cells).alias("_a"), F.xxhash64(F.lit(1), gaps, *cells).alias("_b")).agg(
        F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")).select(
        "n_rows", "duplicate_rows",
        (F.col("duplicate_rows") / F.greatest(F.col("n_rows"), F.lit(1))).alias("duplicate_ratio"))


# ---- value counts: distinct, mode, top-k -------------------------------------------


def value_counts(df: DataFrame, columns: list[str], value: str = "string") -> DataFrame:
    """(column, value, n) for non-missing values of all columns in a single shuffle."""
    df = kinds.nan_to_null(df)
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast(value).alias("value")) for c in columns])))
    return cells.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def _by_type(df: DataFrame, columns: list[str]) -> list[tuple[str, list[str]]]:
    """Columns with the type their values are counted in: whole numbers, fractions, and the text of all else."""
    whole, nums = set(kinds.integral(df)), set(kinds.numeric(df))
    exact = {f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)}
    groups = {"bigint": [c for c in columns if c in whole], "double": [c for c in columns if c in nums - whole - exact],
              "string": [c for c in columns if c not in nums or c in exact]}
    return [(kind, names) for kind, names in groups.items() if names]


def _all_value_counts(df: DataFrame) -> DataFrame:
    """Value counts for every column, in text form; numbers are grouped by value first."""
    return _union([value_counts(df, names, kind).withColumn("value", F.col("value").cast("string"))
                   for kind, names in _by_type(df, kinds.comparable(df))])


def distinct_counts(df: DataFrame) -> DataFrame:
    """Distinct non-missing values per column."""
    names = df.sparkSession.createDataFrame([(c,) for c in kinds.comparable(df)], "column string")
    seen = _all_value_counts(df).groupBy("column").agg(F.count("*").alias("n_distinct"))
    return names.join(F.broadcast(seen), "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def _best(counts: DataFrame) -> DataFrame:
    """Most frequent value per column, the smallest one on ties."""
    return counts.groupBy("column").agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n"),
        F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("best")).select(
        "column", "n", "n_distinct", F.col("best.v").alias("top"), (-F.col("best.k")).alias("freq"))


def text_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: non-missing count, distinct, most frequent value and its count."""
    columns = kinds.text(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n long, n_distinct long, top string, freq long")
    return _best(value_counts(df, columns))


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, smallest on ties; columns without values are absent."""
    modes: dict[str, object] = {}
    for value, names in _by_type(df, columns):
        modes.update({r["column"]: r["top"] for r in _best(value_counts(df, names, value)).collect()})
    return modes


# ---- moments, quartiles, outliers --------------------------------------------------


def fit_quartiles(df: DataFrame, columns: list[str], ps: tuple = (0.25, 0.5, 0.75)) -> dict[str, list]:
    dates = set(kinds.datetime(df))
    return fit_quantiles(df, {c: (epoch_seconds(df, c) if c in dates else as_double(c), list(ps))
                              for c in columns})


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, std, min, quartiles and max of numeric and datetime columns.

    Datetimes are measured in epoch seconds and have no std.
    """
    df = kinds.nan_to_null(df)
    dates = set(kinds.datetime(df))
    columns = [c for c in df.columns if c in dates or c in set(kinds.numeric(df))]
    value = {c: seconds_text(df, c) if c in dates else num(c) for c in columns}
    quartiles = fit_quartiles(df, columns)
    if not columns:
        return per_column(df, [], {}, "column string, count long")
    return per_column(df, columns, {
        "count": lambda c: f"count({value[c]})",
        "mean": lambda c: f"avg({value[c]})",
        "std": lambda c: "cast(null as double)" if c in dates else f"stddev_samp({value[c]})",
        "min": lambda c: f"min({value[c]})",
        "q25": lambda c: lit(quartiles[c][0]),
        "q50": lambda c: lit(quartiles[c][1]),
        "q75": lambda c: lit(quartiles[c][2]),
        "max": lambda c: f"max({value[c]})"}, "")


def describe_all(df: DataFrame) -> DataFrame:
    """``describe`` plus distinct, top and freq for text and boolean columns."""
    numbers = describe(df)
    taken = {*kinds.numeric(df), *kinds.datetime(df)}
    words = text_summary(df, [c for c in kinds.comparable(df) if c not in taken])
    return numbers.unionByName(
        words.select("column", F.col("n").alias("count"), F.col("n_distinct").alias("unique"), "top", "freq"),
        allowMissingColumns=True)


def skewness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    df = kinds.nan_to_null(df)
    columns = kinds.numeric(df) if columns is None else columns
    return per_column(df, columns, {"skew": lambda c: adjusted_skew(num(c))}, "column string, skew double")


def fit_fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper interquartile fence per column.

    Columns without values are absent, and so are those of which both quartiles are the same infinity, which have no range.
    """
    fences = {}
    for c, (q1, q3) in fit_quartiles(df, columns, (0.25, 0.75)).items():
        if q1 is not None and not math.isnan(q3 - q1):
            fences[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return fences


def outlier_counts(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """Values outside the interquartile fence, per numeric column."""
    df = kinds.nan_to_null(df)
    columns = kinds.numeric(df)
    fences = fit_fences(df, columns, factor)

    def outside(c: str) -> str:
        if c not in fences:
            return "0L"
        low, high = fences[c]
        return f"count_if({num(c)} < {lit(low)} or {num(c)} > {lit(high)})"

    return per_column(df, columns, {"outliers": outside}, "column string, outliers long")


# ---- pairs ------------------------------------------------------------------------


def _tiles(n: int) -> list[list[tuple[range, range]]]:
    """Blocks of columns against blocks of columns, the upper triangle, in groups whose sums one task can hold."""
    blocks = [range(i, min(i + COLUMNS_PER_BLOCK, n)) for i in range(0, n, COLUMNS_PER_BLOCK)]
    tiles = [(a, b) for k, a in enumerate(blocks) for b in blocks[k:]]
    return _batches(tiles, max(1, PAIRS_PER_SCAN // COLUMNS_PER_BLOCK ** 2))


def _tile_sums(df: DataFrame, columns: list[str], centre: np.ndarray, tiles: list[tuple[range, range]]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) of the tiles' column pairs, a row per pair and task, over rows where both are present.

    A batch of rows is a matrix and its mask, and the sums are products of blocks of the two.
    """
    used = sorted({i for tile in tiles for side in tile for i in side})
    at = {i: k for k, i in enumerate(used)}
    middle = centre[used]
    spans = [(slice(at[a[0]], at[a[-1]] + 1), slice(at[b[0]], at[b[-1]] + 1), a, b) for a, b in tiles]

    def run(batches):
        total = [np.zeros((6, len(a), len(b))) for _, _, a, b in spans]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - middle
            there = ~np.isnan(x)
            x[~there] = 0.0
            mask, square = there.astype(float), x * x
            for sums, (a, b, _, _) in zip(total, spans):
                sums += np.stack([mask[:, a].T @ mask[:, b], x[:, a].T @ mask[:, b], mask[:, a].T @ x[:, b],
                                  square[:, a].T @ mask[:, b], mask[:, a].T @ square[:, b], x[:, a].T @ x[:, b]])
        for sums, (_, _, a, b) in zip(total, spans):
            i, j = (m.ravel() for m in np.meshgrid(np.array(a), np.array(b), indexing="ij"))
            upper = np.flatnonzero((i <= j) & (sums[0].ravel() > 0))
            yield pa.RecordBatch.from_arrays([pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32()), *[pa.array(m.ravel()[upper]) for m in sums]],
                                             names=["i", "j", *PAIR_SUMS])
    return df.selectExpr(*[f"{num(columns[k])} as c{k}" for k in used]).mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in PAIR_SUMS))


def _pair_frames(df: DataFrame, result: str, name: str, include_same: bool) -> DataFrame:
    """One row per numeric column pair, from sums over the rows where both are present.

    Two scans: the means, then all pairs, as many at once as a task's sums may take; the pairs stay distributed and
    the driver holds a few numbers per column. ``result`` is SQL over n, sxx, syy and sxy.
    """
    df = kinds.nan_to_null(df)
    spark, columns = df.sparkSession, kinds.numeric(df)
    if len(columns) < (1 if include_same else 2):
        return spark.createDataFrame([], f"col_a string, col_b string, {name} double, ord long")
    means, spans = [], []
    for batch in _batches(columns, COLUMNS_PER_PASS):
        row = df.selectExpr(*[f"{fn}({num(c)}) as {letter}{i}" for i, c in enumerate(batch)
                              for letter, fn in (("m", "avg"), ("a", "min"), ("z", "max"))]).first()
        means += [row[f"m{i}"] or 0.0 for i in range(len(batch))]
        spans += [(row[f"z{i}"] or 0.0) - (row[f"a{i}"] or 0.0) for i in range(len(batch))]
    d = len(columns)
    # Every pair has a row, also those that no row of the table has both of.
    pairs = spark.range(d * d).selectExpr(f"cast(id div {d} as int) as i", f"cast(id % {d} as int) as j").where("i <= j" if include_same else "i < j")
    sums = _union([_tile_sums(df, columns, np.array(means), group) for group in _tiles(d)])
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])
    listed = spark.createDataFrame(list(zip(range(d), columns, spans)), "k int, c string, span double")
    # A row per column.
    first, second = (F.broadcast(listed.selectExpr(f"k as {at}", f"c as col_{side}", f"span as span_{side}")) for at, side in (("i", "a"), ("j", "b")))
    found = pairs.join(sums, ["i", "j"], "left").join(first, "i").join(second, "j").na.fill(0.0, list(PAIR_SUMS))
    found = found.selectExpr("i", "j", "col_a", "col_b", "n", "span_a", "span_b", "if(n > 0, xx - x * x / n, 0D) as sxx",
                             "if(n > 0, yy - y * y / n, 0D) as syy", "if(n > 0, xy - x * y / n, 0D) as sxy")
    # What rounding leaves of a constant counts as no spread.
    spread = lambda s, side: f"if({s} > 1e-18 * span_{side} * span_{side} * n, {s}, 0D) as {s}"
    found = found.selectExpr("i", "j", "col_a", "col_b", "n", spread("sxx", "a"), spread("syy", "b"), "sxy")
    return found.selectExpr("col_a", "col_b", f"{result} as {name}", f"cast(i as bigint) * {d} + j as ord")


_PEARSON = "if(sxx > 0 and syy > 0, greatest(-1D, least(1D, sxy / (sqrt(sxx) * sqrt(syy)))), null)"
_COVARIANCE = "case when n >= 2 and sxx > 0 and syy > 0 then sxy / (n - 1) when n >= 2 then 0D end"


def correlations(df: DataFrame) -> DataFrame:
    """Pearson correlation of every column pair (upper triangle), NULL for constants."""
    return _pair_frames(df, _PEARSON, "corr", False)


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Upper triangle mirrored, with the diagonal."""
    half = _pair_frames(df, _PEARSON, "corr", True).drop("ord")
    return half.select(F.inline(F.when(
        F.col("col_a") == F.col("col_b"), F.array(F.struct("col_a", "col_b", "corr"))).otherwise(
        F.array(F.struct("col_a", "col_b", "corr"),
                F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")))))


def covariances(df: DataFrame) -> DataFrame:
    """Sample covariance of every pair and of each column with itself."""
    return _pair_frames(df, _COVARIANCE, "cov", True).drop("ord")


def correlated_pairs(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs with |r| at or above the threshold, in column order; ``corr`` is signed."""
    return correlations(df).where(F.abs("corr") >= threshold)


def max_correlation(df: DataFrame) -> DataFrame:
    return correlations(df).agg(F.coalesce(F.max(F.abs("corr")), F.lit(0.0)).alias("correlation_max"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x over complete rows: intercept, slope, r2, mse, summary."""
    kinds.require(df, x, y)
    df = kinds.nan_to_null(df)
    a, b = as_double(x), as_double(y)
    row = df.agg(F.regr_count(b, a).alias("n"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"),
                 F.regr_sxy(b, a).alias("sxy"), F.regr_avgx(b, a).alias("mx"), F.regr_avgy(b, a).alias("my"))
    # A constant x carries no slope: the fit is then the mean of y.
    slope = F.coalesce(F.try_divide(F.col("sxy"), F.col("sxx")), F.lit(0.0))
    row = row.withColumn("slope", F.when(F.col("n") > 0, slope))
    row = row.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    row = row.withColumn("sse", F.col("syy") - F.col("slope") * F.col("sxy"))
    return row.select(
        "n", "intercept", "slope", (1 - F.try_divide("sse", "syy")).alias("r2"),
        F.try_divide("sse", "n").alias("mse"),
        F.concat(F.lit(f"Linear regression predicting {y} from {x}\n"),
                 F.format_string("Intercept: %.4f\nCoefficient: %.4f\n", "intercept", "slope")).alias("summary"))


# ---- class structure ---------------------------------------------------------------


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """Smallest class size over largest; a missing label is a class of its own."""
    kinds.require(df, target)
    sizes = kinds.nan_to_null(df).groupBy(col(target).alias("label")).agg(F.count("*").alias("n"))
    return sizes.agg((F.min("n") / F.greatest(F.max("n"), F.lit(1))).alias("target_balance"))


def class_count(df: DataFrame, target: str) -> DataFrame:
    kinds.require(df, target)
    labels = kinds.nan_to_null(df).select(col(target).alias("label")).where("label is not null").distinct()
    return labels.agg(F.count("*").alias("n_classes"))


# ---- histogram ----------------------------------------------------------------------


def fit_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float] | None]:
    row = df.selectExpr(*[a for i, c in enumerate(columns)
                          for a in (f"min({num(c)}) as a{i}", f"max({num(c)}) as z{i}")]).first()
    return {c: None if row[f"a{i}"] is None else (row[f"a{i}"], row[f"z{i}"]) for i, c in enumerate(columns)}


def histogram(df: DataFrame, bins: int = 20, columns: list[str] | None = None) -> DataFrame:
    """Equal-width, right-closed bins of every numeric column; empty bins are kept.

    The lowest edge lies 0.1 % of the range below the minimum so the minimum is counted;
    a constant column is widened by 0.1 % of its value on both sides.
    """
    df = kinds.nan_to_null(df)
    columns = kinds.numeric(df) if columns is None else columns
    edges: dict[str, list[float]] = {}
    for c, span in fit_ranges(df, columns).items():
        if span is None:
            continue
        low, high = span
        if low == high:
            pad = 0.001 * abs(low) if low else 0.001
            low, high = low - pad, high + pad
            edges[c] = [low + i * ((high - low) / bins) for i in range(bins)] + [high]
        else:
            edges[c] = [low + i * ((high - low) / bins) for i in range(bins)] + [high]
            edges[c][0] -= 0.001 * (high - low)
    if not edges:
        return df.sparkSession.createDataFrame([], "column string, bin long, lo double, hi double, n long")

    names = list(edges)
    first = per_range([edges[c][1] for c in names])
    width = per_range([(edges[c][2] if bins > 1 else edges[c][1] + 1.0) - edges[c][1] for c in names])
    cuts = "array({})[r]".format(", ".join(f"array({', '.join(lit(x) for x in edges[c])})" for c in names))
    placed = cells(df, [(i, as_double(c)) for i, c in enumerate(names)]).selectExpr(
        "r", "v", f"cast(least(greatest(ceil((v - {first}) / {width}) + 1, 1), {bins}) as int) as guess")
    # The division only guesses; the stored edges decide.
    placed = placed.selectExpr("r", f"""cast(case when guess < {bins} and v > {cuts}[guess] then guess + 1
        when guess > 1 and v <= {cuts}[guess - 1] then guess - 1 else guess end as bigint) as bin""")
    counted = placed.groupBy("r", "bin").agg(F.count("*").alias("n"))
    counted = counted.withColumn("column", F.array(*[F.lit(c) for c in names])[F.col("r")]).drop("r")
    grid = df.sparkSession.createDataFrame(
        [(c, i + 1, e[i], e[i + 1]) for c, e in edges.items() for i in range(bins)],
        "column string, bin long, lo double, hi double")
    # Both sides hold at most columns x bins rows.
    return grid.join(F.broadcast(counted), ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---- full profile ------------------------------------------------------------------


def profile(df: DataFrame, top_k: int = 5, high_cardinality: int = 50) -> DataFrame:
    """One row per column: counts, moments, quartiles, frequent values and alerts.

    Datetime columns are measured in epoch seconds and have no deviation or skew.
    """
    df = kinds.nan_to_null(df)
    columns = kinds.comparable(df)
    nums, dates = set(kinds.numeric(df)), set(kinds.datetime(df))
    value = {c: seconds_text(df, c) if c in dates else num(c) for c in columns if c in nums | dates}
    quartiles = fit_quartiles(df, list(value))

    def number(template: str, of: set = frozenset(value)):
        return lambda c: template.format(value[c]) if c in of else "cast(null as double)"

    def count(template: str):
        return lambda c: f"count_if({template.format(num(c))})" if c in nums else "cast(null as bigint)"

    base = per_column(df, columns, {
        "kind": lambda c: "'numeric'" if c in nums else "'datetime'" if c in dates else "'categorical'",
        "n": lambda c: "count(*)",
        "missing": lambda c: f"count(*) - count({q(c)})",
        "zeros": count("{} = 0"),
        "negatives": count("{} < 0"),
        "infinite": count("abs({}) = double('infinity')"),
        "mean": number("avg({})"),
        "std": number("stddev_samp({})", nums),
        "min": number("min({})"),
        "q25": lambda c: lit(quartiles[c][0] if c in value else None),
        "q50": lambda c: lit(quartiles[c][1] if c in value else None),
        "q75": lambda c: lit(quartiles[c][2] if c in value else None),
        "max": number("max({})"),
        "skew": lambda c: adjusted_skew(num(c)) if c in nums else "cast(null as double)"}, "")
    counts = _all_value_counts(df)
    distinct = counts.groupBy("column").agg(F.count("*").alias("n_distinct"), F.max("n").alias("top_freq"))
    # A rank filter on row_number is limited per input partition before the shuffle.
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    frequent = counts.withColumn("_r", rank).where(F.col("_r") <= top_k).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("_r", "value"))).alias("best"))
    out = base.join(F.broadcast(distinct), "column", "left").join(F.broadcast(frequent), "column", "left")
    out = out.withColumns({
        "n_distinct": F.coalesce("n_distinct", F.lit(0)),
        "top_values": F.array_join(F.transform("best", lambda b: b["value"]), "|")}).drop("best")
    alerts = F.array(
        F.when(F.col("n_distinct") <= 1, F.lit("constant")),
        F.when((F.col("kind") == "categorical") & (F.col("n_distinct") > high_cardinality), F.lit("high_cardinality")),
        F.when(F.col("missing") > 0.2 * F.col("n"), F.lit("high_missing")),
        F.when(F.abs("skew") > 1, F.lit("skewed")))
    return out.withColumns({
        "is_unique": (F.col("n_distinct") == F.col("n") - F.col("missing")) & (F.col("n") > F.col("missing")),
        "alerts": F.array_join(F.array_compact(alerts), ",")})
