"""Encoding, scaling and feature selection."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepwright import kinds
from prepwright.kinds import as_double, col, num
from prepwright.session import attach, cut_lineage, scratch_path


# A text column with more values than this stays one column.
WIDE = 1_000


def _level_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ord, column, level) of every present value of the columns; ``ord`` is the column's position."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), col(c).alias("level"))
                                         for i, c in enumerate(columns)])))
    return cells.where("level is not null")


def count_levels(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values per column, counted in Spark: one number per column reaches the driver."""
    if not columns:
        return {}
    found = _level_cells(df, columns).distinct().groupBy("column").agg(F.count("*").alias("n")).collect()
    return {c: 0 for c in columns} | {r["column"]: r["n"] for r in found}


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, place): all distinct values of the columns, numbered from 0 column by column in sorted order.

    The table is stored and stays distributed, whatever the number of values.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, level string, place long")
    found = _level_cells(df, columns).distinct().withColumn("_o", F.struct("ord", "level"))
    places = _numbered(found.withColumn("_v", F.struct("column", "level")), "_o", "_v")
    return cut_lineage(places.select("_v.column", "_v.level", F.col("_code").alias("place")))


def attach_places(df: DataFrame, columns: list[str], levels: DataFrame, prefix: str = "_at") -> DataFrame:
    """Add ``{prefix}{i}``, the place of each column's value in a dictionary; missing and unknown values have none."""
    for i, c in enumerate(columns):
        places = levels.where(F.col("column") == c).select(F.col("level").alias(c), F.col("place").alias(f"{prefix}{i}"))
        df = attach(df, places, [c]).select(*map(col, df.columns), F.col(f"{prefix}{i}"))
    return df


def feature_vector(df: DataFrame, nums: list[str], words: list[str], output: str = "features") -> tuple[DataFrame, DataFrame]:
    """Add a sparse vector of the numeric columns and of a one per text value; also (place, feature), its names.

    Numbers come first, then the values of each text column in sorted order; a missing value has no one. The
    vector is written in the stored form of Spark ML's sparse vectors and read back as one, so neither
    values nor names pass the driver. ``df`` must be storable.
    """
    kinds.require(df, *nums, *words)
    levels = dictionary(df, words)
    size = len(nums) + levels.count()
    if size >= 1 << 31:
        raise ValueError(f"{size} features are more than a vector can hold")
    placed = attach_places(df, words, levels)
    ones = [F.col(f"_at{i}").cast("int") + len(nums) for i in range(len(words))]
    there = F.array_compact(F.array(*ones)) if words else F.array().cast("array<int>")
    indices = F.concat(F.array(*[F.lit(i) for i in range(len(nums))]).cast("array<int>"), there)
    values = F.concat(F.array(*[as_double(c) for c in nums]).cast("array<double>"), F.transform(there, lambda _: F.lit(1.0)))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    rows = placed.select(*map(col, df.columns), vector.alias(output))
    path = scratch_path(df.sparkSession, "vectors")
    rows.write.parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(output, VectorUDT())])
    names = levels.select((F.col("place") + len(nums)).alias("place"), F.concat_ws("_", "column", "level").alias("feature"))
    if nums:
        names = df.sparkSession.createDataFrame(list(enumerate(nums)), "place long, feature string").unionByName(names)
    return df.sparkSession.read.schema(schema).parquet(path), names


def level_correlations(df: DataFrame, columns: list[str], threshold: float = 0.9) -> DataFrame:
    """(column_a, level_a, column_b, level_b, n, corr): pairs of one-hot columns with abs(corr) at or above ``threshold``.

    ``n`` counts rows with both values. All follows from one table of how often values occur together. Two values
    that never do are as strongly correlated only if both are frequent, so of those only values of a quarter of the
    rows or more are paired (four a column at most); ``threshold`` must be 0.5 or more for that.
    """
    kinds.require(df, *columns)
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0.5 and 1")
    values = F.array_compact(F.array(*[F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), col(c).alias("level")))
                                       for i, c in enumerate(columns)]))
    pairs = F.flatten(F.transform(values, lambda x: F.transform(
        F.filter(values, lambda y: y["ord"] >= x["ord"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    together = cut_lineage(df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")))
    single = cut_lineage(together.where("a = b").select(F.col("a").alias("v"), F.col("n").alias("of")))
    rows = df.count()
    often = single.where(F.col("of") >= rows / 4)
    apart = often.select(F.col("v").alias("a")).join(F.broadcast(often.select(F.col("v").alias("b"))), F.col("a") < F.col("b"))
    found = together.where("a <> b").unionByName(apart.withColumn("n", F.lit(0).cast("long"))).groupBy("a", "b").agg(F.max("n").alias("n"))
    for side in ("a", "b"):
        found = found.join(single.select(F.col("v").alias(side), F.col("of").alias(f"n_{side}")), side)
    spread = lambda c: F.col(c).cast("double") * (F.lit(rows) - F.col(c))
    corr = (F.col("n").cast("double") * rows - F.col("n_a").cast("double") * F.col("n_b")) / F.sqrt(spread("n_a")) / F.sqrt(spread("n_b"))
    found = found.where((F.col("n_a") < rows) & (F.col("n_b") < rows)).withColumn("corr", corr)
    return found.where(F.abs(F.round("corr", 12)) >= threshold).select(
        F.col("a.column").alias("column_a"), F.col("a.level").alias("level_a"), F.col("b.column").alias("column_b"),
        F.col("b.level").alias("level_b"), "n", "corr")


def fit_levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column, for a table that gets a column of each."""
    levels: dict[str, list[str]] = {c: [] for c in columns}
    if not columns:
        return levels
    for r in _level_cells(df, columns).select("column", "level").distinct().collect():
        levels[r["column"]].append(r["level"])
    return {c: sorted(values) for c, values in levels.items()}


def one_hot(df: DataFrame, columns: list[str] | None = None, sparse: list[str] | None = None, wide: int = WIDE) -> DataFrame:
    """Boolean column per value of every text column; a missing value is false everywhere.

    Columns with more than ``wide`` values, and those named in ``sparse``, stay one column instead: a
    struct of ``size``, the number of distinct values, and ``index``, the place of the row's value among
    the sorted values, or NULL if it is missing. Values are counted first, so the driver never holds
    more than ``wide`` of a column.
    """
    columns = kinds.text(df) if columns is None else columns
    sizes = count_levels(df, [c for c in columns if c not in (sparse or [])])
    sparse = [c for c in columns if c in (sparse or []) or sizes[c] > wide]
    levels = fit_levels(df, [c for c in columns if c not in sparse])
    kept = [col(c) for c in df.columns if c not in levels]
    out = df.select(*kept, *[col(c).eqNullSafe(F.lit(v)).alias(f"{c}_{v}") for c in levels for v in levels[c]])
    for c in sparse:
        values = df.where(col(c).isNotNull()).select(col(c).alias("_v")).distinct()
        codes = cut_lineage(_numbered(values.withColumn("_o", F.col("_v")), "_o", "_v"))
        place = F.struct(F.lit(codes.count()).cast("long").alias("size"), F.col("_code").alias("index"))
        out = attach(out, codes.withColumnRenamed("_v", c), [c]).withColumn(c, place).select(*map(col, out.columns))
    return out


def _numbered(values: DataFrame, order: str, key: str) -> DataFrame:
    """Consecutive codes over distinct values without sorting them in a single task.

    Values are range-partitioned by the order, numbered inside each partition, and shifted
    by the sizes of the partitions before it (one number per partition).
    """
    placed = cut_lineage(values.repartitionByRange(order, key).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offset, shifts = 0, []
    for p in sorted(sizes):
        shifts += [F.lit(p), F.lit(offset).cast("long")]
        offset += sizes[p]
    if not shifts:
        return placed.select(key, F.lit(0).cast("long").alias("_code"))
    rank = F.row_number().over(W.partitionBy("_p").orderBy(order, key)) - 1
    return placed.select(key, (rank + F.create_map(*shifts)[F.col("_p")]).cast("long").alias("_code"))


def _coded(df: DataFrame, column: str, codes: DataFrame, output: str) -> DataFrame:
    # Missing keys match nothing, so they fall through to -1.
    return attach(df, codes.withColumnRenamed("_v", column), [column]).withColumn(
        output, F.coalesce("_code", F.lit(-1).cast("long"))).select(*map(col, df.columns), col(output))


def label_codes(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Integer code per value by first appearance in the given order; missing = -1."""
    kinds.require(df, column, order_by)
    first = df.where(col(column).isNotNull()).groupBy(col(column).alias("_v")).agg(F.min(col(order_by)).alias("_o"))
    return _coded(df, column, _numbered(first, "_o", "_v"), f"{column}_code")


def sorted_codes(df: DataFrame, column: str) -> DataFrame:
    """Integer code per value by sorted value; missing = -1."""
    values = df.where(col(column).isNotNull()).select(col(column).alias("_v")).distinct()
    codes = _numbered(values.withColumn("_o", F.col("_v")), "_o", "_v")
    return _coded(df, column, codes, f"{column}_code")


def _moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    stats = {"mean": "avg", "sd": "stddev_pop", "var": "var_pop", "min": "min", "max": "max"}
    row = df.selectExpr(*[f"{fn}({num(c)}) as {m}{i}" for i, c in enumerate(columns)
                          for m, fn in stats.items()]).first() if columns else {}
    return {c: {m: row[f"{m}{i}"] for m in stats} for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0, missing stays."""
    df = kinds.nan_to_null(df)
    columns = kinds.numeric(df) if columns is None else columns
    scaled = {}
    for c, m in _moments(df, columns).items():
        if m["mean"] is None:
            continue
        # A constant is recognised by its range: its computed deviation may not be exactly 0.
        scaled[c] = (as_double(c) - F.lit(m["mean"])) / F.lit(m["sd"]) if m["min"] < m["max"] \
            else F.when(col(c).isNotNull(), F.lit(0.0))
    return df.withColumns(scaled) if scaled else df


def minmax_scale(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column is 0 on every row, missing ones too."""
    df = kinds.nan_to_null(df)
    columns = kinds.numeric(df) if columns is None else columns
    scaled = {}
    for c, m in _moments(df, columns).items():
        if m["min"] is None:
            continue
        scaled[c] = (as_double(c) - F.lit(m["min"])) / F.lit(m["max"] - m["min"]) if m["min"] < m["max"] \
            else F.lit(0.0)
    return df.withColumns(scaled) if scaled else df


def low_variance(df: DataFrame, threshold: float = 0.0) -> tuple[list[str], list[str]]:
    """(kept, dropped) numeric columns by population variance."""
    df = kinds.nan_to_null(df)
    columns = kinds.numeric(df)
    kept = []
    for c, m in _moments(df, columns).items():
        if m["var"] is None:
            continue
        # At threshold 0 the range decides too, so rounding noise keeps no constant alive.
        spread = min(m["var"], m["max"] - m["min"]) if threshold == 0 else m["var"]
        if spread > threshold:
            kept.append(c)
    if columns and not kept:
        raise ValueError(f"No feature meets the variance threshold {threshold}")
    return kept, [c for c in columns if c not in kept]


def drop_low_variance(df: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, list[str]]:
    """Non-numeric columns first, then the numeric columns that vary; and the dropped names."""
    kept, dropped = low_variance(df, threshold)
    nums = {*kept, *dropped}
    return df.select(*[col(c) for c in df.columns if c not in nums], *[col(c) for c in kept]), dropped
