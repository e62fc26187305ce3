"""Reading files, checking uploads and fingerprinting content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.functions.numbers import NUMBER_PATTERN
from prepwright.kinds import col

# CSV texts read as missing, upload limits and extensions.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                  "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOLEAN_TOKENS = ["True", "TRUE", "true", "False", "FALSE", "false"]
MAX_FILE_MB = 25
EXTENSIONS = ["csv"]


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a line holds an odd number of quotes, as it must where a quoted value goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header; a column gets a type only if every present value has it.

    Dates stay text. Integers with missing values become double, an empty column too.
    Files are split across tasks unless quoted line breaks (``multi_line``) forbid it; whether there
    are any is seen from the quotes of each line unless the caller says so.
    """
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"') \
        .option("multiLine", multi_line).csv(path)
    raw = raw.select(*[F.when(~col(c).isin(MISSING_TOKENS), col(c)).alias(c) for c in raw.columns])
    tests = {"n": lambda v: F.count(v), "all": lambda v: F.count("*"),
             "i": lambda v: F.count_if(v.rlike(r"^\s*[+-]?\d+\s*$") & v.try_cast("long").isNotNull()),
             "d": lambda v: F.count_if(v.rlike(NUMBER_PATTERN)), "b": lambda v: F.count_if(v.isin(BOOLEAN_TOKENS))}
    fit = raw.agg(*[make(col(c)).alias(f"{t}{i}") for i, c in enumerate(raw.columns)
                    for t, make in tests.items()]).first()

    def typed(i: int, c: str):
        n, rows = fit[f"n{i}"], fit[f"all{i}"]
        if fit[f"i{i}"] == n and n:
            return col(c).cast("long" if n == rows else "double")
        if fit[f"d{i}"] == n:
            return F.trim(col(c)).cast("double")
        if fit[f"b{i}"] == n and n == rows:
            return F.lower(col(c)).cast("boolean")
        return col(c)

    return raw.select(*[typed(i, c).alias(c) for i, c in enumerate(raw.columns)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str, limit: int = 0, sample_n: int = 0, order_by: list[str] | None = None,
         key: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """Read by extension (``multi_line`` as for ``read_csv``), then the first ``limit`` rows, then a sample of ``sample_n``."""
    from prepwright.operators.sampling import first_rows, sample
    df = read_csv(spark, path, multi_line) if path.lower().endswith(".csv") else read_parquet(spark, path)
    if limit > 0:
        df = first_rows(df, limit, order_by or [df.columns[0]])
    return sample(df, sample_n, key or df.columns[0]) if sample_n > 0 else df


def validate_files(spark: SparkSession, path: str, max_mb: float = MAX_FILE_MB,
                   extensions: list[str] | None = None) -> DataFrame:
    """(path, is_valid, reason): no_extension, extension (not an allowed one), too_large, or none."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    allowed = extensions or EXTENSIONS
    reason = F.when(~F.contains(name, F.lit(".")), "no_extension").when(~extension.isin(allowed), "extension").when(
        F.col("length") > F.lit(float(max_mb) * 1024 * 1024), "too_large").otherwise("")
    return files.select("path", (reason == "").alias("is_valid"), reason.alias("reason"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint) of a table's rows, whatever their order or partitioning.

    A row's cells, as text, are hashed by md5; the fingerprint is the sum of the first 60 bits.
    """
    cells = [F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in kinds.comparable(df)]
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("fingerprint"))


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_rows) of each Parquet file of one table, by reading it."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))
