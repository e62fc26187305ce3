"""Writing tables, reports and the payloads that BI services take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepwright.kinds import col
from prepwright.session import cut_lineage

ROW_MASK = (1 << 33) - 1


def write_csv(df: DataFrame, path: str) -> None:
    """Header, no index; nested columns go out as JSON text."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    flat = df.select(*[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in df.columns])
    flat.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_object(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Any URI the cluster's file systems know, such as an object-store prefix."""
    df.write.format(fmt).save(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A report is one nested row; NULL fields are written too."""
    report.write.option("ignoreNullFields", False).json(path)


def bi_schema(df: DataFrame) -> DataFrame:
    """(column, push_type, extract_type) names of the two BI services' column types."""
    # Type names of the push interface and of the extract file.
    def names(t: T.DataType) -> tuple[str, str]:
        if isinstance(t, T.IntegralType):
            return "Int64", "big_int"
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "Double", "double"
        if isinstance(t, T.BooleanType):
            return "Boolean", "bool"
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "DateTime", "timestamp"
        return "string", "text"

    return df.sparkSession.createDataFrame([(f.name, *names(f.dataType)) for f in df.schema],
                                           "column string, push_type string, extract_type string")


def push_batches(df: DataFrame, batch_rows: int = 10_000, batch_chars: int = 4_000_000) -> DataFrame:
    """(batch_id, n, payload): JSON payloads of at most ``batch_rows`` rows and, but for one row, ``batch_chars``.

    Rows are numbered where they lie, so no value can put too many rows in one batch; the
    numbering is stored first, so a retried task cannot change it. Sending the payloads is
    the caller's ``foreachPartition``.
    """
    rows = df.select(F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))
    rows = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(ROW_MASK))
    # Rows of a stored partition, so the window is as large as an input split.
    size = F.length("row")
    before = F.sum(size).over(W.partitionBy(part).orderBy("_id")) - size
    rows = rows.withColumn("_before", before)
    batch = F.concat_ws("-", part.cast("string"), F.floor(at / batch_rows).cast("string"), F.floor(F.col("_before") / batch_chars).cast("string"))
    return rows.groupBy(batch.alias("batch_id")).agg(
        F.count("*").alias("n"),
        F.concat(F.lit('{"rows":['), F.array_join(F.collect_list("row"), ","), F.lit("]}")).alias("payload"))
