"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import prepwright
from prepwright.session import provide_folder, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them back.

    The rows outlive any executor, later steps do not run this one again, and its shuffle
    files become garbage: the driver's JVM is asked to collect them, for else Spark keeps
    them on the executors' disks until the driver happens to run short of memory.
    """
    spark = df.sparkSession
    provide_folder(spark)
    path, schema = scratch_path(spark, name), df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    back = spark.read.schema(schema).parquet(path)
    back.stored_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def text_key() -> list[Column]:
    """What identifies a document's row beside its id: rows equal in both are repeats of one row."""
    return [F.col("doc_id"), F.xxhash64(F.lit("text"), F.coalesce("text", F.lit(""))).alias("text_hash")]


# Bytes of an Arrow batch, about; a longer row comes alone.
PORTION = 8 << 20
BATCH_BYTES, DEFAULT_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need no installed copy then and keep what they have loaded.

    Documents are long rows, and an executor holds a few batches for each task on either side: where the session
    leaves the size of Arrow batches at its default, it is lowered to PORTION.
    """
    context = spark.sparkContext
    if not getattr(context, "_prepwright_shipped", False):
        root = Path(prepwright.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="prepwright-package-"), "prepwright.zip")
        with zipfile.ZipFile(archive, "w") as packed:
            for path in sorted(root.rglob("*.py")):
                packed.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._prepwright_shipped = True
    if spark.conf.get(BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, str(PORTION))


def _portions(batches: Iterator[pa.RecordBatch], portion: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * portion // max(portion, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]],
                schema: StructType | str, portion: int = PORTION) -> DataFrame:
    """``mapInArrow`` for a function that yields plain columns: a dict of lists or arrays by name.

    It gets batches of about ``portion`` bytes, by the mean size of a row.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    ship_package(df.sparkSession)
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(_portions(batches, portion)):
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in
                 zip((columns[f.name] for f in arrow), arrow)], schema=arrow)
        # The worker lives on, beside other ones of its executor.
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; a missing one is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def join_rows(left: DataFrame, right: DataFrame, how: str, on: tuple[str, ...] = ("doc_id", "text_hash")) -> DataFrame:
    """Join on columns of both, by default those of ``text_key``; missing values match each other."""
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    fits = reduce(Column.__and__, [left[c].eqNullSafe(other[f"_right_{c}"]) for c in on])
    return left.join(other, fits, how).drop(*[f"_right_{c}" for c in on])


# A sketch is a bitmap of hashed keys in slices of 4 KB, 32 MB at most, whatever it is made of.
SLICE_BITS = 32_768
MAX_SKETCH_BITS = 1 << 28


def sketch(keys: DataFrame, bits: int) -> DataFrame:
    """Bitmap of the rows' hashes: (slice, bits), a row for each SLICE_BITS of ``bits``."""
    bit = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    return (keys.select(F.bitmap_bucket_number(bit).alias("slice"), F.bitmap_bit_position(bit).alias("at"))
            .groupBy("slice").agg(F.bitmap_construct_agg("at").alias("bits")))


def held(df: DataFrame, bitmap: DataFrame, bits: int, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: false where a row's keys are surely not in the sketch. The rows do not move.

    The sketch is broadcast; its size is bounded by ``bits``.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return (df.withColumns({"_slice": F.bitmap_bucket_number(bit), "_at": at})
            .join(F.broadcast(bitmap.withColumnsRenamed({"slice": "_slice", "bits": "_bits"})), "_slice", "left")
            .withColumn(name, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1L, cast(_at % 8 as int))")) != 0, F.lit(False)))
            .drop("_slice", "_at", "_bits"))


def join_few(left: DataFrame, right: DataFrame, how: str, on: tuple[str, ...] = ("doc_id", "text_hash")) -> DataFrame:
    """``join_rows`` (inner, left or left_anti) for long rows of which a stored table, with one row per key, concerns a few.

    A sketch of the table's keys tells which rows may have a match. Only these are shuffled; the others go or stay
    where they lie. As more of the rows are concerned it turns into the plain join.
    """
    bits = 1 << min(MAX_SKETCH_BITS.bit_length() - 1, max(SLICE_BITS.bit_length() - 1, (16 * right.count()).bit_length()))
    flagged = held(left, sketch(right.select(*on), bits), bits, list(on), "_may")
    near = join_rows(flagged.filter("_may").drop("_may"), right, how, on)
    if how == "inner":
        return near
    return near.unionByName(flagged.filter("not _may").drop("_may"), allowMissingColumns=True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that a column of ``df`` has."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found
