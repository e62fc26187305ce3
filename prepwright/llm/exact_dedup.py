"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import held, sketch, stored

PREFIX_CHARS = 256
# A sketch of surviving groups has this many bits (1 MB), whatever the size of the table.
SKETCH_BITS = 1 << 23


def surviving(keys: DataFrame) -> DataFrame:
    """Sketch of the keys that several rows share.

    Two keys may share a bit. That only lets a row through that the next level rejects.
    """
    return sketch(keys.groupBy(*keys.columns).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), SKETCH_BITS)


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digests: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The digest is null where the
    text was not read in full, unless ``digests`` asks for all of them.

    Equal texts form a group; its row with the largest doc_id stays. A level reads the next piece
    of a text only where the level before left several rows in a group: lengths need no content,
    prefixes are hashed where a length repeats, whole texts where length and prefix repeat. What
    passes from level to level is a bitmap of fixed size, so no text is ever shuffled.

    A missing text counts as empty. Of rows that repeat a doc_id with the same text one stays at most; each
    counts in group_size. An id that is missing is smaller than any other, and of a group without ids one row
    stays. doc_id may be of any type. Other columns of ``docs`` are not looked at; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    # The number tells rows apart that are equal in all else.
    rows = docs.select("doc_id", text.alias("_text"), F.octet_length(text).alias("size"), F.monotonically_increasing_id().alias("row"))
    by_length = surviving(rows.select("size"))

    rows = held(rows, by_length, SKETCH_BITS, ["size"], "alive")
    rows = rows.withColumn("prefix", F.when(F.col("alive"), F.xxhash64(F.substring("_text", 1, prefix_chars))))
    rows = rows.drop("alive")
    by_prefix = surviving(rows.filter("prefix is not null").select("size", "prefix"))

    rows = held(rows, by_prefix, SKETCH_BITS, ["size", "prefix"], "alive")
    full, last = F.sha2("_text", 256), F.col("alive") & F.col("prefix").isNotNull()
    rows = rows.select("doc_id", "row", "size", "prefix", last.alias("last"), (full if digests else F.when(last, full)).alias("text_sha256"))
    rows = stored(rows, "exact-rows")

    groups = stored(rows.filter("last").groupBy("size", "prefix", "text_sha256")
                    .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
                    .filter("group_size > 1"), "exact-groups")
    # One row per group on the right: a group that holds much of the table is split on the left.
    found = rows.join(groups, ["size", "prefix", "text_sha256"], "left")
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("row").eqNullSafe(F.col("keep.row"))).alias("kept"),
        "text_sha256")
