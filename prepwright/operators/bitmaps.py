"""Bitmaps of keys: rows whose key is surely not on the other side of a join stay where they are."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS_PER_KEY = 16
# 32 MB, whatever the number of keys; more keys only let more rows through.
MAX_BITS = 1 << 28
SLICE_WORDS = 512
SLICE_BITS = 64 * SLICE_WORDS
# Of a bitmap for Python tasks: 128 KB are made at once.
BLOCK_BITS = 1 << 20


def bits_for(keys: int) -> int:
    """A power of two, one slice at least."""
    return 1 << min(MAX_BITS.bit_length() - 1, max(SLICE_BITS.bit_length() - 1, (BITS_PER_KEY * keys).bit_length()))


def bitmap(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(slice, words): the bits of all keys, hashed 64-bit numbers, in slices of 4 KB; combined map-side."""
    at = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(at.alias("at")).selectExpr(
        f"cast(at div {SLICE_BITS} as int) as slice", f"cast(at % {SLICE_BITS} div 64 as int) as word", "shiftleft(1L, cast(at % 64 as int)) as bit")
    words = words.groupBy("slice", "word").agg(F.bit_or("bit").alias("bit"))
    return words.groupBy("slice").agg(F.map_from_entries(F.collect_list(F.struct("word", "bit"))).alias("m")).selectExpr(
        "slice", f"transform(sequence(0, {SLICE_WORDS - 1}), i -> coalesce(m[i], 0L)) as words")


def possible(df: DataFrame, column: str, held: DataFrame, bits: int) -> DataFrame:
    """The rows whose key may be in the bitmap, which is broadcast; its size is bounded by ``bits``."""
    kept = df.columns
    at = F.pmod(F.col(column), F.lit(bits))
    placed = df.withColumn("_at", at).withColumn("slice", F.expr(f"cast(_at div {SLICE_BITS} as int)"))
    near = placed.join(F.broadcast(held), "slice")
    return near.filter(f"(words[cast(_at % {SLICE_BITS} div 64 as int)] & shiftleft(1L, cast(_at % 64 as int))) <> 0").select(*kept)


def _packed(batches):
    """(block, bit in it) to (block, words), little-endian bytes of all its bits."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        block, at = batch.column("block").to_numpy(), batch.column("at").to_numpy()
        for b in np.unique(block):
            blocks.setdefault(int(b), np.zeros(BLOCK_BITS, bool))[at[block == b]] = True
    for b, held in blocks.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "words": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def sent(keys: DataFrame, column: str, bits: int) -> Broadcast:
    """The bits of all keys, hashed 64-bit numbers, as an array of words that Python tasks read; its size is bounded by ``bits``."""
    at = F.pmod(F.col(column), F.lit(bits))
    placed = keys.select(at.alias("at")).selectExpr(f"cast(at div {BLOCK_BITS} as int) as block", f"cast(at % {BLOCK_BITS} as int) as at")
    found = placed.repartition("block").mapInArrow(_packed, "block int, words binary").toArrow()
    words = np.zeros((max(1, bits // BLOCK_BITS), BLOCK_BITS // 64), np.uint64)
    for block, held in zip(found.column("block").to_pylist(), found.column("words")):
        words[block] = np.frombuffer(held.as_buffer(), "<u8")
    return keys.sparkSession.sparkContext.broadcast(words.ravel()[:bits // 64])
