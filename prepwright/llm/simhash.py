"""Near duplicates by SimHash: fingerprints, and exact comparison of tiles of them."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import map_batches, stored, text_key
from prepwright.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
# Fingerprints of a tile, about.
TILE = 4_096
# A fingerprint is counted in this many parts of 16 bits; tiles hold fingerprints of equal counts.
PARTS = 4
PART_BITS = 64 // PARTS
KEYS = (PART_BITS + 1) ** PARTS
# Comparisons held in memory at once, and links that are reduced to a forest at once.
BLOCK = 1 << 22
LINKS = 1 << 18
# Hashes whose bits are counted at once.
COUNTED = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each is 1 if it is set in over half the XXH64 hashes of the text's shingles, repeats included.

    Words lie between ASCII white space, A-Z in lower case; fewer words than a shingle are one shingle,
    none give zero.
    """
    words = (text or "").encode().lower().split()   # both look at ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-1].tolist())]
    n = max(1, len(words) - shingle + 1)
    last = (ends - 1).tolist()[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, COUNTED):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + COUNTED], last[at:at + COUNTED])][:n - at], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """doc_id, text_hash if ``hashed``, and the fingerprint as a signed long."""
    keys = text_key()[:2 if hashed else 1]
    names = ["doc_id", "text_hash"][:len(keys)]

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield {c: batch.column(c) for c in names} | {"fingerprint": pa.array(values.view(np.int64))}
    return map_batches(docs.select(*keys, "text"), run, ", ".join(f"{c} bigint" for c in [*names, "fingerprint"]))


def _key(column: str) -> str:
    """SQL for the number of a fingerprint's counts of set bits, part by part."""
    parts = [f"bit_count(shiftrightunsigned({column}, {PART_BITS * i}) & {(1 << PART_BITS) - 1}L) * {(PART_BITS + 1) ** i}" for i in range(PARTS)]
    return "cast(" + " + ".join(parts) + " as int)"


def _near_keys(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts that fingerprints within the radius can have: a changed bit changes one count by one."""
    return [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each value to the smallest one that the given links reach; fewer than there are values."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def near_links(values: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect just what pairs of the distinct longs ``value`` within ``radius`` bits connect.

    Values of equal bit counts, part by part, form tiles of about ``tile`` values. A tile meets the tiles
    whose counts differ by the radius at most; all others are skipped, for no pair between them can be near.
    Every pair of a met tile is compared by exclusive-or and bit count. Of the near pairs a spanning forest
    leaves the task, so a dense group of m values gives links in proportion to m and not to its pairs.
    """
    keyed = values.selectExpr("value", f"{_key('value')} as key")
    # KEYS rows at most (83,521), whatever the number of values.
    sizes = stored(keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "tile-counts")
    tiles = stored(keyed.join(F.broadcast(sizes), "key")
                   .withColumn("tile", F.pmod(F.xxhash64("value"), F.col("tiles")).cast("int"))
                   .groupBy("key", "tile").agg(F.collect_list("value").alias("members")), "tiles")

    # Which keys a key meets: itself and those above it, so that two tiles meet once.
    steps = ", ".join(f"array({', '.join(map(str, d))})" for d in _near_keys(radius)
                      if sum(x * (PART_BITS + 1) ** i for i, x in enumerate(d)) >= 0)
    counts = ", ".join(f"(key div {(PART_BITS + 1) ** i}) % {PART_BITS + 1}" for i in range(PARTS))
    other = " + ".join(f"(c[{i}] + d[{i}]) * {(PART_BITS + 1) ** i}" for i in range(PARTS))
    inside = " and ".join(f"c[{i}] + d[{i}] between 0 and {PART_BITS}" for i in range(PARTS))
    meets = (sizes.selectExpr("key", f"array({counts}) as c").selectExpr("key", "c", f"explode(array({steps})) as d")
             .filter(inside).selectExpr("key", f"cast({other} as int) as other"))
    meets = (meets.join(F.broadcast(sizes.withColumnsRenamed({"key": "other", "tiles": "others"})), "other")
             .selectExpr("key", "other", "explode(sequence(0, others - 1)) as other_tile"))
    left = (tiles.join(stored(meets, "tile-meetings"), "key")
            .filter("key <> other or tile <= other_tile")
            .select(F.col("members").alias("left"), "other", "other_tile"))
    met = left.join(tiles.withColumnsRenamed({"key": "other", "tile": "other_tile", "members": "right"}), ["other", "other_tile"])

    def compare(batches):
        found, held = [], 0
        for batch in batches:
            lefts, rights = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                a = lefts[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = rights[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                step = max(1, BLOCK // len(b))
                for at in range(0, len(a), step):
                    x, y = np.nonzero(np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= radius)
                    x, y = a[at + x], b[y]
                    near = x != y
                    if near.any():
                        found.append((x[near], y[near]))
                        held += int(near.sum())
                    if held > LINKS:
                        found = [_forest(*map(np.concatenate, zip(*found)))]
                        if len(found[0][0]) > LINKS // 2:
                            yield _columns(*found.pop())
                        held = sum(len(x) for x, _ in found)
        if found:
            yield _columns(*_forest(*map(np.concatenate, zip(*found))))
    return map_batches(met.select("left", "right"), compare, "a bigint, b bigint")


def _columns(a: np.ndarray, b: np.ndarray) -> dict:
    return {"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))}


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Documents whose fingerprints differ in ``radius`` bits at most are linked; component_id is the smallest
    doc_id that links reach. Equal fingerprints are one value in the comparison, so copies make no pairs.
    Documents without words (missing or empty texts too) have fingerprint zero and are linked like others.
    Rows that repeat an id are linked through it, whatever their texts. An id that is missing is smaller than
    none: a group of such rows alone has a missing component_id. Other columns are not looked at.
    """
    return groups(docs, shingle, radius, tile).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, hashed: bool = False) -> DataFrame:
    """As ``near_duplicates``, with the fingerprint as a long and ``root``, a fingerprint that stands for the group;
    unlike component_id it is never missing. ``hashed`` adds text_hash."""
    rows = stored(fingerprints(docs, shingle, hashed), "fingerprints")
    owners = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprint-owners")
    links = near_links(owners.select(F.col("fingerprint").alias("value")), radius, tile)
    # An id that stands for several fingerprints links them.
    repeats = (rows.filter("doc_id is not null").groupBy("doc_id")
               .agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("top")).filter("b <> top").select("doc_id", "b"))
    linked = rows.join(repeats, "doc_id").select(F.col("fingerprint").alias("a"), "b").filter("a <> b").distinct()
    roots = components(links.unionAll(linked))
    grouped = owners.join(roots.withColumnRenamed("value", "fingerprint"), "fingerprint", "left") \
        .withColumn("root", F.coalesce("root", "fingerprint"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = stored(grouped.join(least, "root").select("fingerprint", "root", "component_id"), "fingerprint-components")
    # One row per fingerprint on the right: a fingerprint of very many copies is split on the left.
    return rows.join(ids, "fingerprint")
