"""Which filter removes what: survival words of documents and the interaction of filters in every order."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import join_rows, map_batches, stored

NAMES = "ABCDE"
SUBSETS = 1 << len(NAMES)
REPEATED = 1 << NAMES.index("E")
# Words that are added up at once by bitwise adders.
LANES = 64


@dataclass(frozen=True)
class Limits:
    """A: fewer words. B: fewer distinct words in a hundred. C: more capital letters (A-Z) in a hundred characters.
    D: one of these marks. E has no number: an earlier document has the same text."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10
    marks: str = "#$%&*|"


CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def failures(text: str, limits: Limits = Limits()) -> int:
    """Bits of the filters A to D that a text fails by itself. Words lie between ASCII white space."""
    raw = text.encode()
    words = raw.split()   # of bytes: between \\x20 and \\x09 to \\x0D only
    return ((len(words) < limits.words) | (100 * len(set(words)) < limits.distinct * len(words)) << 1
            | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > limits.capitals * len(text)) << 2
            | any(mark in text for mark in limits.marks) << 3)


def outcomes(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: doc_id, part, digest (of the text), failed (bits in the order of NAMES)."""
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "part": batch.column("part"),
                   "digest": [hashlib.sha256(t.encode()).digest() for t in texts],
                   "failed": [failures(t, limits) for t in texts]}
    wanted = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    kind = wanted.schema["doc_id"].dataType.simpleString()
    rows = stored(map_batches(wanted, run, f"doc_id {kind}, part string, digest binary, failed int"), "audit-outcomes")
    # One row per text that several rows share: a text of very many copies is split on the side of the documents.
    first = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
                   .filter("n > 1").drop("n"), "audit-repeats")
    return rows.join(first, "digest", "left").select(
        "doc_id", "part", "digest", F.when(F.col("doc_id") > F.col("first"), F.col("failed").bitwiseOR(REPEATED)).otherwise(F.col("failed")).alias("failed"))


# Bit s of the word of a document that fails the filters m is set if it survives the filters of subset s: none of them is in m.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, by carry-save adders.

    Rows of LANES words are added three to two: their sum bits stay at one level and their carries, which
    count double, go one level up, until a level has two rows left. Only those are taken apart bit by bit.
    """
    rest = len(words) % LANES
    level = words[rest:].reshape(-1, LANES)
    counts = np.unpackbits(words[:rest].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    weight = 1
    while len(level):
        carried = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c, left = level[:third], level[third:2 * third], level[2 * third:3 * third], level[3 * third:]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            level = np.concatenate([odd ^ c, left])
        bits = np.unpackbits(np.ascontiguousarray(level, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        counts = counts + weight * bits.sum(axis=0, dtype=np.int64)
        level = np.concatenate(carried) if carried else level[:0]
        weight *= 2
    return counts


def survivors(marked: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents that survive the filters of the subset, all of them and by label.

    ``marked`` has part, failed, good and toxic of every document. A task gives a row per part, label and subset.
    """
    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            words = WORDS[batch.column("failed").to_numpy()]
            labels = batch.column("good").to_numpy(zero_copy_only=False) + 2 * batch.column("toxic").to_numpy(zero_copy_only=False)
            parts = batch.column("part").dictionary_encode()
            group = parts.indices.to_numpy() * 4 + labels
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            for rows in np.split(order, cuts):
                key = (parts.dictionary[int(group[rows[0]]) // 4].as_py(), int(group[rows[0]]) % 4)
                sums[key] = sums.get(key, 0) + positional_counts(words[rows])
            if len(sums) > 4096:
                yield _rows(sums)
                sums = {}
        if sums:
            yield _rows(sums)
    cells = map_batches(marked.select("part", "failed", "good", "toxic"), run, "part string, label int, subset int, n bigint")
    labelled = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    return cells.groupBy("part", "subset").agg(F.sum("n").alias("n"), labelled(1).alias("good"), labelled(2).alias("toxic"))


def _rows(sums: dict[tuple, np.ndarray]) -> dict:
    return {"part": [p for p, _ in sums for _ in range(SUBSETS)], "label": [g for _, g in sums for _ in range(SUBSETS)],
            "subset": list(range(SUBSETS)) * len(sums), "n": np.concatenate(list(sums.values()))}


STEP = "array<struct<filter_order: string, step: int, own: int, before: int, after: int>>"


def _steps() -> list[dict]:
    """Every step of every order: its filter and the subsets applied before and after it, as bits."""
    rows = []
    for order in permutations(range(len(NAMES))):
        done = 0
        for step, f in enumerate(order, 1):
            rows.append({"filter_order": "".join(NAMES[i] for i in order), "step": step, "own": 1 << f, "before": done, "after": done | 1 << f})
            done |= 1 << f
    return rows


def audited(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What every filter does at every step of every order, part by part (a value of lang).

    One row per part, filter_order (a permutation of ABCDE) and step (1 to 5, whose filter is that letter):
    kept (documents left after it), removed (by it), redundant (that it would remove but which are gone),
    unique_fails (that fail it alone), good_lost and toxic_lost (removed by it with quality or toxic 1 in
    ``labels``) and shapley (documents that its filter removes, summed over all orders).

    E fails rows whose text a row with a smaller doc_id has; an id that is missing is neither smaller nor larger.
    A missing text counts as empty, a missing lang as the empty string. Rows of labels that repeat a doc_id count
    as one, which is good or toxic if any of them is; rows that repeat a document count each. Empty documents give
    no rows; other columns of both tables are not looked at.
    """
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    marked = join_rows(outcomes(docs, limits), known, "left", ("doc_id",)).select(
        "part", "failed", *[F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")])
    counted = stored(survivors(marked), "audit-survivors")
    # Bounded by the number of subsets: three lists of 32 numbers a part.
    at = lambda c: F.array_sort(F.collect_list(F.struct("subset", c)))[c].alias(c)
    parts = counted.groupBy("part").agg(at("n"), at("good"), at("toxic"))
    rows = parts.select("*", F.explode(F.from_json(F.lit(json.dumps(_steps())), STEP)).alias("s")).select("part", "n", "good", "toxic", "s.*")
    alone = f"n[{SUBSETS - 1} - own] - n[{SUBSETS - 1}]"
    rows = rows.selectExpr(
        "part", "filter_order", "step", "own", "n[after] as kept", "n[before] - n[after] as removed",
        "n[0] - n[own] - (n[before] - n[after]) as redundant", f"{alone} as unique_fails",
        "good[before] - good[after] as good_lost", "toxic[before] - toxic[after] as toxic_lost")
    rows = stored(rows, "audit-steps")
    return join_rows(rows, rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley")), "left", ("part", "own")).drop("own")
