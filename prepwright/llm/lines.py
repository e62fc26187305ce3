"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit if one has a character that the other lacks, or has another one in its place.
Deleting that character, and noting where, gives both the same variant. A line of n characters has about 2n
variants, so they are not all made at once: a first key leaves out a quarter of the line, where the edit may
be; zones whose keys several lines share are cut into smaller zones with keys of their own; and only inside
the small zones that are left the variants of single characters are made. An edit lies in some zone at each
level, so none is lost. All lines of a variant's bucket are within one edit of each other, so the earliest of
a bucket stands for the rest and no pairs are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import free_names, join_few, map_batches, release, stored, text_key, texts_of

MAX_EDITS = 1
# Shorter lines are never near another line: one edit in a few characters makes another line.
MIN_CHARS = 20
QUARTERS = 4
PARTS = 16
# Zones of this many characters are not cut further.
SMALL = 64
PLACE = ["doc_id", "text_hash", "at"]


def zones(start: int, end: int, parts: int) -> list[tuple[int, int]]:
    """Cut [start, end) into about equal parts; empty ones go."""
    cuts = [start + (end - start) * i // parts for i in range(parts + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def first_zones(chars: int) -> list[tuple[int, int, int]]:
    """(short, a, b): quarters of the line taken as the shorter one of a pair, and as the longer one."""
    return [(short, a, b) for short in (chars, chars - 1) for a, b in zones(0, short, QUARTERS)]


def zone_key(line: str, short: int, a: int, b: int) -> int:
    """Hash of a line without a zone. Lines of ``short`` characters or one more share it if they differ by a
    character replaced in [a, b) or put in anywhere from a to b. Other lines may share it too."""
    kept = line[:a] + "\x1f" + (line[len(line) - (short - b):] if b < short else "")
    return xxhash.xxh3_64_intdigest(kept.encode(), (short << 40 ^ a << 20 ^ b) & 0xFFFF_FFFF_FFFF_FFFF)


def variants(line: str, short: int, a: int, b: int) -> list[tuple[int, int]]:
    """128-bit keys of the variants with an edit in the zone: of a line of ``short`` characters those with one
    replaced or one put in, of a longer line those with one left out. The place is part of a key, hence lines
    that share one are within one edit of each other."""
    whole = len(line) == short
    found = [_wide("put", short, p, line[:p], line[p:] if whole else line[p + 1:]) for p in range(a, b + (b == short))]
    if whole:
        found += [_wide("swap", short, p, line[:p], line[p + 1:]) for p in range(a, b)]
    return found


def _wide(kind: str, short: int, p: int, head: str, tail: str) -> tuple[int, int]:
    return _halves(f"{kind} {short} {p} {head}{tail}")


def _halves(text: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(text.encode())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _lines(docs: DataFrame, min_chars: int, near: bool, short: bool) -> DataFrame:
    """Each line at its place, with a 128-bit hash (id, id2), its characters and its quarters' keys. Lines below
    ``min_chars`` have no keys and are there if they are ``short`` ones to compare and not blank."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in (*PLACE, "id", "id2", "chars", "keys")}
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts_of(batch)):
                for at, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars or short and line.strip():
                        row = (doc, key, at, *_halves(line), len(line),
                               _signed([zone_key(line, *z) for z in first_zones(len(line))]) if near and len(line) >= min_chars else None)
                        for column, value in zip(out.values(), row):
                            column.append(value)
            yield out
    return map_batches(docs.select(*text_key(), "text"), run,
                       "doc_id bigint, text_hash bigint, at int, id bigint, id2 bigint, chars int, keys array<bigint>")


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows whose ``key`` several lines have. The right side has one row per key, so a key of very many lines
    is split on the left."""
    often = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "line-keys")
    return keyed.join(often, "key", "left_semi").drop("key")   # ``often`` is read when the result is


def _with_text(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``line``, the text at each row's place (``first``)."""
    listed = stored(lines.withColumnsRenamed({"id": "_id", "id2": "_id2"}).select("first.*", "_id", "_id2", "live").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("at", "_id", "_id2", "live")).alias("_found")), "line-places")
    return (join_few(docs.select(*text_key(), "text"), listed, "inner")
            .select("doc_id", "text_hash", F.split("text", "\n").alias("lines"), F.explode("_found").alias("f"))
            .select(F.col("f._id").alias("id"), F.col("f._id2").alias("id2"),
                    F.struct("doc_id", "text_hash", "f.at").alias("first"), "f.live",
                    F.element_at("lines", F.col("f.at") + 1).alias("line"))
            .dropDuplicates(["id", "id2"]))


def _cut(near: DataFrame) -> DataFrame:
    """Keys of the parts of each line's live zones."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("id", "id2", "zone", "key")}
            for one, two, line, live in zip(*(batch.column(c).to_pylist() for c in ("id", "id2", "line", "live"))):
                for z in live:
                    for a, b in zones(z["a"], z["b"], PARTS if z["b"] - z["a"] > SMALL else 1):
                        out["id"].append(one)
                        out["id2"].append(two)
                        out["zone"].append({"short": z["short"], "a": a, "b": b})
                        out["key"].append(zone_key(line, z["short"], a, b))
            yield out | {"key": pa.array(_signed(out["key"]))}
    return map_batches(near.select("id", "id2", "line", "live"), run,
                       "id bigint, id2 bigint, zone struct<short: int, a: int, b: int>, key bigint")


def _variants(near: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("id", "id2", "first", "v1", "v2")}
            for one, two, line, live, first in zip(*(batch.column(c).to_pylist() for c in ("id", "id2", "line", "live", "first"))):
                for z in live:
                    for v1, v2 in variants(line, z["short"], z["a"], z["b"]):
                        for column, value in zip(out.values(), (one, two, first, v1, v2)):
                            column.append(value)
            yield out
    return map_batches(near.select("id", "id2", "line", "live", "first"), run,
                       "id bigint, id2 bigint, first struct<doc_id: bigint, text_hash: bigint, at: int>, v1 bigint, v2 bigint")


def near_repeats(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, id2) of the distinct lines that have an earlier line within one edit."""
    keyed = distinct.select("id", F.posexplode("keys").alias("zone", "key"))
    live = _shared(keyed).groupBy("id").agg(F.collect_set("zone").alias("zones"))
    short = f"(chars - z div {QUARTERS})"   # as in first_zones
    zone = ", ".join([f"'short', {short}", *[f"'{n}', cast({short} * (z % {QUARTERS} + {i}) div {QUARTERS} as int)" for i, n in enumerate("ab")]])
    found = stored(distinct.select("id", "id2", "first", "chars").join(live, "id")
                   .selectExpr("id", "id2", "first", f"transform(zones, z -> named_struct({zone})) as live"), "line-zones")
    near = stored(_with_text(docs, found), "near-lines")
    release(found)
    while True:
        cut = stored(_shared(_cut(near)), "line-parts")
        zones_of = cut.groupBy("id", "id2").agg(F.collect_list("zone").alias("live"))
        before, near = near, stored(near.drop("live").join(zones_of, ["id", "id2"]), "near-lines")
        release(before)
        # One number a level; zones shrink by PARTS each time.
        if cut.filter(f"zone.b - zone.a > {SMALL}").isEmpty():
            break
    made = stored(_variants(near), "line-variants")
    buckets = stored(made.groupBy("v1", "v2").agg(F.min("first").alias("least"), F.count("*").alias("n"))
                     .filter("n > 1").drop("n"), "line-buckets")
    earlier = (made.join(buckets, ["v1", "v2"]).groupBy("id", "id2", "first").agg(F.min("least").alias("least"))
               .filter("least < first"))
    # Verify: the hashes brought the two together, the distance decides.
    texts = near.select("id", "id2", "line").join(earlier, ["id", "id2"])
    others = near.select(F.col("first").alias("least"), F.col("line").alias("other"))
    return (texts.join(others, "least").filter(F.levenshtein("line", "other", 1).between(0, 1)).select("id", "id2"))


def removed_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """Lines to remove: doc_id, text_hash, ats (their numbers from 0).

    A line of ``min_chars`` characters or more goes if an earlier line (by doc_id, then place) of any document is
    within ``max_edits`` (0 or 1) edits of it. An earlier line counts whether it stays or not. With ``short`` a
    shorter line that is not blank goes if an earlier line equals it.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    if min_chars <= QUARTERS:
        raise ValueError(f"min_chars is above {QUARTERS}: a quarter of a line has a character at least")
    all_lines = stored(_lines(docs, min_chars, max_edits > 0, short), "lines")
    distinct = stored(all_lines.groupBy("id", "id2").agg(
        F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"), F.first("chars").alias("chars"), F.first("keys").alias("keys")), "distinct-lines")
    if max_edits:
        near = near_repeats(docs, distinct).withColumn("near", F.lit(True))
        known = distinct.select("id", "id2", "first", "n").join(near, ["id", "id2"], "left")
    else:
        known = distinct.select("id", "id2", "first", "n", F.lit(None).cast("boolean").alias("near"))
    known = stored(known.filter("n > 1 or near").drop("n"), "repeated-lines")
    # A place may stand in several rows if rows of a document repeat; it is one place.
    gone = all_lines.select(*PLACE, "id", "id2").join(known, ["id", "id2"]).filter(
        F.col("near").isNotNull() | ~F.struct(*PLACE).eqNullSafe(F.col("first")))
    removed = stored(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("ats")), "removed-lines")
    release(all_lines, distinct, known)
    return removed


def without_repeats(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated lines taken out of text, and n_lines and n_removed.

    Lines lie between line feeds. Shorter lines than ``min_chars`` stay and let others stay; with ``short`` their
    exact repeats go too, unless they are blank. A missing text
    stays missing and has no lines, an empty text has one empty line. Of equal lines the earliest by doc_id,
    then by place, stays, a missing doc_id being the earliest; documents that share an id come by a hash of
    their texts; rows that repeat a document stay alike. If ``docs`` has columns n_lines or n_removed they are
    replaced.
    """
    gone = removed_lines(docs, max_edits, min_chars, short)
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    (ats,) = free_names(docs, "ats")
    rows = join_few(docs.select(F.struct(*docs.columns).alias("doc"), *text_key()), gone, "left").select("doc.*", F.col("ats").alias(ats))
    schema = docs.withColumns({"n_lines": F.lit(0).cast("bigint"), "n_removed": F.lit(0).cast("bigint")}).schema

    def run(batches):
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(ats).to_pylist()):
                parts, out = (text.split("\n") if text is not None else []), set(found or ())
                texts.append("\n".join([p for i, p in enumerate(parts) if i not in out]) if out else text)
                lines.append(len(parts))
                removed.append(len(out))
            yield {c: batch.column(c) for c in rest} | {"text": texts, "n_lines": lines, "n_removed": removed}
    return map_batches(rows, run, schema)
