"""Substring dedup by prefix-partitioned suffix trees.

Every word starts a suffix, and two suffixes that agree in their first ``min_words`` words are a repeat. Suffixes
are split into groups by a piece of these words, so that suffixes that agree meet in one group: the piece is the
run of ANCHOR words with the smallest hash. Only pieces that occur more than once are followed. A group that fits
into memory gets a suffix tree: its suffixes in order, and the depth to which neighbours agree; the inner nodes of
depth ``min_words`` are the repeats. A larger group is split by a longer prefix, all ``min_words`` words, which
leaves one such node a group, so that its earliest suffix is a minimum and nothing has to be held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import join_few, map_batches, release, stored, text_key

MIN_WORDS = 20
ANCHOR = 5
# Words of one symbol of a tree's edges.
SYMBOL = 4
# Places of one piece that are held in memory, and places whose trees are built together.
GROUP = 50_000
TOGETHER = 20_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _split(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode().split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    count = len(hashes) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    for i in range(n if count > 0 else 0):
        out = (out ^ hashes[i:i + count]) * MULTIPLIER
        out ^= out >> np.uint64(31)
    return out


def anchors(hashes: np.ndarray, min_words: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor (place and hash) of each run of ``min_words`` words; places do not decrease."""
    runs = _runs(hashes, anchor)
    width = min_words - anchor + 1
    if len(runs) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places = np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1) + np.arange(len(runs) - width + 1)
    return places, runs[places]


def _anchor_rows(docs: DataFrame, min_words: int, anchor: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sizes, places, keys = [], [], []
            for text in batch.column("text").to_pylist():
                at, key = anchors(_hashes(_split(text)), min_words, anchor)
                new = np.flatnonzero(np.diff(at, prepend=-1))
                sizes.append(len(new))
                places.append(at[new])
                keys.append(key[new])
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            yield {"doc_id": batch.column("doc_id").take(pa.array(rows)), "text_hash": batch.column("text_hash").take(pa.array(rows)),
                   "at": pa.array(np.concatenate([*places, []]).astype(np.int32)),
                   "key": pa.array(np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64))}
    return map_batches(docs.select(*text_key(), "text"), run, "doc_id bigint, text_hash bigint, at int, key bigint")


CONTEXT = "doc_id bigint, text_hash bigint, start int, key bigint, n bigint, words binary"


def _contexts(docs: DataFrame, followed: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """For each followed anchor the words of all runs that have it: ``words`` from word number ``start``."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "text_hash", "start", "key", "n", "words")}
            for doc, text_hash, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "found"))):
                words = _split(text)
                places, keys = anchors(_hashes(words), min_words, anchor)
                followed_at = np.array([f["at"] for f in found])
                first = np.searchsorted(places, followed_at, "left")
                last = np.searchsorted(places, followed_at, "right")
                for f, a, b, key in zip(found, first.tolist(), last.tolist(), keys[first].view(np.int64).tolist()):
                    for column, value in zip(out.values(), (doc, text_hash, a, key, f["n"], b" ".join(words[a:b - 1 + min_words]))):
                        column.append(value)
            yield out
    listed = stored(followed.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n")).alias("found")), "followed-places")
    rows = join_few(docs.select(*text_key(), "text"), listed, "inner")
    return map_batches(rows.select("doc_id", "text_hash", "text", "found"), run, CONTEXT)


def tree_nodes(symbols: np.ndarray, group: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix trees of groups, cut at the depth of ``symbols``' columns.

    Returns the suffixes in order (by group, then symbols, then place) and the number of symbols in which each
    agrees with the one before it: an inner node of a tree is a stretch of suffixes that agree to its depth.
    """
    order = np.lexsort([*place[::-1], *symbols.T[::-1], group])
    ordered = symbols[order]
    same = (ordered[1:] == ordered[:-1]) & (group[order][1:] == group[order][:-1])[:, None]
    return order, np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])


def _later(starts: np.ndarray, docs: np.ndarray, hashes: np.ndarray, groups: np.ndarray, contexts: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the contexts that agree with an earlier one: number of the context, word number."""
    words = [c.split(b" ") for c in contexts]
    sizes = np.array([len(w) for w in words])
    flat = _hashes([w for ws in words for w in ws])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - min_words + 1
    owner = np.repeat(np.arange(len(words)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = begins[owner] + inside
    symbols = np.empty((len(first), -(-min_words // SYMBOL)), np.uint64)
    for i, a in enumerate(range(0, min_words, SYMBOL)):
        symbols[:, i] = _runs(flat, min(SYMBOL, min_words - a))[first + a]
    place = [docs[owner], hashes[owner], starts[owner] + inside]
    order, depth = tree_nodes(symbols, groups[owner], place)
    deep = depth == symbols.shape[1]
    # The earliest suffix of each deepest node comes first; rows that repeat it are at its very place.
    head = np.maximum.accumulate(np.where(deep, 0, np.arange(len(order))))
    later = deep & np.any([p[order] != p[order][head] for p in place], axis=0)
    found = order[later]
    return owner[found], starts[owner[found]] + inside[found]


def _ranges(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places: (owner, first, last)."""
    if not len(owner):
        return owner, at, at
    order = np.lexsort([at, owner])
    owner, at = owner[order], at[order]
    new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(at) > 1)])
    begin = np.flatnonzero(new)
    return owner[begin], at[begin], at[np.concatenate([begin[1:], [len(at)]]) - 1]


RANGE = "doc_id bigint, text_hash bigint, first int, last int"
MISSING = np.iinfo(np.int64).min


def _in_memory(contexts: DataFrame, min_words: int) -> DataFrame:
    """Repeats within the groups that fit into memory: ranges of starts that an earlier suffix agrees with."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                whole = pa.Table.from_batches(held)
                keys = whole.column("key").to_numpy()
                # The last group may go on in the next batch.
                done = int(np.searchsorted(keys, keys[-1], "left"))
                if done:
                    yield from build(whole.slice(0, done))
                    held = whole.slice(done).combine_chunks().to_batches()
        if held:
            yield from build(pa.Table.from_batches(held))

    def build(rows: pa.Table):
        if not rows.num_rows:
            return
        docs = rows.column("doc_id").fill_null(MISSING).to_numpy()
        owner, at = _later(rows.column("start").to_numpy().astype(np.int64), docs, rows.column("text_hash").to_numpy(),
                           rows.column("key").to_numpy(), rows.column("words").to_pylist(), min_words)
        owner, first, last = _ranges(owner, at)
        yield {"doc_id": rows.column("doc_id").combine_chunks().take(pa.array(owner)), "text_hash": rows.column("text_hash").to_numpy()[owner],
               "first": first.astype(np.int32), "last": last.astype(np.int32)}
    return map_batches(contexts.repartition("key").sortWithinPartitions("key"), run, RANGE)


def _by_whole_prefix(contexts: DataFrame, min_words: int) -> DataFrame:
    """Repeats within larger groups: one group for each run of ``min_words`` words, by a 128-bit hash."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "text_hash", "start", "k1", "k2")}
            for doc, text_hash, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "start", "words"))):
                words = raw.split(b" ")
                for i in range(len(words) - min_words + 1):
                    digest = xxhash.xxh3_128_digest(b" ".join(words[i:i + min_words]))
                    for column, value in zip(out.values(), (doc, text_hash, start + i, int.from_bytes(digest[:8], "big", signed=True),
                                                            int.from_bytes(digest[8:], "big", signed=True))):
                        column.append(value)
            yield out
    rows = map_batches(contexts, run, "doc_id bigint, text_hash bigint, start int, k1 bigint, k2 bigint")
    place = F.struct("doc_id", "text_hash", "start")
    # One row per run on the right: a run of very many places is split on the left.
    earliest = stored(rows.groupBy("k1", "k2").agg(F.min(place).alias("earliest")), "earliest-runs")
    later = rows.join(earliest, ["k1", "k2"]).filter(~place.eqNullSafe(F.col("earliest")))
    return later.select("doc_id", "text_hash", F.col("start").alias("first"), F.col("start").alias("last"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """Ranges (doc_id, text_hash, first, last) of word numbers at which a run of ``min_words`` words starts that
    also starts earlier: in a smaller doc_id, or in the same document before."""
    found = stored(_anchor_rows(docs, min_words, anchor), "anchors")
    often = stored(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-anchors")
    followed = stored(found.join(often, "key").select("doc_id", "text_hash", "at", "n"), "followed-anchors")
    release(found, often)
    contexts = stored(_contexts(docs, followed, min_words, anchor), "suffix-groups")
    release(followed)
    later = stored(_in_memory(contexts.filter(F.col("n") <= group), min_words).unionAll(
        _by_whole_prefix(contexts.filter(F.col("n") > group), min_words)), "repeats")
    release(contexts)
    return later


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (maximal runs of removed words, as (start, end)),
    text (the words that are kept, joined by a space).

    A word goes if a run of ``min_words`` words that covers it starts earlier too, by the input and not by what
    is left. Words lie between ASCII white space and are compared as they are. A missing or empty text has no
    words; one of fewer words keeps them all. A missing doc_id is smaller than any other; documents that share
    an id come by a hash of their texts; rows that repeat a document give equal rows, and are no repeat of each
    other. Other columns are not looked at.
    """
    found = repeats(docs, min_words, anchor, group)
    ranges = stored(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "repeat-ranges")
    release(found)
    rows = join_few(docs.select(*text_key(), "text"), ranges, "left")

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_removed", "spans", "text")}
            for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = _split(text)
                spans: list[list[int]] = []
                for r in sorted(found or [], key=lambda r: r["first"]):
                    if spans and r["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["last"] + min_words)
                    else:
                        spans.append([r["first"], r["last"] + min_words])
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                row = (len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode())
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield out | {"doc_id": batch.column("doc_id")}
    return map_batches(rows.select("doc_id", "text", "ranges"), run,
                       "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: int, end: int>>, text string")
