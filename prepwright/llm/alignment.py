"""Where the tokens of two tokenizers share bytes: groups that both cut alike, and links between overlapping tokens."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from prepwright.llm.common import map_batches, ship_package, stored

# Characters of text, about, that share one list of id pairs, and characters whose tokens are compared at once.
BLOCK = 8 << 20
PORTION = 1 << 18
# An id pair is one number: the first tokenizer's id, then so many bits of the second one's.
ID_BITS = 24
# tiktoken's expression overflows its stack on longer runs of white space.
BLANKS = re.compile(r"\s{10000}")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a visible character: itself where it is one, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Byte-level merges of a file of the library tokenizers; strings of special tokens are plain text.

    tiktoken encodes by the same vocabulary, for it is five times faster; the library itself takes texts
    that tiktoken cannot.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in entry): i for entry, i in vocabulary.items()}
        self.raw = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.raw[i] = raw
        self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        if BLANKS.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """Pieces of a file of the library sentencepiece, which puts a space before the text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = [bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, pattern: str, piece_path: str):
    """Both tokenizers, the sizes of their tokens in bytes, and their ids as text with each separator of SEPARATORS."""
    both = ByteTokens(byte_path, pattern), PieceTokens(piece_path)
    sizes = [np.array([len(r) for r in t.raw], np.int64) for t in both]
    written = [f"{i}{mark}" for i in range(max(map(len, sizes))) for mark in SEPARATORS]
    return *both, *sizes, written


# What follows an id: another of its side, the other side, the next group, nothing.
SEPARATORS = [",", "|", ";", ""]


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each start, so many as its count."""
    return np.arange(counts.sum()) + np.repeat(starts - _before(counts), counts)


def coalesced(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and of each B token, from 0 on.

    All tokens are sorted by start; a group breaks where a start reaches the furthest end so far.
    """
    starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(breaks) - 1
    return groups[:len(a_starts)], groups[len(a_starts):]


def overlaps(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all A and B tokens that share a byte. Both sides lie in order and without gaps, so the partners
    of an A token are a run of B tokens, which never leaves the group."""
    first = np.searchsorted(b_ends, a_starts, "right")
    counts = np.searchsorted(b_starts, a_ends, "left") - first
    return np.repeat(np.arange(len(a_starts)), counts), _spread(first, counts)


def _aligned(texts: list[str], both) -> list[tuple]:
    """For each text (n_a, n_b, n_groups, groups, linked pairs in order)."""
    byte_tokens, piece_tokens, a_sizes, b_sizes, written = both
    sides, lengths = [], []
    for text in texts:
        a, b = [], []
        if text:
            a, b = byte_tokens.encode(" " + text), piece_tokens.encode(text)
            whole = (" " + text).encode()
            if b"".join(map(byte_tokens.raw.__getitem__, a)) != whole or b"".join(map(piece_tokens.raw.__getitem__, b)) != whole:
                a, b = [], []
        sides.append((a, b))
    counts = np.array([(len(a), len(b)) for a, b in sides], np.int64).reshape(-1, 2)
    a = np.fromiter((i for s, _ in sides for i in s), np.int64, counts[:, 0].sum())
    b = np.fromiter((i for _, s in sides for i in s), np.int64, counts[:, 1].sum())
    # Texts lie one behind another: where one ends both sides end, so no group crosses it.
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    a_starts, b_starts = a_ends - a_sizes[a], b_ends - b_sizes[b]
    a_groups, b_groups = coalesced(a_starts, a_ends, b_starts, b_ends)
    n_groups = int(a_groups[-1]) + 1 if len(a) else 0
    a_in, b_in = np.bincount(a_groups, minlength=n_groups), np.bincount(b_groups, minlength=n_groups)
    a_cuts, b_cuts = np.cumsum(counts[:, 0]), np.cumsum(counts[:, 1])

    # Written side by side: the A tokens of a group stand after all B tokens of the groups before it, and so on.
    marked = np.empty(len(a) + len(b), np.int64)
    a_marks, b_marks = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_marks[np.cumsum(a_in) - 1] = 1
    b_marks[np.cumsum(b_in) - 1] = 2
    b_marks[b_cuts[counts[:, 1] > 0] - 1] = 3
    marked[np.arange(len(a)) + _before(b_in)[a_groups]] = a * len(SEPARATORS) + a_marks
    marked[np.arange(len(b)) + np.cumsum(a_in)[b_groups]] = b * len(SEPARATORS) + b_marks
    parts = list(map(written.__getitem__, marked.tolist()))

    left, right = overlaps(a_starts, a_ends, b_starts, b_ends)
    pairs = a[left] << ID_BITS | b[right]
    link_cuts = np.searchsorted(left, a_cuts)
    out, token, link = [], 0, 0
    for i, (n_a, n_b) in enumerate(counts.tolist()):
        groups = int(a_groups[a_cuts[i] - 1] - a_groups[a_cuts[i] - n_a]) + 1 if n_a else 0
        out.append((n_a, n_b, groups, "".join(parts[token:token + n_a + n_b]), pairs[link:link_cuts[i]]))
        token, link = token + n_a + n_b, int(link_cuts[i])
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, lowest bytes of all first."""
    steps = np.diff(numbers, prepend=0).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


MADE = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
INNER = "block bigint, links binary, pairs array<bigint>, held array<bigint>"


def alignments(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns to ``carry``, n_a, n_b, n_groups, n_links and groups; and what ``weighed`` reads.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of both tokenizers, cut wherever both end a token. A link is
    a pair of tokens that share a byte. Documents are dealt with in blocks of about BLOCK characters (a longer
    one is a block of its own). A block has one more row, without carried columns: the id pairs linked in it,
    most frequent first, and how many of its documents hold each; the links of a document are places in it.
    """
    carry = [c for c in carry if c.lower() not in {f.split()[0] for f in f"{MADE}, {INNER}".split(", ")}]
    schema = StructType([*docs.select(*carry).schema.fields, *StructType.fromDDL(f"{MADE}, {INNER}").fields])
    for field in schema.fields:
        field.nullable = True

    def run(batches):
        both = tokenizers(byte_path, pattern, piece_path)
        block, kept, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            batch = batch.select(carry)
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= PORTION):
                    chars += len(texts[end])
                    end += 1
                if kept and size + chars > BLOCK:
                    yield from _block(block, kept, schema)
                    block, kept, size = block + 1, [], 0
                kept.append((batch.slice(at, end - at), _aligned(texts[at:end], both)))
                size, at = size + chars, end
        if kept:
            yield from _block(block, kept, schema)
    return map_batches(docs.select(*dict.fromkeys([*carry, "text"])), run, schema)


def _block(block: int, kept: list, schema: StructType):
    found = [row for _, rows in kept for row in rows]
    counts = np.array([len(row[4]) for row in found], np.int64)
    codes, pairs = pd.factorize(np.concatenate([row[4] for row in found]))
    order = np.argsort(-np.bincount(codes, minlength=len(pairs)), kind="stable")
    places = np.empty(len(pairs), np.int64)
    places[order] = np.arange(len(pairs))
    # Document by document, in ascending order.
    keyed = np.sort(np.repeat(np.arange(len(found)), counts) * max(1, len(pairs)) + places[codes])
    firsts = np.ones(len(keyed), bool)
    firsts[1:] = keyed[1:] != keyed[:-1]
    keyed %= max(1, len(pairs))
    held = np.bincount(keyed[firsts], minlength=len(pairs))
    links = [_packed(x) for x in np.split(keyed, np.cumsum(counts)[:-1])]
    at = 0
    for batch, rows in kept:
        n = len(rows)
        yield dict(zip(batch.schema.names, batch.columns)) | {
            "n_a": [r[0] for r in rows], "n_b": [r[1] for r in rows], "n_groups": [r[2] for r in rows], "n_links": counts[at:at + n],
            "groups": [r[3] for r in rows], "block": [block] * n, "links": links[at:at + n], "pairs": [None] * n, "held": [None] * n}
        at += n
    yield {f.name: [None] for f in schema.fields} | {"block": [block], "pairs": [pairs[order]], "held": [held]}


def weighed(rows: DataFrame) -> DataFrame:
    """The documents of ``alignments`` with n_best and count_sum; columns added to its rows stay.

    The count of an id pair is the number of documents that hold it linked. count_sum adds the counts of a document's
    links, n_best are its links whose count is the highest of their A id in all documents, ties included.
    Texts that are missing or empty, or that either tokenizer changes, have no tokens: all zero, groups empty. Rows
    that repeat a document count as documents of their own; an empty table gives no rows; carried columns that
    have a name of the results are replaced.
    """
    rows = stored(rows, "alignments")
    listed = rows.filter("pairs is not null").selectExpr("block", "posexplode(arrays_zip(pairs, held)) as (place, p)")
    listed = listed.selectExpr("block", "place", "p.pairs as pair", "p.held as held")
    counts = stored(listed.groupBy("pair").agg(F.sum("held").alias("docs")), "pair-counts")
    # A row per id of a vocabulary at most.
    most = counts.groupBy(F.expr(f"shiftright(pair, {ID_BITS})").alias("a")).agg(F.max("docs").alias("most"))
    judged = counts.withColumn("a", F.expr(f"shiftright(pair, {ID_BITS})")).join(F.broadcast(most), "a").selectExpr(
        "pair", "docs", "docs = most as best")
    # A pair of many blocks is one row on the right and is split on the left.
    places = listed.select("block", "place", "pair").join(judged, "pair").selectExpr("block as of_block", "place", "docs", "best")

    inner = {f.split()[0] for f in INNER.split(", ")}
    names = [c for c in rows.columns if c not in inner]
    ship_package(rows.sparkSession)
    schema = StructType([*rows.select(*names).schema.fields, *StructType.fromDDL("n_best bigint, count_sum bigint").fields])

    def sums(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        docs, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        at = pairs.column("place").to_numpy()
        docs[at], best[at] = pairs.column("docs").to_numpy(), pairs.column("best").to_numpy()
        n_best, total = [], []
        for raw, n in zip(documents.column("links"), documents.column("n_links").to_pylist()):
            places = _unpacked(raw.as_py(), n)
            n_best.append(int(best[places].sum()))
            total.append(int(docs[places].sum()))
        return documents.select(names).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))
    # Both sides of a block are bounded: its documents have about BLOCK characters, its pairs are fewer than their links.
    return rows.filter("pairs is null").select(*names, "block", "links").groupBy("block").cogroup(
        places.groupBy("of_block")).applyInArrow(sums, schema)
