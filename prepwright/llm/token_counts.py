"""Token counts that follow edits.

The state of a document is a segment tree over its pre-tokens. A leaf is a run of whole pre-tokens with its
characters and tokens; an inner node has the sums of its two children. An edit descends to the leaves it
touches, re-encodes from a leaf before it until a pre-token ends where an old leaf ended, and updates the
sums above the leaves that changed. Text outside that region is not encoded again.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import map_batches, texts_of

# Pre-tokens of a leaf.
LEAF = 32
# A pre-token is settled by its own characters and this many after it, or by the white space up to the next word.
CONTEXT = 4
KEPT_PRETOKENS = 200_000


class Encoder:
    """Byte-level merge encoding by a file of ranks and a pre-token pattern that looks ahead only."""

    def __init__(self, path: str, pattern: str):
        if regex.search(r"\(\?<[=!]", pattern):
            raise ValueError("the pattern looks behind")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.counts: dict[str, int] = {}

    def count(self, pretoken: str) -> int:
        """Tokens of one pre-token."""
        found = self.counts.get(pretoken)
        if found is None:
            if len(self.counts) >= KEPT_PRETOKENS:
                self.counts.clear()
            found = self.counts[pretoken] = len(self.encoding.encode_ordinary(pretoken))
        return found

    def leaves(self, pretokens: list[str]) -> list[tuple[int, int]]:
        """(characters, tokens) of runs of LEAF pre-tokens."""
        get = self.counts.get
        return [(sum(map(len, run)), sum([get(p) or self.count(p) for p in run]))
                for run in (pretokens[i:i + LEAF] for i in range(0, len(pretokens), LEAF))]


class Tree:
    """Segment tree over leaves: ``sums`` has a row (characters, tokens) per node, node i has children 2i and 2i+1."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.count = len(leaves)
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if leaves:
            self.sums[self.size:self.size + len(leaves)] = leaves
        self._update(0, self.size)

    def _update(self, low: int, high: int) -> int:
        """Sums above the leaves low to high; returns how many nodes were summed anew."""
        a, b, nodes = (self.size + low) >> 1, (self.size + max(low, high - 1)) >> 1, 0
        while a >= 1:
            self.sums[a:b + 1] = self.sums[2 * a:2 * b + 2].reshape(-1, 2, 2).sum(axis=1)
            nodes += b - a + 1
            a, b = a >> 1, b >> 1
        return nodes

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character place, and where the leaf starts; at the end the number of leaves."""
        if place >= self.chars:
            return self.count, self.chars
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            node, start = (2 * node, start) if place < start + left else (2 * node + 1, start + left)
        return node - self.size, start

    def leaves(self) -> list[tuple[int, int]]:
        return [tuple(x) for x in self.sums[self.size:self.size + self.count].tolist()]

    def replace(self, low: int, high: int, leaves: list[tuple[int, int]]) -> "Tree":
        """Put other leaves in place of low to high: in place if they are as many, else the leaves behind move."""
        if len(leaves) == high - low:
            if leaves:
                self.sums[self.size + low:self.size + high] = leaves
                self._update(low, high)
            return self
        now = self.leaves()
        return Tree(now[:low] + leaves + now[high:])


def tree_of(text: str, encoder: Encoder) -> Tree:
    return Tree(encoder.leaves(encoder.pattern.findall(text)))


def edited(text: str, tree: Tree, start: int, end: int, by: str, encoder: Encoder) -> tuple[str, Tree, int]:
    """Replace text[start:end]; the new text, its tree and how many characters were encoded again."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    new, grown = text[:start] + by + text[end:], len(by) - (end - start)
    # A leaf that ends CONTEXT characters before the edit, and before white space that leads up to it, stays as it is.
    low, begin = tree.leaf_at(max(0, len(text[:start].rstrip()) - CONTEXT))
    if low == tree.count and low:
        low, begin = low - 1, begin - tree.leaves()[-1][0]
    high, border = tree.leaf_at(end)
    if border < end and high < tree.count:
        border += int(tree.sums[tree.size + high, 0])
        high += 1
    pretokens, at = [], begin
    while at < len(new):
        # Once a pre-token ends where an old leaf ended, all after it is as it was.
        if at >= border + grown and at >= start + len(by):
            while high < tree.count and border + grown < at:
                border += int(tree.sums[tree.size + high, 0])
                high += 1
            if border + grown == at:
                break
        found = encoder.pattern.match(new, at).group()
        pretokens.append(found)
        at += len(found)
    else:
        high = tree.count
    return new, tree.replace(low, high, encoder.leaves(pretokens)), sum(map(len, pretokens))


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    """A Python worker reads a file of ranks once."""
    return Encoder(path, pattern)


def trees(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows of ``docs`` with the state of each text: leaf_chars and leaf_tokens, arrays with an entry per leaf.

    ``ranks`` is a file that every executor has. A missing or empty text has no leaves. Columns of these names
    are replaced. A document without them has to be encoded in full; store them to spare that.
    """
    rest = [c for c in docs.columns if c not in ("leaf_chars", "leaf_tokens")]

    def run(batches):
        encoder = encoder_of(ranks, pattern)
        for batch in batches:
            leaves = [encoder.leaves(encoder.pattern.findall(t)) for t in texts_of(batch)]
            yield {c: batch.column(c) for c in rest} | {
                "leaf_chars": [[c for c, _ in x] for x in leaves], "leaf_tokens": [[t for _, t in x] for x in leaves]}
    rows = docs.select(*rest)
    schema = rows.select("*", F.array().cast("array<int>").alias("leaf_chars"), F.array().cast("array<int>").alias("leaf_tokens")).schema
    return map_batches(rows, run, schema)


def recounted(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Apply edits to documents that have their trees: one row per row, with doc_id, n_tokens (before),
    n_tokens_after, n_chars_after, n_edits, n_encoded, and leaf_chars and leaf_tokens after the edits.

    ``edits`` is an array of (start, end, text): replace characters start to end of the text as given. Edits
    may come in any order; of two that overlap, the one that starts later is cut to the end of the other. A
    null text deletes, places beyond the text mean its end, missing edits are none. ``n_encoded`` is how many
    characters had to be encoded again. A missing text is empty; repeated rows give a row each; other columns
    are not looked at. A tree of a very long text has as many nodes as the text has runs of LEAF pre-tokens.
    """
    def run(batches):
        encoder = encoder_of(ranks, pattern)
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "n_encoded", "leaf_chars", "leaf_tokens")}
            for text, changes, chars, tokens in zip(*(batch.column(c).to_pylist() for c in ("text", "edits", "leaf_chars", "leaf_tokens"))):
                text, changes = text or "", sorted(changes or [], key=lambda e: (e["start"], e["end"]))
                tree = Tree(list(zip(chars, tokens)))
                before, encoded, moved, past = tree.tokens, 0, 0, 0
                for e in changes:
                    start, end, was = max(e["start"], past), max(e["end"], past), len(text)
                    text, tree, again = edited(text, tree, start + moved, end + moved, e["text"] or "", encoder)
                    moved, past, encoded = moved + len(text) - was, end, encoded + again
                leaves = tree.leaves()
                row = (before, tree.tokens, len(text), len(changes), encoded, [c for c, _ in leaves], [t for _, t in leaves])
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield out | {"doc_id": batch.column("doc_id")}
    return map_batches(docs.select("doc_id", "text", "edits", "leaf_chars", "leaf_tokens"), run,
                       "doc_id bigint, n_tokens bigint, n_tokens_after bigint, n_chars_after bigint, n_edits bigint, "
                       "n_encoded bigint, leaf_chars array<int>, leaf_tokens array<int>")
