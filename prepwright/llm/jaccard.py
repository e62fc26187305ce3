"""Near duplicates by the Jaccard similarity of word n-grams, by vertical partitioning.

All n-grams lie in one global order, rare ones first, that is cut into fragments. Two sets that are similar
enough share one of their first n-grams in that order, which names the candidates. Overlaps of candidates are
counted fragment by fragment and summed per pair.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepwright.llm.common import join_few, map_batches, release, stored, text_key
from prepwright.llm.components import components

SHINGLE = 4
PERCENT = 85
FRAGMENTS = 8
# Each fragment is cut into so many cells, and each cell into so many fine ones, whose sizes bound an overlap.
CELLS = 32
FINE = 4
# Bytes that are kept of a hash where n-grams only name candidates.
KEPT = 5
# A sketch has about a bit for each n-gram of its set, 2 ** 6 at least and 2 ** 14 at most.
LEAST_BITS, MOST_BITS = 6, 14
SEED = 42
# The order is by the number of documents in so many classes of n-grams, then by hash.
CLASS_BITS = 16
REST_BITS = 64 - CLASS_BITS
# Lists of so many sets are their pairs. Longer ones are cut into tiles of about so many sets, compared by sketches.
SHORT = 8
TILE = 512


# Odd numbers of the hash of neighbouring words, and of the one that mixes its bits.
FACTOR, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Hashes of words kept by a Python worker; longer words are hashed anew.
KEPT_WORDS, KEPT_BYTES = 200_000, 64


class _Words(dict):
    """XXH64 of words, made when they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


_WORDS = _Words()


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams of words, made of the words' XXH64.

    Words lie between ASCII white space, A-Z in lower case; fewer words than ``shingle`` are one n-gram, none none.
    """
    words = (text or "").encode().lower().split()   # both look at ASCII only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    found = np.full(n, size, np.uint64)
    for i in range(size):
        found *= FACTOR
        found += hashes[i:i + n]
    found ^= found >> np.uint64(30)
    found *= MIX_1
    found ^= found >> np.uint64(27)
    found *= MIX_2
    found ^= found >> np.uint64(31)
    return np.unique(found)


def _lists(arrays: list[np.ndarray], kind=np.uint64) -> pa.Array:
    """Arrays as a column; unsigned numbers go as the signed ones of the same bits."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    values = np.concatenate([*arrays, np.empty(0, kind)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if kind is np.uint64 else values))


def _packed(hashes: np.ndarray) -> bytes:
    """The first KEPT bytes of each hash."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The n-grams of each set; packed ones end in zeros."""
    if pa.types.is_binary(column.type):
        found = []
        for kept in column.to_pylist():
            whole = np.zeros((len(kept) // KEPT, 8), np.uint8)
            whole[:, :KEPT] = np.frombuffer(kept, np.uint8).reshape(-1, KEPT)
            found.append(whole.view(">u8").ravel().astype(np.uint64))
        return found
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    cuts = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def sketch(hashes: np.ndarray) -> bytes:
    """A bit per cell of hashes: whether the cell holds an odd number of them.

    An n-gram that only one of two sets has flips one bit, so differing bits never exceed such n-grams. Folding a sketch
    (half against half) gives the sketch of half as many cells.
    """
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, len(hashes).bit_length()))
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """(sketch, word): the sketches in ``size`` bytes each."""
    found = np.empty((len(sketches), size // 8), np.uint64)
    for i, s in enumerate(sketches):
        found[i] = np.frombuffer(s, np.uint64) if len(s) == size else np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0)
    return found


def _may_be_near(flips: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, whose sketches differ in so many bits, can be similar enough."""
    return (flips * np.int64(100 + percent) <= (100 - percent) * (a_n + b_n)) & (100 * np.minimum(a_n, b_n) >= percent * np.maximum(a_n, b_n))


def gram_sets(docs: DataFrame, shingle: int = SHINGLE, packed: bool = False, order: Order | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n (n-grams), set_id (a 64-bit hash of the whole set; missing if it is empty), sketch and grams.

    ``packed`` grams are their first KEPT bytes, which do to find candidates: where two n-grams of a set become one, it counts twice.
    With an ``order`` they are packed numbers in it, and only so many of the first that similar sets share one of them.
    """
    def form(found):
        if order is not None:
            return [_packed(order.firsts(g, len(g) - least_overlap(len(g), percent) + 1)) if len(g) else b"" for g in found]
        return [_packed(g) for g in found] if packed else _lists(found)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [grams(t, shingle) for t in batch.column("text").to_pylist()]
            ids = [xxhash.xxh3_64_intdigest(g.tobytes()) for g in found]
            yield {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": [len(g) for g in found],
                   "set_id": [i - (i >> 63 << 64) if len(g) else None for i, g in zip(ids, found)],
                   "sketch": [sketch(g) for g in found], "grams": form(found)}
    return map_batches(docs.select(*text_key(), "text"), run, f"doc_id {kind}, text_hash bigint, n bigint, set_id bigint, sketch binary, "
                       f"grams {'binary' if packed or order is not None else 'array<bigint>'}")


@dataclass(frozen=True)
class Order:
    """The global order: the place of each class of n-grams, and the places at which fine cells after the first begin."""

    places: np.ndarray
    cuts: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The n-grams as numbers, whose order is the global one."""
        return self.places[hashes >> np.uint64(REST_BITS)] << np.uint64(REST_BITS) | hashes & np.uint64((1 << REST_BITS) - 1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of the n-grams, ascending."""
        return np.sort(self.numbers(hashes))

    def firsts(self, hashes: np.ndarray, count: int) -> np.ndarray:
        """The first so many numbers, in no order."""
        return np.partition(self.numbers(hashes), count - 1)[:count]

    def fine(self, keys: np.ndarray) -> np.ndarray:
        """At which of the keys the fine cells after the first begin."""
        return np.searchsorted(keys, self.cuts << np.uint64(REST_BITS))

    def sizes(self, keys: np.ndarray) -> np.ndarray:
        return np.diff(self.fine(keys)[FINE - 1::FINE], prepend=0, append=len(keys)).astype(np.int32)

    def fragments(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each fragment the keys and the sizes of its fine cells."""
        fine = self.fine(keys)
        sizes = np.diff(fine, prepend=0, append=len(keys)).astype(np.int32).reshape(-1, CELLS * FINE)
        return list(zip(np.split(keys, fine[CELLS * FINE - 1::CELLS * FINE]), sizes))


def order_of(rows: DataFrame, fragments: int = FRAGMENTS, shingle: int = SHINGLE) -> Order:
    """Classes by the number of documents that hold an n-gram of theirs, cut into fine cells of like numbers of n-grams;
    FINE of them are a cell, and CELLS cells a fragment. ``rows`` have grams, or else the text they are made of.

    Any order gives the same links; rare first gives few candidates. The driver gets a number per class (65,536).
    """
    column = "grams" if "grams" in rows.columns else "text"

    def run(batches):
        counts = np.zeros(1 << CLASS_BITS, np.int64)
        for batch in batches:
            found = batch.column(column)
            found = _arrays(found) if column == "grams" else [grams(t, shingle) for t in found.to_pylist()]
            values = np.concatenate([*found, np.empty(0, np.uint64)])
            counts += np.bincount((values >> np.uint64(REST_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield {"class": at, "n": counts[at]}
    found = map_batches(rows.select(column), run, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << CLASS_BITS, np.int64)
    counts[found["class"]] = found["n"]
    ordered = np.argsort(counts, kind="stable")
    places = np.empty(len(counts), np.uint64)
    places[ordered] = np.arange(len(counts), dtype=np.uint64)
    through = np.cumsum(counts[ordered])
    parts = fragments * CELLS * FINE
    cuts = np.searchsorted(through, through[-1] * np.arange(1, parts) / parts)
    return Order(places, cuts.astype(np.uint64))


def least_overlap(n: int, percent: int) -> int:
    """What a set of n shares with any set that is similar enough, at least."""
    return -(-percent * n // 100)


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, set_id, n): a row for each of the n-grams that ``gram_sets`` has kept by an order."""
    def run(batches):
        for batch in batches:
            firsts = _arrays(batch.column("grams"))
            counts = [len(f) for f in firsts]
            yield {"token": pa.array(np.concatenate([*firsts, np.empty(0, np.uint64)]).view(np.int64)),
                   "set_id": pa.array(np.repeat(batch.column("set_id").to_numpy(), counts)),
                   "n": pa.array(np.repeat(batch.column("n").to_numpy(), counts))}
    return map_batches(sets.filter("n > 0").select("set_id", "n", "grams"), run, "token bigint, set_id bigint, n bigint")


def segments(texts: DataFrame, order: Order, shingle: int) -> DataFrame:
    """(set_id, fragment, cells, grams): the sets of texts, each cut at the fragments, and the sizes of the fine cells."""
    def run(batches):
        for batch in batches:
            for set_id, text in zip(batch.column("set_id").to_pylist(), batch.column("text").to_pylist()):
                parts = [(f, p, c) for f, (p, c) in enumerate(order.fragments(order.keys(grams(text, shingle)))) if len(p)]
                yield {"set_id": [set_id] * len(parts), "fragment": [f for f, _, _ in parts],
                       "cells": _lists([c for _, _, c in parts], np.int32), "grams": _lists([p for _, p, _ in parts])}
    return map_batches(texts.select("set_id", "text"), run, "set_id bigint, fragment int, cells array<int>, grams array<bigint>")


def likely_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs, given with a_n, a_sketch, b_n and b_sketch, that the sketches do not rule out, without the sketches."""
    schema = pairs.drop("a_sketch", "b_sketch").schema
    names = schema.names

    def run(batches):
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("a_sketch", "b_sketch")]
            flips = np.zeros(batch.num_rows, np.int64)
            sizes = np.array([min(len(a), len(b)) for a, b in zip(*sides)], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                a, b = (_folded([side[i] for i in at], size) for side in sides)
                flips[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            near = pa.array(_may_be_near(flips, batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy(), percent))
            yield {c: batch.column(c).filter(near) for c in names}
    return map_batches(pairs, run, schema)


def verified(pairs: DataFrame, docs: DataFrame, shaped: DataFrame, order: Order, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs that are similar: 100 * intersection >= percent * union. Columns beside a and b stay.

    Pairs whose sketches differ too much go first. The sets of the others are made anew from their texts and
    cut. Each fragment's overlap is bounded by its fine cells, then counted, by itself, and summed per pair.
    """
    shape = lambda side: shaped.selectExpr(f"set_id as {side}", f"n as {side}_n", f"sketch as {side}_sketch")
    likely = stored(likely_pairs(pairs.join(shape("a"), "a").join(shape("b"), "b"), percent), "jaccard-likely")
    wanted = likely.selectExpr("explode(array(a, b)) as set_id").distinct().join(shaped, "set_id").select("doc_id", "text_hash", "set_id")
    # A text may stand in repeated rows; it is taken once.
    texts = join_few(docs.select(*text_key(), "text"), stored(wanted, "jaccard-wanted"), "inner").dropDuplicates(["set_id"])
    parts = stored(segments(texts, order, shingle), "jaccard-segments")
    left = likely
    for column, common in (("cells", "aggregate(zip_with(a_part, b_part, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"),
                           ("grams", "size(array_intersect(a_part, b_part))")):
        part = lambda side: parts.selectExpr(f"set_id as {side}", "fragment", f"{column} as {side}_part")  # noqa: B023, E731
        sums = left.select("a", "b").join(part("a"), "a").join(part("b"), ["b", "fragment"]).selectExpr("a", "b", f"{common} as common")
        sums = sums.groupBy("a", "b").agg(F.sum("common").alias("common"))
        left = stored(left.join(sums, ["a", "b"]).filter(f"common * {100 + percent} >= {percent} * (a_n + b_n)").drop("common"), f"jaccard-by-{column}")
    found = left.select(*pairs.columns)
    release(likely, parts)
    return found


def _banded(lists: DataFrame, percent: int) -> DataFrame:
    """Each list once for each of its bands of sizes: similar sets lie in the same band or in neighbouring ones, and so meet in one."""
    width = math.log(100 / (percent - 1))
    return lists.withColumn("band", F.explode(F.expr(f"array(cast(floor(ln(n) / {width}) as int), cast(floor(ln(n) / {width}) as int) + 1)"))).drop("n")


def _one_each(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, set_id, other): for each set of some list one other of its lists, in like lists the same one.

    The other is the set with the most lists of them all: where sets are changed copies of one, that one has most, for
    only its n-grams are all shared. Both steps are minima, so a list of any length is no more than a row per task. By
    the order (number of lists, set_id, itself a hash) the other always comes first.
    """
    banded = _banded(lists, percent)
    draw = F.struct("rank", F.col("set_id").alias("other"))
    chosen = banded.groupBy("token", "band").agg(F.min(draw).alias("chosen"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = banded.drop("rank").join(stored(chosen, "jaccard-chosen"), ["token", "band"]).groupBy("set_id").agg(F.min("chosen").alias("chosen"))
    return pairs.filter("set_id <> chosen.other").select(
        F.least("set_id", "chosen.other").alias("a"), F.greatest("set_id", "chosen.other").alias("b"), "set_id", "chosen.other")


def _roots(links: DataFrame) -> DataFrame:
    """(set_id, root) of linked sets: where two steps from a set to the other it was compared with lead.

    Each step leads to a set that comes before in the order of ``_one_each``, so steps make no circle; longer ways are left to what follows.
    """
    steps = links.select("set_id", F.col("other").alias("root"))
    for _ in range(2):
        ahead = steps.select(F.col("set_id").alias("root"), F.col("root").alias("_next"))
        steps = steps.join(ahead, "root", "left").select("set_id", F.coalesce("_next", "root").alias("root"))
    return steps


def _all_apart(lists: DataFrame, shaped: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of all sets that share a list and are not linked so far, but for those that sketches rule out.

    Lists of SHORT sets at most are their pairs, which ``verified`` looks at. Longer ones are dealt into tiles of
    about TILE sets, whose pairs are compared by their sketches in numpy; only those that may be near leave the task.
    """
    keys = ["token", "band"]
    sizes = lists.groupBy(*keys).agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = stored(sizes.filter("low <> high").selectExpr(*keys, "n", f"cast(ceil(n / {TILE}) as int) as tiles"), "jaccard-lists")
    apart = stored(lists.join(sizes, keys).select(*keys, "n", "tiles", "set_id", "root"), "jaccard-apart")
    short = apart.filter(f"n <= {SHORT}").groupBy(*keys).agg(F.collect_list(F.struct("set_id", "root")).alias("m"))
    # Sets that share many n-grams share many equal pairs.
    pairs = short.selectExpr("""inline(flatten(transform(m, x -> transform(filter(m, y -> y.set_id > x.set_id and y.root <> x.root),
                                                                       y -> struct(x.set_id as a, y.set_id as b)))))""")
    dealt = apart.filter(f"n > {SHORT}").join(shaped.select("set_id", F.col("n").alias("grams"), "sketch"), "set_id").withColumn("tile", F.pmod(F.xxhash64("set_id"), "tiles").cast("int"))
    member = F.struct("set_id", "root", "grams", "sketch")
    tiles = stored(dealt.groupBy(*keys, "tiles", "tile").agg(F.array_sort(F.collect_list(member)).alias("members")), "jaccard-tiles")
    alone = tiles.filter("tiles = 1").select("members").distinct().select(F.col("members").alias("left"), F.col("members").alias("right"))
    several = tiles.filter("tiles > 1")
    met = (several.selectExpr(*keys, "tile", "members as left", "explode(sequence(tile, tiles - 1)) as other")
           .join(several.selectExpr(*keys, "tile as other", "members as right"), [*keys, "other"]).select("left", "right"))

    def compare(batches):
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                (a, a_root, a_n, a_sketch), (b, b_root, b_n, b_sketch) = map(_members, (left, right))
                size = min(map(len, a_sketch + b_sketch))
                flips = np.zeros((len(a), len(b)), np.int64)
                for x, y in zip(_folded(a_sketch, size).T, _folded(b_sketch, size).T):
                    flips += np.bitwise_count(x[:, None] ^ y[None, :])
                x, y = np.nonzero(_may_be_near(flips, a_n[:, None], b_n[None, :], percent) & (a_root[:, None] != b_root[None, :]))
                yield {"a": pa.array(np.minimum(a[x], b[y])), "b": pa.array(np.maximum(a[x], b[y]))}
    longer = map_batches(alone.unionAll(met), compare, "a bigint, b bigint")
    return pairs.unionAll(longer).distinct()


def _members(cell: pa.Scalar) -> tuple:
    rows = cell.values
    return *(rows.field(c).to_numpy() for c in ("set_id", "root", "grams")), rows.field("sketch").to_pylist()


def near_links(docs: DataFrame, sets: DataFrame, classes: DataFrame, order: Order, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of set_ids that connect just what pairs of similar sets connect. ``sets``, made by the order, is a stored table and goes.

    Sets of a token's list whose sizes allow it are candidates. First each set is compared with one other of its
    lists; a dense group is mostly linked by then. Then all pairs of sets that share a list and are not linked yet are
    looked at, so no link that matters is lost and a group of m copies does not make m * m pairs.
    """
    firsts = prefixes(sets)
    shared = firsts.groupBy("token").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    shared = stored(shared.filter("low <> high").select("token"), "jaccard-shared")
    postings = join_few(firsts, shared, "inner", ("token",)).distinct()
    lists = postings.withColumn("rank", -F.count("*").over(Window.partitionBy("set_id")))   # a set has no more lists than n-grams
    lists = stored(lists, "jaccard-postings")
    wanted = stored(lists.select("set_id").distinct().join(classes, "set_id").select("own.doc_id", "own.text_hash"), "jaccard-wanted")
    shapes = sets.filter("n > 0").select("doc_id", "text_hash", "set_id", "n", "sketch")
    shaped = stored(join_few(shapes, wanted, "inner").dropDuplicates(["set_id"]), "jaccard-shapes")
    release(shared, wanted, sets)

    compared = stored(_one_each(lists, percent), "jaccard-pairs")
    links = verified(compared, docs, shaped, order, shingle, percent)
    known = stored(lists.drop("rank").join(_roots(links), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "jaccard-known")
    release(lists)
    rest = _all_apart(_banded(known, percent), shaped, percent).join(compared, ["a", "b"], "left_anti")
    found = verified(stored(rest, "jaccard-pairs"), docs, shaped, order, shingle, percent)
    release(known, shaped)
    return links.select("a", "b").unionAll(found)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """One row per document: doc_id, n_shingles (distinct n-grams), component_id.

    Two documents are linked if 100 * intersection >= percent * union of their n-grams, told apart by 64-bit hashes;
    component_id is the smallest doc_id that links reach. Equal sets are one set in the join, so copies make no
    pairs. Documents without words (missing and empty texts too) have no n-grams, are linked with nothing and stand
    for themselves. Other rows that repeat an id are linked through it, whatever their texts. An id that is missing
    is smaller than none: a group of such rows alone has a missing component_id. Other columns are not looked at;
    an empty table gives no rows.
    """
    # Texts are cut into words once for the order and once for what it puts first: stored, all n-grams take more disk than the texts.
    order = order_of(docs.select("text"), fragments, shingle)
    sets = stored(gram_sets(docs, shingle, order=order, percent=percent), "jaccard-sets")
    slim = stored(sets.select("doc_id", "text_hash", "n", "set_id"), "jaccard-documents")
    full = slim.filter("n > 0")
    classes = stored(full.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("own"), F.min("n").alias("n")),
                     "jaccard-classes")
    links = near_links(docs, sets, classes, order, shingle, percent)
    repeats = (full.filter("doc_id is not null").groupBy("doc_id")
               .agg(F.min("set_id").alias("b"), F.max("set_id").alias("top")).filter("b <> top").select("doc_id", "b"))
    linked = full.join(repeats, "doc_id").select(F.col("set_id").alias("a"), "b").filter("a <> b").distinct()
    roots = components(links.unionAll(linked))
    grouped = classes.select("set_id", "first").join(roots.withColumnRenamed("value", "set_id"), "set_id", "left") \
        .withColumn("root", F.coalesce("root", "set_id"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = stored(grouped.join(least, "root").select("set_id", "component_id"), "jaccard-components")
    # One row per set on the right: a set of very many copies is split on the left.
    rows = full.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(ids, "set_id").select("doc_id", "n_shingles", "component_id")
    return rows.unionAll(slim.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
