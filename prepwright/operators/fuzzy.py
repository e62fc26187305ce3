"""Similarity joins on text and the greedy operators built on them.

Two texts match when 200 * LCS / (|a| + |b|) reaches the threshold. Candidates come from
an equi-join that loses no match. Above two thirds a match allows fewer changes than the
shorter text has characters. With few changes the text is cut into so few parts that one
differs by one at most, and keys of the parts meet (``functions/parts.py``). With more it is
cut into at least D + 1 pieces, one of which occurs unchanged in the longer text, near the
same position. Down to any lower threshold a match still shares
characters: with the characters of a text in a common order, rarest first, the first few of
the two texts must overlap. Only hashes travel; texts are fetched once per candidate pair.

The greedy scan "keep a value unless it resembles one kept before" equals the
lexicographically first maximal independent set. Values are taken in growing prefixes of
the arrival order; what resembles an earlier leader is removed before the next prefix is
compared with itself, so even a huge group of near copies is met leader by leader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.functions import parts
from prepwright.functions.indel import indel_ratio
from prepwright.functions.text import normal_form, sorted_tokens, strip
from prepwright.kinds import col
from prepwright.operators.bitmaps import bitmap, bits_for, possible, sent
from prepwright.operators.columns import map_by_table
from prepwright.operators.encode import _numbered
from prepwright.session import attach, cut_lineage

# At or below two thirds a match may share no piece longer than a character.
PIECES_ABOVE = 200 / 3
FIRST_PREFIX = 5_000
PREFIX_GROWTH = 4
# Comparisons of one key that a task makes, about; a key with more is dealt to several tasks.
COMPARISONS_PER_TASK = 2_000_000
# Texts that the driver looks at to choose where texts are cut, which decides the work and not the result.
TEXTS_FOR_CUTS = 5_000
# Texts whose parts less a character are stored all; those of more are first held against a bitmap.
FEW_TEXTS = 10_000
# With so many times fewer texts on the other side, all keys of those are a bitmap. About so many keys they have, and of parts less a character.
MUCH_FEWER, PROBE_KEYS, END_KEYS = 50, 256, 8

# One bit per character class: whether it occurs an odd number of times. An insertion or a
# deletion flips exactly one bit, so differing bits never exceed the changes of a match.
PARITY = "aggregate(split(txt, ''), 0L, (m, ch) -> m ^ shiftleft(1L, pmod(ascii(ch), 64)))"


def _share(threshold: float) -> float:
    if not 0 < threshold <= 100:
        raise ValueError("a similarity threshold lies above 0 and at most at 100")
    return threshold / 100


def _changes(n: Column, share: float) -> Column:
    """Most insertions plus deletions between a text of length n and a longer match."""
    return F.floor(n * F.lit((2 - 2 * share) / share) + F.lit(1e-9)).cast("int")


def _shortest(n: Column, share: float) -> Column:
    """Least length of a match of a text of length n; as many characters are shared at least."""
    return F.ceil(n * F.lit(share / (2 - share)) - F.lit(1e-9)).cast("int")


def _piece_width(n: Column, share: float) -> Column:
    return F.greatest(F.floor(n / (_changes(n, share) + 1)), F.lit(1)).cast("int")


KEYED = ["node", "grp", "n", "m", "at", "key"]


def _pieces(nodes: DataFrame, share: float) -> DataFrame:
    """Keys of D + 1 disjoint pieces of every text with their positions, the rarest ones (index side)."""
    n = F.col("n")
    shaped = nodes.withColumns({"w": _piece_width(n, share), "need": _changes(n, share) + 1})
    cut = "transform(sequence(0, greatest(cast(floor(n / w) as int) - 1, 0)), i -> struct(i * w as at, xxhash64(grp, substr(txt, i * w + 1, w)) as key))"
    cells = shaped.withColumn("_s", F.explode(F.expr(cut))).select("node", "grp", "n", "m", "need", "_s.at", "_s.key")
    often = cells.groupBy("key").agg(F.count("*").alias("often"))
    ranked = attach(cells, often, ["key"]).groupBy("node", "grp", "n", "m", "need").agg(
        F.array_sort(F.collect_list(F.struct("often", "at", "key"))).alias("_s"))
    return ranked.withColumn("_s", F.explode(F.slice("_s", 1, F.col("need")))).select("node", "grp", "n", "m", "_s.at", "_s.key")


def _occurrences(nodes: DataFrame, share: float) -> DataFrame:
    """Keys of all substrings of every text that a piece of a shorter match could equal (probe side)."""
    n = F.col("n")
    least = F.greatest(F.least(_shortest(n, share), n), F.lit(1))
    widths = F.array_distinct(F.transform(F.sequence(least, F.greatest(n, F.lit(1))), lambda m: _piece_width(m, share)))
    wide = nodes.withColumn("w", F.explode(widths))
    keys = "transform(sequence(1, greatest(n - w + 1, 1)), p -> xxhash64(grp, substr(txt, p, w)))"
    return wide.select("node", "grp", "n", "m", F.posexplode(F.expr(keys)).alias("at", "key"))


def _characters(nodes: DataFrame, share: float) -> DataFrame:
    """Keys of the first characters of every text, rarest first, as many as a match cannot avoid all of.

    The second, third, ... of a character are characters of their own. A match of length n shares
    L characters at least, so of n - L + 1 it shares one.
    """
    chars = nodes.select("node", "grp", "n", "m", F.explode(F.split("txt", "")).alias("c")).where("c <> ''")
    times = chars.groupBy("node", "grp", "n", "m", "c").agg(F.count("*").alias("times"))
    cells = times.select("node", "grp", "n", "m", "c", F.explode(F.expr("sequence(1, times)")).alias("k")).withColumn(
        "key", F.xxhash64("grp", "c", "k"))
    often = cells.groupBy("key").agg(F.count("*").alias("often"))
    first = attach(cells, often, ["key"]).groupBy("node", "grp", "n", "m").agg(
        F.array_sort(F.collect_list(F.struct("often", "key"))).alias("_s"))
    need = F.col("n") - F.greatest(_shortest(F.col("n"), share), F.lit(1)) + 1
    full = first.select("node", "grp", "n", "m", F.lit(0).alias("at"), F.explode(F.slice("_s", 1, need)).alias("_s"))
    # Empty texts match each other.
    empty = nodes.where("n = 0").select("node", "grp", "n", "m", F.lit(0).alias("at"), F.xxhash64("grp", F.lit("")).alias("key"))
    return full.select("node", "grp", "n", "m", "at", "_s.key").unionByName(empty)


def _dealt(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``salt``: a key with many comparisons meets in as many tasks as they need.

    The rows of the second side are dealt to the tasks, those of the first go to each of them.
    """
    work = a.groupBy("key").agg(F.count("*").alias("x")).join(b.groupBy("key").agg(F.count("*").alias("y")), "key")
    tasks = work.select("key", F.ceil(F.col("x") * F.col("y") / COMPARISONS_PER_TASK).cast("int").alias("tasks")).where("tasks > 1")
    tasks = cut_lineage(tasks)
    if tasks.isEmpty():
        return a.withColumn("salt", F.lit(0)), b.withColumn("salt", F.lit(0))
    a = attach(a, tasks, ["key"]).withColumn("salt", F.explode(F.expr("sequence(0, coalesce(tasks, 1) - 1)")))
    b = attach(b, tasks, ["key"]).withColumn("salt", F.expr("cast(pmod(xxhash64(node), coalesce(tasks, 1)) as int)"))
    return a.drop("tasks"), b.drop("tasks")


def _matching(nodes: DataFrame, threshold: float, strict: bool) -> parts.Matching:
    """The matches that are wanted, and cuts for the given nodes (node, txt)."""
    matching = parts.Matching(threshold, strict)
    some = nodes.where(F.length("txt").between(1, matching.longest())).select("txt", F.xxhash64("node").alias("_h")).orderBy("_h", "txt").limit(TEXTS_FOR_CUTS)
    return parts.Matching(threshold, strict, parts.choose_cuts([r["txt"] for r in some.collect()], matching))


def _by_parts(index: DataFrame, probe: DataFrame, matching: parts.Matching) -> tuple[DataFrame, DataFrame]:
    """Stored keys (node, n, m, key) of both sides of texts that are cut into parts."""
    longest = matching.longest()
    index = index.where(F.col("n") <= longest)

    def made(nodes: DataFrame, kind: str, held=None) -> DataFrame:
        rows = nodes.select("node", F.xxhash64("grp").alias("g"), "txt", "n", "m")
        return rows.mapInArrow(parts.key_maker(matching, longest, kind, held), parts.SCHEMA)
    held, few, many = None, probe.count(), index.count()
    if few * MUCH_FEWER < many:
        held = sent(made(probe, "probe"), "key", bits_for(few * PROBE_KEYS))
    elif many > FEW_TEXTS:
        held = sent(made(probe, "ends"), "key", bits_for(few * END_KEYS))
    a = cut_lineage(made(index, "some" if few * MUCH_FEWER < many else "index", held))
    bits = bits_for(a.count())
    return a, cut_lineage(made(probe, "probe", sent(a, "key", bits)))


def _sized(nodes: DataFrame) -> DataFrame:
    """Stored nodes (node, grp, txt) with length and parity; those that have them stay as they are."""
    if {"n", "m"} <= set(nodes.columns):
        return nodes
    return cut_lineage(nodes.where("txt is not null").select("node", "grp", "txt", F.length("txt").alias("n"), F.expr(PARITY).alias("m")))


def similar_pairs(left: DataFrame, threshold: float, strict: bool = False,
                  right: DataFrame | None = None, matching: parts.Matching | None = None) -> DataFrame:
    """(u, v, score) for similar nodes of the same group, u before v.

    Nodes are (node, grp, txt), or stored ones with n and m (``_sized``). With ``right`` only
    left-right pairs are compared, and every left node must precede every right node.
    """
    share = _share(threshold)
    by_pieces = threshold > PIECES_ABOVE

    def met(a: DataFrame, b: DataFrame, distinct_sets: bool) -> DataFrame:
        """Pairs of equal keys of which the first side is the shorter text, or as long."""
        placed = "at" in a.columns
        a, b = (side.alias(name) for name, side in zip("ab", _dealt(a, b)))
        na, nb = F.col("a.n"), F.col("b.n")
        total = F.floor(F.lit(1 - share) * (na + nb) + F.lit(1e-9))
        longer = nb >= na if distinct_sets else (nb > na) | ((nb == na) & (F.col("a.node") < F.col("b.node")))
        flips = F.bit_count(F.col("a.m").bitwiseXOR(F.col("b.m")))
        fits = longer & (nb - na <= total) & (flips <= total)
        if placed and by_pieces:
            shift = F.col("b.at") - F.col("a.at")
            fits = fits & (2 * shift <= total + nb - na) & (-2 * shift <= total - nb + na)
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.salt") == F.col("b.salt")) & fits)
        return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))

    def joined(index: DataFrame, probe: DataFrame, distinct_sets: bool) -> DataFrame:
        if not by_pieces:
            return met(cut_lineage(_characters(index, share)), cut_lineage(_characters(probe, share)), distinct_sets)
        pairs = met(*_by_parts(index, probe, matching), distinct_sets)
        index, probe = (side.where(F.col("n") > matching.longest()) for side in (index, probe))
        if index.isEmpty():
            return pairs
        a = cut_lineage(_pieces(index, share))
        # Most substrings equal no piece; a bitmap of the pieces drops them before they are stored or moved.
        bits = bits_for(a.count())
        b = possible(_occurrences(probe, share), "key", cut_lineage(bitmap(a, "key", bits)), bits)
        return pairs.unionByName(met(a, cut_lineage(b), distinct_sets))

    left = _sized(left)
    if by_pieces and matching is None:
        matching = _matching(left, threshold, strict)
    if right is None:
        both, candidates = left, joined(left, left, False)
    else:
        right = _sized(right)
        both = left.unionByName(right)
        candidates = joined(left, right, True).unionByName(joined(right, left, True))
    candidates = candidates.distinct()
    texts = both.select("node", "grp", "txt")
    full = candidates.join(texts.select(F.col("node").alias("u"), F.col("grp").alias("_g"), F.col("txt").alias("_a")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("grp").alias("_h"), F.col("txt").alias("_b")), "v").where("_g = _h")
    # The banded distance on the JVM side leaves few pairs to the exact ratio.
    near = full.where(F.expr(f"levenshtein(_a, _b, cast(floor({1 - share!r}D * (length(_a) + length(_b)) + 1e-9D) as int)) >= 0"))
    scored = near.select("u", "v", indel_ratio(F.col("_a"), F.col("_b")).alias("score"))
    return scored.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def number_nodes(values: DataFrame) -> DataFrame:
    """(grp, value, txt, first) to (node, grp, value, txt), numbered by first appearance."""
    values = cut_lineage(values)   # read twice
    keyed = values.withColumn("_id", F.struct("grp", "value"))
    codes = _numbered(keyed.select("_id", F.col("first").alias("_o")), "_o", "_id")
    numbered = codes.select(F.col("_id.grp").alias("grp"), F.col("_id.value").alias("value"),
                            F.col("_code").alias("node"))
    return cut_lineage(numbered.join(values.drop("first"), ["grp", "value"]))


def _first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaders: nodes without an earlier leader among their neighbours (u before v).

    Each round settles every node all of whose earlier neighbours are settled: a ``u``
    that is nobody's ``v`` leads, and what it touches follows. Only followers are stored.
    A round settles the least open node at least, and as a rule far more.
    """
    followers = []
    while not edges.isEmpty():
        held = edges.select(F.col("v").alias("u")).distinct()
        fresh = cut_lineage(edges.join(held, "u", "left_anti").select("v").distinct())
        followers.append(fresh)
        edges = cut_lineage(edges.join(fresh, "v", "left_anti").join(
            fresh.withColumnRenamed("v", "u"), "u", "left_anti").select("u", "v"))
    leaders = nodes.select("node")
    if followers:
        leaders = leaders.join(reduce(DataFrame.unionByName, followers).withColumnRenamed("v", "node"), "node", "left_anti")
    return leaders


def greedy_leaders(nodes: DataFrame, threshold: float, strict: bool = False,
                   first_prefix: int = FIRST_PREFIX) -> DataFrame:
    """(node, leader) for every node, leaders pointing at themselves."""
    open_nodes, size = _sized(nodes.select("node", "grp", "txt")), first_prefix
    matching = _matching(open_nodes, threshold, strict) if threshold > PIECES_ABOVE else None
    found: list[DataFrame] = []
    while True:
        total = open_nodes.count()
        if total > 2 * size:
            cut = open_nodes.agg(F.percentile_approx("node", size / total, 10_000)).first()[0]
            prefix, rest = open_nodes.where(F.col("node") <= cut), open_nodes.where(F.col("node") > cut)
        else:
            prefix, rest = open_nodes, None
        edges = cut_lineage(similar_pairs(prefix, threshold, strict, matching=matching).select("u", "v"))
        chosen = cut_lineage(_first_independent(prefix, edges))
        found.append(chosen.select("node", F.col("node").alias("leader")))
        followers = edges.join(chosen.withColumnRenamed("node", "u"), "u", "left_semi").groupBy(
            F.col("v").alias("node")).agg(F.min("u").alias("leader"))
        found.append(followers)
        if rest is None:
            break
        leaders = cut_lineage(prefix.join(chosen, "node", "left_semi"))
        hits = cut_lineage(similar_pairs(leaders, threshold, strict, rest, matching).groupBy(
            F.col("v").alias("node")).agg(F.min("u").alias("leader")))
        found.append(hits)
        open_nodes = cut_lineage(rest.join(hits, "node", "left_anti"))
        size *= PREFIX_GROWTH
    return cut_lineage(reduce(DataFrame.unionByName, found))


# ---- category values ----------------------------------------------------------------


def _column_values(df: DataFrame, columns: list[str], order_by: list[str], value, txt) -> DataFrame:
    """(grp, value, txt, first) of the distinct values of several columns in one shuffle."""
    order = F.struct(*[col(c) for c in order_by]) if order_by else F.lit(0)
    cells = df.select(order.alias("_o"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("grp"), value(col(c)).alias("value")) for c in columns])))
    cells = cells.where("value is not null")
    return cells.groupBy("grp", "value").agg(F.struct(F.min("_o"), F.col("value")).alias("first")) \
        .withColumn("txt", txt(F.col("value")))


def fuzzy_pairs(df: DataFrame, threshold: float = 85, columns: list[str] | None = None,
                order_by: list[str] | None = None) -> DataFrame:
    """Value pairs per text column whose token-sorted similarity reaches the threshold."""
    columns = kinds.text(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value_a string, value_b string, score long")
    nodes = number_nodes(_column_values(df, columns, order_by or [], lambda c: c, sorted_tokens))
    pairs = similar_pairs(nodes, threshold)
    a = nodes.select(F.col("node").alias("u"), "grp", F.col("value").alias("value_a"))
    b = nodes.select(F.col("node").alias("v"), F.col("value").alias("value_b"))
    return pairs.join(a, "u").join(b, "v").select(
        F.col("grp").alias("column"), "value_a", "value_b", F.floor("score").cast("long").alias("score"))


def pair_classes(df: DataFrame, threshold: float = 85, columns: list[str] | None = None,
                 order_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``fuzzy_pairs`` says, without a row per pair of mutually similar values: (members, links).

    Members are (column, value, representative, n_links): values with the same sorted words are one class, which its
    first value stands for, and n_links is the number of other values of the column that a value resembles. Links are
    (column, value_a, value_b, score) between representatives. Two values of a class score 100; two of different
    classes score as their representatives do, so all pairs follow from the two tables.
    """
    columns = kinds.text(df) if columns is None else columns
    if not columns:
        spark = df.sparkSession
        return (spark.createDataFrame([], "column string, value string, representative string, n_links long"),
                spark.createDataFrame([], "column string, value_a string, value_b string, score long"))
    values = cut_lineage(_column_values(df, columns, order_by or [], lambda c: c, sorted_tokens))
    sizes = values.groupBy("grp", "txt").agg(F.min(F.struct("first", "value")).alias("_f"), F.count("*").alias("n"))
    classes = number_nodes(sizes.select("grp", F.col("_f.value").alias("value"), "txt", F.col("_f.first").alias("first"), "n"))
    pairs = cut_lineage(similar_pairs(classes, threshold))
    side = lambda c, name: classes.select(F.col("node").alias(c), F.col("value").alias(name))
    links = pairs.join(classes.select(F.col("node").alias("u"), "grp"), "u").join(side("u", "value_a"), "u").join(side("v", "value_b"), "v").select(
        F.col("grp").alias("column"), "value_a", "value_b", F.floor("score").cast("long").alias("score"))
    both = pairs.select("u", "v").unionAll(pairs.select("v", "u"))
    outside = both.join(classes.select(F.col("node").alias("v"), "n"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("_others"))
    counted = classes.join(outside, "node", "left").select(
        "grp", "txt", F.col("value").alias("representative"), (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"))
    # A class of very many values is one row on the right and is split on the left.
    members = values.join(counted, ["grp", "txt"]).select(F.col("grp").alias("column"), "value", "representative", "n_links")
    return members, links


def group_members(df: DataFrame, columns: list[str] | None = None, threshold: float = 85,
                  order_by: list[str] | None = None) -> DataFrame:
    """(column, value, leader, suggested) for trimmed values in groups of two or more.

    Values are compared in lower case. The suggestion is the longest member, most hyphens
    first and earliest on ties, in upper case.
    """
    columns = kinds.text(df) if columns is None else columns
    schema = "column string, value string, leader long, suggested string"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    trimmed = lambda c: F.when(strip(c) != "", strip(c))
    nodes = number_nodes(_column_values(df, columns, order_by or [], trimmed, F.lower))
    led = greedy_leaders(nodes, threshold).join(nodes.select("node", "grp", "value"), "node")
    hyphens = F.length("value") - F.length(F.replace("value", F.lit("-"), F.lit("")))
    names = led.groupBy("leader").agg(
        F.count("*").alias("_size"),
        F.max_by("value", F.struct(F.length("value"), hyphens, -F.col("node"))).alias("_best"))
    return led.join(names.where("_size > 1"), "leader").select(
        F.col("grp").alias("column"), "value", "leader", F.upper("_best").alias("suggested"))


def fuzzy_groups(df: DataFrame, columns: list[str] | None = None, threshold: float = 85,
                 order_by: list[str] | None = None) -> DataFrame:
    """(column, original, suggested): each group's sorted members and its canonical value."""
    members = group_members(df, columns, threshold, order_by)
    return members.groupBy("column", "leader", "suggested").agg(
        F.sort_array(F.collect_list("value")).alias("original")).drop("leader")


def apply_groups(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Replace members of a group, found by their trimmed text, by the suggestion."""
    kinds.require(df, column)
    dim = members.where(F.col("column") == column).select(F.col("value").alias("_trim"),
                                                          F.col("suggested").alias("_to"))
    mapped = map_by_table(df.withColumn("_trim", strip(col(column))), "_trim",
                          dim.withColumn("_to", F.concat(F.lit("="), "_to")))
    # Only real replacements carry the marker; a padded value without a group keeps its blanks.
    return mapped.withColumn(column, F.when(F.startswith("_trim", F.lit("=")) & (
        F.col("_trim") != strip(col(column))), F.substr("_trim", F.lit(2))).otherwise(col(column))).drop("_trim")


def normalize_map(df: DataFrame, column: str, threshold: float = 85,
                  order_by: list[str] | None = None) -> DataFrame:
    """(original, canonical): each trimmed value's most frequent similar normal form.

    Ties go to the longer form, then to the one seen first.
    """
    kinds.require(df, column)
    order = F.struct(*[col(c) for c in order_by or [column]])
    values = df.select(strip(col(column)).alias("original"), order.alias("_o")).where("original <> ''")
    values = values.groupBy("original").agg(F.min("_o").alias("_o")).withColumn("norm", normal_form(F.col("original")))
    values = cut_lineage(values)
    forms = values.groupBy("norm").agg(F.count("*").alias("c"), F.min("_o").alias("_o"))
    nodes = number_nodes(forms.select(F.lit(column).alias("grp"), F.col("norm").alias("value"),
                                      F.col("norm").alias("txt"), F.struct("_o", "norm").alias("first"), "c"))
    pairs = cut_lineage(similar_pairs(nodes, threshold).select("u", "v"))
    near = pairs.union(pairs.select("v", "u")).union(nodes.select(F.col("node"), F.col("node")))
    named = near.join(nodes.select(F.col("node").alias("v"), F.col("value").alias("form"), "c"), "v")
    best = named.groupBy("u").agg(F.max_by("form", F.struct("c", F.length("form"), -F.col("v"))).alias("canonical"))
    forms = nodes.select(F.col("node").alias("u"), F.col("value").alias("norm")).join(best, "u")
    return values.join(forms.select("norm", "canonical"), "norm").select("original", "canonical")


# ---- whole rows ---------------------------------------------------------------------


def _cell_text(df: DataFrame, name: str) -> Column:
    c = col(name)
    if name in set(kinds.numeric(df)) - set(kinds.integral(df)):
        plain = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
        c = F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit("nan"))


def drop_fuzzy_rows(df: DataFrame, order_by: list[str], threshold: float = 95,
                    columns: list[str] | None = None) -> DataFrame:
    """Rows in order, without those whose text is more than ``threshold`` similar to a kept one.

    A row's text is its cells, of all columns unless some are named, joined by ``||``.
    """
    kinds.require(df, *order_by, *(columns or []))
    names = order_by + [c for c in df.columns if c not in order_by]
    value = F.concat_ws("||", *[_cell_text(df, c) for c in columns or df.columns])
    row = F.struct(*[col(c) for c in names])
    # Rows are known by the hash of all their cells until the kept ones are fetched.
    cells = [_cell_text(df, c) for c in df.columns]
    keyed = df.select(value.alias("value"), F.struct(*[col(c) for c in order_by], F.xxhash64(*cells).alias("_h")).alias("first"))
    first = keyed.groupBy("value").agg(F.min("first").alias("first"))
    nodes = number_nodes(first.select(F.lit("").alias("grp"), "value", F.col("value").alias("txt"), "first"))
    led = greedy_leaders(nodes, threshold, strict=True)
    kept = nodes.join(led.where("node = leader"), "node", "left_semi").select("value")
    rows = df.select(value.alias("value"), row.alias("_row")).join(kept, "value", "left_semi")
    return rows.groupBy("value").agg(F.min("_row").alias("_row")).select(*[F.col("_row")[c].alias(c) for c in df.columns])
