"""Shards by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import stored

# Rows of a shard are numbered in this many groups by key, so that no task holds a whole shard.
NUMBERING_GROUPS = 1_024


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A leaf has its shard number and weight; else the weight is its children's."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def standard_tree(shards: int, base: int = 24, racks: int = 3, per_rack: int = 4) -> Node:
    """The first ``base`` shards in regions of ``racks`` racks; each later shard in a region of its own."""
    regions, step = [], racks * per_rack
    for first in range(0, min(base, shards), step):
        inside = range(first, min(first + step, base, shards))
        regions.append(Node(f"region{first // step}", tuple(
            Node(f"region{first // step}/rack{k}", tuple(Node(f"shard{s}", shard=s) for s in inside[k * per_rack:(k + 1) * per_rack]))
            for k in range(-(-len(inside) // per_rack)))))
    for s in range(base, shards):
        regions.append(Node(f"grown{s}", (Node(f"grown{s}/rack0", (Node(f"shard{s}", shard=s),)),)))
    return Node("root", tuple(regions))


def _shards(tree: Node) -> list[int]:
    return [s for c in tree.children for s in _shards(c)] if tree.children else [tree.shard]


def one_more(tree: Node) -> Node:
    """The tree with the next shard in a region of its own. No other weight changes, so it draws keys only to itself."""
    new = max(_shards(tree)) + 1
    region = Node(f"grown{new}", (Node(f"grown{new}/rack0", (Node(f"shard{new}", shard=new),)),))
    return Node(tree.name, (*tree.children, region))


def _draw(key: Column, node: Node) -> Column:
    """Weighted rendezvous: -ln(u) / weight, u in (0, 1) from 52 bits of md5. The smallest draw wins, so a
    child wins with a chance in proportion to its weight and a change of one weight leaves the order of
    the others as it is."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(node.name), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(node.weight)


def _winner(key: Column, node: Node, numbers: dict[str, int]) -> Column:
    """Number of the child that wins the draw in a node."""
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return F.lit(numbers[live[0].name])
    return F.array_min(F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(numbers[c.name]).alias("child"))
                                 for c in live]))["child"]


def place(rows: DataFrame, key: Column, tree: Node, name: str) -> DataFrame:
    """Add the shard of each key as a column: descend the tree, one draw among siblings a level."""
    level = [tree]
    rows = rows.withColumn(name, F.lit(0))
    while any(n.children for n in level):
        below = [c for n in level for c in (n.children or (n,))]
        numbers = {n.name: i for i, n in enumerate(below)}
        step = F.lit(None).cast("int")
        for i in reversed(range(len(level))):
            chosen = _winner(key, level[i], numbers) if level[i].children else F.lit(numbers[level[i].name])
            step = F.when(F.col(name) == i, chosen).otherwise(step)
        rows, level = rows.withColumn(name, step), below
    return rows.withColumn(name, F.element_at(F.array(*[F.lit(n.shard) for n in level]), F.col(name) + 1))


def numbered(rows: DataFrame, order: list[str], groups: int = NUMBERING_GROUPS) -> DataFrame:
    """Add ``slot``: 0, 1, … within each shard, without gaps.

    Rows are dealt to ``groups`` hashed groups a shard, numbered there, and moved up by the sizes of the
    groups before. Rows equal in ``order`` are interchangeable. The offsets have one row per shard and group.
    """
    rows = stored(rows.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups))), "shard-rows")
    counts = rows.groupBy("shard", "_group").agg(F.count("*").alias("_n"))
    # One shard's counts are ``groups`` rows, so this window is small whatever the table's size.
    before = counts.selectExpr("shard", "_group", "coalesce(sum(_n) over (partition by shard order by _group "
                               "rows between unbounded preceding and 1 preceding), 0) as _before")
    within = rows.selectExpr("*", "row_number() over (partition by shard, _group order by "
                             + ", ".join(f"`{c}`" for c in order) + ") - 1 as _at")
    # At most shards x groups rows, hence a bounded broadcast.
    return (within.join(F.broadcast(before), ["shard", "_group"])
            .withColumn("slot", F.col("_before") + F.col("_at")).drop("_group", "_before", "_at"))


def sharded(docs: DataFrame, shards: int = 24, tree: Node | None = None, grown: Node | None = None) -> DataFrame:
    """Put documents into shards by doc_id alone: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; ``grown_shard`` is the shard in ``grown``, by default the
    tree with one more shard, which takes rows only into that one. doc_id may be of any type. A missing text counts as empty; documents without an id share one shard;
    rows that repeat an id go to the same shard and get a slot each. Other columns are not looked at.
    """
    tree = tree or standard_tree(shards)
    grown = grown or one_more(tree)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), key.alias("_key"))
    rows = place(place(rows, F.col("_key"), tree, "shard"), F.col("_key"), grown, "grown_shard").drop("_key")
    placed = numbered(rows, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
