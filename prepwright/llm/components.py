"""Connected components of links between 64-bit values, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import release, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each value to the smallest value among them and itself.

    The large star does so for the larger neighbours, the small star for the value and its smaller ones.
    A value with very many neighbours is one row of the smallest values, which are stored and so joined by
    plain shuffles: Spark splits such a value on the side of the links. ``links`` is a stored table and goes.
    """
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = stored(both.groupBy("a").agg(F.min("b").alias("least")), "least")
    tied = both.join(least, "a").withColumn("least", F.least("a", "least"))
    if large:
        pairs = tied.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        pairs = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select("a", F.col("least").alias("b")))
    out = stored(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    release(links, least)
    return out


def components(links: DataFrame) -> DataFrame:
    """Rows (value, root) for every linked value; the root is the smallest value it reaches.

    ``links`` has columns a and b of one type. A round halves the depth of the trees at least, so the
    number of rounds grows with the logarithm of the longest chain; each leaves at most as many links
    as there were. The driver sees two numbers a round.
    """
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        now = _star(_star(now, large=True), large=False)
        after = mark(now)
        if after == before:
            break
        before = after
    # At the end every link is (value, root).
    return now.select(F.col("a").alias("value"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("value"), F.col("b").alias("root"))).distinct()
