"""Exact, linearly interpolated quantiles in two scans whose memory does not grow with the data.

Spark's exact ``percentile`` keeps one counter per distinct value in a single task, so it is used only where
an action has shown that few values take part. Otherwise the first scan makes a mergeable sketch per column,
whose rank error is known: its values a little below and above a wanted rank bracket it for certain. The second
scan counts the rows below each bracket and stores the counted values inside it, a few rows in ten thousand; the
rank is then found in that table, by bins if it is still large.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepwright.kinds import lit
from prepwright.session import attach, cut_lineage

DIRECT_VALUES = 50_000
BINS = 1_000
# A sketched rank is off by one row in so many at most.
ACCURACY = 10_000
LARGEST = sys.float_info.max
# A group of no more rows is sorted whole, in tasks of about so many rows; a larger one is located by bins.
WHOLE_GROUP = 10_000
ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Range:
    """Closed value interval of one column, with the rows below it and inside it."""

    name: str
    lo: float
    hi: float
    below: int
    inside: int


def per_range(items: list[float]) -> str:
    """SQL text of a per-range constant, looked up by the range number ``r``."""
    return f"array({', '.join(lit(x) for x in items)})[r]"


def cells(df: DataFrame, values: list[tuple[int, Column]]) -> DataFrame:
    """(r, v) rows of numbered double columns; each value is computed once per row."""
    named = df.select(*[v.alias(f"v{i}") for i, (_, v) in enumerate(values)])
    structs = ", ".join(f"struct({r} as r, v{i} as v)" for i, (r, _) in enumerate(values))
    return named.selectExpr(f"inline(array({structs}))").where("v is not null")


def fit_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]],
                  limit: int = DIRECT_VALUES) -> dict[str, list[float | None]]:
    """Quantiles per label; ``wanted`` maps a label to a double column and its fractions."""
    if not wanted:
        return {}
    # Infinities take part as the largest finite numbers; least and greatest would drop NULL.
    values = {name: F.when(F.abs(v) <= LARGEST, v).when(v.isNotNull(), F.signum(v) * LARGEST)
              for name, (v, _) in wanted.items()}
    edges = {name: [min(1.0, max(0.0, p + step / ACCURACY)) for p in ps for step in (-2, 2)] for name, (_, ps) in wanted.items()}
    # Each value is computed once a row for its aggregates.
    named = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    sized = named.agg(*[a for i, name in enumerate(wanted) for v in [F.col(f"v{i}")] for a in (
        F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}"), F.approx_count_distinct(v).alias(f"d{i}"),
        F.percentile_approx(v, F.array(*map(F.lit, edges[name])), ACCURACY).alias(f"e{i}"))]).first()
    total = {name: sized[f"n{i}"] for i, name in enumerate(wanted)}
    answer: dict[tuple[str, float], float | None] = {}
    direct: dict[Range, list[float]] = {}
    brackets: dict[str, list[tuple[float, float]]] = {}
    for i, (name, (_, ps)) in enumerate(wanted.items()):
        if not total[name]:
            answer.update({(name, p): None for p in ps})
        elif min(total[name], 2 * sized[f"d{i}"]) <= limit:
            direct[Range(name, sized[f"a{i}"], sized[f"z{i}"], 0, total[name])] = list(ps)
        else:
            brackets[name] = _apart(list(zip(sized[f"e{i}"][::2], sized[f"e{i}"][1::2])))
    if direct:
        answer.update(_pick(df, values, direct, total))
    while brackets:
        answer_now, missed = _settle(df, values, brackets, {n: wanted[n][1] for n in brackets}, total, limit)
        answer.update(answer_now)
        # A bracket misses its rank only if the sketch is not as good as it promises: then all values are counted.
        brackets = {n: [(sized[f"a{i}"], sized[f"z{i}"])] for i, n in enumerate(wanted) if n in missed}
    restore = {LARGEST: math.inf, -LARGEST: -math.inf}
    return {name: [restore.get(answer[(name, p)], answer[(name, p)]) for p in ps]
            for name, (_, ps) in wanted.items()}


def _apart(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sorted spans, those that touch made one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _settle(df: DataFrame, values: dict[str, Column], brackets: dict[str, list[tuple[float, float]]], wanted: dict[str, list[float]],
            total: dict[str, int], limit: int) -> tuple[dict[tuple[str, float], float], set[str]]:
    """The counted scan: quantiles found inside the brackets, and columns of which a rank lies outside."""
    names = list(brackets)
    # Even zones lie between brackets, odd ones are brackets; only there values are kept apart.
    zones = ", ".join("array({})".format(", ".join(f"{lit(x)}" for span in brackets[n] for x in span)) for n in names)
    widest = max(map(len, brackets.values()))
    zone = " + ".join(f"if(v >= get(e, {2 * k}), 1, 0) + if(v > get(e, {2 * k + 1}), 1, 0)" for k in range(widest))
    placed = cells(df, [(i, values[n]) for i, n in enumerate(names)]).selectExpr("r", "v", f"array({zones})[r] as e").selectExpr(
        "r", "v", f"{zone} as zone")
    counted = cut_lineage(placed.selectExpr("r", "zone", "if(zone % 2 = 1, v, null) as v").groupBy("r", "zone", "v").agg(F.count("*").alias("n")))
    sizes = {(r["r"], r["zone"]): (r["n"], r["d"]) for r in counted.groupBy("r", "zone").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    few: dict[Range, list[float]] = {}
    many: dict[Range, list[float]] = {}
    missed = set()
    for i, n in enumerate(names):
        at, found = 0, {}
        for zone in range(2 * len(brackets[n]) + 1):
            inside, distinct = sizes.get((i, zone), (0, 0))
            if zone % 2:
                lo, hi = brackets[n][zone // 2]
                for p in wanted[n]:
                    position = p * (total[n] - 1)
                    if at <= math.floor(position) and math.ceil(position) < at + inside:
                        found[p] = Range(n, lo, hi, at, inside), distinct
            at += inside
        if len(found) < len(set(wanted[n])):
            missed.add(n)
            continue
        for p, (r, distinct) in found.items():
            (few if distinct <= limit else many).setdefault(r, []).append(p)
    answer: dict[tuple[str, float], float] = {}
    while many:
        many, done = _narrow(counted, names, many, total)
        answer.update(done)
        for r in [r for r in many if r.inside <= limit]:
            few[r] = many.pop(r)
    if few:
        place = {n: i for i, n in enumerate(names)}
        aggs, keys = [], []
        for i, (r, ps) in enumerate(few.items()):
            at = [min(1.0, max(0.0, (p * (total[r.name] - 1) - r.below) / max(r.inside - 1, 1))) for p in ps]
            inside = (F.col("r") == place[r.name]) & (F.col("v") >= F.lit(r.lo)) & (F.col("v") <= F.lit(r.hi))
            aggs.append(F.percentile(F.when(inside, F.col("v")), F.array(*[F.lit(float(a)) for a in at]), F.col("n")).alias(f"q{i}"))
            keys.append([(r.name, p) for p in ps])
        row = counted.agg(*aggs).first()
        answer.update({key: x for i, group in enumerate(keys) for key, x in zip(group, row[i])})
    return answer, missed


def _pick(df: DataFrame, values: dict[str, Column], ranges: dict[Range, list[float]],
          total: dict[str, int]) -> dict[tuple[str, float], float]:
    """Interpolate inside ranges that hold few values; all in one scan."""
    aggs, keys = [], []
    for i, (r, ps) in enumerate(ranges.items()):
        v = values[r.name]
        at = [min(1.0, max(0.0, (p * (total[r.name] - 1) - r.below) / max(r.inside - 1, 1))) for p in ps]
        whole = r.below == 0 and r.inside == total[r.name]
        inside = F.when((v >= F.lit(r.lo)) & (v <= F.lit(r.hi)), v)
        aggs.append(F.percentile(v if whole else inside,
                                 F.array(*[F.lit(float(p if whole else a)) for p, a in zip(ps, at)])).alias(f"q{i}"))
        keys.append([(r.name, p) for p in ps])
    row = df.agg(*aggs).first()
    return {key: q for i, group in enumerate(keys) for key, q in zip(group, row[i])}


def _narrow(counted: DataFrame, names: list[str], ranges: dict[Range, list[float]],
            total: dict[str, int]) -> tuple[dict[Range, list[float]], dict[tuple[str, float], float]]:
    """One pass over counted values: smaller ranges for the ranks still open, and the ranks settled."""
    order = list(ranges)
    spans = ", ".join(f"struct({names.index(r.name)} as c, {i} as i, {lit(r.lo)} as low, {lit(r.hi)} as high)" for i, r in enumerate(order))
    near = counted.where("v is not null").selectExpr("v", "n", f"inline(filter(array({spans}), x -> x.c = r and v between x.low and x.high))")
    # Halves keep the width finite; every step is monotone, so bins never mix ranks.
    bins = near.selectExpr("i as r", "v", "n", f"cast(floor((v * 0.5D - low * 0.5D) / (high * 0.5D - low * 0.5D) * {BINS}) as int) as bin")
    counted = bins.groupBy("r", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows: dict[int, list] = {i: [] for i in range(len(order))}
    for row in counted.collect():  # at most BINS + 1 rows per range
        rows[row["r"]].append((row["bin"], row["n"], row["lo"], row["hi"]))
    smaller: dict[Range, list[float]] = {}
    found: dict[tuple[str, float], float] = {}
    for i, r in enumerate(order):
        bins, below = [], r.below
        for _, n, lo, hi in sorted(rows[i]):
            bins.append(Range(r.name, lo, hi, below, n))
            below += n
        for p in ranges[r]:
            position = p * (total[r.name] - 1)
            k0, k1 = math.floor(position), math.ceil(position)
            first = next(b for b in bins if k0 < b.below + b.inside)
            last = next(b for b in bins if k1 < b.below + b.inside)
            if first is not last:
                # The two ranks end one bin and begin the next; weighted as ``percentile`` does.
                found[(r.name, p)] = (k1 - position) * first.hi + (position - k0) * last.lo
            elif first.lo == first.hi:
                found[(r.name, p)] = first.lo
            else:
                smaller.setdefault(first, []).append(p)
    return smaller, found


def fit_median(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return {name: found[0] for name, found in
            fit_quantiles(df, {name: (v, [0.5]) for name, v in columns.items()}).items()}


def _interpolated(ps: list[float], at) -> str:
    """SQL array of the quantiles; ``at`` gives the SQL text of the value of a rank. NaN-free weights as in ``percentile``; equal ranks need none."""
    def one(p: float) -> str:
        x = f"({lit(p)} * (n - 1))"
        low, high = at(f"floor({x})"), at(f"ceil({x})")
        return f"if(floor({x}) = ceil({x}), {low}, (ceil({x}) - {x}) * {low} + ({x} - floor({x})) * {high})"
    return f"array({', '.join(map(one, ps))})"


def group_quantiles(df: DataFrame, key: str, value: str, ps: list[float]) -> DataFrame:
    """(key, q array) of every group, however many there are and however large one is.

    A group of at most WHOLE_GROUP rows is sorted as one array; the tasks for these are as many as their rows need.
    Ranks of larger groups are located by counting in bins.
    """
    rows = df.select(F.col(key).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    sizes = cut_lineage(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    total, large = sizes.agg(F.sum("n"), F.count_if(F.col("n") > WHOLE_GROUP)).first()
    many = None
    if large:
        many = sizes.where(F.col("n") > WHOLE_GROUP)
        marked = attach(rows, many.select("g", F.lit(True).alias("_large")), ["g"])
        rows, apart = marked.where("_large is null").drop("_large"), marked.where("_large").drop("_large")
    n = max(-(-(total or 0) // ROWS_PER_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = rows.repartition(n, "g").groupBy("g").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("s"))
    found = whole.selectExpr("g", f"{_interpolated(ps, lambda k: f's[cast({k} as int)]')} as q")
    if many is not None:
        found = found.unionByName(_large_group_quantiles(apart, many, ps))
    return found.withColumnRenamed("g", key)


def _large_group_quantiles(rows: DataFrame, sizes: DataFrame, ps: list[float]) -> DataFrame:
    """(g, q array) of the groups in ``sizes`` (g, n, lo, hi).

    As above, ranks are located by counting in bins, here by group and rank, and the state
    is a table with one row per group. The loop ends when every rank is one value.
    """
    ranks = ", ".join(f"floor({lit(p)} * (n - 1)), ceil({lit(p)} * (n - 1))" for p in ps)
    state = cut_lineage(sizes.selectExpr("g", "n", "lo", "hi", f"explode(array_distinct(array({ranks}))) as k").selectExpr(
        "g", "n", "k", "lo", "hi", "0L as below"))
    while True:
        live = state.where("lo < hi")
        if live.isEmpty():
            break
        wanted = live.groupBy("g").agg(F.collect_list(F.struct("k", "lo", "hi", "below")).alias("w"))
        near = attach(rows, wanted, ["g"]).selectExpr("g", "v", "inline(filter(w, x -> v between x.lo and x.hi))")
        bins = near.groupBy("g", "k", "below", F.expr(f"floor((v * 0.5D - lo * 0.5D) / (hi * 0.5D - lo * 0.5D) * {BINS})").alias("bin")).agg(
            F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # At most BINS + 1 rows per group and rank.
        until = bins.selectExpr("*", "below + sum(c) over (partition by g, k order by bin) as until")
        found = until.where("k < until and k >= until - c").selectExpr("g", "k", "lo", "hi", "until - c as below")
        kept = state.where("lo = hi")
        state = cut_lineage(kept.unionByName(live.select("g", "n", "k").join(found, ["g", "k"]).select(*kept.columns)))
    at = state.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("k", "lo"))).alias("m"))
    return at.selectExpr("g", f"{_interpolated(ps, lambda k: f'm[{k}]')} as q")
