"""Statistics, features, encodings and chart data."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from prepwright.catalog.registry import (
    LINEITEM_COLUMNS, LINEITEM_NUMBERS, dirty, on_dirty, plain, query, r, rounds, sig, significant, table, union_all)
from prepwright.operators import charts, encode, features, profile, rules
from prepwright.plans import flows

NUMS = LINEITEM_NUMBERS
PAIRS = list(combinations(NUMS, 2))


def _corr(a: str, b: str) -> str:
    return f"(regr_sxy({a}, {b}) / nullif(sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})), 0))"


def _quantile(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


def _fence(c: str) -> tuple[str, str]:
    q1, q3 = f"(select {_quantile(c, 0.25)} from d)", f"(select {_quantile(c, 0.75)} from d)"
    return f"({q1} - 1.5 * ({q3} - {q1}))", f"({q3} + 1.5 * ({q3} - {q1}))"


# ---- statistics ---------------------------------------------------------------------

_KIND = "case typeof({c}) when 'VARCHAR' then '{t}' when 'TIMESTAMP' then '{d}' else 'numeric' end"


@query("st_overview", "with one as (select * from lineitem limit 1) " + union_all([
    f"""select '{c}' as "column", {_KIND.format(c=c, t='text', d='datetime')} as kind,
        (select count(*) from lineitem) as n_rows, cast(11 as bigint) as n_cols from one"""
    for c in LINEITEM_COLUMNS if c not in ("price_twice", "const_one")]))
def st_overview(spark, sf):
    return profile.shape_and_types(table(spark, sf, "lineitem"))


@query("st_feature_types", "with one as (select * from lineitem limit 1) " + union_all([
    f"""select '{c}' as "column", {_KIND.format(c=c, t='categorical', d='categorical')} as kind,
        typeof({c}) = 'TIMESTAMP' as is_datetime from one"""
    for c in LINEITEM_COLUMNS if c not in ("price_twice", "const_one")]))
def st_feature_types(spark, sf):
    return profile.feature_types(table(spark, sf, "lineitem"))


_MISSING = union_all([f"""select '{c}' as "column", count(*) - count({c}) as missing_count,
    (count(*) - count({c})) / count(*)::double as ratio from d""" for c in LINEITEM_COLUMNS])


@query("st_missing", on_dirty("lineitem", f"""
    select "column", missing_count, round(ratio, 4) as missing_ratio from ({_MISSING})"""))
def st_missing(spark, sf):
    return profile.missing_summary(dirty(spark, sf, "lineitem"))


@query("top_missing", on_dirty("lineitem", f"""
    select "column", {r("ratio")} as missing_ratio from ({_MISSING}) order by ratio desc, "column" limit 3"""))
def top_missing(spark, sf):
    return rounds(profile.top_missing(dirty(spark, sf, "lineitem")), 6, "missing_ratio")


def _described(c: str) -> str:
    date = c == "l_shipdate"
    v = f"(epoch_us({c}) / 1e6)" if date else f"cast({c} as double)"
    std = "cast(null as double)" if date else sig(f"stddev_samp({v})")
    return f"""select '{c}' as "column", count({v}) as count, {sig(f"avg({v})")} as mean, {std} as std,
        {sig(f"min({v})")} as min, {sig(_quantile(v, 0.25))} as q25, {sig(_quantile(v, 0.5))} as q50,
        {sig(_quantile(v, 0.75))} as q75, {sig(f"max({v})")} as max"""


_MEASURES = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query("st_describe", on_dirty("lineitem", union_all([_described(c) + " from d" for c in [*NUMS, "l_shipdate"]])))
def st_describe(spark, sf):
    return significant(profile.describe(dirty(spark, sf, "lineitem")), *_MEASURES)


@query("st_describe_all", on_dirty("lineitem", union_all(
    [_described(c) + ", cast(null as bigint) as \"unique\", cast(null as varchar) as top, cast(null as bigint) as freq from d"
     for c in [*NUMS, "l_shipdate"]] +
    [f"""select '{c}', count({c}), null, null, null, null, null, null, null, count(distinct {c}),
         (select {c} from d where {c} is not null group by {c} order by count(*) desc, {c} limit 1),
         (select count(*) from d where {c} is not null group by {c} order by count(*) desc, {c} limit 1) from d"""
     for c in ("l_returnflag", "l_linestatus")])))
def st_describe_all(spark, sf):
    return significant(profile.describe_all(dirty(spark, sf, "lineitem")), *_MEASURES)


@query("st_corr_matrix", on_dirty("lineitem", union_all([
    f"""select '{a}' as col_a, '{b}' as col_b, {r(_corr(a, b))} as corr from d""" for a in NUMS for b in NUMS])))
def st_corr_matrix(spark, sf):
    return rounds(profile.correlation_matrix(dirty(spark, sf, "lineitem")), 6, "corr")


@query("st_cov_matrix", on_dirty("lineitem", union_all([
    f"""select '{a}' as col_a, '{b}' as col_b, {sig(f"covar_samp({a}, {b})")} as cov from d"""
    for a, b in [(c, c) for c in NUMS] + PAIRS])))
def st_cov_matrix(spark, sf):
    return significant(profile.covariances(dirty(spark, sf, "lineitem")), "cov")


_ALL_PAIRS = union_all([f"""select '{a}' as col_a, '{b}' as col_b, {_corr(a, b)} as corr,
    cast({NUMS.index(a) * len(NUMS) + NUMS.index(b)} as bigint) as ord from d""" for a, b in PAIRS])


@query("st_corr_pairs", on_dirty("lineitem", f"""
    select col_a, col_b, {r("corr")} as corr, ord from ({_ALL_PAIRS}) where abs(corr) >= 0.85"""))
def st_corr_pairs(spark, sf):
    return rounds(profile.correlated_pairs(dirty(spark, sf, "lineitem"), 0.85), 6, "corr")


@query("st_corr_max", on_dirty("lineitem", f"""
    select {r("coalesce(max(abs(corr)), 0.0)")} as correlation_max from ({_ALL_PAIRS})"""))
def st_corr_max(spark, sf):
    return rounds(profile.max_correlation(dirty(spark, sf, "lineitem")), 6, "correlation_max")


def _skew(c: str) -> str:
    return f"(case when min({c}) = max({c}) then 0.0::double else skewness({c}) end)"


@query("st_skew", on_dirty("lineitem", union_all([
    f"""select '{c}' as "column", {r(_skew(c))} as skew from d""" for c in NUMS])))
def st_skew(spark, sf):
    return rounds(profile.skewness(dirty(spark, sf, "lineitem")), 6, "skew")


_X, _Y = "l_quantity", "l_extendedprice"


@query("st_regression", on_dirty("lineitem", f"""
    select regr_count({_Y}, {_X})::bigint as n, {sig(f"regr_intercept({_Y}, {_X})")} as intercept,
      {sig(f"regr_slope({_Y}, {_X})")} as slope, {r(f"regr_r2({_Y}, {_X})")} as r2,
      {sig(f"(regr_syy({_Y}, {_X}) - regr_sxy({_Y}, {_X}) ** 2 / regr_sxx({_Y}, {_X})) / regr_count({_Y}, {_X})")} as mse,
      'Linear regression predicting {_Y} from {_X}' || chr(10) || 'Intercept: ' ||
      format('{{:.4f}}', regr_intercept({_Y}, {_X})) || chr(10) || 'Coefficient: ' ||
      format('{{:.4f}}', regr_slope({_Y}, {_X})) || chr(10) as summary from d"""))
def st_regression(spark, sf):
    out = profile.regression(dirty(spark, sf, "lineitem"), _X, _Y)
    return rounds(significant(out, "intercept", "slope", "mse"), 6, "r2")


@query("st_outlier_counts", on_dirty("lineitem", union_all([
    f"""select '{c}' as "column", count(*) filter ({c} < {_fence(c)[0]} or {c} > {_fence(c)[1]}) as outliers from d"""
    for c in NUMS])))
def st_outlier_counts(spark, sf):
    return profile.outlier_counts(dirty(spark, sf, "lineitem"))


def _histogram(c: str, bins: int) -> str:
    return f"""select '{c}' as "column", i as bin, {r("lo")} as lo, {r("hi")} as hi, count({c}) as n from (
        select i, case when i = 1 and z > a then a - 0.001 * (z - a) else low + (i - 1) * ((high - low) / {bins}) end as lo,
               case when i = {bins} then high else low + i * ((high - low) / {bins}) end as hi
        from (select a, z, case when a = z then a - 0.001 * abs(a) else a end as low,
                     case when a = z then z + 0.001 * abs(z) else z end as high
              from (select min(cast({c} as double)) as a, max(cast({c} as double)) as z from d)),
             (select unnest(range(1, {bins + 1})) as i))
      left join d on {c} > lo and {c} <= hi group by i, lo, hi"""


@query("st_histogram", on_dirty("lineitem", union_all([_histogram(c, 20) for c in NUMS])))
def st_histogram(spark, sf):
    return rounds(profile.histogram(dirty(spark, sf, "lineitem"), 20), 6, "lo", "hi")


@query("st_target_balance", on_dirty("lineitem", f"""
    select {r("min(n) / max(n)::double")} as target_balance from (select count(*) as n from d group by l_returnflag)"""))
def st_target_balance(spark, sf):
    return rounds(profile.target_balance(dirty(spark, sf, "lineitem"), "l_returnflag"), 6, "target_balance")


@query("st_class_count", on_dirty("lineitem", "select count(distinct l_returnflag) as n_classes from d"))
def st_class_count(spark, sf):
    return profile.class_count(dirty(spark, sf, "lineitem"), "l_returnflag")


def _profiled(c: str, number: bool) -> str:
    def n(expr: str, kind: str = "double") -> str:
        return expr if number else f"cast(null as {kind})"

    counts = f"select {c} as v, count(*) as k from d where {c} is not null group by {c}"
    top = "cast(null as varchar)" if number else \
        f"(select string_agg(v, '|' order by k desc, v) from (select * from ({counts}) order by k desc, v limit 5))"
    distinct = f"count(distinct {c})"
    if c == "l_shipdate":
        v, none = f"(epoch_us({c}) / 1e6)", "cast(null as bigint)"
        return f"""select '{c}' as "column", 'datetime' as kind, count(*) as n, count(*) - count({c}) as missing, {none} as zeros,
          {none} as negatives, {none} as infinite, {sig(f"avg({v})")} as mean, cast(null as double) as std, {sig(f"min({v})")} as min,
          {sig(_quantile(v, 0.25))} as q25, {sig(_quantile(v, 0.5))} as q50, {sig(_quantile(v, 0.75))} as q75, {sig(f"max({v})")} as max,
          cast(null as double) as skew, {distinct} as n_distinct, (select max(k) from ({counts})) as top_freq,
          cast(null as varchar) as top_values, {distinct} = count({c}) and count({c}) > 0 as is_unique,
          concat_ws(',', case when {distinct} <= 1 then 'constant' end,
            case when count(*) - count({c}) > 0.2 * count(*) then 'high_missing' end) as alerts from d"""
    return f"""select '{c}' as "column", '{"numeric" if number else "categorical"}' as kind, count(*) as n,
      count(*) - count({c}) as missing, {n(f"count(*) filter ({c} = 0)", "bigint")} as zeros,
      {n(f"count(*) filter ({c} < 0)", "bigint")} as negatives,
      {n(f"count(*) filter (isinf(cast({c} as double)))", "bigint")} as infinite, {n(sig(f"avg({c})"))} as mean,
      {n(sig(f"stddev_samp({c})"))} as std, {n(sig(f"min({c})"))} as min, {n(sig(_quantile(c, 0.25)))} as q25,
      {n(sig(_quantile(c, 0.5)))} as q50, {n(sig(_quantile(c, 0.75)))} as q75, {n(sig(f"max({c})"))} as max,
      {n(r(_skew(c)))} as skew, {distinct} as n_distinct, (select max(k) from ({counts})) as top_freq, {top} as top_values,
      {distinct} = count({c}) and count({c}) > 0 as is_unique,
      concat_ws(',', case when {distinct} <= 1 then 'constant' end,
        case when {"false" if number else f"{distinct} > 50"} then 'high_cardinality' end,
        case when count(*) - count({c}) > 0.2 * count(*) then 'high_missing' end,
        case when {f"abs({_skew(c)}) > 1" if number else "false"} then 'skewed' end) as alerts from d"""


@query("st_profile", on_dirty("lineitem", union_all(
    [_profiled(c, c in NUMS) for c in LINEITEM_COLUMNS])))
def st_profile(spark, sf):
    out = profile.profile(dirty(spark, sf, "lineitem"))
    out = out.withColumn("top_values", F.when(F.col("kind") == "categorical", F.col("top_values")))
    return rounds(significant(out, *_MEASURES), 6, "skew")


# ---- features -----------------------------------------------------------------------

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_PARTS = {"year": "year(o_orderdate)", "month": "month(o_orderdate)", "day": "day(o_orderdate)",
          "weekday": "isodow(o_orderdate) - 1"}
_DATE_PARTS = ", ".join(f"cast({v} as integer) as o_orderdate_{k}" for k, v in _PARTS.items())


@query("feat_date_parts", f"select *, {_DATE_PARTS} from orders")
def feat_date_parts(spark, sf):
    return features.date_parts(table(spark, sf, "orders"))


@query("feat_log1p", f"""select p_partkey, p_size, p_retailprice, {r("ln(1 + p_size)")} as p_size_log,
    {r("ln(1 + p_retailprice)")} as p_retailprice_log from part""")
def feat_log1p(spark, sf):
    df = plain(table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice")
    return rounds(features.log_features(df), 6, "p_size_log", "p_retailprice_log")


_VARYING = [c for c in NUMS if c != "const_one"]


@query("feat_zscore", on_dirty("lineitem", "select *, " + ", ".join(
    f"""{r(f"({c} - (select avg({c}) from d)) / (select stddev_samp({c}) from d)")} as {c}_z""" for c in _VARYING)
    + " from d"))
def feat_zscore(spark, sf):
    return rounds(features.zscore_features(dirty(spark, sf, "lineitem")), 6, *[f"{c}_z" for c in _VARYING])


@query("feat_group_mean", on_dirty("lineitem", "select d.*, " + ", ".join(
    f"case when l_returnflag is not null then {sig(f'avg({c}) over (partition by l_returnflag)')} end as l_returnflag_{c}_grpmean"
    for c in NUMS) + " from d"))
def feat_group_mean(spark, sf):
    return significant(features.group_means(dirty(spark, sf, "lineitem")), *[f"l_returnflag_{c}_grpmean" for c in NUMS])


# Order keys start at 0, so only these columns are positive on every row.
_LOGGED = ["o_totalprice", "o_orderdate_year", "o_orderdate_month", "o_orderdate_day"]
_BASIC = ["o_orderkey", "o_custkey", "o_totalprice", *[f"o_orderdate_{k}" for k in _PARTS], *[f"{c}_log" for c in _LOGGED]]
_BASIC_ALL = _BASIC + [f"{c}_z" for c in _BASIC]


@query("feat_basic_all", f"""
    with a as (select *, {_DATE_PARTS} from orders),
    b as (select *, {", ".join(f"ln(1 + {c}) as {c}_log" for c in _LOGGED)} from a),
    s as (select {", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in _BASIC)} from b),
    e as (select b.*, {", ".join(f"({c} - m_{c}) / s_{c} as {c}_z" for c in _BASIC)} from b, s)
    select {", ".join(c for c in _ORDERS)}, {", ".join(f"o_orderdate_{k}" for k in _PARTS)},
      {", ".join(f"{r(c)} as {c}" for c in _BASIC_ALL if c.endswith("_log") or c.endswith("_z"))},
      {", ".join(f"{r(f'avg({c}) over (partition by o_orderstatus)', 5)} as o_orderstatus_{c}_grpmean" for c in _BASIC_ALL)}
    from e""")
def feat_basic_all(spark, sf):
    out = features.basic_features(table(spark, sf, "orders"))
    means = [f"o_orderstatus_{c}_grpmean" for c in _BASIC_ALL]
    out = rounds(out, 6, *[c for c in _BASIC_ALL if c.endswith(("_log", "_z"))])
    return rounds(out, 5, *means)


# ---- encoding, scaling, selection ---------------------------------------------------

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_ONEHOT = ", ".join(f"coalesce(c_mktsegment = '{v}', false) as c_mktsegment_{v}" for v in _SEGMENTS)


@query("enc_onehot", on_dirty("customer", f"select c_custkey, c_nationkey, c_acctbal, {_ONEHOT} from d"))
def enc_onehot(spark, sf):
    return encode.one_hot(dirty(spark, sf, "customer"))


@query("enc_onehot_wide", """
    select o_orderkey, (select count(distinct o_orderdate) from orders) as size,
           dense_rank() over (order by cast(o_orderdate as varchar)) - 1 as index from orders""")
def enc_onehot_wide(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
    return encode.one_hot(df, sparse=["day"]).select("o_orderkey", "day.size", "day.index")


@query("enc_onehot_vector", """
    with cells as (
      select p_partkey, 0 as ord, 'p_size' as feature, cast(p_size as double) as value, null as level from part
      union all select p_partkey, 1, 'p_name_' || p_name, 1.0, p_name from part
      union all select p_partkey, 2, 'p_brand_' || p_brand, 1.0, p_brand from part)
    select p_partkey, feature, value, (select 1 + count(distinct p_name) + count(distinct p_brand) from part) as size,
           cast(dense_rank() over (order by ord, level) - 1 as integer) as place from cells""")
def enc_onehot_vector(spark, sf):
    """The values of all text columns as ones of a sparse vector, and their names."""
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    out, names = encode.feature_vector(df, ["p_size"], ["p_name", "p_brand"])
    cells = out.select("p_partkey", F.posexplode(vector_to_array("features")).alias("place", "value"),
                       F.size(vector_to_array("features")).cast("long").alias("size")).filter("value <> 0 or place = 0")
    return cells.join(names, "place").select("p_partkey", "feature", "value", "size", F.col("place").cast("int").alias("place"))


_LEVELS = union_all([f"select rid, {i} as o, '{c}' as c, {c} as v from n where {c} is not null"
                     for i, c in enumerate(("l_returnflag", "l_linestatus", "month"))])


@query("feat_level_pairs", on_dirty("lineitem", f"""
    , n as materialized (select row_number() over () as rid, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') as month from d),
    e as materialized ({_LEVELS}),
    v as (select o, c, v, count(*) as k from e group by all), t as (select count(*)::double as n from d),
    j as (select a.o as oa, a.v as va, b.o as ob, b.v as vb, count(*) as n from e a join e b using (rid) group by all),
    p as (select a.c as column_a, a.v as level_a, b.c as column_b, b.v as level_b, coalesce(j.n, 0) as n,
            (coalesce(j.n, 0) * t.n - a.k::double * b.k) / sqrt(a.k * (t.n - a.k)) / sqrt(b.k * (t.n - b.k)) as corr
          from v a cross join v b cross join t left join j on j.oa = a.o and j.va = a.v and j.ob = b.o and j.vb = b.v
          where (a.o < b.o or a.o = b.o and a.v < b.v) and a.k < t.n and b.k < t.n)
    select column_a, level_a, column_b, level_b, n, {r("corr")} as corr from p where abs(round(corr, 12)) >= 0.6"""))
def feat_level_pairs(spark, sf):
    df = dirty(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return rounds(encode.level_correlations(df, ["l_returnflag", "l_linestatus", "month"], 0.6), 6, "corr")


@query("enc_label", on_dirty("customer", """
    , v as (select value, row_number() over (order by first, value) - 1 as code from (
        select c_mktsegment as value, min(c_custkey) as first from d where c_mktsegment is not null group by c_mktsegment))
    select d.*, cast(coalesce(code, -1) as bigint) as c_mktsegment_code from d left join v on value = c_mktsegment"""))
def enc_label(spark, sf):
    return encode.label_codes(dirty(spark, sf, "customer"), "c_mktsegment", "c_custkey")


def _scaled(kind: str) -> str:
    out = []
    for c in NUMS:
        if c == "const_one":
            out.append("0.0::double as const_one")
        elif kind == "standard":
            out.append(f"""{r(f"({c} - (select avg({c}) from d)) / (select stddev_pop({c}) from d)")} as {c}""")
        else:
            low, high = f"(select min({c}) from d)", f"(select max({c}) from d)"
            out.append(f"""{r(f"({c} - {low}) / ({high} - {low})::double")} as {c}""")
    return on_dirty("lineitem", f"select {', '.join(out)}, l_returnflag, l_linestatus, l_shipdate from d")


@query("scl_standard", _scaled("standard"))
def scl_standard(spark, sf):
    return rounds(encode.standard_scale(dirty(spark, sf, "lineitem")), 6, *NUMS)


@query("scl_minmax", _scaled("minmax"))
def scl_minmax(spark, sf):
    return rounds(encode.minmax_scale(dirty(spark, sf, "lineitem")), 6, *NUMS)


@query("sel_low_variance", on_dirty("lineitem", f"""
    select l_returnflag, l_linestatus, l_shipdate, {", ".join(c for c in NUMS if c != "const_one")} from d"""))
def sel_low_variance(spark, sf):
    return encode.drop_low_variance(dirty(spark, sf, "lineitem"))[0]


def _z(c: str) -> str:
    return f"""{r(f"({c} - (select avg({c}) from d)) / (select stddev_pop({c}) from d)")} as {c}"""


_CUSTOMER_NUMS = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("feat_pipeline", on_dirty("customer", f"select {_ONEHOT}, {', '.join(map(_z, _CUSTOMER_NUMS))} from d"))
def feat_pipeline(spark, sf):
    return rounds(flows.engineer(dirty(spark, sf, "customer"))[0], 6, *_CUSTOMER_NUMS)


_FLAGS = ["A", "N", "R"]


@query("feat_choices", on_dirty("lineitem", f"""
    select {", ".join(f"coalesce(l_returnflag = '{v}', false) as l_returnflag_{v}" for v in _FLAGS)},
      {", ".join(f"l_linestatus = '{v}' as l_linestatus_{v}" for v in ("F", "O"))}, l_shipdate,
      {", ".join(f'''{r(f"({c} - (select min({c}) from d)) / (select max({c}) - min({c}) from d)::double")} as {c}'''
                 if c != "const_one" else "0.0::double as const_one" for c in NUMS if c != "price_twice")} from d"""))
def feat_choices(spark, sf):
    out = flows.choose_features(dirty(spark, sf, "lineitem"), encoding=True, drop_correlated=True, scaling="minmax")
    return rounds(out, 6, *[c for c in NUMS if c != "price_twice"])


@query("feat_choices_label", on_dirty("customer", f"""
    , v as (select value, row_number() over (order by first, value) - 1 as code from (
        select c_mktsegment as value, min(c_custkey) as first from d where c_mktsegment is not null group by c_mktsegment)),
    e as (select c_custkey, c_nationkey, c_acctbal, cast(coalesce(code, -1) as bigint) as c_mktsegment
          from d left join v on value = c_mktsegment)
    select {", ".join(_z(c).replace("from d)", "from e)") for c in [*_CUSTOMER_NUMS, "c_mktsegment"])} from e"""))
def feat_choices_label(spark, sf):
    out = flows.choose_features(dirty(spark, sf, "customer"), encoding=False, label_columns=["c_mktsegment"],
                                order_by="c_custkey")
    return rounds(out, 6, *_CUSTOMER_NUMS, "c_mktsegment")


@query("advise_features", on_dirty("lineitem", f"""
    , p as (select * from ({_ALL_PAIRS}) where abs(corr) >= 0.9)
    select 1 as section, 'low_variance' as code, 'const_one' as subject, 1.0::double as value
    union all select * from (select 2, 'correlated', col_a || '|' || col_b, {r("abs(corr)")} from p order by ord limit 3)
    union all select 3, 'use_trees', null, null where exists (select 1 from p)"""))
def advise_features(spark, sf):
    df = dirty(spark, sf, "lineitem")
    kept, dropped = encode.drop_low_variance(df)
    return rounds(rules.advise_features(df, dropped, profile.correlated_pairs(kept, 0.9)).drop("message"), 6, "value")


# ---- chart data ---------------------------------------------------------------------


@query("ch_hist", """
    with s as (select min(value) as a, (max(value) - min(value)) / 30 as w from events),
    b as (select cast(least(floor((value - a) / w), 29) as bigint) as bin, count(*) as n from events, s group by 1)
    select bin, """ + f"""{r("a + bin * w")} as lo, {r("a + (bin + 1) * w")} as hi, n from b, s""")
def ch_hist(spark, sf):
    return rounds(charts.histogram_data(table(spark, sf, "events"), "value", 30), 6, "lo", "hi")


@query("ch_hist_text", "select event_type as value, count(*) as n from events group by event_type")
def ch_hist_text(spark, sf):
    return charts.histogram_data(table(spark, sf, "events"), "event_type")


@query("ch_box", f"""
    with q as (select event_type as grp, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50,
                      quantile_cont(value, 0.75) as q75 from events group by event_type),
    f as (select *, q25 - 1.5 * (q75 - q25) as lo, q75 + 1.5 * (q75 - q25) as hi from q)
    select grp, {r("q25")} as q25, {r("q50")} as q50, {r("q75")} as q75, count(*) as n,
      {r("min(value) filter (value between lo and hi)")} as whisker_lo,
      {r("max(value) filter (value between lo and hi)")} as whisker_hi,
      count(*) filter (not (value between lo and hi)) as outliers
    from events join f on grp = event_type group by grp, q25, q50, q75""")
def ch_box(spark, sf):
    out = charts.box_data(table(spark, sf, "events"), "value", "event_type")
    return rounds(out, 6, "q25", "q50", "q75", "whisker_lo", "whisker_hi")


@query("ch_box_wide", f"""
    with q as (select l_partkey as grp, quantile_cont(l_extendedprice, 0.25) as q25, quantile_cont(l_extendedprice, 0.5) as q50,
                      quantile_cont(l_extendedprice, 0.75) as q75 from lineitem group by l_partkey),
    f as (select *, q25 - 1.5 * (q75 - q25) as lo, q75 + 1.5 * (q75 - q25) as hi from q)
    select cast(grp as varchar) as grp, {r("q25")} as q25, {r("q50")} as q50, {r("q75")} as q75, count(*) as n,
      count(*) filter (l_extendedprice < lo - 1e-6 or l_extendedprice > hi + 1e-6) as outliers
    from lineitem join f on grp = l_partkey group by grp, q25, q50, q75""")
def ch_box_wide(spark, sf):
    out = charts.box_data(table(spark, sf, "lineitem"), "l_extendedprice", "l_partkey")
    return rounds(out, 6, "q25", "q50", "q75").drop("whisker_lo", "whisker_hi")


@query("ch_bar", f"""select l_shipdate as x, {r("sum(l_extendedprice)", 2)} as total from lineitem group by l_shipdate
    """)
def ch_bar(spark, sf):
    return rounds(charts.bar_data(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice"), 2, "total")


@query("ch_line", f"""select date_trunc('day', ts)::timestamp as x, {r("avg(value)")} as y, count(*) as n
    from events group by 1""")
def ch_line(spark, sf):
    out = rounds(charts.line_data(table(spark, sf, "events"), "ts", "value", "day"), 6, "y")
    return out.withColumn("x", F.col("x").cast("timestamp_ntz"))


_HASHED = "order by md5(concat('42|', cast(o_orderkey as varchar))), o_orderkey limit 1000"


@query("ch_scatter", "select o_orderkey, o_custkey, o_totalprice from orders")
def ch_scatter(spark, sf):
    return charts.scatter_data(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("ch_scatter_sample", f"select o_orderkey, o_custkey, o_totalprice from orders {_HASHED}")
def ch_scatter_sample(spark, sf):
    return charts.scatter_data(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 1_000)


@query("ch_pair", "select o_orderkey, o_custkey, o_totalprice from orders")
def ch_pair(spark, sf):
    return charts.pair_data(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"], "o_orderkey")


@query("ch_heatmap", on_dirty("lineitem", union_all([
    f"select '{a}' as col_a, '{b}' as col_b, {r(_corr(a, b), 2)} as corr from d" for a in NUMS for b in NUMS])))
def ch_heatmap(spark, sf):
    return charts.heatmap_data(dirty(spark, sf, "lineitem"))
