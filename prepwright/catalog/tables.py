"""Sources, sinks, projections, filters, imputation, deduplication and casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.catalog.registry import (
    LINEITEM_COLUMNS, LINEITEM_NUMBERS, dirty, on_dirty, query, r, rounds, table, union_all)
from prepwright.operators import casting, columns, dedupe, fuzzy, impute, profile, sampling
from prepwright.plans import flows
from prepwright.session import scratch_path
from prepwright.sinks import writers
from prepwright.sources import readers

# ---- sources ------------------------------------------------------------------------


@query("src_csv", on_dirty("part", """
    select p_partkey, p_name, p_brand, case when size_text = 'n/a' then null else cast(size_text as double) end as size_text,
           mixed_text, date_text, p_retailprice from d"""))
def src_csv(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(dirty(spark, sf, "part"), path)
    return readers.read_csv(spark, path)


_BREAKS = """
    select p_partkey, cast(p_size as bigint) as p_size, case when p_partkey % 3 = 0 then translate(p_name, ' ', '{n}')
      when p_partkey % 3 = 1 then concat('"', p_name, '", {n}{n}said') else p_name end as p_name from {part}"""


@query("src_csv_breaks", _BREAKS.replace("{n}", "\n").format(part="part"))
def src_csv_breaks(spark, sf):
    """Names with line breaks and quotes, written and read again."""
    path = f"{scratch_path(spark, 'breaks')}.csv"
    writers.write_csv(spark.sql(_BREAKS.replace("{n}", "\n"), part=table(spark, sf, "part")), path)
    return readers.load(spark, path)


@query("src_parquet", "select * from orders")
def src_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/orders.parquet")


@query("src_limit", "select * from orders order by o_orderkey limit 1000")
def src_limit(spark, sf):
    return readers.load(spark, f"{sf}/orders.parquet", limit=1000, order_by=["o_orderkey"])


@query("src_sample", """
    select * from orders order by md5(concat('42|', cast(o_orderkey as varchar))), o_orderkey limit 500""")
def src_sample(spark, sf):
    return readers.load(spark, f"{sf}/orders.parquet", sample_n=500, key="o_orderkey")


_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
           "conversations").split()


@query("src_validate", union_all([f"select '{t}.parquet' as name, true as is_valid, count(*) as n_rows from {t}" for t in _TABLES]))
def src_validate(spark, sf):
    parts = []
    for t in _TABLES:
        path = f"{sf}/{t}.parquet"
        checked = readers.validate_files(spark, path, max_mb=1 << 20, extensions=["parquet"])
        parts.append(checked.agg(F.every("is_valid").alias("is_valid")).select(F.lit(f"{t}.parquet").alias("name"), "is_valid", F.lit(None).cast("long").alias("n_rows")).unionByName(
            readers.file_rows(spark, path).agg(F.sum("n_rows").alias("n_rows")).select(F.lit(f"{t}.parquet").alias("name"), F.lit(True).alias("is_valid"), "n_rows")))
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.every("is_valid").alias("is_valid"), F.max("n_rows").alias("n_rows"))


@query("src_fingerprint", """
    select count(*) as n_rows, cast(sum(cast(('0x' || substr(md5(concat_ws(chr(31), doc_id, coalesce(text, chr(0)), coalesce(lang, chr(0)),
      coalesce(source, chr(0)), n_chars)), 1, 15)) as hugeint)) as varchar) as fingerprint from documents""")
def src_fingerprint(spark, sf):
    return readers.table_fingerprint(table(spark, sf, "documents"))


@query("src_sanitize_names", "select c_custkey as cust_key, c_name as cust_name, c_acctbal as acct_bal from customer")
def src_sanitize_names(spark, sf):
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" cust key"), F.col("c_name").alias("cust name "), F.col("c_acctbal").alias("acct bal"))
    return columns.sanitize_names(df)


def _gap_count(names: list[str]) -> str:
    return " + ".join(f"(count(*) - count({c}))" for c in names)


@query("src_overview", on_dirty("lineitem", f"""
    select count(*) as n_rows, cast({len(LINEITEM_COLUMNS)} as bigint) as n_cols,
           cast({_gap_count(LINEITEM_COLUMNS)} as bigint) as missing_cells,
           cast({" + ".join(f"(case when count({c}) < count(*) then 1 else 0 end)" for c in LINEITEM_COLUMNS)} as bigint)
             as missing_columns from d"""))
def src_overview(spark, sf):
    return profile.overview(dirty(spark, sf, "lineitem"))


@query("src_preview", "select * from orders order by o_orderkey limit 20")
def src_preview(spark, sf):
    return sampling.first_rows(table(spark, sf, "orders"), 20, ["o_orderkey"])


# ---- sinks --------------------------------------------------------------------------


@query("snk_csv", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def snk_csv(spark, sf):
    df, path = table(spark, sf, "customer"), scratch_path(spark, "csv")
    writers.write_csv(df, path)
    return spark.read.option("header", True).schema(df.schema).csv(path)


@query("snk_parquet", on_dirty("customer", "select * from d"))
def snk_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    writers.write_parquet(dirty(spark, sf, "customer"), path)
    return spark.read.parquet(path)


@query("snk_object_store", "select * from supplier")
def snk_object_store(spark, sf):
    path = scratch_path(spark, "objects")
    writers.write_object(table(spark, sf, "supplier"), path)
    return spark.read.parquet(path)


_BI_TYPES = """case typeof({c}) when 'BIGINT' then '{i}' when 'INTEGER' then '{i}' when 'DOUBLE' then '{d}'
    when 'TIMESTAMP' then '{t}' else '{s}' end"""
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("snk_bi_schema", "with one as (select * from orders limit 1) " + union_all([
    f"""select '{c}' as "column", {_BI_TYPES.format(c=c, i='Int64', d='Double', t='DateTime', s='string')} as push_type,
        {_BI_TYPES.format(c=c, i='big_int', d='double', t='timestamp', s='text')} as extract_type from one"""
    for c in _ORDER_COLUMNS]))
def snk_bi_schema(spark, sf):
    return writers.bi_schema(table(spark, sf, "orders"))


@query("snk_push_batches", """
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, true as bounded from orders""")
def snk_push_batches(spark, sf):
    batches = writers.push_batches(table(spark, sf, "orders").drop("o_orderdate"), 500)
    schema = "rows array<struct<o_orderkey: long, o_custkey: long, o_orderstatus: string, o_totalprice: double, o_orderpriority: string>>"
    # A payload is checked once, before its rows part; behind them it would be read again for every one.
    sent = batches.select("n", F.from_json("payload", schema)["rows"].alias("sent")).select(
        ((F.col("n") <= 500) & (F.size("sent") == F.col("n"))).alias("bounded"), "sent")
    return sent.select("bounded", F.inline("sent"))


# ---- projections --------------------------------------------------------------------


@query("prj_drop", "select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders")
def prj_drop(spark, sf):
    return columns.drop_columns(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "no_such_column"])


@query("prj_rename", """select o_orderkey as order_id, o_custkey, o_orderstatus as status, o_totalprice, o_orderdate,
    o_orderpriority from orders""")
def prj_rename(spark, sf):
    return columns.rename_columns(table(spark, sf, "orders"),
                                  {"o_orderkey": "order_id", "o_orderstatus": "status", "no_such_column": "x"})


@query("prj_map_values", on_dirty("customer", """
    select c_custkey, c_nationkey, c_acctbal, case c_mktsegment when 'BUILDING' then 'MACHINERY'
      when 'MACHINERY' then 'Machines' when 'HOUSEHOLD' then 'Home' else c_mktsegment end as c_mktsegment from d"""))
def prj_map_values(spark, sf):
    return columns.map_values(dirty(spark, sf, "customer"), {
        "c_mktsegment": {"BUILDING": "MACHINERY", "MACHINERY": "Machines", "HOUSEHOLD": "Home"}, "no_such": {"a": "b"}})


@query("prj_map_values_wide", """
    select o_orderkey, case when o_custkey between 1 and 400 then cast(-o_custkey as varchar) || 'x'
      when o_custkey = 401 then null else cast(o_custkey as varchar) end as o_custkey from orders""")
def prj_map_values_wide(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return columns.map_values(df, {"o_custkey": {**{k: f"-{k}x" for k in range(1, 401)}, 401: None, "402": "no such key"}})


@query("prj_drop_correlated", on_dirty("lineitem", f"""
    select {", ".join(c for c in LINEITEM_COLUMNS if c != "price_twice")} from d"""))
def prj_drop_correlated(spark, sf):
    return columns.drop_correlated(dirty(spark, sf, "lineitem"), 0.9)


# ---- filters ------------------------------------------------------------------------

_FILTERS = {
    "flt_eq": ("l_quantity", "==", "24", "l_quantity = 24"),
    "flt_ne": ("l_returnflag", "!=", "A", "l_returnflag is distinct from 'A'"),
    "flt_gt": ("l_extendedprice", ">", "50000.5", "l_extendedprice > 50000.5::double"),
    "flt_lt": ("l_quantity", "<", "10", "l_quantity < 10"),
    "flt_ge": ("l_discount", ">=", "0.05", "l_discount >= 0.05::double"),
    "flt_le": ("l_tax", "<=", "0.02", "l_tax <= 0.02::double"),
    "flt_contains": ("l_returnflag", "contains", "^[AN]$", "regexp_matches(l_returnflag, '^[AN]$')"),
}


def _register_filter(key: str, column: str, operator: str, value: str, where: str) -> None:
    @query(key, on_dirty("lineitem", f"select * from d where {where}"))
    def run(spark, sf):
        return columns.filter_rows(dirty(spark, sf, "lineitem"), column, operator, value)


for _key, _spec in _FILTERS.items():
    _register_filter(_key, *_spec)


_LARGE = 9007199254740992   # 2 ** 53


@query("flt_eq_large", f"select o_orderkey + {_LARGE}::bigint as id, o_custkey from orders where o_orderkey = 33")
def flt_eq_large(spark, sf):
    df = table(spark, sf, "orders").select((F.col("o_orderkey") + F.lit(_LARGE)).alias("id"), "o_custkey")
    return columns.filter_rows(df, "id", "==", str(_LARGE + 33))


@query("flt_ge_nan", on_dirty("lineitem", "select * from d where l_quantity >= 25.5"))
def flt_ge_nan(spark, sf):
    df = dirty(spark, sf, "lineitem")
    gap = F.when(F.col("l_partkey") % 2 == 0, F.lit(float("nan")))
    return columns.filter_rows(df.withColumn("l_quantity", F.coalesce("l_quantity", gap)), "l_quantity", ">=", "25.5")


@query("flt_drop_missing", on_dirty("lineitem", """
    select * from d where l_quantity is not null and l_discount is not null and l_returnflag is not null"""))
def flt_drop_missing(spark, sf):
    return columns.drop_missing(dirty(spark, sf, "lineitem"), "any")


@query("flt_drop_missing_subset", on_dirty("lineitem", "select * from d where l_discount is not null"))
def flt_drop_missing_subset(spark, sf):
    return columns.drop_missing(dirty(spark, sf, "lineitem"), "any", ["l_discount"])


@query("flt_outlier_iqr_rows", on_dirty("lineitem", """
    , q as (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from d)
    select d.* from d, q where l_extendedprice < q1 - 1.5 * (q3 - q1) or l_extendedprice > q3 + 1.5 * (q3 - q1)"""))
def flt_outlier_iqr_rows(spark, sf):
    return columns.iqr_outlier_rows(dirty(spark, sf, "lineitem"), "l_extendedprice")


@query("flt_outlier_zscore_rows", on_dirty("lineitem", """
    select * from d where abs((l_extendedprice - (select avg(l_extendedprice) from d))
                              / (select stddev_pop(l_extendedprice) from d)) > 3"""))
def flt_outlier_zscore_rows(spark, sf):
    return columns.zscore_outlier_rows(dirty(spark, sf, "lineitem"), "l_extendedprice")


# ---- imputation ---------------------------------------------------------------------

# Most frequent value, smallest on ties.
_MODE = "(select {c} from d where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


def _filled(value: str, segment: str | None = _MODE.format(c="c_mktsegment")) -> str:
    text = f"coalesce(c_mktsegment, {segment})" if segment else "c_mktsegment"
    return on_dirty("customer", f"""select c_custkey, c_nationkey, {r(f"coalesce(c_acctbal, {value})")} as c_acctbal,
        {text} as c_mktsegment from d""")


_MEAN, _MEDIAN = "(select avg(c_acctbal) from d)", "(select quantile_cont(c_acctbal, 0.5) from d)"


@query("imp_mean", _filled(_MEAN))
def imp_mean(spark, sf):
    return rounds(impute.impute(dirty(spark, sf, "customer"), "mean"), 6, "c_acctbal")


@query("imp_mean_skip_text", _filled(_MEAN, None))
def imp_mean_skip_text(spark, sf):
    return rounds(impute.impute(dirty(spark, sf, "customer"), "mean", text="skip"), 6, "c_acctbal")


@query("imp_median", _filled(_MEDIAN))
def imp_median(spark, sf):
    return rounds(impute.impute(dirty(spark, sf, "customer"), "median"), 6, "c_acctbal")


@query("imp_mode", _filled(_MODE.format(c="c_acctbal")))
def imp_mode(spark, sf):
    return rounds(impute.impute(dirty(spark, sf, "customer"), "mode"), 6, "c_acctbal")


@query("imp_custom", on_dirty("customer", """select c_custkey, c_nationkey, coalesce(c_acctbal, -1.5) as c_acctbal,
    coalesce(c_mktsegment, 'OTHER') as c_mktsegment from d"""))
def imp_custom(spark, sf):
    return impute.impute_custom(dirty(spark, sf, "customer"), {"c_acctbal": -1.5, "c_mktsegment": "OTHER"})


def _other_columns(*changed: str) -> str:
    return ", ".join(c for c in LINEITEM_COLUMNS if c not in changed)


@query("imp_per_column", on_dirty("lineitem", f"""
    select distinct {_other_columns("l_quantity", "l_discount", "l_returnflag", "l_tax")},
      {r("coalesce(l_quantity, (select avg(l_quantity) from d))")} as l_quantity,
      {r("coalesce(l_discount, (select quantile_cont(l_discount, 0.5) from d))")} as l_discount,
      coalesce(l_returnflag, {_MODE.format(c="l_returnflag")}) as l_returnflag from d"""))
def imp_per_column(spark, sf):
    return rounds(flows.clean(dirty(spark, sf, "lineitem"), {
        "l_quantity": "Mean", "l_discount": "Median", "l_returnflag": "Mean", "l_tax": "Drop",
        "l_linestatus": "None", "no_such": "Mean"}), 6, "l_quantity", "l_discount")


@query("imp_selected", on_dirty("lineitem", f"""
    select {_other_columns("l_discount", "l_returnflag")},
      {r("coalesce(l_discount, (select quantile_cont(l_discount, 0.5) from d))")} as l_discount,
      coalesce(l_returnflag, {_MODE.format(c="l_returnflag")}) as l_returnflag from d"""))
def imp_selected(spark, sf):
    return rounds(flows.clean_selected(dirty(spark, sf, "lineitem"), ["l_discount", "l_returnflag"], "median"),
                  6, "l_discount")


@query("imp_adaptive", on_dirty("lineitem", f"""
    select distinct {_other_columns("l_quantity", "l_discount", "l_returnflag")},
      {r("coalesce(l_quantity, (select quantile_cont(l_quantity, 0.5) from d))")} as l_quantity,
      {r("coalesce(l_discount, (select quantile_cont(l_discount, 0.5) from d))")} as l_discount,
      coalesce(l_returnflag, {_MODE.format(c="l_returnflag")}) as l_returnflag from d"""))
def imp_adaptive(spark, sf):
    return rounds(flows.adaptive_clean(dirty(spark, sf, "lineitem")), 6, "l_quantity", "l_discount")


_NESTED = """select c_custkey, case when c_custkey % 3 = 0 then null else c_acctbal end as c_acctbal,
    case when c_custkey % 4 = 0 then null else c_mktsegment end as c_mktsegment,
    case when c_custkey % 5 = 0 then null else [array] end as pair from {customer}"""


@query("imp_adaptive_nested", f"""
    with d as ({_NESTED.replace("[array]", "c_mktsegment || '|' || c_name").format(customer="customer")})
    select c_custkey, {r("coalesce(c_acctbal, (select quantile_cont(c_acctbal, 0.5) from d))")} as c_acctbal,
           coalesce(c_mktsegment, {_MODE.format(c="c_mktsegment")}) as c_mktsegment, pair from d""")
def imp_adaptive_nested(spark, sf):
    df = spark.sql(_NESTED.replace("[array]", "array(c_mktsegment, c_name)"), customer=table(spark, sf, "customer"))
    filled = rounds(impute.impute_adaptive(df), 6, "c_acctbal")
    return filled.withColumn("pair", F.array_join("pair", "|"))


# ---- deduplication ------------------------------------------------------------------


@query("dd_exact", on_dirty("lineitem", "select distinct * from d"))
def dd_exact(spark, sf):
    return dedupe.drop_exact(dirty(spark, sf, "lineitem"))


_FIRST_ORDER = ["l_orderkey", "l_linenumber"] + [
    c for c in LINEITEM_COLUMNS if c not in ("l_orderkey", "l_linenumber")]


@query("dd_subset", on_dirty("lineitem", f"""
    select {", ".join(LINEITEM_COLUMNS)} from (select *, row_number() over (partition by l_partkey
      order by {", ".join(f"{c} nulls first" for c in _FIRST_ORDER)}) as rn from d) where rn = 1"""))
def dd_subset(spark, sf):
    return dedupe.keep_first(dirty(spark, sf, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("dd_count", on_dirty("lineitem", f"""
    , g as (select count(*) as n from d group by {", ".join(LINEITEM_COLUMNS)})
    select cast(sum(n) as bigint) as n_rows, cast(sum(n - 1) as bigint) as duplicate_rows,
           {r("sum(n - 1) / sum(n)::double")} as duplicate_ratio from g"""))
def dd_count(spark, sf):
    return rounds(profile.duplicate_counts(dirty(spark, sf, "lineitem")), 6, "duplicate_ratio")


# ---- casts --------------------------------------------------------------------------

_PART_REST = "p_partkey, p_name, p_brand"


@query("cast_numeric", on_dirty("part", f"""select {_PART_REST}, try_cast(size_text as double) as size_text,
    try_cast(mixed_text as double) as mixed_text, date_text, p_retailprice from d"""))
def cast_numeric(spark, sf):
    return casting.convert_types(dirty(spark, sf, "part"), {"size_text": "numeric", "mixed_text": "numeric", "no_such": "numeric"})


@query("cast_datetime", on_dirty("part", f"""select {_PART_REST}, size_text, mixed_text,
    try_strptime(date_text, '%Y-%m-%d') as date_text, p_retailprice from d"""))
def cast_datetime(spark, sf):
    return casting.cast_datetime(dirty(spark, sf, "part"), "date_text")


@query("cast_datetime_single_format", on_dirty("part", f"""select {_PART_REST}, size_text, mixed_text,
    try_strptime(date_text, '%Y-%m-%d') as date_text, p_retailprice from d"""))
def cast_datetime_single_format(spark, sf):
    return casting.cast_datetime(dirty(spark, sf, "part"), "date_text", single_format=True)


@query("cast_text", on_dirty("part", f"""select cast(p_partkey as varchar) as p_partkey, p_name, p_brand, size_text,
    mixed_text, date_text, p_retailprice from d"""))
def cast_text(spark, sf):
    return casting.convert_column(dirty(spark, sf, "part"), "p_partkey", "string")


@query("cast_category", on_dirty("customer", """
    , v as (select c_mktsegment as value, row_number() over (order by c_mktsegment) - 1 as code from (
        select distinct c_mktsegment from d where c_mktsegment is not null))
    select d.*, cast(coalesce(code, -1) as bigint) as c_mktsegment_code from d left join v on value = c_mktsegment"""))
def cast_category(spark, sf):
    return casting.convert_column(dirty(spark, sf, "customer"), "c_mktsegment", "category")


_FORMS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss.SSS", "M/d/yyyy HH:mm", "MMM d, yyyy", "dd-MMM-yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm"]


@query("cast_datetime_free", """
    select o_orderkey, case o_orderkey % 7 when 0 then date_trunc('second', t) when 1 then date_trunc('millisecond', t)
      when 2 then date_trunc('minute', t) when 6 then date_trunc('minute', t) else date_trunc('day', t)::timestamp end as at
    from (select o_orderkey, o_orderdate + to_milliseconds(o_orderkey * 86413) as t from orders)""")
def cast_datetime_free(spark, sf):
    at = F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, 0, cast(o_orderkey * 86413 as decimal(18,6)) / 1000)")
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 7 == i, F.date_format("t", form)) for i, form in enumerate(_FORMS)])
    df = table(spark, sf, "orders").select("o_orderkey", at.alias("t")).select("o_orderkey", text.alias("at"))
    return casting.cast_datetime(df, "at")


@query("dd_exact_nan", on_dirty("customer", "select distinct c_nationkey % 3 as k, c_acctbal is null as gap, null::double as x from d"))
def dd_exact_nan(spark, sf):
    x = F.when(F.col("c_custkey") % 2 == 0, F.lit(float("nan")))
    df = dirty(spark, sf, "customer").select((F.col("c_nationkey") % 3).alias("k"), F.col("c_acctbal").isNull().alias("gap"), x.alias("x"))
    return dedupe.drop_exact(df)


@query("fix_types", on_dirty("part", f"""select {_PART_REST}, try_cast(size_text as double) as size_text, mixed_text,
    try_strptime(date_text, '%Y-%m-%d') as date_text, p_retailprice from d"""))
def fix_types(spark, sf):
    return casting.fix_types(dirty(spark, sf, "part"))
