"""Registered queries over the given tables, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepwright.functions.numbers import rounded
from prepwright.kinds import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The given tables have no missing values and no repeated rows. These selects put some in,
# the same way on both sides; they are valid in Spark SQL and in the oracle's SQL.
DIRT = {
    "lineitem": """
      with base as (
        select l_orderkey, l_partkey, l_suppkey, l_linenumber,
               case when (l_orderkey + l_linenumber) % 10 = 0 then null else l_quantity end as l_quantity,
               case when l_partkey % 97 = 0 then l_extendedprice * 100 else l_extendedprice end as l_extendedprice,
               case when l_suppkey % 4 = 0 then null else l_discount end as l_discount,
               l_tax,
               (case when l_partkey % 97 = 0 then l_extendedprice * 100 else l_extendedprice end) * 2 + l_tax as price_twice,
               cast(1 as double) as const_one,
               case when l_orderkey % 25 = 0 then null else l_returnflag end as l_returnflag,
               l_linestatus, l_shipdate
        from {lineitem})
      select * from base union all select * from base where l_orderkey % 50 = 0""",
    "part": """
      select p_partkey,
             case p_partkey % 4 when 0 then p_name when 1 then upper(p_name)
                  when 2 then replace(p_name, ' ', '-') else concat(' ', p_name, ' ') end as p_name,
             p_brand,
             case when p_partkey % 20 = 0 then 'n/a' else cast(p_size as varchar(20)) end as size_text,
             case when p_partkey % 5 = 0 then 'x' else cast(p_size as varchar(20)) end as mixed_text,
             case when p_partkey % 20 = 7 then 'unknown'
                  else concat('2024-01-', lpad(cast(1 + p_partkey % 28 as varchar(20)), 2, '0')) end as date_text,
             p_retailprice
      from {part}""",
    "customer": """
      select c_custkey, c_nationkey,
             case when c_custkey % 3 = 0 then null else c_acctbal end as c_acctbal,
             case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment
      from {customer}""",
}


def dirty(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.sql(DIRT[name], **{name: table(spark, sf, name)})


def on_dirty(name: str, body: str) -> str:
    """Oracle SQL with the dirty table as ``d``."""
    return f"with d as ({DIRT[name].format(**{name: name})}) {body}"


def rounds(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: rounded(col(c), digits) for c in names})


def r(expr: str, digits: int = 6) -> str:
    """Oracle twin of ``rounds``."""
    return f"round({expr}, {digits}) + 0.0"


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in that order."""
    return df.select(*[F.col(c) for c in names])


LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "price_twice", "const_one"]
LINEITEM_COLUMNS = LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"]


def union_all(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def significant(df: DataFrame, *names: str) -> DataFrame:
    """Nine significant digits, for values of any magnitude."""
    return df.withColumns({c: F.when(col(c).isNotNull(), F.format_string("%.8e", rounded(col(c), 6)).cast("double"))
                           + F.lit(0.0) for c in names})


def sig(expr: str) -> str:
    """Oracle twin of ``significant``."""
    return f"cast(format('{{:.8e}}', round({expr}, 6) + 0.0::double) as double) + 0.0"
