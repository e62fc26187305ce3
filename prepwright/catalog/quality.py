"""Quality score, diagnosis, rule engines, reports and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepwright.catalog.registry import (
    LINEITEM_COLUMNS, LINEITEM_NUMBERS, dirty, on_dirty, query, r, rounds, table, union_all)
from prepwright.catalog.statistics import _ALL_PAIRS, _FLAGS, _MISSING, _fence, _skew
from prepwright.catalog.tables import _MODE, _other_columns
from prepwright.catalog.text import MEMBERS, PART_TEXT, with_dirty_part
from prepwright.operators import quality, rules
from prepwright.plans import flows
from prepwright.session import scratch_path
from prepwright.sinks import writers

NUMS = LINEITEM_NUMBERS
TARGET = "l_returnflag"


def _gaps(names: list[str]) -> str:
    return " + ".join(f"(count(*) - count({c}))" for c in names)


def _score(missing: str, duplicates: str, outliers: str, categories: str, source: str) -> str:
    """Score and penalties from four ratios."""
    return f"""select round(100 - missing_values - duplicates - outliers - inconsistent_categories, 2) as score,
        'Data Quality Score: ' || cast(cast(round_even(100 - missing_values - duplicates - outliers
          - inconsistent_categories, 0) as bigint) as varchar) || '/100' as label,
        missing_values, duplicates, outliers, inconsistent_categories from (
      select round(least(35.0::double, 100 * {missing}), 2) as missing_values,
        round(least(20.0::double, 100 * {duplicates}), 2) as duplicates,
        round(least(25.0::double, 100 * {outliers}), 2) as outliers,
        round(least(20.0::double, 100 * {categories}), 2) as inconsistent_categories from {source})"""


def _outliers(names: list[str]) -> str:
    return " + ".join(f"count(*) filter ({c} < {_fence(c)[0]} or {c} > {_fence(c)[1]})" for c in names)


_DUPLICATES = "(select sum(n - 1) from (select count(*) as n from d group by {})) / count(*)::double"


# Single letters are similar to none but themselves: no groups among the two text columns.
_SCORED = _score(
    f"({_gaps(LINEITEM_COLUMNS)}) / (count(*) * {len(LINEITEM_COLUMNS)})::double",
    _DUPLICATES.format(", ".join(LINEITEM_COLUMNS)),
    f"({_outliers(NUMS)}) / (count(*) * {len(NUMS)})::double", "0.0::double", "d")


@query("dq_score", on_dirty("lineitem", _SCORED))
def dq_score(spark, sf):
    return quality.quality_score(dirty(spark, sf, "lineitem"))


_PART_COLUMNS = ["p_partkey", *PART_TEXT, "p_retailprice"]


@query("dq_score_text", with_dirty_part(f"{MEMBERS} " + _score(
    f"({_gaps(_PART_COLUMNS)}) / (count(*) * {len(_PART_COLUMNS)})::double",
    _DUPLICATES.format(", ".join(_PART_COLUMNS)),
    f"({_outliers(['p_partkey', 'p_retailprice'])}) / (count(*) * 2)::double",
    "(select count(distinct leader) from member) / ({})::double".format(
        " + ".join(f"greatest(count(distinct {c}), 1)" for c in PART_TEXT)), "d")))
def dq_score_text(spark, sf):
    return quality.quality_score(dirty(spark, sf, "part"), ["p_partkey"])


# ---- diagnosis ----------------------------------------------------------------------

_CATS = [c for c in LINEITEM_COLUMNS if c not in NUMS]
_DIAGNOSIS = f"""diag as (select count(*) as n_rows, cast({len(LINEITEM_COLUMNS)} as bigint) as n_cols,
    ({_gaps(LINEITEM_COLUMNS)}) / (count(*) * {len(LINEITEM_COLUMNS)})::double as missing_ratio,
    {_DUPLICATES.format(", ".join(LINEITEM_COLUMNS))} as duplicate_ratio,
    (select max(abs(corr)) from ({_ALL_PAIRS})) as correlation_max,
    (select min(n) / max(n)::double from (select count(*) as n from d group by {TARGET})) as target_balance from d)"""

_ISSUES = """issue as (
    select 1 as rank, 'missing' as issue, case when missing_ratio > 0.2 then 'High' when missing_ratio > 0.05
      then 'Medium' else 'Low' end as severity, missing_ratio as value, 0.6 + missing_ratio as sure
      from diag where missing_ratio > 0
    union all select 2, 'duplicate', case when duplicate_ratio > 0.02 then 'Medium' else 'Low' end, duplicate_ratio,
      0.5 + duplicate_ratio * 2 from diag where duplicate_ratio > 0
    union all select 3, 'correlation', 'Medium', correlation_max, 0.55 + correlation_max / 2 from diag where correlation_max > 0.85
    union all select 4, 'class imbalance', case when target_balance < 0.2 then 'High' else 'Medium' end, target_balance,
      0.65 + (1 - target_balance) / 3 from diag where target_balance < 0.35)"""


def on_diagnosis(body: str) -> str:
    return on_dirty("lineitem", f", {_DIAGNOSIS}, {_ISSUES} {body}")


def _diagnosis(spark, sf):
    return flows.diagnosis(dirty(spark, sf, "lineitem"), TARGET)


@query("diag_analyze", on_diagnosis(f"""select n_rows, n_cols, {r("missing_ratio")} as missing_ratio,
    {r("duplicate_ratio")} as duplicate_ratio, {r("correlation_max")} as correlation_max,
    {r("target_balance")} as target_balance, '{",".join(NUMS)}' as numeric_cols, '{",".join(_CATS)}' as categorical_cols
    from diag"""))
def diag_analyze(spark, sf):
    return rounds(quality.diagnose(dirty(spark, sf, "lineitem"), TARGET), 6,
                  "missing_ratio", "duplicate_ratio", "correlation_max", "target_balance")


@query("reason_issues", on_diagnosis(f"""select rank, issue, severity, {r("value")} as value,
    {r("least(1.0, round(least(1.0, sure), 2))")} as confidence from issue"""))
def reason_issues(spark, sf):
    found = _diagnosis(spark, sf)["issues"].drop("recommendation")
    return rounds(found, 6, "value", "confidence")


_DCI = """round(least(10.0::double, least(3.0, missing_ratio * 10) + least(2.5, n_cols / 20) + least(2.5, correlation_max * 2.5)
    + coalesce(least(2.0, (1 - target_balance) * 2.0), 0.0)), 2)"""


@query("dci_score", on_diagnosis(f"""select score, case when score < 3.5 then 'Low Complexity'
    when score < 7 then 'Medium Complexity' else 'High Complexity' end as label from (select {_DCI} as score from diag)"""))
def dci_score(spark, sf):
    return _diagnosis(spark, sf)["complexity"]


_HEALTH = f"""select dimension, {r("value")} as value, case when value >= 0.8 then 'ok' when value >= 0.5 then 'warn'
    else 'error' end as status from (
    select 'Completeness' as dimension, 1 - missing_ratio as value from diag
    union all select 'Consistency', 1 - duplicate_ratio from diag
    union all select 'Redundancy', 1 - least(1.0, correlation_max) from diag
    union all select 'Balance', coalesce(target_balance, 1.0) from diag)"""


@query("health_dims", on_diagnosis(_HEALTH))
def health_dims(spark, sf):
    return rounds(_diagnosis(spark, sf)["health"], 6, "value")


_STEPS = """(values (1, 'missing', 'impute'), (2, 'duplicate', 'drop duplicates'), (3, 'correlation', 'drop correlated'),
    (4, 'class imbalance', 'stratify'), (5, null, 'encode'), (6, null, 'scale')) s(ord, issue, step)"""


@query("plan_adaptive", on_diagnosis(
    f"select ord, step from {_STEPS} where s.issue is null or s.issue in (select issue from issue)"))
def plan_adaptive(spark, sf):
    return rules.adaptive_steps(_diagnosis(spark, sf)["issues"])


@query("risk_if_ignored", on_diagnosis("""select ord, code from (values (1, 'missing'), (2, 'correlation'),
    (3, 'class imbalance'), (4, 'duplicate')) s(ord, code) where code in (select issue from issue)
    union all select 0, 'none' where not exists (select 1 from issue)"""))
def risk_if_ignored(spark, sf):
    return rules.risks_if_ignored(_diagnosis(spark, sf)["issues"]).drop("severity")


def _advised(table_name: str, target: str) -> str:
    return f"""select case when typeof(any_value({target})) = 'VARCHAR' or count(distinct {target}) < 20
        then 'classification' else 'regression' end as task, count(distinct {target}) as n from {table_name}"""


@query("advise_model", f"""with t as ({_advised("labels", "quality")}),
    m as (select * from (values ('classification', true, 1, 'Logistic Regression'),
      ('classification', true, 2, 'Random Forest Classifier'), ('classification', false, 1, 'Random Forest Classifier'),
      ('classification', false, 2, 'Gradient Boosting Classifier'), ('regression', null, 1, 'Linear Regression'),
      ('regression', null, 2, 'Random Forest Regressor')) v(task, two, rank, model))
    select t.task, case when t.task = 'classification' then n end as n_classes, rank, model
    from t join m on t.task = m.task and (two is null or two = (n = 2))""")
def advise_model(spark, sf):
    return rules.advise_models(table(spark, sf, "labels"), "quality")


@query("infer_task", union_all([f"select '{t}.{c}' as target, task from ({_advised(t, c)})" for t, c in (
    ("labels", "quality"), ("orders", "o_totalprice"), ("orders", "o_orderpriority"), ("lineitem", "l_linenumber"))]))
def infer_task(spark, sf):
    rows = [(f"{t}.{c}", quality.infer_task(table(spark, sf, t), c)) for t, c in (
        ("labels", "quality"), ("orders", "o_totalprice"), ("orders", "o_orderpriority"), ("lineitem", "l_linenumber"))]
    return spark.createDataFrame(rows, "target string, task string")


# ---- suggestions --------------------------------------------------------------------

_FACTS = f"""fact as (select count(*) as n_rows, ({_gaps(LINEITEM_COLUMNS)})::double as missing_cells,
    (select sum(n - 1)::double from (select count(*) as n from d group by {", ".join(LINEITEM_COLUMNS)})) as duplicate_rows,
    (select count(*)::double from ({_ALL_PAIRS}) where abs(corr) >= 0.85) as pairs from d)"""
_SKEWS = union_all([f"select {i} as o, '{c}' as name, {_skew(c)} as skew from d" for i, c in enumerate(NUMS)])


def on_facts(*parts: str) -> str:
    return on_dirty("lineitem", f", {_FACTS} {union_all(list(parts))}")


def _row(section: int, code: str, value: str, where: str, subject: str = "null") -> str:
    return f"""select {section} as section, '{code}' as code, cast({subject} as varchar) as subject,
        cast({value} as double) as value from fact where {where}"""


def _coded(df):
    return rounds(df.drop("message"), 6, "value")


@query("suggest_cleaning", on_facts(
    _row(1, "missing", "missing_cells", "missing_cells > 0"),
    f"""select 2, case when ratio > 0.4 then 'drop_column' else 'impute_column' end, "column", {r("ratio")} from (
        select * from ({_MISSING}) order by ratio desc, "column" limit 3) where ratio > 0.1""",
    _row(3, "duplicates", "duplicate_rows", "duplicate_rows > 0"),
    f"select * from (select 4, 'skewed', name, {r('abs(skew)')} from ({_SKEWS}) where abs(skew) > 1 order by o limit 1)",
    _row(5, "check_outliers", "null", "true"), _row(6, "review_text", "null", "true")))
def suggest_cleaning(spark, sf):
    return _coded(rules.suggest_cleaning(dirty(spark, sf, "lineitem")))


@query("suggest_prep", on_facts(
    _row(1, "missing", "missing_cells", "missing_cells > 0"), _row(2, "duplicates", "duplicate_rows", "duplicate_rows > 0"),
    _row(3, "categorical", str(len(_CATS)), "true"), _row(4, "numeric", str(len(NUMS)), "true"),
    _row(5, "correlated", "pairs", "pairs > 0"), _row(7, "classification", "null", "true", f"'{TARGET}'")))
def suggest_prep(spark, sf):
    return _coded(rules.suggest_preparation(dirty(spark, sf, "lineitem"), TARGET))


@query("insight_simple", on_facts(
    _row(1, "missing", "missing_cells", "missing_cells > 0"), _row(2, "duplicates", "duplicate_rows", "duplicate_rows > 0"),
    _row(3, "correlated", "pairs", "pairs > 0"), _row(4, "categorical", str(len(_CATS)), "true")))
def insight_simple(spark, sf):
    return _coded(rules.simple_insights(dirty(spark, sf, "lineitem")))


@query("insight_data", on_facts(
    f"""select 1 as section, 'missing' as code, "column" as subject, {r("ratio")} as value from ({_MISSING}) where ratio >= 0.2""",
    f"select 2, 'skewed', name, {r('skew')} from ({_SKEWS}) where abs(skew) > 1",
    f"""select * from (select 3, 'correlated', col_a || '|' || col_b, {r("corr")} from ({_ALL_PAIRS})
        where abs(corr) >= 0.85 order by ord limit 1)""",
    _row(4, "more_pairs", "null", "pairs >= 1"), _row(5, "normalized", "0", "true", f"'{TARGET}'")))
def insight_data(spark, sf):
    return _coded(rules.data_insights(dirty(spark, sf, "lineitem"), normalized=[TARGET], max_pairs=1))


@query("residual_risks", on_facts(
    _row(1, "missing", "missing_cells", "missing_cells > 0"), _row(2, "correlated", "pairs", "pairs > 0"),
    _row(3, "many_columns", str(len(LINEITEM_COLUMNS)), str(len(LINEITEM_COLUMNS) > 10).lower())))
def residual_risks(spark, sf):
    return _coded(rules.residual_risks(dirty(spark, sf, "lineitem"), max_columns=10))


@query("explore_notes", on_facts(
    _row(1, "correlated", "pairs", "pairs > 0"), _row(2, "categorical", str(len(_CATS)), "true")))
def explore_notes(spark, sf):
    return _coded(rules.exploration_notes(dirty(spark, sf, "lineitem")))


# ---- reports and whole flows --------------------------------------------------------


_REPORT = on_diagnosis(f""", score as ({_SCORED})
    select 'summary' as part, 'rows' as name, null as status, n_rows::double as value from diag
    union all select 'summary', 'columns', null, n_cols::double from diag
    union all select 'complexity', 'score', case when v < 3.5 then 'Low Complexity' when v < 7 then 'Medium Complexity'
      else 'High Complexity' end, v from (select {_DCI} as v from diag)
    union all select 'health', 'score', label, score from score
    union all select 'health', 'missing_values', null, missing_values from score
    union all select 'health', 'duplicates', null, duplicates from score
    union all select 'health', 'outliers', null, outliers from score
    union all select 'health', 'inconsistent_categories', null, inconsistent_categories from score
    union all select 'issue', issue, severity, {r("value")} from issue""")


def _unpacked(report):
    """Each value of a report as a row (part, name, status, value)."""
    def one(part, name, status, value):
        return F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), (F.col(status) if status else F.lit(None)).cast("string").alias("status"),
                        F.col(value).cast("double").alias("value"))
    parts = [one("summary", "rows", None, "dataset_summary.rows"), one("summary", "columns", None, "dataset_summary.columns"),
             one("complexity", "score", "dataset_complexity_index.label", "dataset_complexity_index.score"),
             one("health", "score", "data_health.label", "data_health.score")]
    parts += [one("health", c, None, f"data_health.{c}") for c in ("missing_values", "duplicates", "outliers", "inconsistent_categories")]
    issues = F.transform("issues", lambda i: F.struct(F.lit("issue").alias("part"), i["issue"].alias("name"), i["severity"].alias("status"),
                                                      i["value"].alias("value")))
    return rounds(report.select(F.inline(F.concat(F.array(*parts), issues))), 6, "value")


@query("report_full", _REPORT)
def report_full(spark, sf):
    full = flows.report(dirty(spark, sf, "lineitem"), TARGET)
    return _unpacked(flows.report_json(full).select(F.from_json("report", full.schema).alias("r")).select("r.*"))


@query("snk_json_report", _REPORT)
def snk_json_report(spark, sf):
    full, path = flows.report(dirty(spark, sf, "lineitem"), TARGET), scratch_path(spark, "report")
    writers.write_json_report(full, path)
    return _unpacked(spark.read.schema(full.schema).json(path))


_CLEANED = f"""
    select distinct {_other_columns("l_quantity", "l_discount", "l_returnflag")},
      {r("coalesce(l_quantity, (select quantile_cont(l_quantity, 0.5) from d))")} as l_quantity,
      {r("coalesce(l_discount, (select quantile_cont(l_discount, 0.5) from d))")} as l_discount,
      coalesce(l_returnflag, {_MODE.format(c="l_returnflag")}) as l_returnflag from d"""


@query("pipe_auto_prepare", on_dirty("lineitem", f""", c as ({_CLEANED})
    select {", ".join("0.0::double as const_one" if c == "const_one" else
                      f'''{r(f"({c} - (select avg({c}) from c)) / (select stddev_pop({c}) from c)")} as {c}''' for c in NUMS)},
      {", ".join(f"l_returnflag = '{v}' as l_returnflag_{v}" for v in _FLAGS)},
      {", ".join(f"l_linestatus = '{v}' as l_linestatus_{v}" for v in ("F", "O"))}, l_shipdate from c"""))
def pipe_auto_prepare(spark, sf):
    return rounds(flows.auto_prepare(dirty(spark, sf, "lineitem"))[2], 6, *NUMS)


@query("pipe_auto_prepare_text", with_dirty_part(f"""{MEMBERS}
    select distinct p_partkey, coalesce(m.suggested, p_name) as p_name, coalesce(b.suggested, p_brand) as p_brand,
      try_cast(size_text as double) as size_text, coalesce(x.suggested, mixed_text) as mixed_text,
      try_strptime(date_text, '%Y-%m-%d') as date_text, p_retailprice
    from d left join member m on m.grp = 'p_name' and m.value = trim(p_name)
      left join member b on b.grp = 'p_brand' and b.value = p_brand
      left join member x on x.grp = 'mixed_text' and x.value = mixed_text"""))
def pipe_auto_prepare_text(spark, sf):
    return flows.auto_prepare(dirty(spark, sf, "part"), ["p_partkey"])[1]


def _place(c: str) -> str:
    return f"""(select count(distinct {c}) from c) as {c}_size,
      case when {c} is not null then dense_rank() over (order by {c} nulls last) - 1 end as {c}_index"""


def _unit(c: str) -> str:
    return f"""{r(f"({c} - (select avg({c}) from c)) / (select stddev_pop({c}) from c)")} as {c}"""


@query("pipe_auto_prepare_engineered", with_dirty_part(f"""{MEMBERS},
    c as materialized (
      select distinct p_partkey, coalesce(m.suggested, p_name) as p_name, coalesce(b.suggested, p_brand) as p_brand,
        try_cast(size_text as double) as size_text, coalesce(x.suggested, mixed_text) as mixed_text,
        try_strptime(date_text, '%Y-%m-%d') as date_text, p_retailprice
      from d left join member m on m.grp = 'p_name' and m.value = trim(p_name)
        left join member b on b.grp = 'p_brand' and b.value = p_brand
        left join member x on x.grp = 'mixed_text' and x.value = mixed_text)
    select {", ".join(map(_unit, ("p_partkey", "size_text", "p_retailprice")))},
      {", ".join(map(_place, ("p_name", "p_brand", "mixed_text")))}, date_text from c"""))
def pipe_auto_prepare_engineered(spark, sf):
    """The last stage: values of text columns as places, numbers scaled."""
    texts = ["p_name", "p_brand", "mixed_text"]
    out = flows.auto_prepare(dirty(spark, sf, "part"), ["p_partkey"], sparse=texts)[2]
    out = out.withColumns({f"{c}_{f}": F.col(c)[f] for c in texts for f in ("size", "index")}).drop(*texts)
    return rounds(out, 6, "p_partkey", "size_text", "p_retailprice")


@query("pipe_diagnose", on_diagnosis(f"""
    select 'issue' as part, issue as name, severity as status, {r("value")} as value from issue
    union all select 'health', dimension, status, value from ({_HEALTH})
    union all select 'complexity', 'index', null, {_DCI} + 0.0 from diag"""))
def pipe_diagnose(spark, sf):
    out = _diagnosis(spark, sf)
    parts = out["issues"].select(F.lit("issue").alias("part"), F.col("issue").alias("name"),
                                 F.col("severity").alias("status"), "value")
    parts = parts.unionByName(out["health"].select(F.lit("health").alias("part"), F.col("dimension").alias("name"),
                                                   "status", "value"))
    parts = parts.unionByName(out["complexity"].select(
        F.lit("complexity").alias("part"), F.lit("index").alias("name"), F.lit(None).cast("string").alias("status"),
        F.col("score").alias("value")))
    return rounds(parts, 6, "value")


@query("pipe_report", on_dirty("customer", "select count(*) as csv_rows, 4::bigint as csv_columns, 1::bigint as reports from d"))
def pipe_report(spark, sf):
    df = dirty(spark, sf, "customer")
    report_path, csv_path = scratch_path(spark, "report"), scratch_path(spark, "csv")
    writers.write_json_report(flows.report(df, "c_mktsegment", order_by=["c_custkey"]), report_path)
    writers.write_csv(df, csv_path)
    back = spark.read.option("header", True).csv(csv_path)
    reports = spark.read.json(report_path).agg(F.count("*").alias("reports"))
    counted = back.agg(F.count("*").alias("csv_rows"), F.lit(len(back.columns)).cast("long").alias("csv_columns"))
    out = quality.side_by_side([counted, reports])
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])
