"""Splits, models, evaluation, uncertainty and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepwright.catalog.registry import plain, query, r, rounds, sig, significant, table, union_all
from prepwright.models import bayes, evaluate, explain, training
from prepwright.operators import rules, sampling

def _classes(spark, sf):
    """Label quality from the other columns of the labels and the shape of their documents."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id")


def _parts(spark, sf):
    return table(spark, sf, "part")


# ---- splits -------------------------------------------------------------------------


@query("ml_split", """
    select doc_id, quality, toxic, row_number() over (partition by quality
        order by md5(concat('42|', cast(doc_id as varchar))), doc_id)
      <= ceil(round(count(*) over (partition by quality) * 0.2, 9)) as is_test from labels""")
def ml_split(spark, sf):
    return sampling.stratified_split(table(spark, sf, "labels"), "quality", "doc_id")


@query("ml_split_flags", """
    select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus
        order by md5(concat('7|', cast(o_orderkey as varchar))), o_orderkey)
      <= ceil(round(count(*) over (partition by o_orderstatus) * 0.25, 9)) as is_test from orders""")
def ml_split_flags(spark, sf):
    df = plain(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus")
    return sampling.stratified_split(df, "o_orderstatus", "o_orderkey", 0.25, 7)


@query("ml_split_regression", """
    select o_orderkey, o_totalprice, row_number() over (order by md5(concat('42|', cast(o_orderkey as varchar))), o_orderkey)
      <= ceil(round(count(*) over () * 0.2, 9)) as is_test from orders""")
def ml_split_regression(spark, sf):
    return sampling.random_split(plain(table(spark, sf, "orders"), "o_orderkey", "o_totalprice"), "o_orderkey")


# ---- models -------------------------------------------------------------------------


@query("ml_select")
def ml_select(spark, sf):
    return training.select_model(_classes(spark, sf), "quality", "doc_id")[0]


@query("ml_select_regression")
def ml_select_regression(spark, sf):
    return training.select_model(_parts(spark, sf), "p_retailprice", "p_partkey")[0]


@query("ml_select_multiclass")
def ml_select_multiclass(spark, sf):
    return training.select_model(table(spark, sf, "customer"), "c_mktsegment", "c_custkey")[0]


@query("ml_train_one")
def ml_train_one(spark, sf):
    return training.train_one(_parts(spark, sf), "p_retailprice", "p_partkey", "Random Forest")[0]


@query("ml_baseline")
def ml_baseline(spark, sf):
    return training.baseline(_parts(spark, sf), "p_retailprice", "p_partkey")[0].unionByName(
        training.baseline(_classes(spark, sf), "quality", "doc_id")[0])


_LINE = """with s as (select *, row_number() over (order by md5(concat('42|', cast(p_partkey as varchar))), p_partkey)
        <= ceil(round(count(*) over () * 0.2, 9)) as is_test from part),
    f as (select regr_slope(p_retailprice, p_size) as a, regr_intercept(p_retailprice, p_size) as b, avg(p_size) as m
          from s where not is_test)"""


def _line(spark, sf):
    """The price of a part from its size: a model with a closed form."""
    return plain(table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice")


def _fit(where: str) -> str:
    return f"""(select 1 - sum((p_retailprice - a * p_size - b) * (p_retailprice - a * p_size - b))
        / (var_pop(p_retailprice) * count(*)) from s, f where {where})"""


@query("ml_baseline_line", f"""{_LINE} select 1 as rank, 'Linear Regression' as model, 'r2' as metric,
    {r(_fit("not is_test"))} as train_score, {r(_fit("is_test"))} as test_score""")
def ml_baseline_line(spark, sf):
    return rounds(training.baseline(_line(spark, sf), "p_retailprice", "p_partkey")[0], 6, "train_score", "test_score")


@query("rank_models")
def rank_models(spark, sf):
    scores = training.select_model(_parts(spark, sf), "p_retailprice", "p_partkey")[0]
    return scores.select("rank", "model", "test_score")


@query("ch_model_compare")
def ch_model_compare(spark, sf):
    return training.select_model(_classes(spark, sf), "quality", "doc_id")[0].select("model", "metric", "test_score")


@query("ev_predictions")
def ev_predictions(spark, sf):
    _, model, prepared = training.train_one(_classes(spark, sf), "quality", "doc_id", "Linear")
    return sampling.first_rows(training.predictions(model, prepared), 40, ["key"])


@query("ml_bayes_interval")
def ml_bayes_interval(spark, sf):
    prepared = training.prepare(_parts(spark, sf), "p_retailprice", "p_partkey")
    return bayes.prediction_interval(prepared.train, prepared.test)


# ---- evaluation ---------------------------------------------------------------------

# A fixed rule stands in for a model, so both sides score the same predictions.
_RULE = "case when l_linestatus = 'O' then 'N' when l_quantity > 25 then 'A' else 'R' end"


@query("ev_confusion", f"""
    with p as (select l_returnflag as actual, {_RULE} as predicted from lineitem),
    l as (select distinct actual as x from p union select predicted from p)
    select a.x as actual, b.x as predicted, count(p.actual) as n from l a cross join l b
    left join p on p.actual = a.x and p.predicted = b.x group by 1, 2""")
def ev_confusion(spark, sf):
    return evaluate.confusion(table(spark, sf, "lineitem").withColumn("p", F.expr(_RULE)), "l_returnflag", "p")


@query("ev_accuracy", f"""select {r(f"avg(case when l_returnflag = ({_RULE}) then 1.0 else 0.0 end)")} as accuracy from lineitem""")
def ev_accuracy(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("p", F.expr(_RULE))
    return rounds(evaluate.accuracy(df, "l_returnflag", "p"), 6, "accuracy")


_GAP = "(l_extendedprice - l_quantity * 1500)"


@query("ev_rmse_mae", f"select {sig(f'sqrt(avg({_GAP} * {_GAP}))')} as rmse, {sig(f'avg(abs({_GAP}))')} as mae from lineitem")
def ev_rmse_mae(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("p", F.expr("l_quantity * 1500D"))
    return significant(evaluate.errors(df, "l_extendedprice", "p"), "rmse", "mae")


@query("ev_r2", f"""select {r(f"1 - sum({_GAP} * {_GAP}) / (var_pop(l_extendedprice) * count(*))")} as r2 from lineitem""")
def ev_r2(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("p", F.expr("l_quantity * 1500D"))
    return rounds(evaluate.r2(df, "l_extendedprice", "p"), 6, "r2")


# ---- attributions -------------------------------------------------------------------

_COEFFICIENTS = {"l_quantity": 1500.0, "l_discount": -20000.0, "l_tax": 350.0}
_IMPORTANCE = union_all([
    f"select '{c}' as feature, avg(abs({w}::double * ({c} - (select avg({c}) from lineitem)))) as importance from lineitem"
    for c, w in _COEFFICIENTS.items()])


@query("xai_global", f"select feature, {sig('importance')} as importance from ({_IMPORTANCE})")
def xai_global(spark, sf):
    return significant(explain.linear_importance(table(spark, sf, "lineitem"), _COEFFICIENTS), "importance")


@query("top_importance", f"select feature, {sig('importance')} as importance from ({_IMPORTANCE} order by 2 desc limit 2)")
def top_importance(spark, sf):
    found = explain.linear_importance(table(spark, sf, "lineitem"), _COEFFICIENTS)
    return significant(explain.top_importance(found, 2), "importance")


@query("xai_linear", f"""{_LINE} select p_partkey as key, 0 as class, 'p_size' as feature, {r("a * (p_size - m)")} as contribution,
    {r("b + a * m")} as base_value from s, f where is_test""")
def xai_linear(spark, sf):
    _, model, prepared = training.baseline(_line(spark, sf), "p_retailprice", "p_partkey")
    found = explain.model_contributions(model, prepared.test, prepared)
    return rounds(found, 6, "contribution", "base_value")


@query("xai_linear_classes")
def xai_linear_classes(spark, sf):
    _, model, prepared = training.baseline(_classes(spark, sf), "quality", "doc_id")
    return explain.model_importance(model, prepared)


def _forest(spark, sf):
    return training.train_one(_parts(spark, sf), "p_retailprice", "p_partkey", "Random Forest")


@query("xai_global_trees")
def xai_global_trees(spark, sf):
    _, model, prepared = _forest(spark, sf)
    return explain.model_importance(model, prepared)


@query("xai_local")
def xai_local(spark, sf):
    _, model, prepared = _forest(spark, sf)
    return explain.model_contributions(model, prepared.test, prepared)


@query("ch_importance")
def ch_importance(spark, sf):
    _, model, prepared = _forest(spark, sf)
    return explain.top_importance(explain.model_importance(model, prepared), 5)


# ---- insights about models ----------------------------------------------------------


@query("insight_model")
def insight_model(spark, sf):
    scores, _, prepared = training.select_model(_parts(spark, sf), "p_retailprice", "p_partkey")
    return rules.model_insights(scores, prepared.test.agg(F.stddev_samp("label")).first()[0])


@query("insight_feature", f"""
    select 1 as section, 'top_feature' as code, feature as subject, {sig('importance')} as value from ({_IMPORTANCE}
    order by 2 desc limit 1)""")
def insight_feature(spark, sf):
    found = rules.feature_insights(explain.linear_importance(table(spark, sf, "lineitem"), _COEFFICIENTS))
    return significant(found.drop("message"), "value")


@query("insight_all")
def insight_all(spark, sf):
    df = _parts(spark, sf)
    scores, model, prepared = training.train_one(df, "p_retailprice", "p_partkey", "Random Forest")
    spread = prepared.test.agg(F.stddev_samp("label")).first()[0]
    return rules.all_insights(df, scores, spread, explain.model_importance(model, prepared))
