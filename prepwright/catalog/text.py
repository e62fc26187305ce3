"""Text functions, fuzzy matching and category correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepwright.catalog.registry import DIRT, dirty, on_dirty, query, r, rounds, table, union_all
from prepwright.functions import text as words
from prepwright.functions.indel import indel_ratio
from prepwright.operators import fuzzy
from prepwright.plans import flows

# ---- oracle building blocks ---------------------------------------------------------


def lcs_ctes(source: str = "cand") -> str:
    """CTEs scoring the text pairs (a, b) of ``source``: score(a, b, s). Needs WITH RECURSIVE."""
    return f"""
    lcs(a, b, i, cells) as (
      select a, b, 0::bigint, list_transform(range(0, length(b) + 1), lambda x: 0::bigint) from {source}
      union all
      select a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc,
          case when a[i + 1] = b[j] then cells[j] + 1 else greatest(cells[j + 1], acc[j]) end), [0::bigint])
      from lcs where i < length(a)),
    score as (select a, b, case when length(a) + length(b) = 0 then 100.0::double
        else 200.0::double * cells[-1] / (length(a) + length(b)) end as s from lcs where i = length(a))"""


def similar_ctes(threshold: float, strict: bool = False) -> str:
    """CTEs from node(grp, value, txt, id) to edge(u, v, s), u before v."""
    rest = 1 - threshold / 100
    return f"""
    near as materialized (select x.id as u, y.id as v, x.txt as a, y.txt as b from node x join node y
             on x.grp = y.grp and x.id < y.id
             and levenshtein(x.txt, y.txt) <= {rest} * (length(x.txt) + length(y.txt)) + 1e-9),
    cand as (select distinct a, b from near),
    {lcs_ctes()},
    edge as materialized (select u, v, s from near join score using (a, b) where s {'>' if strict else '>='} {threshold})"""


def greedy_ctes(threshold: float, strict: bool = False) -> str:
    """CTEs from node to led(id, leader): the sequential scan, one node after the other."""
    return f"""{similar_ctes(threshold, strict)},
    back as materialized (select id, coalesce(list(u) filter (u is not null), []) as us from node left join edge on v = id group by id),
    scan(id, leaders) as (
      select 0::bigint, []::bigint[]
      union all
      select b.id, case when list_has_any(b.us, leaders) then leaders else list_append(leaders, b.id) end
      from scan join back b on b.id = scan.id + 1),
    leads as (select unnest(leaders) as leader from (select leaders from scan order by id desc limit 1)),
    led as (select leader as id, leader from leads union all
            select v, min(u) from edge join leads on u = leader where v not in (select leader from leads) group by v)"""


def value_nodes(columns: list[str], order: str, value: str, txt: str) -> str:
    """CTE node over the distinct values of several columns; templates use {c} and {v}."""
    cells = union_all([f"select '{c}' as grp, {value.format(c=c)} as value, {order} as o from d" for c in columns])
    return f"""node as (select grp, value, {txt.format(v="value")} as txt,
      row_number() over (order by min(o), value, grp) as id from ({cells}) where value is not null group by grp, value)"""


def with_dirty_part(body: str) -> str:
    return f"with recursive d as ({DIRT['part'].format(part='part')}), {body}"


PART_TEXT = ["p_name", "p_brand", "size_text", "mixed_text", "date_text"]
PART_NODES = value_nodes(PART_TEXT, "p_partkey", "nullif(trim({c}), '')", "lower({v})")

# Members of groups of two or more, with the suggested spelling.
MEMBERS = f"""{PART_NODES}, {greedy_ctes(85)},
    sized as (select leader, count(*) as n, first(value order by length(value) desc,
        length(value) - length(replace(value, '-', '')) desc, id) as best
      from led join node using (id) group by leader),
    member as (select grp, value, leader, upper(best) as suggested
               from led join node using (id) join sized using (leader) where n > 1)"""

# ---- similarity ---------------------------------------------------------------------

_VARIANT = """case p_partkey % 4 when 0 then p_name when 1 then upper(p_name) when 2 then replace(p_name, ' ', '-')
    else concat(' ', p_name, ' ') end"""


@query("fuzzy_ratio", f"""
    with recursive t as (select p_partkey, p_name as a, {_VARIANT} as b from part),
    cand as (select distinct a, b from t), {lcs_ctes()}
    select p_partkey, a, b, {r("s")} as score from t join score using (a, b)""")
def fuzzy_ratio(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"), F.expr(_VARIANT).alias("b"))
    return rounds(df.withColumn("score", indel_ratio(F.col("a"), F.col("b"))), 6, "score")


@query("fuzzy_token_sort", f"""
    with recursive t as (select p_partkey, list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' ') as a,
        list_aggregate(list_sort(string_split(p_brand || ' ' || p_name, ' ')), 'string_agg', ' ') as b from part),
    cand as (select distinct a, b from t), {lcs_ctes()}
    select p_partkey, {r("s")} as score from t join score using (a, b)""")
def fuzzy_token_sort(spark, sf):
    a = words.sorted_tokens(F.col("p_name"))
    b = words.sorted_tokens(F.concat("p_brand", F.lit(" "), "p_name"))
    return rounds(table(spark, sf, "part").select("p_partkey", indel_ratio(a, b).alias("score")), 6, "score")


@query("fuzzy_pairs", with_dirty_part(f"""
    {value_nodes(PART_TEXT, "p_partkey", "{c}",
                 "list_aggregate(list_sort(list_filter(string_split({v}, ' '), lambda w: w <> '')), 'string_agg', ' ')")},
    {similar_ctes(85)}
    select x.grp as "column", x.value as value_a, y.value as value_b, cast(floor(s) as bigint) as score
    from edge join node x on x.id = u join node y on y.id = v"""))
def fuzzy_pairs(spark, sf):
    return fuzzy.fuzzy_pairs(dirty(spark, sf, "part"), 85, order_by=["p_partkey"])


@query("fuzzy_pair_classes", with_dirty_part(f"""
    {value_nodes(PART_TEXT, "p_partkey", "{c}",
                 "list_aggregate(list_sort(list_filter(string_split({v}, ' '), lambda w: w <> '')), 'string_agg', ' ')")},
    {similar_ctes(85)},
    links as (select id, count(*) as n from (select u as id from edge union all select v from edge) group by id)
    select grp as "column", value, first_value(value) over (partition by grp, txt order by node.id) as representative,
           coalesce(links.n, 0) as n_links from node left join links using (id)"""))
def fuzzy_pair_classes(spark, sf):
    return fuzzy.pair_classes(dirty(spark, sf, "part"), 85, order_by=["p_partkey"])[0]


@query("fuzzy_groups", with_dirty_part(f"""{MEMBERS}
    select grp as "column", string_agg(value, '|' order by value) as original, suggested
    from member group by grp, leader, suggested"""))
def fuzzy_groups(spark, sf):
    out = fuzzy.fuzzy_groups(dirty(spark, sf, "part"), threshold=85, order_by=["p_partkey"])
    return out.withColumn("original", F.array_join("original", "|"))


_LOW = f"""{PART_NODES}, {greedy_ctes(60)},
    member as (select grp, value, leader from led join node using (id))"""


@query("fuzzy_groups_low", with_dirty_part(f"""{_LOW}
    select grp as "column", string_agg(value, '|' order by value) as original from member group by grp, leader having count(*) > 1"""))
def fuzzy_groups_low(spark, sf):
    out = fuzzy.fuzzy_groups(dirty(spark, sf, "part"), threshold=60, order_by=["p_partkey"])
    return out.select("column", F.array_join("original", "|").alias("original"))


@query("fix_apply_groups", with_dirty_part(f"""{MEMBERS}
    select p_partkey, coalesce(suggested, p_name) as p_name, p_brand, size_text, mixed_text, date_text, p_retailprice
    from d left join member on grp = 'p_name' and value = trim(p_name)"""))
def fix_apply_groups(spark, sf):
    return flows.correct_text(dirty(spark, sf, "part"), ["p_name"], order_by=["p_partkey"])


@query("fuzzy_normalize", with_dirty_part(f"""
    val as (select trim(p_name) as original, min(p_partkey) as o from d group by 1),
    norm as (select *, replace(replace(upper(original), '_', ' '), '-', ' ') as form from val),
    forms as (select form, count(*) as n, min(o) as o from norm group by form),
    node as (select 'p_name' as grp, form as value, form as txt, n, row_number() over (order by o, form) as id from forms),
    {similar_ctes(85)},
    linked as (select u, v from edge union all select v, u from edge union all select id, id from node),
    best as (select u, first(y.value order by y.n desc, length(y.value) desc, y.id) as canonical
             from linked join node y on y.id = v group by u)
    select original, canonical from norm join node on node.value = form join best on u = node.id"""))
def fuzzy_normalize(spark, sf):
    return fuzzy.normalize_map(dirty(spark, sf, "part"), "p_name", 85, order_by=["p_partkey"])


@query("dd_fuzzy_rows", with_dirty_part(f"""
    rows as (select *, p_partkey || '||' || p_name || '||' || p_brand || '||' || size_text || '||' || mixed_text || '||' ||
             date_text || '||' || p_retailprice as txt from d),
    node as (select '' as grp, txt as value, txt, row_number() over (order by min(p_partkey), txt) as id,
                    min(p_partkey) as first_key from rows group by txt),
    {greedy_ctes(95, True)}
    select rows.* exclude (txt) from rows join (
      select first_key from node join leads on id = leader) on first_key = p_partkey"""))
def dd_fuzzy_rows(spark, sf):
    return fuzzy.drop_fuzzy_rows(dirty(spark, sf, "part"), ["p_partkey"], 95)


# ---- text functions -----------------------------------------------------------------


def _standard(c: str) -> str:
    return rf"""regexp_replace(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')),
        '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g')"""


@query("txt_standardize", f"select doc_id, {_standard('text')} as text, lang, {_standard('source')} as source, n_chars from documents")
def txt_standardize(spark, sf):
    return flows.standardize_columns(table(spark, sf, "documents"), ["text", "source", "no_such_column"])


# The references in the given pages, the ampersand last.
_REFERENCES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _unescaped(expr: str) -> str:
    for reference, char in _REFERENCES:
        expr = f"replace({expr}, '{reference}', '{char}')"
    return expr


@query("txt_html_to_text", rf"""
    with bare as (select page_id, regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script.*?>.*?</script>', '', 'g'), '(?is)<style.*?>.*?</style>', '', 'g'), '(?s)<.*?>', '', 'g') as t from pages)
    select page_id, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array({_unescaped('t')}, '\r\n|\n|\r'),
        lambda l: regexp_replace(l, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda l: l <> ''), chr(10)), '') as text from bare""")
def txt_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", words.html_to_text(F.col("html")).alias("text"))


@query("txt_entities", "select page_id, 'é’€Ω<&amp;> ' || page_id as text from pages")
def txt_entities(spark, sf):
    raw = F.concat(F.lit("&eacute;&#8217;&#x20AC;&Omega;&lt;&amp;amp;&gt; "), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", words.unescape(raw).alias("text"))


@query("act_dispatch", on_dirty("customer", f"""
    select cast(c_custkey as varchar) as c_custkey, c_nationkey,
      {r("coalesce(c_acctbal, (select quantile_cont(c_acctbal, 0.5) from d))")} as c_acctbal,
      lower(c_mktsegment) as c_mktsegment from d"""))
def act_dispatch(spark, sf):
    out = flows.run_actions(dirty(spark, sf, "customer"), [
        {"type": "fill", "strategy": "median"}, {"type": "convert", "col": "c_custkey", "to": "text"},
        {"type": "standardize", "col": "c_mktsegment"}, {"type": "no_such_action"}])
    return rounds(out, 6, "c_acctbal")
