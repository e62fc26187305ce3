"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepwright.llm import alignment, audit, decontaminate, exact_dedup, jaccard, language, lines, sentencepieces, sharding, simhash, substrings, token_counts, url_filter
from prepwright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return register


RULES = [url_filter.Rule("net/", False), url_filter.Rule("example.net/en/", True),
         url_filter.Rule("example.com/de/", False), url_filter.Rule("org/fr/", True)]
# Pages on hosts that name one of these make up the list of unwanted URLs.
UNWANTED_HOSTS = "spam|pills|adult|casino"


@query("op1_url_filter", r"""
with u as (
  select page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
         regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1) as q
  from pages),
c as (
  select *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '')
            || regexp_replace(path, '/+$', '') || '?' || array_to_string(list_sort(list_filter(string_split(q, '&'),
               lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') as canonical
  from u),
l as (select distinct canonical from c where host <> '' and regexp_matches(host, 'spam|pills|adult|casino')),
r as (
  select *, host <> '' and canonical in (select canonical from l) as listed,
         case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
              when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
              when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
              when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from c)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when listed then 'block' else 'allow' end as verdict, listed
from r""")
def op1_url_filter(spark, sf):
    pages = table(spark, sf, "pages")
    unwanted = pages.select("url").filter(url_filter.host_of(F.col("url")).rlike(UNWANTED_HOSTS))
    return url_filter.judged(pages, unwanted, RULES)


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op2_simhash")
def op2_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf):
    trips = sentencepieces.round_trips(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))
    return trips.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op4_decontaminate", f"""
with iw as (select item_id, {_WORDS} as w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from iw where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
dw as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)),
m as (select doc_id, i, dw.n, item_id from dw join win using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items,
                 array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from m group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)""")
def op4_decontaminate(spark, sf):
    rows = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items",
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


# Each document is cut by ten characters after its first quarter, gets its source put in at its middle
# and its language at its end.
EDITS = """
  array(named_struct('start', length(text) div 4, 'end', length(text) div 4 + 10, 'text', ''),
        named_struct('start', length(text) div 2 + 10, 'end', length(text) div 2 + 10, 'text', concat(' [', coalesce(source, ''), '] ')),
        named_struct('start', length(text) + 10, 'end', length(text) + 10, 'text', concat('\n', coalesce(lang, ''))))"""


@query("op5_token_counts")
def op5_token_counts(spark, sf):
    import public_tokenizers
    where = tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf, "documents").selectExpr("doc_id", "coalesce(text, '') as text", "source", "lang").selectExpr(
        "doc_id", "text", f"{EDITS} as edits")
    rows = token_counts.recounted(token_counts.trees(docs, *where), *where)
    return rows.drop("leaf_chars", "leaf_tokens")


@query("op6_language")
def op6_language(spark, sf):
    docs = table(spark, sf, "documents")
    return language.predicted(docs, language.learn(docs)).drop("spans")


@query("op7_substring_dedup", r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s
        from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from later),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, count(g.p) as n_removed, string_agg(x, ' ' order by p) filter (g.p is null) as t
         from words left join gone g using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)""")
def op7_substring_dedup(spark, sf):
    rows = substrings.without_repeats(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_sharding")
def op8_sharding(spark, sf):
    return sharding.sharded(table(spark, sf, "documents"), 24)


@query("op9_line_dedup")
def op9_line_dedup(spark, sf):
    rows = lines.without_repeats(table(spark, sf, "documents").select("doc_id", "text"), short=True)
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_exact_dedup", """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
       row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256
from d""")
def op10_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"), digests=True)


@query("op11_ngram_jaccard", r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') as w from documents),
g as materialized (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from g group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
near as materialized (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
links as materialized (select a, b from near union all select b, a from near),
reach as (select doc_id, doc_id as r from n union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(r.component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join (select doc_id, min(r) as component_id from reach group by doc_id) r using (doc_id)""")
def op11_ngram_jaccard(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark, sf):
    import public_tokenizers
    rows = alignment.alignments(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                                tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    return alignment.weighed(rows.withColumn("groups_sha256", digest).drop("groups"))


@query("op13_filter_audit", r"""
with words as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
          from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
             [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails
      from words left join known using (doc_id)),
c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
      where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, ascii(filter_order[step]) - 64 as own,
             list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) as before
      from o, unnest(range(1, 6)) as t(step)),
j as (select part, filter_order, step, own, fails[own] as fails_own,
             step > 1 and len(list_filter(before, lambda x: fails[x])) > 0 as gone,
             len(list_filter(fails, lambda x: x)) as n_fails, n, good, toxic from c, s),
r as (select part, filter_order, step, own,
             coalesce(sum(n) filter (not gone and not fails_own), 0) as kept, coalesce(sum(n) filter (not gone and fails_own), 0) as removed,
             coalesce(sum(n) filter (gone and fails_own), 0) as redundant, coalesce(sum(n) filter (fails_own and n_fails = 1), 0) as unique_fails,
             coalesce(sum(good) filter (not gone and fails_own), 0) as good_lost,
             coalesce(sum(toxic) filter (not gone and fails_own), 0) as toxic_lost
      from j group by part, filter_order, step, own)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley
from r""")
def op13_filter_audit(spark, sf):
    return audit.audited(table(spark, sf, "documents"), table(spark, sf, "labels"))



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
