import random

import corpus_cases as cases
import numpy as np
from pyspark.sql import functions as F

from prepwright.llm import url_filter
from prepwright.llm.catalog import RULES

PAGES = [
    (1, "https://A.Example.NET/en/x?q=1#t"), (2, "http://example.net/de/"), (3, "http://x.net"), (4, "http://badexample.com/de/1"),
    (5, "http://www.example.com/de/1"), (6, "http://a.org/fr/"), (7, "http://a.org/FR/"), (8, None), (9, "no scheme/path"), (10, ""),
    (11, "http://spam.example.com/en/1/"), (12, "http://www.spam.example.com/en/1?utm_source=x"), (13, "http://spam.example.com/en/2"),
    (14, "x://y://z"), (15, "http://[?#"), (16, "http://a.net/\npath"), (17, "http://É.com/é?b=2&a=1"), (17, "http://É.com/é?b=2&a=1")]


def test_rules_and_list(spark):
    pages = cases.clashing(spark.createDataFrame(PAGES, "page_id bigint, url string"), "host", "rule", "passes", "listed", "canonical")
    listed = spark.createDataFrame([("https://spam.example.com:443/en/1",), (None,), ("nothing",)], "url string")
    found = {r["page_id"]: tuple(r)[1:] for r in url_filter.judged(pages, listed, RULES).collect()}
    assert found[1] == ("a.example.net", "/en/x", "example.net/en/", "allow", False)
    assert found[2] == ("example.net", "/de/", "net/", "block", False)
    assert found[3] == ("x.net", "", None, "allow", False)
    assert found[4] == ("badexample.com", "/de/1", None, "allow", False)
    assert found[5] == ("www.example.com", "/de/1", "example.com/de/", "block", False)
    assert found[6][2:4] == ("org/fr/", "allow") and found[7][2:4] == (None, "allow")
    assert found[8] == found[9] == found[10] == ("", "", None, "allow", False)
    assert found[11][2:] == found[12][2:] == (None, "block", True) and found[13][2:] == (None, "allow", False)
    assert found[14][:2] == ("y:", "//z") and found[15][:2] == ("[", "")
    assert found[16][:3] == ("a.net", "/\npath", "net/") and found[17][:2] == ("É.com", "/é")
    assert url_filter.judged(pages, listed, RULES).count() == len(PAGES)


def test_longest_rule_wins(spark):
    rules = [url_filter.Rule("com/a/", False), url_filter.Rule("b.com/", True), url_filter.Rule("com/a/b/", False)]
    rows = spark.createDataFrame([("b.com", "/a/"), ("b.com", "/a/b/"), ("c.com", "/a/")], "h string, p string")
    found = [r[0] for r in rows.select(url_filter.rule_for(F.col("h"), F.col("p"), rules)).collect()]
    assert found == ["b.com/", "com/a/b/", "com/a/"]


def test_join_is_exact_even_if_the_filter_is_tiny(spark):
    rng = random.Random(3)
    urls = [f"http://h{rng.randrange(400)}.com/{rng.randrange(50)}" for _ in range(3_000)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    listed = spark.createDataFrame([(u,) for u in urls[::3]], "url string")
    for blocks in (1, url_filter.MAX_BLOCKS):
        found = {r["page_id"]: r["listed"] for r in url_filter.listed_rows(pages, "url", listed, blocks).collect()}
        assert found == {i: u in set(urls[::3]) for i, u in enumerate(urls)}


def test_filter_passes_all_and_few_others(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    words = url_filter.bloom_filter(keys)

    def share(frame):
        at, masks = url_filter._masks(frame.toPandas()["key"].to_numpy().view(np.uint64), len(words))
        return ((words[at] & masks) == masks).all(axis=1).mean()
    assert share(keys) == 1.0
    assert share(spark.range(20_000, 40_000).select(F.xxhash64("id").alias("key"))) < 0.02


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judged(pages, pages.select("url"), RULES).count() == 0
    some = spark.createDataFrame(PAGES, "page_id bigint, url string")
    assert url_filter.judged(some, pages.select("url"), RULES).filter("listed").count() == 0
