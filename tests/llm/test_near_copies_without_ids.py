import random

import corpus_cases as cases

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(4)
    a, b, c, d, e = (cases.sentence(rng, 60) + f" {i}" for i in range(5))
    rows = [(1, a, "en", "s", 1), (None, a, "en", "s", 1),        # a copy without an id goes, the one with an id stays
            (None, b, "en", "s", 2),                              # unrelated, without an id
            (None, c, "en", "s", 3), (None, c, "en", "t", 3), (None, c, "fr", "t", 3),   # a group without ids
            (7, d, "en", "s", 4), (7, d, "en", "s", 4),           # repeated rows
            (9, e, "en", "s", 5)]
    out = corpus_pipeline.by_simhash(spark, cases.frame(spark, rows).repartition(4), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["lang"], r["source"]) for r in out) == sorted([
        (1, a, "en", "s"), (0, b, "en", "s"), (0, c, "en", "s"), (7, d, "en", "s"), (9, e, "en", "s")])
