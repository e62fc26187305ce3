import random
from collections import Counter

import corpus_cases as cases
import numpy as np
import pytest
import regex

from prepwright.llm import substrings


def brute(rows, n):
    """Rows in the order of their places."""
    seen, out = {}, []
    words_of = [(d, regex.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in words_of:
        for i in range(len(w) - n + 1):
            place = (-1 if d is None else d, i)
            key = tuple(w[i:i + n])
            seen[key] = min(seen.get(key, place), place)
    for d, w in words_of:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] != (-1 if d is None else d, i):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("n,anchor,group", [(20, 5, 50_000), (20, 5, 1), (6, 2, 3), (7, 7, 50_000), (1, 1, 4), (3, 1, 50_000)])
def test_agrees_with_brute_force(spark, n, anchor, group):
    rng = random.Random(n)
    passages = [cases.sentence(rng, rng.choice([5, 20, 21, 60])) for _ in range(5)]
    rows = [(d, t) for d, t, *_ in cases.documents(n, 40)]
    rows += [(d, t) for d, t in ((200 + i, "  ".join([cases.sentence(rng, rng.randint(0, 40)), rng.choice(passages), cases.sentence(rng, 9)])) for i in range(30))]
    rows += [(300, "a " * 90), (301, "a b " * 30), (302, passages[-1] + "\n" + passages[-1])]
    docs = cases.clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "at", "key", "n", "ranges", "words")
    found = substrings.without_repeats(docs, n, anchor, group).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found) == brute(rows, n)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in found)


def test_groups_reach_over_batches(spark, monkeypatch):
    rng = random.Random(1)
    text = cases.sentence(rng, 50)
    rows = [(i, text + f" x{i}") for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(substrings, "TOGETHER", 20)
    try:
        found = substrings.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found) == brute(rows, 20)


def test_tree_nodes_are_stretches_of_equal_prefixes():
    symbols = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [5, 5, 5], [1, 2, 3]], np.uint64)
    order, depth = substrings.tree_nodes(symbols, np.array([0, 0, 0, 0, 1]), [np.arange(5)])
    assert order.tolist() == [0, 2, 1, 3, 4] and depth.tolist() == [0, 3, 2, 0, 0]


def test_empty_table(spark):
    assert substrings.without_repeats(cases.frame(spark, [])).count() == 0
