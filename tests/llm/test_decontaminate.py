import random
from collections import Counter, defaultdict

import corpus_cases as cases
import pytest
import regex

from prepwright.llm import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    listed = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            listed[tuple(w[i:i + n])].add(item)
    sizes = {len(k) for k in listed}
    out = Counter()
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in listed:
                    hit.update(range(i, i + n))
                    named |= listed[tuple(w[i:i + n])]
        out[doc, len(w), len(hit), tuple(sorted(map(str, named - {None})))] += 1
    return out


def check(spark, docs, items, window=10, gram=5):
    d = cases.clashing(spark.createDataFrame(docs, "doc_id bigint, text string"), "words", "at", "piece", "item_id", "n_hit")
    i = cases.clashing(spark.createDataFrame(items, "item_id bigint, text string"), "words", "doc_id")
    found = decontaminate.contamination(d, i, window, gram).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == brute(docs, items, window)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in found)


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, cases.sentence(rng, rng.choice([1, 3, 9, 10, 11, 25, 40]))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "--"), (0, items[0][1]), (None, cases.sentence(rng, 12)), (23, items[5][1].upper())]
    docs = [(d, t) for d, t, *_ in cases.documents(seed)]
    for i in range(12):
        text = items[i][1].split()
        docs.append((100 + i, " -- ".join([cases.sentence(rng, 70), ", ".join(text[:rng.randint(1, len(text))]).title(), cases.sentence(rng, rng.randint(0, 130))])))
    docs += [(200, "a " * 500), docs[-1], (100, "same id, other text " + items[2][1])]
    check(spark, docs, items + [(30, "a " * 30)])


def test_spans_of_ten_words_are_found_wherever_they_start(spark):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(30)]
    docs = []
    for n in range(150):
        before, start, length = rng.randint(0, 140), rng.randint(0, 20), rng.randint(8, 12)
        docs.append((n, " ".join([*(f"x{rng.random()}" for _ in range(before)), *item[start:start + length], *(f"y{rng.random()}" for _ in range(rng.randint(0, 80)))])))
    check(spark, docs, [(1, " ".join(item))])


def test_empty_sides(spark):
    docs = [(1, "one two")]
    check(spark, docs, [(1, None)])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    assert decontaminate.contamination(empty, items).count() == 0
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), items.limit(0)).first()
    assert not found["contaminated"] and found["n_words"] == 2
