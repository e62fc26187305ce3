import random
from itertools import permutations

import numpy as np

from corpus_cases import clashing, documents, frame
from prepwright.llm import audit


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    firsts = {}
    for d, text, _ in rows:
        if d is not None:
            firsts[text or ""] = min(firsts.get(text or "", d), d)
    parts = {}
    for d, text, lang in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > firsts[text]}
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part, docs in parts.items():
        removals = {}
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                left = [x for x in docs if not x[0] & set(order[:step - 1])]
                gone = [x for x in left if f in x[0]]
                removals[f] = removals.get(f, 0) + len(gone)
                out.append([part, "".join(order), step, len(left) - len(gone), len(gone), sum(f in x[0] for x in docs) - len(gone),
                            sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)])
        for row in out:
            if row[0] == part:
                row.append(removals[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def cases():
    rng = random.Random(4)
    rows = [(r[0], r[1], r[2]) for r in documents()]
    for i in range(100, 160):
        words = [rng.choice("Aa b cC DD e% f g|h 漢字 ÜB x".split()) + str(rng.randint(0, 300)) for _ in range(rng.choice([3, 99, 100, 160]))]
        rows.append((i, " ".join(words), rng.choice(["de", "", None])))
    rows += [(200, rows[-1][1], "de"), (200, rows[-1][1], "de"), (None, rows[-1][1], "de"), (201, "", "de"), (202, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 205, 2)]
    return rows, labels + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9_999, 1, 1)]


def tables(spark, rows, labels):
    return (spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_agrees_with_brute_force(spark):
    rows, labels = cases()
    found = audit.audited(*tables(spark, rows, labels))
    assert found.columns and sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == brute(rows, labels)


def test_positional_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 129, 192, 5_000, 100_003):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert audit.positional_counts(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]


def test_words_name_the_surviving_subsets():
    for failed in range(32):
        assert [s for s in range(32) if audit.WORDS[failed] >> s & 1] == [s for s in range(32) if not s & failed]


def test_empty_clashing_and_text_ids(spark):
    rows, labels = cases()
    docs, known = tables(spark, rows, labels)
    assert audit.audited(docs.limit(0), known).collect() == []
    unlabelled = audit.audited(docs, known.limit(0))
    assert unlabelled.filter("good_lost + toxic_lost > 0").count() == 0 and unlabelled.count() == 600 * 4
    named = clashing(docs, "part", "failed", "digest", "first", "n", "good", "own"), clashing(known, "part", "n", "good")
    assert sorted(map(tuple, audit.audited(*named).select(COLUMNS).collect())) == brute(rows, labels)
    texts = audit.audited(docs.selectExpr("cast(doc_id as string) as doc_id", "text", "lang"), known.selectExpr("cast(doc_id as string) as doc_id", "quality", "toxic"))
    assert texts.count() == 600 * 4
    assert frame(spark).count() > 0


def test_limits_are_a_parameter():
    assert audit.failures("Aa bb", audit.Limits(words=2, capitals=50)) == 0
    assert audit.failures("Aa bb", audit.Limits(words=3, capitals=50)) == 1
    assert audit.failures("", audit.Limits()) == 1
