import random

import corpus_cases as cases
import pytest

from prepwright.llm import lines


def within(a, b, edits):
    if a == b:
        return True
    if not edits or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def brute(rows, edits, min_chars):
    """Kept text of each row; rows come in the order of the places."""
    seen, out = [], []
    for doc, text in rows:
        kept = []
        for at, line in enumerate(text.split("\n")):
            if len(line) >= min_chars:
                if any(place < (doc, at) and within(line, other, edits) for place, other in seen):
                    kept.append(None)
                else:
                    kept.append(line)
                seen.append(((doc, at), line))
            else:
                kept.append(line)
        out.append((doc, len(kept), kept.count(None), "\n".join(x for x in kept if x is not None)))
    return out


def changed(rng, line):
    k, p = rng.randrange(4), rng.randrange(len(line) + 1)
    c = rng.choice("aé漢 ")
    return [line[:p] + c + line[p:], line[:p] + line[p + 1:], line[:p] + c + line[p + 1:], line][k]


@pytest.mark.parametrize("seed,edits", [(1, 1), (2, 1), (3, 0)])
def test_agrees_with_brute_force(spark, seed, edits):
    rng = random.Random(seed)
    stock = [cases.sentence(rng, rng.choice([5, 8, 30, 120])) for _ in range(12)] + ["a" * 25, "ab" * 15, "é" * 30, "short"]
    rows = []
    for doc in range(40):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(stock)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                line = changed(rng, line)
            text.append(line)
        rows.append((doc, "\n".join(text)))
    rows.append((40, ""))
    docs = cases.clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), "ats", "text_hash", "n_lines", "at", "id", "other_id")
    found = lines.without_repeats(docs, edits).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in found) == brute(rows, edits, lines.MIN_CHARS)
    assert found[0]["ats"] == found[0]["text_hash"] == "mine"


def test_edits_at_every_place_of_a_long_line(spark):
    rng = random.Random(9)
    base = cases.sentence(rng, 1_500)
    places = sorted({0, 1, len(base) - 1, len(base), *(rng.randrange(len(base)) for _ in range(20))})
    rows = [(0, base)]
    for p in places:
        rows += [(len(rows), base[:p] + "#" + base[p:]), (len(rows) + 1, base[:p] + "#" + base[p + 1:])]
        if p < len(base):
            rows.append((len(rows), base[:p] + base[p + 1:]))
    rows.append((len(rows), base[:50] + "##" + base[50:]))
    found = {r["doc_id"]: r["n_removed"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    wanted = {d: n for d, _, n, _ in brute(rows, 1, 20)}
    assert found == wanted and wanted[len(rows) - 1] in (0, 1)


def test_nulls_repeats_and_empty_tables(spark):
    line, other = "a line of more than twenty characters", "a line of more than twenty charakters"
    rows = [(5, line), (5, line), (None, other), (2, None), (3, line + "\n" + line), (3, line + "\nx")]
    found = lines.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["text"]) for r in found if r["text"] is not None)
    assert texts == sorted([("5", 1, 1, ""), ("5", 1, 1, ""), ("None", 1, 0, other), ("3", 2, 2, ""), ("3", 2, 1, "x")])
    assert [tuple(r) for r in found if r["text"] is None] == [(2, None, 0, 0)]
    assert lines.without_repeats(cases.frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lines.without_repeats(cases.frame(spark), max_edits=2)
