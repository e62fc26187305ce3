"""Keys of parts lose no match, whatever the cuts, and rows that share common pieces are not compared all with all."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prepwright.functions import parts
from prepwright.functions.indel import similarities
from prepwright.operators import fuzzy


def _changed(rng, text, changes, letters):
    out = list(text)
    for _ in range(changes):
        if out and rng.random() < 0.5:
            del out[rng.randrange(len(out))]
        else:
            out.insert(rng.randrange(len(out) + 1), rng.choice(letters))
    return "".join(out)


def _keys(texts, matching, kind):
    batch = pa.RecordBatch.from_pydict({
        "node": pa.array(range(len(texts)), pa.int64()), "g": pa.array([7] * len(texts), pa.int64()), "txt": texts,
        "n": pa.array([len(t) for t in texts], pa.int32()), "m": pa.array([0] * len(texts), pa.int64())})
    found = [set() for _ in texts]
    for out in parts.key_maker(matching, matching.longest(), kind)([batch]):
        for node, key in zip(out.column("node").to_pylist(), out.column("key").to_pylist()):
            found[node].add(key)
    return found


@pytest.mark.parametrize("threshold,strict", [(95, True), (95, False), (90, False), (85, False), (85.5, True), (72, False), (99, True), (100, False)])
def test_every_match_shares_a_key(threshold, strict):
    rng = random.Random(int(threshold * 2))
    longest = parts.Matching(threshold, strict).longest()
    a, b = [""], [""]
    for _ in range(1_500):
        letters = rng.choice(["ab", "abcdefgh0123456789", "é€Ω𝄞x"])
        a.append("".join(rng.choice(letters) for _ in range(rng.randrange(0, min(longest, 90) + 1))))
        b.append(_changed(rng, a[-1], rng.randrange(parts.MOST_CHANGES + 2), letters))
    a, b = [min(x, y, key=len) for x, y in zip(a, b)], [max(y, x, key=len) for x, y in zip(a, b)]
    score = similarities(a, b)
    match = (score > threshold if strict else score >= threshold) & np.array([len(x) <= longest for x in a])
    assert match.sum() > 100
    chosen = parts.choose_cuts([x for x in a if 0 < len(x) <= longest], parts.Matching(threshold, strict))
    for cuts in ({}, chosen, {2: ((0,), 1), 3: ((0, 1), 3), 4: ((0, 2, 3), 2)}):
        matching = parts.Matching(threshold, strict, cuts)
        for x, y, wanted in zip(_keys(a, matching, "index"), _keys(b, matching, "probe"), match):
            assert not wanted or x & y


@pytest.mark.parametrize("few", [1, 10_000])
def test_pairs_equal_brute_force(spark, monkeypatch, few):
    """Texts cut into parts and longer ones, in two groups, on one side and on two, with and without the bitmap of ends."""
    monkeypatch.setattr(fuzzy, "FEW_TEXTS", few)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde01") for _ in range(rng.choice([5, 30, 58, 70, 90]))) for _ in range(40)]
    texts += [_changed(rng, rng.choice(texts), rng.randrange(7), "abcde01") for _ in range(160)]
    rows = [(i, "xy"[i % 2], t) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node long, grp string, txt string")
    u, v = zip(*[(i, j) for i in range(200) for j in range(i + 1, 200) if i % 2 == j % 2])
    score = similarities([texts[i] for i in u], [texts[j] for j in v])
    wanted = {(i, j) for i, j, s in zip(u, v, score) if s > 95}
    assert len(wanted) > 40
    assert {(r["u"], r["v"]) for r in fuzzy.similar_pairs(nodes, 95, True).collect()} == wanted
    got = fuzzy.similar_pairs(nodes.where("node < 3"), 95, True, nodes.where("node >= 3")).collect()
    assert {(r["u"], r["v"]) for r in got} == {(i, j) for i, j in wanted if i < 3 <= j}


def test_rows_with_common_pieces_are_not_all_compared(spark, monkeypatch):
    made, dealt = [], fuzzy._dealt

    def counted(a, b):
        made.append(a.select("key").join(b.select("key"), "key").count())
        return dealt(a, b)
    monkeypatch.setattr(fuzzy, "_dealt", counted)
    rows = spark.range(3_000).select("id", F.expr("element_at(array('large', 'small', 'red', 'old', 'new'), cast(id * 7 % 5 + 1 as int)) || ' ring'").alias("name"),
                                     F.expr("'Brand#' || xxhash64(id) % 25").alias("brand"), F.expr("'2024-01-' || lpad(1 + abs(xxhash64(id, 1)) % 28, 2, '0')").alias("day"))
    assert fuzzy.drop_fuzzy_rows(rows, ["id"], 95).count() > 0
    # All pairs of the 3,000 rows are 4,500,000; each row meets itself in a few parts.
    assert sum(made) < 300_000
