import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_cases import clashing, documents, frame
from prepwright.llm import jaccard
from prepwright.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def gram_set(text, shingle=4):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def brute(rows, percent=85):
    """(doc_id, n, component) with every pair compared; rows of one id are one node."""
    sets = [gram_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (100 * len(a & b) >= percent * len(a | b) or rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df, **options).collect()), key=repr)


def families(seed, sizes=(40, 15, 3, 2), words=120):
    """Groups of texts, each with a few words of one before it changed, so that links form chains."""
    rng, rows = random.Random(seed), []
    for size in sizes:
        members = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 20, words]))]]
        while len(members) < size:
            copy = list(rng.choice(members))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = [f"w{rng.randint(0, 400)}"]
            members.append(copy)
        rows += [" ".join(m) for m in members]
    common = " ".join(f"c{i}" for i in range(60))
    rows += [common + " " + " ".join(f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 25))) for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, tile, percent", [(1, 512, 85), (2, 3, 85), (3, 4, 60)])
def test_agrees_with_brute_force(spark, monkeypatch, seed, tile, percent):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "SHORT", 2 if tile < 512 else 8)
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(df, percent=percent) == brute(rows, percent)


def test_edge_cases(spark):
    rows = [(r[0], r[1]) for r in documents()]
    rows += [(500, "The cat"), (501, "the CAT"), (502, "the cat sat"), (503, "É x"), (504, "é x"), (None, "gone away now"), (None, "gone away now")]
    rows += [(3, "a second text under the id three, unlike the first"), (505, "  \x1c"), (506, " \x0b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df) == brute(rows)
    named = clashing(df, "set_id", "n", "row", "grams", "token", "root", "a")
    assert found(named) == brute(rows)
    assert found(frame(spark, [])) == []
    assert jaccard.near_duplicates(df.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == len(rows)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_ngram_jaccard"](spark, SF).collect()), key=repr) == brute(rows)


def test_hashes_tell_sequences_apart():
    texts = ["a b", "b a", "a b c d", "a b c", "d c b a", "a", "a a", "a a a a", "a a a a a", "A B"]
    found = {t: tuple(jaccard.grams(t).tolist()) for t in texts}
    assert found["a b"] == found["A B"] and found["a a a a"] == found["a a a a a"] and len(set(found.values())) == len(texts) - 2
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 50)}" for _ in range(5000)]
    assert len(jaccard.grams(" ".join(words))) == len(gram_set(" ".join(words)))


def test_fragments_cut_every_set(spark):
    df = spark.createDataFrame(families(6), "doc_id bigint, text string")
    sets = jaccard.gram_sets(df).cache()
    order = jaccard.order_of(sets, 5)
    assert sorted(order.places.tolist()) == list(range(1 << jaccard.CLASS_BITS)) and len(order.cuts) == 5 * jaccard.CELLS * jaccard.FINE - 1
    for row in sets.collect():
        hashes = np.array(row["grams"], np.int64).view(np.uint64)
        keys = order.keys(hashes)
        parts, sizes = order.fragments(keys), order.sizes(keys)
        assert [len(p) for p, _ in parts] == [c.sum() for _, c in parts] == sizes.reshape(5, -1).sum(axis=1).tolist()
        parts = [p for p, _ in parts]
        assert len(parts) == 5 and (np.concatenate(parts) == keys).all() and len(set(keys.tolist())) == row["n"]
    sets.unpersist()


def test_sketches_bound_what_differs():
    rng = np.random.default_rng(4)
    for n, changed in ((3, 1), (60, 5), (700, 40), (700, 700), (40_000, 900)):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, rng.integers(0, 2 * changed), np.uint64)]))
        if not len(b):
            continue
        size = min(len(jaccard.sketch(a)), len(jaccard.sketch(b)))
        x, y = jaccard._folded([jaccard.sketch(a), jaccard.sketch(b)], size)
        assert 8 <= size <= 2048 and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        assert jaccard._folded([jaccard.sketch(a)], 8)[0, 0] == np.bitwise_xor.reduce(jaccard._folded([jaccard.sketch(a)], size)[0])


def test_candidates_move_few_bytes(spark):
    df = spark.createDataFrame(families(7), "doc_id bigint, text string")
    for whole, brief in zip(*(jaccard.gram_sets(df, packed=p).orderBy("doc_id").collect() for p in (False, True))):
        assert len(brief["grams"]) == 5 * whole["n"] and len(brief["sketch"]) <= max(8, whole["n"] / 4)
        kept = jaccard._arrays(jaccard.pa.array([bytes(brief["grams"])]))[0]
        assert (kept >> np.uint64(24) == np.array(whole["grams"], np.int64).view(np.uint64) >> np.uint64(24)).all()


def test_only_first_n_grams_are_stored(spark):
    df = spark.createDataFrame(families(8) + [(9_001, None), (9_002, " ")], "doc_id bigint, text string")
    whole = jaccard.gram_sets(df).cache()
    order = jaccard.order_of(df.select("text"))
    assert (order.places == jaccard.order_of(whole).places).all() and (order.cuts == jaccard.order_of(whole).cuts).all()
    kept = {r["doc_id"]: r for r in jaccard.gram_sets(df, order=order).collect()}
    for row in whole.collect():
        keys = order.keys(np.array(row["grams"], np.int64).view(np.uint64))
        count = row["n"] - jaccard.least_overlap(row["n"], jaccard.PERCENT) + 1 if row["n"] else 0
        found = jaccard._arrays(jaccard.pa.array([bytes(kept[row["doc_id"]]["grams"])]))[0]
        assert sorted((found >> np.uint64(24)).tolist()) == (keys[:count] >> np.uint64(24)).tolist()
        assert all(kept[row["doc_id"]][c] == row[c] for c in ("text_hash", "n", "set_id", "sketch"))
    whole.unpersist()
