import random
from collections import defaultdict

import corpus_cases as cases
import pytest
import regex
import xxhash

from prepwright.llm import components, simhash


def brute_fingerprint(text, shingle=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = regex.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprints_are_those_of_the_definition():
    rng = random.Random(2)
    texts = [t for _, t, *_ in cases.documents()] + ["A b", "a b c d", "É x y\x0bz Q w", "a b c　d e f g"]
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in range(12)]
    assert all(simhash.fingerprint(t) == brute_fingerprint(t) for t in texts)
    assert simhash.fingerprint("a b c d e", shingle=2) == brute_fingerprint("a b c d e", 2)


def test_counting_in_blocks_changes_nothing(monkeypatch):
    text = cases.sentence(random.Random(4), 1_000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("radius,tile", [(4, 4096), (4, 3), (0, 5), (2, 50)])
def test_links_connect_what_all_pairs_connect(spark, radius, tile):
    rng = random.Random(radius + tile)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            near = centre
            for _ in range(rng.randint(0, 6)):
                near ^= 1 << rng.randrange(64)
            values.add(near)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "value bigint"), radius, tile)
    found = {r["value"]: r["root"] for r in components.components(links).collect()}
    wanted = brute_roots(signed, radius)
    assert {v: found.get(v, v) for v in signed} == wanted


def test_forest_keeps_components(monkeypatch, spark):
    monkeypatch.setattr(simhash, "LINKS", 4)
    test_links_connect_what_all_pairs_connect(spark, 4, 20)


def test_components_of_chains_stars_and_circles(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (201, 200)]
    found = {r["value"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents(spark):
    rows = cases.documents()
    docs = cases.clashing(cases.frame(spark, rows), "fingerprint", "value", "key", "first", "root")
    found = simhash.near_duplicates(docs).collect()
    prints = {t: brute_fingerprint(t) for _, t, *_ in rows}
    roots = brute_roots(set(prints.values()), 4)
    least = defaultdict(lambda: None)
    for i, t, *_ in rows:
        r = roots[prints[t]]
        if i is not None:
            least[r] = i if least[r] is None else min(least[r], i)
    wanted = sorted((str(i), f"{prints[t]:016x}", least[roots[prints[t]]]) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == wanted


def test_rows_of_one_id_are_linked_and_empty_tables_stay_empty(spark):
    rng = random.Random(8)
    a, b, c = (cases.sentence(rng, 30) for _ in range(3))
    found = simhash.near_duplicates(spark.createDataFrame([(5, a), (5, b), (3, b), (9, c)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(3, 3), (5, 3), (5, 3), (9, 9)]
    assert simhash.near_duplicates(cases.frame(spark, [])).count() == 0
