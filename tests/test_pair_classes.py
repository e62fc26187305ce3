import random

from prepwright.operators import fuzzy


def test_all_pairs_follow_from_classes(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = []
    for i in range(150):
        picked = [rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(3)]
        rng.shuffle(picked)
        rows.append((i, (" " * rng.randint(1, 2)).join(picked), rng.choice([None, "b a", "a b", "a  b", "zz"])))
    df = spark.createDataFrame(rows, "id long, t string, u string")
    wanted = {(r["column"], frozenset((r["value_a"], r["value_b"]))): r["score"] for r in fuzzy.fuzzy_pairs(df, 85, order_by=["id"]).collect()}
    members, links = fuzzy.pair_classes(df, 85, order_by=["id"])
    members, classes = members.collect(), {}
    for r in members:
        classes.setdefault((r["column"], r["representative"]), []).append(r["value"])
    found = {(c, frozenset((x, y))): 100 for (c, _), values in classes.items() for x in values for y in values if x < y}
    assert links.count() < len(wanted) / 2
    for r in links.collect():
        for x in classes[r["column"], r["value_a"]]:
            for y in classes[r["column"], r["value_b"]]:
                found[r["column"], frozenset((x, y))] = r["score"]
    assert found == wanted
    for r in members:
        assert r["n_links"] == sum(c == r["column"] and r["value"] in pair for c, pair in wanted)
    empty = fuzzy.pair_classes(df.select("id"), 85)
    assert empty[0].count() == empty[1].count() == 0
