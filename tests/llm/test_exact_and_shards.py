import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_cases as cases
import pytest
from pyspark.sql import functions as F

from prepwright.llm import common, exact_dedup, sharding


def test_exact_duplicates_agree_with_brute_force(spark):
    docs = cases.clashing(cases.frame(spark), "size", "prefix", "alive", "bits", "slice")
    for prefix in (1, 256):
        found = exact_dedup.exact_duplicates(docs, prefix_chars=prefix, digests=True).collect()
        groups = defaultdict(list)
        for doc_id, text, *_ in cases.documents():
            groups[text or ""].append(doc_id)
        wanted = Counter()
        for text, ids in groups.items():
            named = [i for i in ids if i is not None]
            keep = max(named) if named else None
            for k, i in enumerate(ids):
                wanted[i, keep, len(ids), i == keep and keep not in ids[:k], hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(map(tuple, found)) == wanted


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "x"), (1, "x"), (None, "z"), (None, "z"), (None, "x"), (2, "y"), (2, "other"), (3, None), (3, ""), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for df in (docs, docs.withColumn("doc_id", F.col("doc_id").cast("string"))):
        found = exact_dedup.exact_duplicates(df, digests=True).collect()
        kept = Counter(r["text_sha256"] for r in found if r["kept"])
        assert len(found) == len(rows) and set(kept.values()) == {1} and len(kept) == 5
        assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
        name = str if df is not docs else int
        assert {(r["keep_id"], r["group_size"]) for r in found} == {(None, 2), *((name(i), n) for i, n in ((1, 3), (2, 2), (2, 1), (3, 2)))}


def test_full_reads_only_where_length_and_prefix_repeat(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "xyz"), (4, "long text"), (5, "abc")], "doc_id bigint, text string")
    digests = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_duplicates(docs, prefix_chars=2).collect()}
    assert {k for k, v in digests.items() if v} == {1, 2, 5}


def test_bitmap_has_every_shared_key(spark):
    keys = spark.range(50_000).select((F.col("id") % 30_000).alias("k"))
    alive = common.held(spark.range(60_000).withColumnRenamed("id", "k"), exact_dedup.surviving(keys), exact_dedup.SKETCH_BITS, ["k"], "alive")
    let_in = {r["k"] for r in alive.filter("alive").collect()}
    assert set(range(20_000)) <= let_in and len(let_in) < 20_400


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_join_few_is_the_plain_join(spark, how):
    left = spark.createDataFrame([(i % 50, i % 7, f"t{i}") for i in range(200)] + [(None, 3, "n"), (None, 4, "n")], "doc_id bigint, text_hash bigint, t string")
    right = common.stored(spark.createDataFrame([(i, i % 7, f"r{i}") for i in range(0, 60, 3)] + [(None, 3, "rn")], "doc_id bigint, text_hash bigint, r string"), "right")
    few, plain = (f(left, right, how) for f in (common.join_few, common.join_rows))
    assert few.columns == plain.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, plain.collect())) != []
    none = common.stored(right.limit(0), "none")
    assert common.join_few(left, none, how).count() == {"inner": 0, "left": 202, "left_anti": 202}[how]


@pytest.mark.parametrize("apply", [exact_dedup.exact_duplicates, sharding.sharded])
def test_empty_table(spark, apply):
    assert apply(cases.frame(spark, [])).count() == 0


def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(6_000)] + [(None, None), (3, "again"), (3, "again")]
    docs = cases.clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), "shard", "_group", "slot")
    found = sharding.sharded(docs, 24).collect()
    assert len(found) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(150 < len(s) < 350 for s in slots.values())
    moved = sum(r["grown_shard"] == 24 for r in found)
    assert 150 < moved < 350
    # The id and the number of shards decide: other rows, other texts, the same shards.
    again = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs.filter("doc_id % 5 = 0").withColumn("text", F.lit("y")), 24).collect()}
    assert all(again[r["doc_id"]] == r["shard"] for r in found if r["doc_id"] is not None and r["doc_id"] % 5 == 0)


@pytest.mark.parametrize("shards", [1, 3, 10, 13, 23, 26])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    docs = spark.range(600).selectExpr("id as doc_id", "'' as text")
    found = sharding.sharded(docs, shards).collect()
    assert {r["shard"] for r in found} <= set(range(shards))
    moved = {r["grown_shard"] for r in found if r["shard"] != r["grown_shard"]}
    assert moved == {shards}


def test_a_grown_tree_changes_no_other_weight():
    for shards in range(1, 101):
        tree = sharding.standard_tree(shards)
        grown = sharding.one_more(tree)
        assert grown.children[:-1] == tree.children and sorted(sharding._shards(grown)) == list(range(shards + 1))


def test_weights_confine_movement(spark):
    def tree(weight):
        racks = [sharding.Node(f"rack{k}", tuple(sharding.Node(f"s{k}{i}", shard=2 * k + i, own_weight=weight if (k, i) == (2, 1) else 1.0)
                                                for i in range(2))) for k in range(4)]
        return sharding.Node("root", (sharding.Node("region0", tuple(racks[:2])), sharding.Node("region1", tuple(racks[2:]))))
    docs = spark.range(8_000).selectExpr("id as doc_id", "'' as text")
    found = sharding.sharded(docs, tree=tree(1.0), grown=tree(3.0)).collect()
    assert all(r["shard"] == r["grown_shard"] or r["grown_shard"] in (4, 5, 6, 7) for r in found)   # into region1 only
    share = Counter(r["grown_shard"] for r in found)
    assert abs(share[5] / 8_000 - 0.3) < 0.03
