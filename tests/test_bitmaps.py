from pyspark.sql import functions as F

from prepwright.operators.bitmaps import bitmap, bits_for, possible


def test_no_key_is_lost_and_few_strangers_pass(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    bits = bits_for(5000)
    held = bitmap(keys, "key", bits)
    assert held.count() == bits // 32768
    mixed = spark.range(105_000).select("id", F.xxhash64("id").alias("key"))
    found = possible(mixed, "key", held, bits)
    assert found.columns == ["id", "key"]
    assert found.filter("id < 5000").count() == 5000
    assert found.filter("id >= 5000").count() < 100_000 / 8
    assert possible(mixed, "key", bitmap(keys.limit(0), "key", bits), bits).count() == 0
