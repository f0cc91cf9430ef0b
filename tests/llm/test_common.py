import random

import pytest

from textloom.llm import common as C


@pytest.mark.parametrize("words", [1, 8, 1 << 12])
def test_without_is_exact_whatever_the_filter(spark, words):
    rng = random.Random(words)
    rows = [(i % 900, f"d{rng.randrange(5)}", "wide text") for i in range(1500)] + [(None, "d1", "x")]
    df = spark.createDataFrame(rows, "a long, b string, bloom_word string").repartition(6)
    picked = {(a, b) for a, b, _ in rows if rng.random() < 0.3 and a is not None}
    chosen = C.staged(spark.createDataFrame(sorted(picked), "a long, b string"), "chosen")
    everyone = C.staged(df.select("a", "b"), "everyone")
    want = sorted(str(r) for r in rows if (r[0], r[1]) not in picked)
    for direct in (0, 8 << 20):
        got = C.without(df, ["a", "b"], chosen, everyone, direct, words)
        assert got.columns == df.columns and sorted(str(tuple(r)) for r in got.collect()) == want
    assert C.without(df.limit(0), ["a", "b"], chosen, everyone, 0, words).count() == 0


def test_bloom_filter_is_bounded_and_mostly_right(spark):
    keys = spark.range(3000).withColumnRenamed("id", "k")
    bloom = C.bloom_filter(keys.where("k < 1000"), 256)
    assert bloom.count() <= 256
    held = {r.k for r in C.with_maybe(keys, ["k"], bloom, "m", 256).where("m").collect()}
    assert set(range(1000)) <= held and len(held) < 1500


def test_join_side_and_names(spark):
    table = C.staged(spark.range(100), "t")
    assert "broadcast" in str(C.join_side(table, 8)._jdf.queryExecution().logical()).lower()
    assert "shuffle_hash" in str(C.join_side(table, 8, 100)._jdf.queryExecution().logical()).lower()
    assert C.free_name(spark.createDataFrame([(1, 2)], "Fp int, _fp int"), "fp") == "__fp"
