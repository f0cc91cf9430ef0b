"""Shared helpers of the corpus operators: staging tables, join sides of a counted size, names that are free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.config import free_name, join_side, scratch_path, scratch_scope

__all__ = ["bloom_filter", "doc_crc", "free_name", "join_side", "scratch_path", "scratch_scope", "staged", "with_maybe", "without"]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


#: 64-bit words of a Bloom filter: 67 million bits, some 50 MB as a table in memory, whatever it holds.
BLOOM_WORDS = 1 << 20


def _word_and_mask(keys: list[Column], words: int) -> tuple[Column, Column]:
    """Which word of the filter a key belongs to, and its three bits there."""
    bits = F.xxhash64(*keys, F.lit(1))
    mask = None
    for at in (0, 6, 12):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, at).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.pmod(F.xxhash64(*keys), F.lit(words)), mask


def bloom_filter(keys: DataFrame, words: int = BLOOM_WORDS) -> DataFrame:
    """A Bloom filter of all columns of ``keys`` as a table (word, bits) of at most ``words`` rows, written to the shared folder."""
    word, mask = _word_and_mask([F.col(c) for c in keys.columns], words)
    return staged(keys.select(word.alias("word"), mask.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), "bloom")


def with_maybe(df: DataFrame, keys: list[str], bloom: DataFrame, output: str, words: int = BLOOM_WORDS) -> DataFrame:
    """Adds whether the filter may hold the row's key; the filter's size is bounded, so it is broadcast."""
    word, mask = _word_and_mask([F.col(k) for k in keys], words)
    own, other = free_name(df, "bloom_word"), free_name(df, "bloom_bits")
    joined = df.join(F.broadcast(bloom.select(F.col("word").alias(own), F.col("bits").alias(other))), word == F.col(own), "left")
    return joined.withColumn(output, F.coalesce(F.col(other).bitwiseAND(mask) == mask, F.lit(False))).drop(own, other)


def without(df: DataFrame, keys: list[str], chosen: DataFrame, everyone: DataFrame, direct_bytes: int = 8 << 20, words: int = BLOOM_WORDS) -> DataFrame:
    """The rows of a wide ``df`` whose keys aren't among ``chosen``; ``everyone`` has all keys that occur. Both are written tables of the keys alone.

    A small ``chosen`` is broadcast. Otherwise a first Bloom filter holds the chosen keys and a second one the other
    keys that the first one takes for chosen, which the key tables tell. What the first filter hasn't is kept, what
    only the first one has is gone, and no more than the few rows that both have are shuffled to be told apart.
    """
    chosen = chosen.select(*keys)
    same = lambda side: [df[k].eqNullSafe(side[k]) for k in keys]
    if chosen.count() * (16 + 32 * len(keys)) <= direct_bytes:
        small = F.broadcast(chosen)
        return df.join(small, same(small), "left_anti")
    first = bloom_filter(chosen, words)
    wrong = with_maybe(everyone.select(*keys), keys, first, "maybe", words).where("maybe").drop("maybe")
    wrong = wrong.join(chosen.hint("shuffle_hash"), keys, "left_anti")
    second = bloom_filter(wrong, words)
    a, b = free_name(df, "maybe_a"), free_name(df, "maybe_b")
    marked = with_maybe(with_maybe(df, keys, first, a, words), keys, second, b, words)
    unsure = marked.where(F.col(a) & F.col(b)).drop(a, b)
    side = chosen.hint("merge")
    return marked.where(~F.col(a)).drop(a, b).unionByName(unsure.join(side, [unsure[k].eqNullSafe(side[k]) for k in keys], "left_anti"))
