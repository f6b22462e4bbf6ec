"""Bloom filters as small tables: rows that cannot match a list are left out before anything is shuffled.

A filter is blocked: a key's first hash names a block of 32,768 bits, the others its bits there, so
testing a row is one lookup and a few bit tests.  Building is an aggregate of bit-wise ors, so filters of the
same number of blocks merge by adding their rows.  The number of blocks follows the list's count;
a filter beyond ``MAX_BYTES`` is not made, and all rows go on to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768
BITS_PER_KEY = 12
HASHES = 4
MAX_BYTES = 64 << 20


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, -(-keys * bits_per_key // BITS))


def _positions(key: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(BITS)).cast("int") for i in range(HASHES)])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_words(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, word, bits): the non-zero 64-bit words of a filter; several filters merge by union and ``merge_words``."""
    placed = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), F.explode(_positions(F.col(key))).alias("p"))
    bits = placed.select("block", F.floor(F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, p % 64)").alias("bits"))
    return merge_words(bits)


def merge_words(words: DataFrame) -> DataFrame:
    return words.groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))


def may_contain(rows: DataFrame, words: DataFrame, key: Column, blocks: int, out: str) -> DataFrame:
    """Rows with the boolean ``out``: false if their key is certainly not in the filter, or null."""
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))
    held = held.select(F.col("block").alias("__block"), every.alias("__words"))
    hit = F.lit(True)
    for i in range(HASHES):
        p = F.pmod(F.xxhash64(F.lit(i), F.col("__key")), F.lit(BITS)).cast("int")
        word = F.get("__words", F.floor(p / 64).cast("int"))
        hit = hit & (F.getbit(word, p % 64) == 1)
    # The caller has checked the filter's size.
    joined = rows.withColumn("__key", key).withColumn("__b", _block(F.col("__key"), blocks)).join(
        F.broadcast(held), F.col("__b") == F.col("__block"), "left"
    )
    found = F.coalesce(hit & F.col("__key").isNotNull(), F.lit(False))
    return joined.withColumn(out, found).drop("__key", "__b", "__block", "__words")
