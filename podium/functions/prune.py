"""Which rows can meet a small table, before they are shuffled to it: a Bloom filter as a table of 64-bit words.

A key sets a few bits within one word, so looking it up is one join on the row its word stands in, and the table of
words is bounded and broadcast. Keys that were never put in may be found (about one in a hundred); none that
was is missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.nest import small_list
from podium.functions.store import forget, stored

# Keys a word holds on average, bits a key sets, and the most words that are broadcast (34 MB).
KEYS_PER_WORD = 5
KEY_BITS = 4
LONGEST_FILTER = 1 << 22
# Words in a row of the table. As a row of its own a word takes the driver 44 bytes, and its place in the hash table.
ROW_WORDS = 512
MAY_MEET = "_may_meet"


def key_place(key: list[str], n_words: int) -> tuple[Column, Column]:
    """The word of a key and the bits it sets there. Equal keys, nulls included, have the same."""
    mixed, one = F.xxhash64(*key, F.lit(1)), F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftright(mixed, 6 * i).bitwiseAND(63).cast("int")) for i in range(KEY_BITS)]
    return F.pmod(F.xxhash64(*key), F.lit(n_words)), reduce(lambda x, y: x.bitwiseOR(y), bits)


def key_filter(rows: DataFrame, key: list[str], longest: int = LONGEST_FILTER) -> tuple[DataFrame, int] | None:
    """The filter of the keys of `rows`: its words, `ROW_WORDS` to a row (`_row`, `_words`), stored, and how many there
    are. None if the keys are too many for a filter of `longest` words."""
    keys = stored(rows.select(key).distinct(), "filter-keys")
    n_words = max(1, -(-keys.count() // KEYS_PER_WORD))
    words = None
    if n_words <= longest:
        word, bits = key_place(key, n_words)
        placed = keys.select(word.alias("_word"), bits.alias("_bits"))
        # Words that no key set are there as well: a word is found by its place in its row.
        unset = rows.sparkSession.range(n_words).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_bits"))
        whole = placed.unionByName(unset).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
        whole = whole.withColumn("_row", F.expr(f"_word div {ROW_WORDS}"))
        words = stored(small_list(whole, "_row", "_word", F.col("_bits"), "_words"), "filter"), n_words
    forget(keys)
    return words


def looked_up(rows: DataFrame, words: tuple[DataFrame, int], key: list[str]) -> DataFrame:
    """Add the column `_may_meet`: false only where no key of the filter equals the row's."""
    table, n_words = words
    word, bits = key_place(key, n_words)
    placed = rows.withColumn("_word", word).withColumn("_mask", bits).withColumn("_row", F.expr(f"_word div {ROW_WORDS}"))
    set_bits = F.get("_words", F.pmod("_word", F.lit(ROW_WORDS)).cast("int"))
    found = F.coalesce(set_bits.bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return placed.join(F.broadcast(table), "_row", "left").withColumn(MAY_MEET, found).drop("_word", "_mask", "_row", "_words")
