"""Benchmark decontamination by spaced seeds. Native DataFrame operations only.

A spaced seed is a fixed mask over SPAN consecutive words: the words at its open places are hashed, the others
may differ. Hashes of all windows of the benchmark and of all documents are joined; each hit names a document,
a benchmark item and the offset between them. At every such offset the words around the hit are compared one
by one, and the passage counts if enough of them agree.

The benchmark is the small side: its hashes are broadcast if a count shows that they fit, else both sides are
shuffled by hash. Hits are reduced to distinct (text, item, offset) before the texts are joined again, so copies
are verified once, a passage that many documents share costs each a few rows, and no pair of documents meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import NOT_WORD, stored

# Open places of the masks. Every passage that `enough` accepts hits one, wherever its other words are.
MASKS = ((0, 1, 4, 6, 8), (1, 3, 4, 7, 8), (0, 1, 3, 6, 7), (0, 2, 6, 7, 8), (1, 2, 4, 5, 8), (0, 3, 4, 5, 6))
SPAN = 9
# Words compared around a hit, and how many of them must agree.
WINDOW = 13
AGREE = 10
# Items with fewer words than the window must agree in all but one fifth of their words, and have this many.
SHORTEST = SPAN
BROADCAST_HASHES, BROADCAST_KEYS = 1_000_000, 1_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text; a null text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def windows(words: Column) -> Column:
    """All windows of SPAN words, one struct each with the words as fields w0, w1, ..."""
    n = F.size(words) - (SPAN - 1)
    slices = [F.slice(words, i + 1, F.greatest(n, F.lit(0))) for i in range(SPAN)]
    return F.when(n > 0, F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(slices)]))


def seed_hashes(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, position, mask, hash) for every window and mask. The windows are exploded first: their hashes
    are then plain expressions of the generated code."""
    spread = rows.select(*keys, F.posexplode(windows(F.col(words))).alias("position", "_window"))
    fields = [F.col("_window").getField(f"w{i}") for i in range(SPAN)]
    masked = F.array(*[F.xxhash64(F.lit(m), *[fields[i] for i in mask]) for m, mask in enumerate(MASKS)])
    return spread.select(*keys, "position", F.explode(masked).alias("hash"))


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart: equal texts have the same passages and are searched under one key."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, first_word, n_words, n_agree): every place where a text has a passage of the benchmark, at
    its best window, once for all copies of the text."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("item"))
    items = stored(items.dropDuplicates(["item_id", "item"]).withColumn("item_row", F.monotonically_increasing_id()), "leak-items")
    seeds = seed_hashes(items, ["item_row"], "item").select("item_row", F.col("position").alias("item_at"), "hash")
    seeds = stored(seeds, "leak-seeds")
    small = F.broadcast if seeds.count() <= BROADCAST_HASHES else (lambda df: df)
    hashed = docs.select(text_key(F.col("text")).alias("key"), word_hashes(F.col("text")).alias("words"))
    hits = seed_hashes(hashed, ["key"], "words").join(small(seeds), "hash")
    offsets = hits.select("key", "item_row", (F.col("position") - F.col("item_at")).alias("shift")).distinct()
    offsets = stored(offsets, "leak-hits")
    texts = with_keys(docs.select(text_key(F.col("text")).alias("key"), "text"), offsets)
    texts = texts.groupBy("key").agg(F.first("text").alias("text")).select("key", word_hashes(F.col("text")).alias("words"))
    found = offsets.join(items, "item_row").join(texts, "key")
    return stored(best_window(found).where(enough(F.col("n_agree"), F.col("n_words"))), "leak-passages")


def with_keys(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows whose key the stored table has. A counted list of keys goes to the rows, so that copies of a text
    can be combined before any shuffle; a longer one meets them by shuffle."""
    keys = stored(table.select("key").distinct(), "leak-keys")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")


def enough(agree: Column, compared: Column) -> Column:
    """Whether so many agreeing words among the compared ones are a passage."""
    return F.when(compared >= WINDOW, agree >= AGREE).otherwise((compared >= SHORTEST) & (agree * 5 >= compared * 4))


def best_window(found: DataFrame) -> DataFrame:
    """Compare item and document word by word at the offset and take the best window, the first of equals."""
    lowest = F.greatest(F.lit(0), -F.col("shift"))
    end = F.least(F.size("item"), F.size("words") - F.col("shift"))
    inside = end - lowest
    mine = F.slice("item", lowest + 1, inside)
    theirs = F.slice("words", lowest + F.col("shift") + 1, inside)
    same = F.zip_with(mine, theirs, lambda a, b: (a == b).cast("int"))
    size = F.least(F.lit(WINDOW), F.size("_same"))
    scores = F.transform(
        F.sequence(F.lit(1), F.size("_same") - size + 1),
        lambda i: F.struct(F.aggregate(F.slice("_same", i, size), F.lit(0), lambda a, x: a + x).alias("agree"), (-i).alias("at")),
    )
    rows = found.select("key", "item_id", "shift", lowest.alias("_low"), same.alias("_same"))
    best = rows.withColumn("_best", F.array_max(scores)).withColumn("n_words", size)
    return best.select(
        "key", "item_id", (F.col("_low") + F.col("shift") - F.col("_best.at") - 1).cast("bigint").alias("first_word"),
        F.col("n_words").cast("bigint").alias("n_words"), F.col("_best.agree").cast("bigint").alias("n_agree"),
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item it has a passage of: (doc_id, item_id, n_places, n_agree, n_words,
    first_word), with the best place by agreeing words, then the first.

    Null or short texts (fewer than SPAN words) have no passage and no row. Different texts of one doc_id are
    reported together, equal rows once; items with a null id are reported with a null id. Extra columns are
    ignored; empty tables give no rows.
    """
    found = passages(docs, benchmark)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    named = with_keys(rows, found).distinct().join(found, "key")
    best = F.max(F.struct("n_agree", (-F.col("first_word")).alias("_at"), "n_words"))
    return named.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_places"), best.alias("_best")).select(
        "doc_id", "item_id", "n_places", "_best.n_agree", "_best.n_words", (-F.col("_best._at")).alias("first_word")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a passage of the benchmark, all columns kept."""
    leaked = stored(passages(docs, benchmark).select("key").distinct(), "leak-keys")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    clean = docs.select(doc, text_key(F.col("text")).alias("key")).join(leaked, "key", "left_anti")
    return clean.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
