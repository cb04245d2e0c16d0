"""Mixing sources to target weights by capped water-filling, native DataFrame operations only.

Every source has a size (words of its documents) and a weight. All sources share the total of all sizes in
proportion to their weights, but no source is repeated more than `max_epochs` times: sources above that are
clamped, their excess goes to the others by weight, again until none is above. A source with target t and
size s takes each document floor(t / s) times, and once more the documents that come first in a seeded
order, up to the place where their sizes come nearest to the fractional rest.

Sources are aggregated before any shuffle, so a hot source is a few rows per map task. The cut of the seeded
order is found by three histograms of 11, 11 and 10 bits of a 32-bit hash; only counters are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import count_words, free_name, stored

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
# Plans of more sources than this are joined by a shuffle, with every source spread over SALTS places.
BROADCAST_SOURCES = 100_000
SALTS = 64
# Bits of the hash that each of the three histograms splits.
LEVELS = (11, 11, 10)
LONGEST_ROUNDS = 100


def draw(seed: int, doc_id: Column) -> Column:
    """32 bits of a seeded hash: the place of a document in the order of its source. Rows of one id share it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last. Each range of names is numbered by itself, then shifted."""
    parts = stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()),
        "mix-sources",
    )
    by_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    shifts = shifts.select("_part", F.coalesce(F.sum("_n").over(by_part), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("_place", place).join(shifts, "_part").select(
        "source", "source_size", (F.col("_place") + F.col("_shift") - 1).alias("rank")
    )


def water_fill(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets (source, source_size, weight, target) of a table (source, source_size) with one row a source.

    Only sums come to the driver, one pair a round. A round clamps every source above its cap; the level
    rises from round to round, so a clamped source stays clamped and no source is read twice into the sums.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    table = stored(ranked(sources).select("source", "source_size", weight.alias("weight"), cap.alias("_cap")), "mix-caps")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, None
    for _ in range(LONGEST_ROUNDS):
        above = F.col("_cap") < F.col("weight") * F.lit(level)
        n, capped, free = table.agg(
            F.sum(above.cast("bigint")), F.sum(F.when(above, F.col("_cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - capped) / free
    else:  # many sources, each round clamps few: the level by one sorted pass over sums of equal ratios
        level = sorted_level(table, total)
    return table.select(
        "source", "source_size", "weight", F.least("_cap", F.col("weight") * F.lit(level)).alias("target")
    )


def sorted_level(table: DataFrame, total: float) -> float:
    """The level where clamping ends, from the sums of caps and weights below each ratio of cap to weight."""
    ratios = table.groupBy((F.col("_cap") / F.col("weight")).alias("_ratio")).agg(
        F.sum("_cap").alias("_caps"), F.sum("weight").alias("_weights")
    )
    before = Window.orderBy("_ratio").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_ratio").rowsBetween(0, Window.unboundedFollowing)
    levels = ratios.select(
        "_ratio", ((F.lit(float(total)) - F.coalesce(F.sum("_caps").over(before), F.lit(0.0))) / F.sum("_weights").over(after)).alias("_level")
    )
    return levels.where(F.col("_level") <= F.col("_ratio")).agg(F.min_by("_level", "_ratio")).first()[0]


def join_plan(rows: DataFrame, plan: DataFrame, broadcast: bool) -> DataFrame:
    """Left join by source (null equals null): a counted broadcast, else salted."""
    if broadcast:
        same = F.col("rows.source").eqNullSafe(F.col("plan.source"))
        joined = rows.alias("rows").join(F.broadcast(plan).alias("plan"), same, "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_draw"), F.lit(SALTS)).cast("int"))
        plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = F.col("rows.source").eqNullSafe(F.col("plan.source")) & (F.col("rows._salt") == F.col("plan._salt"))
        joined = rows.alias("rows").join(plan.alias("plan"), same, "left").drop("_salt")
    return joined.select("rows.*", *[F.col(f"plan.{c}") for c in plan.columns if c not in ("source", "_salt")])


def mix_plan(sized: DataFrame, weights=WEIGHTS, max_epochs=MAX_EPOCHS) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, cut) by source, stored, and whether it is small enough to broadcast.

    `sized` has (source, size, _draw). A document is taken `whole` times, and once more if its draw is below `cut`.
    """
    histogram = stored(
        sized.groupBy("source", F.shiftright("_draw", 32 - LEVELS[0]).alias("_bin")).agg(F.sum("size").alias("_sum")), "mix-bins"
    )
    filled = water_fill(histogram.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(epochs)
    plan = stored(
        filled.select(
            "source", "source_size", "target", whole.cast("int").alias("whole"),
            ((epochs - whole) * F.col("source_size")).alias("_left"), F.lit(0).cast("bigint").alias("_from"),
        ),
        "mix-plan",
    )
    small = plan.count() <= BROADCAST_SOURCES
    # A row whose bin fills up the rest ends the search of its source in that bin, one level down.
    running = Window.partitionBy("source").orderBy("_bin")
    shift = 32
    for bits in LEVELS:
        shift -= bits
        if shift < 32 - LEVELS[0]:
            inside = join_plan(sized, plan.select("source", "_from"), small)
            inside = inside.where(F.shiftright("_draw", shift + bits) == F.shiftright("_from", shift + bits))
            histogram = inside.groupBy("source", F.shiftright("_draw", shift).alias("_bin")).agg(F.sum("size").alias("_sum"))
        sums = histogram.withColumn("_upto", F.sum("_sum").over(running)).alias("rows")
        known = plan.select("source", "_left").alias("plan")
        both = sums.join(known, F.col("rows.source").eqNullSafe(F.col("plan.source"))).select("rows.*", "_left")
        fits = F.col("_upto") <= F.col("_left")
        cuts = both.groupBy("source").agg(
            F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0)).alias("_used"),
            F.min(F.when(~fits, F.col("_bin"))).alias("_cut"),
            F.min(F.when(~fits, F.col("_upto"))).alias("_over"),
        )
        joined = plan.alias("plan").join(cuts.alias("cuts"), F.col("plan.source").eqNullSafe(F.col("cuts.source")), "left")
        full = F.lit(1 << 32).cast("bigint")
        # No bin beyond the rest: every document of the range fits, and the cut is the end of the range.
        # On the last level the draw that crosses the rest is taken if that comes nearer to it.
        nearer = F.lit(shift == 0) & (F.col("_over") - F.col("_left") < F.col("_left") - F.col("_used"))
        start = F.when(F.col("_from") >= full, F.col("_from")).otherwise(
            F.shiftleft(F.col("_cut"), shift) + nearer.cast("bigint")
        )
        upper = F.col("_from") + F.lit(1 << (shift + bits)).cast("bigint")
        plan = stored(
            joined.select(
                "plan.source", "source_size", "target", "whole",
                (F.col("_left") - F.coalesce("_used", F.lit(0))).alias("_left"),
                F.coalesce(start, F.least(upper, full)).alias("_from"),
            ),
            "mix-plan",
        )
    return plan.select("source", "source_size", "target", "whole", F.col("_from").alias("cut")), small


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per document (doc_id, size, source_size, target, repeats, taken): how often the mix takes it.

    A null text has size 0, and so has an empty one; such documents are taken like others of their source but
    add no words. A source without words has target 0 and its documents are taken once. A null source is a source of its own. Rows of one doc_id share one draw: they are taken
    together. An empty table gives an empty result. Other columns are ignored.
    """
    sized = stored(
        docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), draw(seed, F.col("doc_id")).alias("_draw")),
        "mix-sizes",
    )
    plan, small = mix_plan(sized, weights, max_epochs)
    repeats = F.col("whole") + (F.col("_draw") < F.col("cut")).cast("int")
    return join_plan(sized, plan, small).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents as the mix takes them, one row a repetition, numbered from 1 in a column `repetition`.

    All input columns are kept; if one is named `repetition`, the number's name gets an underscore in front.
    """
    name = free_name(docs, "repetition")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(
        doc.alias("_doc"), "source", count_words(F.col("text")).alias("size"), draw(seed, F.col("doc_id")).alias("_draw")
    )
    plan, small = mix_plan(stored(sized.select("source", "size", "_draw"), "mix-sizes"), weights, max_epochs)
    repeats = F.col("whole") + (F.col("_draw") < F.col("cut")).cast("int")
    taken = join_plan(sized, plan, small).withColumn("_repeats", repeats).where(F.col("_repeats") > 0)
    copies = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats"))))
    return copies.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], F.col("_copy").alias(name))
