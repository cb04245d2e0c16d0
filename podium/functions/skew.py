"""Joins of many rows to one row per key, where a single key may hold a large share of the many rows.

AQE splits a skewed partition only where both sides of a sort-merge join come straight from a shuffle. It
cannot where the "one" side was just aggregated on the join key, which is the usual case in the folds. The
join is then salted here, for the hot keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.store import stored

# Rows of one key that a task can take; a key with more is spread over as many tasks as needed.
HOT_ROWS = 1_000_000
# Longest list of hot keys that is broadcast.
BROADCAST_KEYS = 1_000_000
SALT = "_salt"
# Places for rows with a NULL key.
NULL_SALTS = 4096


def hot_keys(many: DataFrame, key: str, hot_rows: int = HOT_ROWS, weight: Column | None = None) -> DataFrame:
    """The keys with more than `hot_rows` rows, and the number of salts each gets, stored. With `weight`, rows
    count that much. The count combines before its shuffle."""
    rows = F.count("*") if weight is None else F.sum(weight)
    counts = many.groupBy(key).agg(rows.alias("_n")).where(F.col("_n") > hot_rows)
    return stored(counts.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")), "hot-keys")


def checked(hot: DataFrame) -> DataFrame:
    """Broadcast a stored list if a count shows that it is short; Spark joins a longer one as it sees fit."""
    return F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot


def salt(many: DataFrame, one: DataFrame, hot: DataFrame, key: str, spread: str) -> tuple[DataFrame, DataFrame]:
    """Add the column `_salt` to both sides: rows of a hot key are spread by the column `spread` on the many
    side and repeated per salt on the other. All other rows have salt 0, but those with a NULL key, which
    match nothing and may be many, are spread as well."""
    n = F.coalesce("_salts", F.lit(1))
    spread_rows = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(n)
    hot = checked(hot)
    many = many.join(hot, key, "left").withColumn(
        SALT, F.pmod(F.xxhash64(spread), spread_rows).cast("int")
    )
    one = one.join(hot, key, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), n - 1)))
    return many.drop("_salts"), one.drop("_salts")


def salted_join(many: DataFrame, one: DataFrame, hot: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """Join on `key`, hot keys spread out."""
    left, right = salt(many, one, hot, key, spread)
    return left.join(right, [key, SALT], how).drop(SALT)


def nullable_left_join(many: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on a key that is NULL in many rows, which would all meet in one partition."""
    place = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(NULL_SALTS)).cast("int")).otherwise(0)
    return many.withColumn(SALT, place).join(one.withColumn(SALT, F.lit(0)), [key, SALT], "left").drop(SALT)
