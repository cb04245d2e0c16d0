"""Deterministic unique ids: the same natural key gives the same id on every retry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.session import shared_folder


# Rows of two columns a broadcast may have, some tens of megabytes.
BROADCAST_ROWS = 500_000


def hashed_id(key: Column, bits: int, salt: int = 0) -> Column:
    """The first `bits` of the key's md5 as a number."""
    if bits % 4 or not 4 <= bits <= 60:
        raise ValueError("bits must be a multiple of 4, from 4 to 60")
    digest = F.md5(F.concat(key, F.lit(f"#{salt}")))
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("bigint")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast rows that were counted and are few; many are joined by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def assign_ids(
    df: DataFrame, key: str, bits: int = 48, taken: DataFrame | None = None, name: str = "id", max_rounds: int = 50
) -> DataFrame:
    """Add a unique id column hashed from the unique text column `key`.

    Of the keys hashed to one free id the lowest keeps it. The others, and those hashed to a taken id (the
    single column of `taken`), draw again with the next salt, away from every id drawn first. One shuffle
    finds the contested ids. They are few, so they and the redrawn ids are counted and broadcast, and the
    large side is only scanned again; every other id stays a plain expression.
    """
    shared_folder(df.sparkSession)
    first = df.select(F.col(key).alias("_key"), hashed_id(F.col(key), bits).alias("_id"))
    claims = first.withColumn("_taken", F.lit(False))
    used = [first.select("_id")]
    if taken is not None:
        used.append(taken.select(F.col(taken.columns[0]).cast("bigint").alias("_id")))
        claims = claims.unionByName(used[1].select(F.lit(None).cast("string").alias("_key"), "_id", F.lit(True).alias("_taken")))
    contested = (
        claims.groupBy("_id")
        .agg(F.min("_key").alias("_owner"), F.count("_key").alias("_n"), F.max("_taken").alias("_taken"))
        .where("_n > 1 OR (_n = 1 AND _taken)")
        .checkpoint()
    )
    n = contested.count()
    if n == 0:
        return df.withColumn(name, hashed_id(F.col(key), bits))
    pending = first.join(_small(contested, n), "_id").where("_taken OR _key <> _owner").select("_key").checkpoint()
    left = n_redrawn = pending.count()

    redrawn: list[DataFrame] = []
    while left:
        salt = len(redrawn) + 1
        if salt > max_rounds:
            raise ValueError(f"no free {bits}-bit ids left after {max_rounds} rounds")
        drawn = pending.select("_key", hashed_id(F.col("_key"), bits, salt).alias("_id"))
        everything = reduce(DataFrame.union, used)
        hits = everything.join(_small(drawn.select("_id"), left), "_id", "left_semi").distinct()
        won = drawn.join(hits, "_id", "left_anti").groupBy("_id").agg(F.min("_key").alias("_key")).checkpoint()
        redrawn.append(won)
        used.append(won.select("_id"))
        pending = pending.join(won.select("_key"), "_key", "left_anti").checkpoint()
        left = pending.count()

    changed = reduce(DataFrame.unionByName, redrawn).select(F.col("_key").alias(key), F.col("_id").alias("_redrawn"))
    return (
        df.join(_small(changed, n_redrawn), key, "left")
        .withColumn(name, F.coalesce("_redrawn", hashed_id(F.col(key), bits)))
        .drop("_redrawn")
    )
