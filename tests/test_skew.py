from collections import Counter

from pyspark.sql import functions as F

from podium.functions.skew import hot_keys, nullable_left_join, salt, salted_join
from podium.session import configure


def test_salted_join_equals_the_plain_join(spark):
    many = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN id % 50 END AS key", "id AS value"
    )
    one = spark.range(40).selectExpr("id AS key", "id * 10 AS info")
    hot = hot_keys(many.where("key IS NOT NULL"), "key", 100)
    assert [(r.key, r._salts) for r in hot.collect()] == [(1, 11)]
    for how in ("inner", "left"):
        rows = lambda df: Counter(tuple(r) for r in df.select("key", "value", "info").collect())
        assert rows(salted_join(many, one, hot, "key", "value", how)) == rows(many.join(one, "key", how))
        if how == "left":
            assert rows(nullable_left_join(many, one, "key", "value")) == rows(many.join(one, "key", how))
    left, right = salt(many, one, hot, "key", "value")
    spread = {r.key: r.n for r in left.groupBy("key").agg(F.countDistinct("_salt").alias("n")).collect()}
    # The hot key has its salts, rows without a key are spread, every other key keeps to one place.
    assert spread[1] == 11 and spread[None] > 500
    assert {n for key, n in spread.items() if key not in (1, None)} == {1}
    assert right.count() == 39 + 11


def test_a_long_list_of_hot_keys_is_not_broadcast(spark, monkeypatch):
    from podium.functions import skew

    hot = hot_keys(spark.range(100).selectExpr("id % 3 AS key"), "key", 10)
    plan = lambda: skew.checked(hot)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 2)
    assert "broadcast" not in plan()


def test_weighted_hot_keys(spark):
    rows = spark.createDataFrame([(1, 6), (1, 6), (2, 6)], "key BIGINT, n BIGINT")
    assert [tuple(r) for r in hot_keys(rows, "key", 10, F.col("n")).collect()] == [(1, 2)]


def test_shuffles_are_cut_small_whatever_the_session_says(spark):
    """With 64 MB a task, the default, sorts and aggregates of shuffled ids spill at a gigabyte of input."""
    fresh = spark.newSession()
    fresh.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    assert configure(fresh).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
