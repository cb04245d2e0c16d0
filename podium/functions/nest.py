"""Ordered lists nested in rows. A list that nothing bounds is cut into pages, in order; no item is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.skew import checked
from podium.functions.store import stored

# Items of a page: a longer list goes on in the next one.
PAGE_ITEMS = 500
# Items of long lists that a task sorts, about.
RANGE_ITEMS = 100_000


def paged_list(
    df: DataFrame, key: str, order: list[Column | str], item: Column, name: str, spread: list[str],
    page_items: int = PAGE_ITEMS, weight: Column | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """(key, page, pages, <name>): every item in exactly one row, pages numbered from 0. The pages of a key one after
    the other are its whole list in order; items of equal order are put by the columns `spread`.

    A list of up to `page_items` items (or of that weight) is one page. Longer ones are sorted by ranges, so that no
    task ever holds more than a range or a page of a key. `counts` (key, _n) says how many items, or what weight,
    each key has, where that is known without building `df`.
    """
    counts = counts if counts is not None else df.groupBy(key).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    long = counts.where(F.col("_n") > page_items).select(key, "_n")
    order = [*order, *spread]
    if long.isEmpty():
        return _single_pages(df, key, order, item, name)
    long = stored(long, "long-lists")
    listed = checked(long)
    short = _single_pages(df.join(listed, key, "left_anti"), key, order, item, name)
    weight = (F.lit(1) if weight is None else weight).alias("_weight")
    return short.unionByName(_pages(df.join(listed, key, "left_semi"), long, key, order, item, name, page_items, weight))


def _single_pages(df: DataFrame, key: str, order: list[Column | str], item: Column, name: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    lists = df.select(key, item.alias("_item"), rank.alias("_rank")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_item"))).alias("_list")
    )
    return lists.select(key, F.lit(0).alias("page"), F.lit(1).alias("pages"), F.transform("_list", lambda x: x["_item"]).alias(name))


def _pages(df: DataFrame, long: DataFrame, key: str, order: list[Column | str], item: Column, name: str, page_items: int,
           weight: Column) -> DataFrame:
    """Lists of any length. All rows are sorted by key and order over as many ranges as they need, which cuts long lists
    wherever a range ends; what the ranges before hold of a list is then added to the places inside a range."""
    ranges = 1 + long.agg(F.sum("_n")).first()[0] // RANGE_ITEMS
    rows = df.repartitionByRange(ranges, F.col(key), *order).sortWithinPartitions(key, *order)
    # The number of the range in the upper bits, the row's place in it in the lower ones.
    placed = rows.select(key, item.alias("_item"), weight, F.monotonically_increasing_id().alias("_at"))
    placed = stored(placed.withColumn("_range", F.shiftright("_at", 33)), "list-ranges")
    held = placed.groupBy(key, "_range").agg(F.sum("_weight").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(key, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    upto = F.sum("_weight").over(Window.partitionBy(key, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    page = F.floor((F.col("_before") + F.col("_upto") - F.col("_weight")) / page_items).cast("int")
    paged = placed.withColumn("_upto", upto).join(held, [key, "_range"]).select(key, page.alias("page"), "_at", "_item")
    paged = stored(paged, "list-pages")
    lists = paged.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("_at", "_item"))).alias("_list"))
    pages = paged.groupBy(key).agg((F.max("page") + 1).alias("pages"))
    return lists.join(pages, key).select(key, "page", "pages", F.transform("_list", lambda x: x["_item"]).alias(name))


def small_list(df: DataFrame, key: str, order: str, item: Column, name: str) -> DataFrame:
    """The same in one row for lists that a unique key bounds (options of a question, answers of a response)."""
    lists = df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), item.alias("_item")))).alias("_list")
    )
    return lists.select(key, F.transform("_list", lambda x: x["_item"]).alias(name))


def if_paged(page: str, pages: str) -> list[Column]:
    """`page` and `pages` for a JSON body; NULL (left out) where there is one page."""
    several = F.col(pages) > 1
    return [F.when(several, F.col(page)).alias("page"), F.when(several, F.col(pages)).alias("pages")]
