"""Question depth and the columns derived from questions and options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.store import forget, stored

CYCLE = "on or behind a cycle of follow-up questions"


def question_depths(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Depth of every question that has options and can be reached from a root of the follow-up graph, however deep,
    and the questions (question_id, error) that have none because they are on or behind a cycle a root reaches.

    Questions are peeled off once all questions that lead to them are: the last of them gives the longest path. What a
    cycle holds back is never peeled, and no other question is touched by it. Questions that only a cycle out of
    reach leads to are absent; if there is any cycle, the peeling is done again without what no root reaches.
    """
    nodes = options.select("question_id").distinct()
    edges = (
        options.where("if_selected_show_question_id IS NOT NULL")
        .select("question_id", F.col("if_selected_show_question_id").alias("next_id"))
        .distinct()
    )
    inner = stored(edges.join(nodes.select(F.col("question_id").alias("next_id")), "next_id"), "follow-ups")
    pointed_at = edges.select(F.col("next_id").alias("question_id")).distinct()
    roots = stored(nodes.join(pointed_at, "question_id", "left_anti"), "roots")
    depths, stuck = _peeled(roots, inner)
    if not stuck.isEmpty():
        reached = _reached(roots, inner)
        depths, stuck = _peeled(roots, stored(inner.join(reached, "question_id", "left_semi"), "follow-ups"))
    return depths, stuck.select("question_id", F.lit(CYCLE).alias("error"))


def _peeled(roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question_id, indent) of all questions that peeling gets at, and the others that edges lead to. Every round is
    stored, so its lineage is one join."""
    waiting = stored(edges.groupBy(F.col("next_id").alias("question_id")).agg(F.count("*").alias("left")), "waiting")
    level, levels = roots, [roots.withColumn("indent", F.lit(0))]
    while True:
        taken = level.join(edges, "question_id").groupBy(F.col("next_id").alias("question_id")).agg(F.count("*").alias("_taken"))
        after = waiting.join(taken, "question_id", "left").select("question_id", (F.col("left") - F.coalesce("_taken", F.lit(0))).alias("left"))
        after = stored(after, "waiting")
        level = stored(after.where("left = 0").select("question_id"), "level")
        if level.isEmpty():
            return reduce(DataFrame.union, levels), after
        forget(waiting)
        waiting = after.where("left > 0")
        levels.append(level.withColumn("indent", F.lit(len(levels))))


def _reached(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """All questions that paths from a root lead to, the roots included."""
    found = level = roots
    while True:
        following = level.join(edges, "question_id").select(F.col("next_id").alias("question_id")).distinct()
        level = stored(following.join(found, "question_id", "left_anti"), "reached")
        if level.isEmpty():
            return found
        found = found.union(level)


def question_indent(options: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The depths alone, for data that must not have a cycle: raises if a root reaches one, or if a chain is deeper than
    `max_depth`. `question_depths` serves all other questions beside a cycle."""
    depths, stuck = question_depths(options)
    if not stuck.isEmpty():
        raise ValueError("the follow-up questions form a cycle")
    if max_depth is not None and not depths.where(F.col("indent") > max_depth).isEmpty():
        raise ValueError(f"a chain of follow-up questions is deeper than {max_depth}")
    return depths


def question_display(questions: DataFrame, options: DataFrame) -> DataFrame:
    """`display`: no option opens this question as a follow-up."""
    linked = (
        options.where("if_selected_show_question_id IS NOT NULL")
        .select(F.col("if_selected_show_question_id").alias("question_id"), F.lit(True).alias("linked"))
        .distinct()
    )
    return (
        questions.select("question_id")
        .join(linked, "question_id", "left")
        .select("question_id", F.col("linked").isNull().alias("display"))
    )


def question_has_percentages(questions: DataFrame, options: DataFrame) -> DataFrame:
    """Whether any option of the question has a percent value."""
    counts = options.groupBy("question_id").agg((F.count("percent_value") > 0).alias("has_percentages"))
    return (
        questions.select("question_id")
        .join(counts, "question_id", "left")
        .select("question_id", F.coalesce("has_percentages", F.lit(False)).alias("has_percentages"))
    )


def allow_plaintext():
    """Column: the question takes text."""
    return F.col("has_plaintext") | (F.col("type") == "text")


def question_allow_plaintext(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", allow_plaintext().alias("allow_plaintext"))


def question_form(questions: DataFrame, options: DataFrame) -> DataFrame:
    """Questions with every derived column of the form, built once for all events. A question without a depth, also for
    a cycle of its event, is shown at depth 0.

    `display` and `has_percentages` take one aggregate and one join each on the small question tables.
    """
    return (
        questions.join(question_depths(options)[0], "question_id", "left")
        .join(question_display(questions, options), "question_id")
        .join(question_has_percentages(questions, options), "question_id")
        .withColumn("indent", F.coalesce("indent", F.lit(0)))
        .withColumn("allow_plaintext", allow_plaintext())
    )


def pack_order(df: DataFrame, parent: str, order: str, changed_only: bool = True) -> DataFrame:
    """Renumber 1..n inside each parent. The order value is unique per parent, and a display order has at
    most 256 values and an ordinal 65,536, which bounds every window partition."""
    position = F.row_number().over(Window.partitionBy(parent).orderBy(order)).cast("smallint")
    packed = df.withColumn("packed", position)
    if changed_only:
        packed = packed.where(F.col("packed") != F.col(order))
    return packed
