"""Edits of ordered lists: questions of an event, options of a question.

Edits of a list depend on each other, so they are replayed in order. Lists and edits are shuffled by parent and
sorted, lists first; a task then reads one row after the other and holds nothing but the list it is at, which
the order's type bounds. Parents run in parallel; a parent with very many edits takes time, but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.ids import assign_ids

# Largest order values: a question's order is one unsigned byte, an option's a signed short.
QUESTION_CAPACITY = 255
OPTION_CAPACITY = 32767


class EditedList:
    """The list of one parent while its edits pass by. After the first edit it is packed to 1..n."""

    def __init__(self, parent: int):
        self.parent, self.ids, self.orders, self.edited = parent, [], [], False

    def stored(self, item: int, order: int) -> None:
        self.ids.append(item)
        self.orders.append(order)

    def place(self, position: int | None) -> int | None:
        """Only the first edit can meet gaps; its position counts the stored orders before it."""
        if position is not None and not self.edited:
            position = sum(o < position for o in self.orders) + 1
        self.edited = True
        return position

    def insert(self, item: int, position: int | None, capacity: int) -> None:
        """Put a new item before the one at `position`, at the end if there is none. A full list stays as it is."""
        if len(self.ids) < capacity:
            position, n = self.place(position), len(self.ids)
            self.ids.insert(n if position is None else min(max(position, 1), n + 1) - 1, item)

    def move(self, item: int, position: int | None) -> None:
        """Put an item before the one now at `position`; on its own position it stays, beyond the end it is last."""
        position = self.place(position)
        if position is not None:
            own, n = self.ids.index(item) + 1, len(self.ids)
            to = n if position > n else position - 1 if position > own else max(position, 1)
            self.ids.pop(own - 1)
            self.ids.insert(to - 1, item)

    def rows(self) -> pd.DataFrame:
        orders = range(1, len(self.ids) + 1) if self.edited else self.orders
        return pd.DataFrame({"parent": self.parent, "item": self.ids, "order": list(orders)})


def _replay(frames: Iterator[pd.DataFrame], edit: Callable) -> Iterator[pd.DataFrame]:
    current: EditedList | None = None
    for frame in frames:
        done = []
        for parent, is_edit, seq, item, position in zip(*[frame[c] for c in frame.columns], strict=True):
            if current is None or current.parent != parent:
                if current is not None:
                    done.append(current.rows())
                current = EditedList(parent)
            if is_edit:
                edit(current, item, None if pd.isna(position) else int(position))
            else:
                current.stored(item, seq)
        if done:
            yield pd.concat(done)
    if current is not None:
        yield current.rows()


def _edited(items: DataFrame, edits: DataFrame, parent: str, item: str, order: str, edit: Callable) -> DataFrame:
    """(parent, item, order) after the edits (parent, seq, item, position)."""
    stored = items.select(parent, F.lit(0).alias("is_edit"), F.col(order).cast("bigint").alias("seq"), item, F.lit(None).cast("int").alias("position"))
    coming = edits.select(parent, F.lit(1).alias("is_edit"), "seq", item, F.col("position").cast("int").alias("position"))
    rows = stored.unionByName(coming).repartition(parent).sortWithinPartitions(parent, "is_edit", "seq", item)
    replayed = rows.mapInPandas(partial(_replay, edit=edit), "parent bigint, item bigint, order int")
    return replayed.select(F.col("parent").alias(parent), F.col("item").alias(item), F.col("order").cast("smallint").alias(order))


def _insert(items: DataFrame, requests: DataFrame, parent: str, item: str, order: str, capacity: int) -> DataFrame:
    """(parent, item, order) after the inserts that fit."""
    return _edited(items, requests, parent, item, order, partial(EditedList.insert, capacity=capacity))


def insert_questions(questions: DataFrame, requests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert questions at their positions; returns the new snapshot and the rejected requests.

    `requests` has event_id, position, seq and the question's columns. Rejected are unknown events and
    inserts into a full list.
    """
    known = requests.join(events.select("event_id"), "event_id", "left_semi")
    known = assign_ids(
        known.withColumn("identity", F.concat_ws("/", F.lit("new question"), "event_id", "seq")), "identity", 60,
        questions.select("question_id"), "question_id",
    )
    order = _insert(questions, known, "event_id", "question_id", "display_order", QUESTION_CAPACITY)
    attributes = ["question", "description", "optimal_percent", "is_required", "type", "has_plaintext"]
    new = known.select(
        "question_id", "question", "description", "optimal_percent",
        F.coalesce("is_required", F.lit(False)).alias("is_required"),
        F.coalesce("type", F.lit("radio")).alias("type"),
        F.coalesce("has_plaintext", F.lit(False)).alias("has_plaintext"),
    )
    content = questions.select("question_id", *attributes).unionByName(new)
    snapshot = order.join(content, "question_id").select("question_id", "event_id", "display_order", *attributes)
    full = known.join(order.select("question_id"), "question_id", "left_anti")
    unknown = requests.join(events.select("event_id"), "event_id", "left_anti")
    rejected = full.select("event_id", "seq", F.lit("the list is full").alias("error")).union(
        unknown.select("event_id", "seq", F.lit("event not found").alias("error"))
    )
    return snapshot, rejected


def insert_answer_options(options: DataFrame, requests: DataFrame, questions: DataFrame
                          ) -> tuple[DataFrame, DataFrame]:
    """The same for the options of a question, on `answer_ordinal`."""
    known = requests.join(questions.select("question_id"), "question_id", "left_semi")
    known = assign_ids(
        known.withColumn("identity", F.concat_ws("/", F.lit("new option"), "question_id", "seq")), "identity", 60,
        options.select("answer_option_id"), "answer_option_id",
    )
    order = _insert(options, known, "question_id", "answer_option_id", "answer_ordinal", OPTION_CAPACITY)
    attributes = ["percent_value", "if_selected_show_question_id", "annotation", "css_classes"]
    content = options.select("answer_option_id", *attributes).unionByName(known.select("answer_option_id", *attributes))
    snapshot = order.join(content, "answer_option_id").select(
        "question_id", "answer_option_id", "answer_ordinal", *attributes
    )
    full = known.join(order.select("answer_option_id"), "answer_option_id", "left_anti")
    unknown = requests.join(questions.select("question_id"), "question_id", "left_anti")
    rejected = full.select("question_id", "seq", F.lit("the list is full").alias("error")).union(
        unknown.select("question_id", "seq", F.lit("question not found").alias("error"))
    )
    return snapshot, rejected


# Moves


def update_questions(questions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patch the given fields of questions and move those with a position, in the order of seq.

    NULL leaves a field as it is. Returns the new snapshot and the requests for unknown questions. Of the
    requests without a position only the first of an event is replayed, as it packs the list.
    """
    attributes = ["question", "description", "optimal_percent", "is_required", "type", "has_plaintext"]
    patches = requests.groupBy("question_id").agg(
        *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("seq"))).alias(f"new_{a}") for a in attributes]
    )
    edits = requests.join(questions.select("question_id", "event_id"), "question_id").select(
        "event_id", "seq", "position", "question_id"
    )
    still = edits.where("position IS NULL").groupBy("event_id").agg(
        F.min("seq").alias("seq"), F.min_by("position", "seq").alias("position"), F.min_by("question_id", "seq").alias("question_id")
    )
    moves = edits.where("position IS NOT NULL").unionByName(still)
    placed = _edited(questions, moves, "event_id", "question_id", "display_order", EditedList.move)
    snapshot = (
        placed.join(questions.drop("event_id", "display_order"), "question_id")
        .join(patches, "question_id", "left")
        .select(
            "question_id", "event_id", "display_order",
            *[F.coalesce(f"new_{a}", a).alias(a) for a in attributes],
        )
    )
    rejected = requests.join(questions.select("question_id"), "question_id", "left_anti").select(
        "question_id", "seq", F.lit("question not found").alias("error")
    )
    return snapshot, rejected
