"""What a user may see: events they are listed for, or all events for an administrator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = [
    "event_id", "name", "css", "is_template", "accepts_responses_from", "accepts_responses_to", "api_key",
]


def my_events(events: DataFrame, event_users: DataFrame, user: str, is_admin: bool = False,
              fanout: bool = False) -> DataFrame:
    """Visible events. `fanout=True` gives one row per listed user, as a left join with the users does."""
    if fanout:
        visible = events.join(event_users, "event_id", "left")
        if not is_admin:
            visible = visible.where(F.col("user") == user)
    elif is_admin:
        visible = events
    else:
        mine = event_users.where(F.col("user") == user)
        visible = events.join(mine, "event_id", "left_semi")
    return visible.select(EVENT_COLUMNS)


def my_sessions(sessions: DataFrame, visible_events: DataFrame) -> DataFrame:
    return sessions.join(visible_events.select("event_id"), "event_id").select("session_id", "event_id", "title")


def my_questions(questions: DataFrame, visible_events: DataFrame) -> DataFrame:
    return questions.join(visible_events.select("event_id"), "event_id").select(
        "question_id", "event_id", "display_order", "question", "is_required", "has_plaintext"
    )


def my_answer_options(options: DataFrame, questions: DataFrame, visible_events: DataFrame) -> DataFrame:
    visible = questions.select("question_id", "event_id").join(visible_events.select("event_id"), "event_id")
    return options.join(visible, "question_id").select(
        "event_id", "question_id", "answer_option_id", "answer_ordinal", "percent_value",
        "if_selected_show_question_id", "annotation",
    )


def split_by_access(requests: DataFrame, visible: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests on visible parents, and the rejected rest."""
    known = visible.select(key).distinct()
    accepted = requests.join(known, key, "left_semi")
    rejected = requests.join(known, key, "left_anti").withColumn(
        "error", F.lit("not found, or no access to it")
    )
    return accepted, rejected
