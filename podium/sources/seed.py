"""The default questionnaire: ten questions and their options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (display order, type, required, optimal percent, has plaintext, question, description).
QUESTIONS = [
    (1, "radio", True, 100, False, "Overall impression", None),
    (2, "checkbox", False, None, True, "Could you elaborate on your score?", None),
    (3, "checkbox", False, None, True, "What issues did you have understanding the speaker?", None),
    (4, "checkbox", False, None, False, "What affected the timing?", None),
    (5, "radio", False, 100, False, "Speaker's knowledge", "in relation to the presentation"),
    (6, "radio", False, 100, True, "Did you learn something?",
     "What were your key takeaways from the session?"),
    (7, "radio", False, 0, False, "How was the difficulty?", "in relation to the session abstract"),
    (8, "radio", False, 0, False, "What about the tempo?", None),
    (9, "radio", False, 100, False, "Was the presenter engaging?", None),
    (10, "text", False, None, True, "Feedback to the presenter",
     "Remember to make your feedback actionable and specific."),
]

# Fixed values: (question, ordinal, percent, classes, follow-up question, annotation), by display order.
OPTIONS = [
    (1, 1, 0, "bad", 2, "Terrible"),
    (1, 2, 20, "bad", 2, None),
    (1, 3, 40, "bad", 2, None),
    (1, 4, 60, "avg", 2, None),
    (1, 5, 80, "good", None, None),
    (1, 6, 100, "good", None, "Amazing"),
    (2, 1, None, None, None, "The session did not align with the abstract."),
    (2, 2, None, None, None, "Too much marketing content."),
    (2, 3, None, None, None, "I couldn't understand slides/demos."),
    (2, 4, None, None, 3, "I couldn't understand the presenter."),
    (2, 5, None, None, 4, "Presenter went over time."),
    (3, 1, None, None, None, "Audio/microphone issues."),
    (3, 2, None, None, None, "Poor acoustics in the room."),
    (3, 3, None, None, None, "Language/accent hard to understand."),
    (3, 4, None, None, None, "Speaking too fast."),
    (3, 5, None, None, None, "Speaking too quietly."),
    (4, 1, None, None, None, "Started late."),
    (4, 2, None, None, None, "Technical issues."),
    (4, 3, None, None, None, "Broken demo."),
    (4, 4, None, None, None, "Presentation got sidetracked."),
    (4, 5, None, None, None, "Took too many questions."),
    (5, 1, 0, "bad", None, "Poor"),
    (5, 2, 20, "bad", None, None),
    (5, 3, 40, "avg", None, None),
    (5, 4, 60, "avg", None, None),
    (5, 5, 80, "good", None, None),
    (5, 6, 100, "good", None, "Excellent"),
    (6, 1, 0, "bad", None, "Nothing"),
    (6, 2, 20, "avg", None, None),
    (6, 3, 40, "avg", None, None),
    (6, 4, 60, "good", None, None),
    (6, 5, 80, "good", None, None),
    (6, 6, 100, "good", None, "Lots"),
    (7, 1, -100, "bad", None, "Too easy"),
    (7, 2, -60, "avg", None, None),
    (7, 3, -20, "good", None, None),
    (7, 4, 20, "good", None, "Good"),
    (7, 5, 60, "avg", None, None),
    (7, 6, 100, "bad", None, "Too hard"),
    (8, 1, -100, "bad", None, "Too slow"),
    (8, 2, -60, "avg", None, None),
    (8, 3, -20, "good", None, None),
    (8, 4, 20, "good", None, "Good"),
    (8, 5, 60, "avg", None, None),
    (8, 6, 100, "bad", None, "Too fast"),
    (9, 1, 0, "bad", None, "Not at all"),
    (9, 2, 20, "bad", None, None),
    (9, 3, 40, "avg", None, None),
    (9, 4, 60, "avg", None, None),
    (9, 5, 80, "good", None, None),
    (9, 6, 100, "good", None, "Yes, very"),
]

QUESTION_DDL = (
    "display_order SMALLINT, type STRING, is_required BOOLEAN, optimal_percent SMALLINT, "
    "has_plaintext BOOLEAN, question STRING, description STRING"
)
OPTION_DDL = (
    "question_order SMALLINT, answer_ordinal SMALLINT, percent_value SMALLINT, css_classes STRING, "
    "follow_up_order SMALLINT, annotation STRING"
)


def template_seed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The questionnaire as two DataFrames, keyed by display order."""
    return spark.createDataFrame(QUESTIONS, QUESTION_DDL), spark.createDataFrame(OPTIONS, OPTION_DDL)


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, str):
        text = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"
    return f"CAST({value} AS {kind})"


def _literal_rows(rows: list[tuple], ddl: str) -> Column:
    """The rows as one array literal."""
    fields = [part.strip().split(" ") for part in ddl.split(",")]
    structs = [
        ", ".join(f"'{name}', {_literal(value, kind)}" for value, (name, kind) in zip(row, fields)) for row in rows
    ]
    return F.expr("array(" + ", ".join(f"named_struct({s})" for s in structs) + ")")


def questions_for_events(events: DataFrame) -> DataFrame:
    """Give every event the seed's questions. The seed is a literal array, so no join is planned."""
    return events.select("event_id", F.inline(_literal_rows(QUESTIONS, QUESTION_DDL))).select(
        (F.col("event_id") * 100 + F.col("display_order")).alias("question_id"),
        "event_id",
        "display_order",
        "question",
        "description",
        "optimal_percent",
        "is_required",
        "type",
        "has_plaintext",
    )


def options_for_events(events: DataFrame) -> DataFrame:
    """Give every event the seed's options, with question and follow-up ids of that event."""
    event = F.col("event_id")
    return events.select("event_id", F.inline(_literal_rows(OPTIONS, OPTION_DDL))).select(
        (event * 100 + F.col("question_order")).alias("question_id"),
        (event * 10000 + F.col("question_order") * 100 + F.col("answer_ordinal")).alias("answer_option_id"),
        "answer_ordinal",
        "percent_value",
        (event * 100 + F.col("follow_up_order")).alias("if_selected_show_question_id"),
        "annotation",
        "css_classes",
    )
