"""Fixed schemas of the ten feedback tables and of the logs and feeds.

Surrogate ids are BIGINT: a template copied to many events needs more option ids than an INT holds.
Display orders are SMALLINT with a 0..255 rule, since Spark's TINYINT is signed.
"""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "BIGINT": T.LongType(),
    "SMALLINT": T.ShortType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    """A flat schema from its DDL, also where no session runs yet."""
    schema = T.StructType()
    for column in columns.split(", "):
        name, kind, *rest = column.split(" ")
        schema.add(name, TYPES[kind], nullable=not rest)
    return schema


TABLES: dict[str, T.StructType] = {
    "events": _struct(
        "event_id BIGINT NOT NULL, name STRING NOT NULL, css STRING, is_template BOOLEAN NOT NULL, "
        "accepts_responses_from TIMESTAMP_NTZ, accepts_responses_to TIMESTAMP_NTZ, "
        "api_key STRING, event_secret STRING NOT NULL"
    ),
    "event_users": _struct("event_id BIGINT NOT NULL, user STRING NOT NULL"),
    "presenters": _struct(
        "presenter_id BIGINT NOT NULL, name STRING NOT NULL, email STRING, identifier STRING"
    ),
    "sessions": _struct(
        "session_id BIGINT NOT NULL, event_id BIGINT NOT NULL, feed_id BIGINT, title STRING NOT NULL"
    ),
    "session_presenters": _struct(
        "session_id BIGINT NOT NULL, presented_by_id BIGINT NOT NULL, is_session_owner BOOLEAN NOT NULL"
    ),
    "questions": _struct(
        "question_id BIGINT NOT NULL, event_id BIGINT NOT NULL, display_order SMALLINT NOT NULL, "
        "question STRING NOT NULL, description STRING, optimal_percent SMALLINT, "
        "is_required BOOLEAN NOT NULL, type STRING NOT NULL, has_plaintext BOOLEAN NOT NULL"
    ),
    "answer_options": _struct(
        "question_id BIGINT NOT NULL, answer_option_id BIGINT NOT NULL, answer_ordinal SMALLINT NOT NULL, "
        "percent_value SMALLINT, if_selected_show_question_id BIGINT, annotation STRING, css_classes STRING"
    ),
    "responses": _struct(
        "response_id BIGINT NOT NULL, session_id BIGINT NOT NULL, client_key STRING NOT NULL, "
        "created TIMESTAMP_NTZ NOT NULL, updated TIMESTAMP_NTZ NOT NULL"
    ),
    "response_answers": _struct(
        "response_id BIGINT NOT NULL, question_id BIGINT NOT NULL, answer_option_id BIGINT NOT NULL, "
        "created TIMESTAMP_NTZ NOT NULL, revision BIGINT NOT NULL, updated TIMESTAMP_NTZ NOT NULL"
    ),
    "response_plaintext": _struct(
        "response_id BIGINT NOT NULL, question_id BIGINT NOT NULL, plaintext STRING NOT NULL, "
        "created TIMESTAMP_NTZ NOT NULL, revision BIGINT NOT NULL, updated TIMESTAMP_NTZ NOT NULL"
    ),
}

# `seq` orders the changes of one response; it is unique inside the response.
ANSWER_CHANGES = _struct(
    "response_id BIGINT, question_id BIGINT, answer_ordinal SMALLINT, plaintext STRING, "
    "ts TIMESTAMP_NTZ, seq BIGINT"
)

# A save request as the form posts it: every field is text, and a missing value is the text 'null'.
RAW_CHANGES = _struct(
    "responseId STRING, questionId STRING, answerOrdinal STRING, plaintext STRING, ts TIMESTAMP_NTZ, seq BIGINT"
)

# The feed of one event: a list of session groups.
FEED_GROUPS = (
    "ARRAY<STRUCT<sessions: ARRAY<STRUCT<id: BIGINT, title: STRING, status: STRING, isServiceSession: BOOLEAN, "
    "speakers: ARRAY<STRUCT<id: STRING, name: STRING>>>>>>"
)
# The same as one document per line, with the event it belongs to.
FEED = f"event_key STRING, groups {FEED_GROUPS}"

# Declared text lengths.
MAX_LENGTH = {
    ("events", "name"): 200,
    ("events", "api_key"): 50,
    ("event_users", "user"): 128,
    ("presenters", "name"): 200,
    ("presenters", "email"): 300,
    ("presenters", "identifier"): 50,
    ("sessions", "title"): 200,
    ("questions", "question"): 200,
    ("questions", "type"): 20,
    ("answer_options", "annotation"): 200,
    ("answer_options", "css_classes"): 200,
}
