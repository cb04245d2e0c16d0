"""The declared constraints as data-quality jobs. Each returns rows (rule, key, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.sources.schemas import MAX_LENGTH, TABLES

# (rule, table, key columns)
UNIQUE = [
    ("pk_events", "events", ["event_id"]),
    ("pk_event_users", "event_users", ["event_id", "user"]),
    ("pk_presenters", "presenters", ["presenter_id"]),
    ("pk_sessions", "sessions", ["session_id"]),
    ("pk_session_presenters", "session_presenters", ["session_id", "presented_by_id"]),
    ("pk_questions", "questions", ["question_id"]),
    ("uq_questions", "questions", ["event_id", "display_order"]),
    ("pk_answer_options", "answer_options", ["answer_option_id"]),
    ("uq_answer_options", "answer_options", ["question_id", "answer_ordinal"]),
    ("pk_responses", "responses", ["response_id"]),
    ("pk_response_answers", "response_answers", ["response_id", "question_id", "answer_option_id"]),
    ("pk_response_plaintext", "response_plaintext", ["response_id", "question_id"]),
]

# (rule, table, filter, key columns)
UNIQUE_WHERE = [
    ("uq_event_api_key", "events", "api_key IS NOT NULL", ["api_key"]),
    ("uq_template_name", "events", "is_template", ["name"]),
    ("uq_presenter_identifier", "presenters", "identifier IS NOT NULL", ["identifier"]),
    ("uq_session_feed_id", "sessions", "feed_id IS NOT NULL", ["event_id", "feed_id"]),
    ("uq_session_owner", "session_presenters", "is_session_owner", ["session_id"]),
]

# (rule, child table, child key, parent table, parent key)
REFERENCES = [
    ("fk_event_users_event", "event_users", "event_id", "events", "event_id"),
    ("fk_sessions_event", "sessions", "event_id", "events", "event_id"),
    ("fk_session_presenters_session", "session_presenters", "session_id", "sessions", "session_id"),
    ("fk_session_presenters_presenter", "session_presenters", "presented_by_id", "presenters", "presenter_id"),
    ("fk_questions_event", "questions", "event_id", "events", "event_id"),
    ("fk_answer_options_question", "answer_options", "question_id", "questions", "question_id"),
    ("fk_answer_options_follow_up", "answer_options", "if_selected_show_question_id", "questions", "question_id"),
    ("fk_responses_session", "responses", "session_id", "sessions", "session_id"),
    ("fk_response_answers_response", "response_answers", "response_id", "responses", "response_id"),
    ("fk_response_answers_question", "response_answers", "question_id", "questions", "question_id"),
    ("fk_response_answers_option", "response_answers", "answer_option_id", "answer_options", "answer_option_id"),
    ("fk_response_plaintext_response", "response_plaintext", "response_id", "responses", "response_id"),
    ("fk_response_plaintext_question", "response_plaintext", "question_id", "questions", "question_id"),
]

# (rule, table, violation, key columns)
DOMAINS = [
    ("ck_question_type", "questions", "type NOT IN ('checkbox', 'radio', 'text')", ["question_id"]),
    ("ck_percent_value", "answer_options", "percent_value NOT BETWEEN -100 AND 100", ["answer_option_id"]),
    ("ck_display_order", "questions", "display_order NOT BETWEEN 0 AND 255", ["question_id"]),
]


def _findings(df: DataFrame, rule: str, key: list[str], n: Column) -> DataFrame:
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return df.select(F.lit(rule).alias("rule"), text.alias("key"), n.cast("bigint").alias("n"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _repeated(df: DataFrame, rule: str, key: list[str]) -> DataFrame:
    groups = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return _findings(groups, rule, key, F.col("n"))


def dq_unique(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([_repeated(tables[t], rule, key) for rule, t, key in UNIQUE if t in tables])


def dq_unique_filtered(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([_repeated(tables[t].where(only), rule, key) for rule, t, only, key in UNIQUE_WHERE if t in tables])


def dq_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Child keys without a parent, with the number of child rows. The child is reduced to its keys first,
    so a key that many rows share is joined once."""
    parts = []
    for rule, child, key, parent, parent_key in REFERENCES:
        if child not in tables or parent not in tables:
            continue
        keys = tables[child].where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        missing = keys.join(tables[parent].select(F.col(parent_key).alias(key)), key, "left_anti")
        parts.append(_findings(missing, rule, [key], F.col("n")))
    return _union(parts)


def dq_domain(tables: dict[str, DataFrame]) -> DataFrame:
    return _union(
        [_findings(tables[t].where(bad), rule, key, F.lit(1)) for rule, t, bad, key in DOMAINS if t in tables]
    )


def dq_not_null_length(tables: dict[str, DataFrame]) -> DataFrame:
    """Missing required values and overlong texts per column: one pass and one row of counts per table."""
    parts = []
    for table, schema in TABLES.items():
        if table not in tables:
            continue
        counts = []
        for field in schema.fields:
            column = F.col(field.name)
            if not field.nullable:
                counts.append((f"not_null_{table}", field.name, F.count_if(column.isNull())))
            limit = MAX_LENGTH.get((table, field.name))
            if limit:
                counts.append((f"max_length_{table}", field.name, F.count_if(F.length(column) > limit)))
        row = tables[table].agg(*[count.alias(f"c{i}") for i, (_, _, count) in enumerate(counts)])
        found = F.array(
            *[
                F.struct(F.lit(rule).alias("rule"), F.lit(key).alias("key"), F.col(f"c{i}").alias("n"))
                for i, (rule, key, _) in enumerate(counts)
            ]
        )
        parts.append(row.select(F.inline(found)).where("n > 0"))
    return _union(parts)


def summarise(findings: DataFrame, rules: list[str]) -> DataFrame:
    """Number of offending keys per rule, with the clean rules as zero."""
    spark = findings.sparkSession
    all_rules = spark.createDataFrame([(r,) for r in rules], "rule STRING")
    counts = findings.groupBy("rule").agg(F.count("*").alias("violations"))
    return all_rules.join(counts, "rule", "left").select(
        "rule", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")
    )
