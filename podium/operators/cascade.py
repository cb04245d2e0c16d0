"""Deletes with everything that depends on the deleted rows. Snapshot in, snapshot out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.skew import nullable_left_join
from podium.operators.questions import pack_order


def delete_questions(tables: dict[str, DataFrame], ids: DataFrame, cascade: bool = False
                     ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete questions with their options and click answers, and renumber the rest of their events.

    Text answers and follow-ups pointing at the question are not removed, so they block its deletion; those
    requests are rejected. Every request is judged against the snapshot, not against earlier ones of the
    batch. `cascade=True` removes the texts and clears the follow-ups instead.
    """
    questions, options = tables["questions"], tables["answer_options"]
    known = ids.select("question_id").distinct().join(questions.select("question_id"), "question_id", "left_semi")
    unknown = ids.select("question_id").distinct().join(questions.select("question_id"), "question_id", "left_anti")
    followed = (
        options.where("if_selected_show_question_id IS NOT NULL AND if_selected_show_question_id <> question_id")
        .select(F.col("if_selected_show_question_id").alias("question_id"))
        .distinct()
    )
    texted = tables["response_plaintext"].select("question_id").distinct()
    rejected = unknown.withColumn("error", F.lit("question not found"))
    doomed = known
    if not cascade:
        blocked = known.join(followed.union(texted), "question_id", "left_semi")
        rejected = rejected.union(blocked.withColumn("error", F.lit("still referenced")))
        doomed = known.join(followed, "question_id", "left_anti").join(texted, "question_id", "left_anti")

    kept = questions.join(doomed, "question_id", "left_anti")
    touched = questions.join(doomed, "question_id", "left_semi").select("event_id").distinct()
    packed = pack_order(kept.join(touched, "event_id", "left_semi"), "event_id", "display_order", changed_only=False)
    packed = packed.withColumn("display_order", F.col("packed")).drop("packed")
    untouched = kept.join(touched, "event_id", "left_anti")
    result = {
        **tables,
        "questions": untouched.unionByName(packed),
        "answer_options": options.join(doomed, "question_id", "left_anti"),
        "response_answers": tables["response_answers"].join(doomed, "question_id", "left_anti"),
    }
    if cascade:
        result["response_plaintext"] = tables["response_plaintext"].join(doomed, "question_id", "left_anti")
        gone = doomed.select(F.col("question_id").alias("if_selected_show_question_id"), F.lit(True).alias("gone"))
        cleared = nullable_left_join(
            result["answer_options"], gone, "if_selected_show_question_id", "answer_option_id"
        )
        result["answer_options"] = cleared.withColumn(
            "if_selected_show_question_id",
            F.when(F.col("gone").isNull(), F.col("if_selected_show_question_id")),
        ).select(options.columns)
    return result, rejected


def orphan_presenters(presenters: DataFrame, session_presenters: DataFrame) -> DataFrame:
    """Presenters of no session at all."""
    linked = session_presenters.select(F.col("presented_by_id").alias("presenter_id")).distinct()
    return presenters.join(linked, "presenter_id", "left_anti")


def delete_events(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete events with users, sessions, links, questions, options, responses and answers; then delete
    every presenter left without a session, also those that had none before.

    The doomed ids are resolved once down the chain event, session, response; every table is then one
    anti-join on its own key. The fact tables are joined on their response, never on a wider path.
    """
    doomed = ids.select("event_id").distinct().join(tables["events"].select("event_id"), "event_id", "left_semi")
    sessions = tables["sessions"].join(doomed, "event_id", "left_semi").select("session_id")
    responses = tables["responses"].join(sessions, "session_id", "left_semi").select("response_id")
    questions = tables["questions"].join(doomed, "event_id", "left_semi").select("question_id")
    result = dict(tables)
    for name, key, gone in [
        ("event_users", "event_id", doomed),
        ("response_plaintext", "response_id", responses),
        ("response_answers", "response_id", responses),
        ("responses", "session_id", sessions),
        ("answer_options", "question_id", questions),
        ("questions", "event_id", doomed),
        ("session_presenters", "session_id", sessions),
        ("sessions", "event_id", doomed),
        ("events", "event_id", doomed),
    ]:
        if name in tables:
            result[name] = tables[name].join(gone, key, "left_anti")
    linked = result["session_presenters"].select(F.col("presented_by_id").alias("presenter_id"))
    result["presenters"] = tables["presenters"].join(linked, "presenter_id", "left_semi")
    rejected = ids.join(tables["events"].select("event_id"), "event_id", "left_anti").select(
        "event_id", F.lit("event not found").alias("error")
    )
    return result, rejected
