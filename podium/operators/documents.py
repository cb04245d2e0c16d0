"""Nested documents: session lists, forms and event reports.

A nested list is either bounded by a unique key (options of a question, questions of an event, answers of
a response) or cut into pages: a document too large for one row has several rows, numbered in `page`, and every
item stands in exactly one of them. Documents are built once per event; `events_by_secret` maps requests to
them. The keys of the documents are fixed names that clients read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.nest import PAGE_ITEMS, if_paged, paged_list, small_list
from podium.functions.store import stored
from podium.functions.skew import salted_join
from podium.functions.text import collated
from podium.operators.fold import popular_events
from podium.operators.lookup import events_by_secret, listing_counts, session_listing, session_speakers
from podium.operators.questions import question_form


# Session lists


def sessions_blob(listing: DataFrame, collation: str | None = None, page_items: int = PAGE_ITEMS,
                  counts: DataFrame | None = None) -> DataFrame:
    """Per event the list of its sessions by title. A session with several pages of speakers is an item each."""
    item = F.struct(F.col("session_id").alias("sessionId"), "title", "css", "presenters", *if_paged("page", "pages"))
    by = [collated("title", collation), "session_id", "page"]
    return paged_list(listing, "event_id", by, item, "sessions", ["session_id", "page"], page_items, counts=counts)


def admin_event_info(requests: DataFrame, events: DataFrame, sessions: DataFrame, session_presenters: DataFrame,
                     presenters: DataFrame, page_items: int = PAGE_ITEMS) -> DataFrame:
    """(event_id, name, css, page, pages, sessions) of every event that a request knows the secret of."""
    event_ids = stored(events_by_secret(requests, events).select("event_id").distinct(), "wanted")
    asked = sessions.join(event_ids, "event_id", "left_semi")
    listing = session_listing(asked, events, session_presenters, presenters, restrict=True, page_items=page_items)
    wanted = events.join(event_ids, "event_id", "left_semi").select("event_id", "name", "css")
    counts = listing_counts(asked, session_presenters, page_items)
    info = wanted.join(sessions_blob(listing, page_items=page_items, counts=counts), "event_id", "left")
    return info.withColumns({"page": F.coalesce("page", F.lit(0)), "pages": F.coalesce("pages", F.lit(1))})


def admin_event_json(info: DataFrame) -> DataFrame:
    body = F.struct(F.col("event_id").alias("eventId"), "name", "css", "sessions", *if_paged("page", "pages"))
    return info.select("event_id", "page", F.to_json(body).alias("body"))


# Forms


def event_forms(questions: DataFrame, options: DataFrame) -> DataFrame:
    """Per event the array `questions` of its form, by display order. Built once per event."""
    option_lists = small_list(
        options,
        "question_id",
        "answer_ordinal",
        F.struct(
            "answer_ordinal",
            "annotation",
            F.col("if_selected_show_question_id").alias("followUpQuestionId"),
            F.col("css_classes").alias("classList"),
        ),
        "options",
    )
    form = question_form(questions, options).join(option_lists, "question_id", "left")
    item = F.struct(
        "question",
        "description",
        F.col("question_id").alias("questionId"),
        F.col("is_required").alias("isRequired"),
        "indent",
        "display",
        "type",
        F.col("allow_plaintext").alias("allowPlaintext"),
        F.col("has_percentages").alias("hasPercentages"),
        "options",
    )
    return small_list(form, "event_id", "display_order", item, "questions")


def questionnaire(responses: DataFrame, sessions: DataFrame, events: DataFrame, session_presenters: DataFrame,
                  presenters: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Per response the form of its session, once for each page of speakers.

    Everything about a session is put together first, so a popular session is joined to its responses once.
    The wide form, one row per event, comes last and is salted for an event with many responses.
    """
    speakers = session_speakers(session_presenters, presenters, order="owner").select(
        "session_id", F.col("presenters").alias("speakers"), "page", "pages"
    )
    headers = (
        sessions.select("session_id", "event_id", "title")
        .join(speakers, "session_id", "left")
        .withColumns({"page": F.coalesce("page", F.lit(0)), "pages": F.coalesce("pages", F.lit(1))})
        .join(events.select("event_id", "css"), "event_id")
    )
    per_response = responses.select("client_key", "response_id", "session_id").join(headers, "session_id")
    hot = popular_events(responses, sessions)
    return salted_join(per_response, event_forms(questions, options), hot, "event_id", "response_id", "left")


def questionnaire_json(forms: DataFrame) -> DataFrame:
    return forms.select(
        "response_id",
        F.to_json(
            F.struct(
                F.col("client_key").alias("clientKey"), F.col("response_id").alias("responseId"), "css", "title",
                F.col("event_id").alias("eventId"), "speakers", *if_paged("page", "pages"), "questions",
            )
        ).alias("body"),
    )


# Event reports


def _report_questions(tables: dict[str, DataFrame]) -> DataFrame:
    option_lists = small_list(
        tables["answer_options"],
        "question_id",
        "answer_ordinal",
        F.struct(
            F.col("answer_option_id").alias("optionId"),
            F.col("answer_ordinal").alias("ordinal"),
            F.col("percent_value").alias("percent"),
            "annotation",
        ),
        "options",
    )
    return (
        tables["questions"]
        .join(option_lists, "question_id", "left")
        .select(
            "event_id",
            F.struct(
                F.col("question_id").alias("questionId"),
                F.col("display_order").alias("displayOrder"),
                F.col("question").alias("text"),
                "type",
                F.col("optimal_percent").alias("optimalValue"),
                "options",
            ).alias("item"),
        )
    )


def _event_presenters(tables: dict[str, DataFrame]) -> DataFrame:
    pairs = (
        tables["session_presenters"]
        .join(tables["sessions"].select("session_id", "event_id"), "session_id")
        .select("event_id", F.col("presented_by_id").alias("presenter_id"))
        .distinct()
    )
    return pairs.join(tables["presenters"], "presenter_id").select(
        "event_id",
        "presenter_id",
        F.struct(F.col("presenter_id").alias("presenterId"), "name", "email").alias("item"),
    )


def _report_responses(tables: dict[str, DataFrame]) -> DataFrame:
    answers = small_list(
        tables["response_answers"].withColumn("_by", F.struct("question_id", "answer_option_id")),
        "response_id", "_by", F.struct(F.col("answer_option_id").alias("optionId")), "answers",
    )
    texts = small_list(
        tables["response_plaintext"], "response_id", "question_id",
        F.struct(F.col("question_id").alias("questionId"), F.col("plaintext").alias("text")), "textAnswers",
    )
    return (
        tables["responses"]
        .join(answers, "response_id", "left")
        .join(texts, "response_id", "left")
        .select(
            "session_id",
            "response_id",
            F.struct(
                "created", "updated", F.col("response_id").alias("responseId"), "answers", "textAnswers"
            ).alias("item"),
        )
    )


def restrict_to_events(tables: dict[str, DataFrame], event_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report for some events. Each semi-join is on the key its table is grouped by next, so
    the cut costs no shuffle of its own there. What several tables are cut by is stored."""
    kept = dict(tables)
    for name in ("events", "sessions", "questions"):
        kept[name] = tables[name].join(event_ids, "event_id", "left_semi")
    kept["sessions"] = stored(kept["sessions"], "kept-sessions")
    kept["session_presenters"] = tables["session_presenters"].join(kept["sessions"], "session_id", "left_semi")
    kept["responses"] = stored(tables["responses"].join(kept["sessions"], "session_id", "left_semi"), "kept-responses")
    kept["answer_options"] = tables["answer_options"].join(kept["questions"], "question_id", "left_semi")
    for name in ("response_answers", "response_plaintext"):
        kept[name] = tables[name].join(kept["responses"], "response_id", "left_semi")
    return kept


def event_report(requests: DataFrame, tables: dict[str, DataFrame], page_items: int = PAGE_ITEMS) -> DataFrame:
    """(event_id, name, page, pages, presenters, questions, sessions) of every event that a request knows the
    secret of.

    Every table is cut down to the requested events before anything is nested. Lists are collected per
    response, then per session, then per event. A session with more responses or links than a page holds is
    several items, and an event whose items hold more than ten pages of them several rows. The questions are
    in the first row.
    """
    event_ids = stored(events_by_secret(requests, tables["events"]).select("event_id").distinct(), "wanted")
    tables = restrict_to_events(tables, event_ids)
    events, sessions = tables["events"], tables["sessions"]
    # How long the lists are follows from ids alone; the lists themselves are built once.
    n_links = tables["session_presenters"].groupBy("session_id").agg(F.count("*").alias("_n"))
    n_responses = tables["responses"].groupBy("session_id").agg(F.count("*").alias("_n"))
    both = n_links.unionByName(n_responses).groupBy("session_id").agg(F.sum("_n").alias("_held"))
    held = F.coalesce("_held", F.lit(0))
    per_event = sessions.join(both, "session_id", "left").join(n_links, "session_id", "left").groupBy("event_id").agg(
        F.sum(F.coalesce("_n", F.lit(0))).alias("_links"), F.sum(1 + held + F.floor(held / page_items)).alias("_held")
    )
    per_event = stored(per_event, "report-sizes")
    presenters = paged_list(
        _event_presenters(tables), "event_id", ["presenter_id"], F.col("item"), "presenters", ["presenter_id"], page_items,
        counts=per_event.select("event_id", F.col("_links").alias("_n")),
    )
    questions = small_list(
        _report_questions(tables).withColumn("displayOrder", F.col("item.displayOrder")),
        "event_id", "displayOrder", F.col("item"), "questions",
    ).withColumn("page", F.lit(0))
    links = paged_list(
        tables["session_presenters"], "session_id", ["presented_by_id"],
        F.struct(F.col("presented_by_id").alias("presenterId"), F.col("is_session_owner").alias("isOwner")),
        "presenters", ["presented_by_id"], page_items, counts=n_links,
    )
    responses = paged_list(
        _report_responses(tables), "session_id", ["response_id"], F.col("item"), "responses", ["response_id"], page_items,
        counts=n_responses,
    )
    parts = _page_by_page(links, responses, "session_id")
    session_items = sessions.join(parts, "session_id", "left").withColumn("pages", F.coalesce("pages", F.lit(1)))
    item = F.struct(
        F.col("session_id").alias("sessionId"), F.col("feed_id").alias("sessionizeId"), "title", "presenters", "responses",
        *if_paged("page", "pages"),
    )
    held = 1 + F.coalesce(F.size("presenters"), F.lit(0)) + F.coalesce(F.size("responses"), F.lit(0))
    nested = paged_list(
        session_items, "event_id", ["session_id", "page"], item, "sessions", ["session_id", "page"], 10 * page_items, held,
        counts=per_event.select("event_id", F.col("_held").alias("_n")),
    )
    lists = _page_by_page(presenters, nested, "event_id").join(questions, ["event_id", "page"], "full_outer")
    reports = events.select("event_id", "name").join(lists, "event_id", "left")
    return reports.withColumns({"page": F.coalesce("page", F.lit(0)), "pages": F.coalesce("pages", F.lit(1))})


def _page_by_page(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two paged lists of a key side by side: page n of one with page n of the other."""
    both = a.withColumnRenamed("pages", "_a").join(b.withColumnRenamed("pages", "_b"), [key, "page"], "full_outer")
    return both.withColumn("pages", F.greatest("_a", "_b")).drop("_a", "_b")


def event_report_json(reports: DataFrame) -> DataFrame:
    body = F.struct("name", "presenters", "questions", "sessions", *if_paged("page", "pages"))
    return reports.select("event_id", "page", F.to_json(body).alias("body"))


def report_parts(tables: dict[str, DataFrame]) -> DataFrame:
    """The report of every event in parts: one JSON body per event, speaker, question, session, link and
    response, so that no row grows with its event."""
    events, sessions = tables["events"], tables["sessions"]
    in_event = sessions.select("session_id", "event_id")

    def part(df: DataFrame, kind: str, key: str, *body) -> DataFrame:
        return df.select(
            "event_id",
            F.lit(kind).alias("part"),
            F.col(key).cast("string").alias("part_id"),
            F.to_json(F.struct(*body)).alias("body"),
        )

    questions = _report_questions(tables)
    return reduce(
        DataFrame.unionByName,
        [
            part(events, "event", "event_id", "name"),
            part(_event_presenters(tables), "presenter", "presenter_id", "item.*"),
            part(questions, "question", "item.questionId", "item.*"),
            part(
                sessions, "session", "session_id",
                F.col("session_id").alias("sessionId"), F.col("feed_id").alias("sessionizeId"), "title",
            ),
            part(
                tables["session_presenters"].join(in_event, "session_id"), "session_presenter", "session_id",
                F.col("session_id").alias("sessionId"), F.col("presented_by_id").alias("presenterId"),
                F.col("is_session_owner").alias("isOwner"),
            ),
            part(
                _report_responses(tables).join(in_event, "session_id"), "response", "response_id",
                F.col("session_id").alias("sessionId"), "item.*",
            ),
        ],
    )


REPORT_COLUMNS = [
    "event_id", "event_name", "session_id", "session_title", "response_id", "question_id", "display_order",
    "question_type", "optimal_percent", "answer_option_id", "answer_ordinal", "percent_value", "text", "revision",
    "created", "updated",
]


def report_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The flat report: one row per answer and per text answer, with its question, session and event.

    The two fact tables are joined to the dimensions by key only. Question, session and event are joined
    after the union, once for both.
    """
    options = tables["answer_options"].select("answer_option_id", "answer_ordinal", "percent_value")
    answers = tables["response_answers"].join(options, "answer_option_id").select(
        "response_id", "question_id", "answer_option_id", "answer_ordinal", "percent_value",
        F.lit(None).cast("string").alias("text"), "revision", "created", "updated",
    )
    texts = tables["response_plaintext"].select(
        "response_id", "question_id",
        F.lit(None).cast("bigint").alias("answer_option_id"),
        F.lit(None).cast("smallint").alias("answer_ordinal"),
        F.lit(None).cast("smallint").alias("percent_value"),
        F.col("plaintext").alias("text"), "revision", "created", "updated",
    )
    questions = tables["questions"].select(
        "question_id", "display_order", F.col("type").alias("question_type"), "optimal_percent"
    )
    titled = tables["sessions"].select("session_id", "event_id", F.col("title").alias("session_title")).join(
        tables["events"].select("event_id", F.col("name").alias("event_name")), "event_id"
    )
    return (
        answers.unionByName(texts)
        .join(tables["responses"].select("response_id", "session_id"), "response_id")
        .join(questions, "question_id")
        .join(titled, "session_id")
        .select(REPORT_COLUMNS)
    )
