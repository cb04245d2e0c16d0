"""Named queries: every operator run over the whole test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.ids import assign_ids
from podium.functions.store import stored
from podium.functions.text import speaker_names
from podium.operators import access, cascade, copies, documents, fold, imports, lists, lookup, quality, questions, upsert
from podium.session import fresh_path
from podium.sources import feed, sinks, tables
from podium.sources.adapters import TestTables
from podium.streaming import changes as stream
from podium.streaming import keyed

AS_OF = dt.datetime(2000, 6, 1)
USER = "MACHINERY"
HOST = "feedback.example.org"
LONG_NEEDLES = ["00098, customer#000000100", "00749, customer#000000751"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[TestTables], DataFrame], name: str | None = None):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(TestTables(spark, folder))

    run.__name__ = name or build.__name__
    run.__doc__ = build.__doc__
    QUERIES[run.__name__] = run
    return build


def named(name: str):
    """Register under a name that a function of this module has already."""
    return lambda build: query(build, name)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _dims(t: TestTables):
    return t.responses, t.sessions, t.questions, t.answer_options


# Sources and sinks


@query
def load_feedback(t):
    """Publish the ten tables, load them back and count rows and keys."""
    path = fresh_path(t.spark, "feedback")
    tables.save_feedback(t.folded, path)
    loaded = tables.load_feedback(t.spark, path)
    keys = {
        "events": "event_id", "event_users": "event_id", "presenters": "presenter_id", "sessions": "session_id",
        "session_presenters": "presented_by_id", "questions": "question_id", "answer_options": "answer_option_id",
        "responses": "response_id", "response_answers": "answer_option_id", "response_plaintext": "question_id",
    }
    return union(
        *[
            loaded[name].agg(
                F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(key).alias("key_sum")
            )
            for name, key in keys.items()
        ]
    )


def _feed(t):
    path = fresh_path(t.spark, "feed")
    t.feed_documents.write.text(path)
    return feed.read_session_feed(t.spark, path)


@query
def read_session_feed_sessions(t):
    return _feed(t)[0]


@query
def read_session_feed_speakers(t):
    return _feed(t)[1]


@query
def read_answer_changes(t):
    path = fresh_path(t.spark, "changes")
    t.raw_changes.write.json(path)
    return feed.read_answer_changes(t.spark, path)


@query
def template_seed_questions(t):
    return t.questions


@query
def template_seed_options(t):
    return t.answer_options


@query
def write_event_reports(t):
    path = fresh_path(t.spark, "reports")
    sinks.write_event_reports(documents.report_parts(t.published), path)
    written = t.spark.read.schema("event_id BIGINT, part STRING, part_id STRING, body STRING").json(path)
    body = lambda key: F.get_json_object("body", f"$.{key}")
    size = lambda key: F.json_array_length(body(key)).cast("bigint")
    return written.select(
        "event_id", "part", "part_id",
        F.coalesce(body("name"), body("title"), body("text")).alias("label"),
        body("presenterId").cast("bigint").alias("presenter_id"),
        body("sessionId").cast("bigint").alias("session_id"),
        size("options").alias("n_options"),
        size("answers").alias("n_answers"),
        size("textAnswers").alias("n_texts"),
        body("textAnswers[0].text").alias("first_text"),
    )


# Access


@query
def my_events(t):
    return access.my_events(t.events, t.event_users, USER)


@query
def my_events_admin(t):
    return access.my_events(t.events, t.event_users, "admin", is_admin=True, fanout=True)


def _mine(t):
    return access.my_events(t.events, t.event_users, USER)


@query
def my_sessions(t):
    return access.my_sessions(t.sessions, _mine(t))


@query
def my_questions(t):
    return access.my_questions(t.questions, _mine(t))


@query
def my_answer_options(t):
    return access.my_answer_options(t.answer_options, t.questions, _mine(t))


# Questions


@query
def question_indent(t):
    return questions.question_indent(t.answer_options)


@query
def question_depths(t):
    """Depths and errors where every tenth event leads its fourth question back to the second."""
    back = F.expr("question_id % 100 = 4 AND question_id div 100 % 10 = 3")
    cyclic = t.answer_options.withColumn(
        "if_selected_show_question_id", F.when(back, F.col("question_id") - 2).otherwise(F.col("if_selected_show_question_id"))
    )
    depths, stuck = questions.question_depths(cyclic)
    return union(depths.withColumn("error", F.lit(None).cast("string")), stuck.select("question_id", F.lit(None).cast("int").alias("indent"), "error"))


@query
def question_display(t):
    return questions.question_display(t.questions, t.answer_options)


@query
def question_has_percentages(t):
    return questions.question_has_percentages(t.questions, t.answer_options)


@query
def question_allow_plaintext(t):
    return questions.question_allow_plaintext(t.questions)


@query
def pack_order(t):
    """Orders spread out with gaps, packed again."""
    gaps = t.questions.withColumn("display_order", (F.col("display_order") * 3).cast("smallint"))
    return questions.pack_order(gaps, "event_id", "display_order").select("question_id", "display_order", "packed")


# Lookups


@query
def list_templates(t):
    return lookup.list_templates(t.events)


@query
def resolve_template(t):
    resolved, rejected = lookup.resolve_template(t.event_requests, t.events)
    none = F.lit(None)
    return union(
        resolved.select("request_id", F.col("from_template_event_id").alias("template_id"), none.cast("string").alias("error")),
        rejected.select("request_id", none.cast("bigint").alias("template_id"), "error"),
    )


@query
def open_sessions(t):
    return lookup.open_sessions(t.sessions, t.events, AS_OF)


@query
def events_by_secret(t):
    return lookup.events_by_secret(t.secrets, t.events).select("request_id", "event_id")


def _listing(t):
    return lookup.session_listing(t.sessions, t.events, t.session_presenters, t.presenters)


def _listing_rows(listing, *more):
    return listing.select(
        "event_id", "session_id", "title", "css", speaker_names("presenters").alias("speakers"), *more
    )


@named("speaker_names")
def listed_speakers(t):
    return _listing_rows(_listing(t))


@query
def search_sessions(t):
    return _listing_rows(lookup.search_sessions(_listing(t), "Red"))


@query
def search_sessions_by_speaker(t):
    return _listing_rows(lookup.search_sessions(_listing(t), "SUPPLIER#00000000"))


@query
def share_links(t):
    return lookup.share_links(t.sessions, HOST)


@query
def route_session_requests(t):
    return lookup.route_session_requests(t.session_requests).select("request_id", "route")


@query
def requested_events(t):
    return lookup.requested_events(t.session_requests, t.responses, t.sessions)


@query
def sessions_by_response(t):
    rows = lookup.sessions_by_response(t.session_requests, t.responses, t.stored)
    return _listing_rows(rows, "n_requests")


@query
def sessions_by_presenter_event(t):
    rows = lookup.sessions_by_presenter_event(t.presenter_requests, t.stored)
    return _listing_rows(rows, "n_requests")


@query
def sessions_by_presenter_event_strict(t):
    rows = lookup.sessions_by_presenter_event(t.presenter_requests, t.stored, strict=True)
    return _listing_rows(rows, "presenter_id", "n_requests")


@query
def sessions_by_event(t):
    rows = lookup.sessions_by_event(t.session_requests, t.stored)
    return _listing_rows(rows, "n_requests")


# Documents


def _positions(df, key, name, keep):
    return df.select(*keep, F.posexplode(name).alias("position", "item"))


@query
def session_speaker_rows(t):
    return lookup.session_speaker_rows(t.session_presenters, t.presenters)


@query
def session_speakers_by_name(t):
    lists_ = lookup.session_speakers(t.session_presenters, t.presenters)
    return lists_.select("session_id", speaker_names("presenters").alias("speakers"))


@query
def session_speakers(t):
    lists_ = lookup.session_speakers(t.session_presenters, t.presenters, order="owner")
    return lists_.select("session_id", speaker_names("presenters").alias("speakers"))


@query
def session_speakers_long(t):
    """Speakers of a session with two thirds of all customers, owner first, over as many pages as it takes."""
    lists_ = lookup.session_speakers(t.audience["session_presenters"], t.audience["presenters"], order="owner")
    leaves = lists_.select("session_id", "page", "pages", F.posexplode("presenters").alias("position", "p"))
    return leaves.select("session_id", "page", "pages", "position", F.col("p.name").alias("name"))


def _long_listing(t):
    a = t.audience
    return lookup.session_listing(a["sessions"], a["events"], a["session_presenters"], a["presenters"])


@query
def search_sessions_long(t):
    """Needles over two names; those of the second are on different pages."""
    parts = [lookup.search_sessions(_long_listing(t), needle).withColumn("needle", F.lit(needle)) for needle in LONG_NEEDLES]
    return union(*parts).select("needle", "session_id", "title", "page", F.size("presenters").alias("n_names"))


@query
def sessions_blob_long(t):
    """An event with a session for every third customer, by title, over as many pages as it takes."""
    blob = documents.sessions_blob(_long_listing(t))
    leaves = blob.select("event_id", "page", "pages", F.posexplode("sessions").alias("position", "s"))
    return leaves.select("event_id", "page", "pages", "position", F.col("s.sessionId").alias("session_id"), F.coalesce("s.page", F.lit(0)).alias("speaker_page"))


def _session_items(df, *keep):
    return df.select(*keep, F.posexplode("sessions").alias("position", "s")).select(
        *keep, "position", F.col("s.sessionId").alias("session_id"), F.col("s.title").alias("title"),
        F.col("s.css").alias("css"), speaker_names("s.presenters").alias("speakers"),
    )


def _per_request(t, df):
    """Rows of events for every request that knows the event's secret."""
    return lookup.events_by_secret(t.secrets, t.events).select("request_id", "event_id").join(df, "event_id")


@query
def sessions_blob(t):
    return _session_items(documents.sessions_blob(_listing(t)), "event_id")


@query
def admin_event_info(t):
    info = documents.admin_event_info(t.secrets, t.events, t.sessions, t.session_presenters, t.presenters)
    return _session_items(_per_request(t, info.select("event_id", "name", "sessions")), "request_id", "event_id", "name")


@query
def admin_event_json(t):
    """The documents as JSON text, read back by path."""
    info = documents.admin_event_info(t.secrets, t.events, t.sessions, t.session_presenters, t.presenters)
    body = lambda path: F.get_json_object("body", path)
    return _per_request(t, documents.admin_event_json(info)).select(
        "request_id",
        body("$.eventId").cast("bigint").alias("event_id"),
        body("$.name").alias("name"),
        body("$.css").alias("css"),
        F.json_array_length(body("$.sessions")).cast("bigint").alias("n_sessions"),
        body("$.sessions[0].title").alias("first_title"),
        body("$.sessions[0].presenters[0].name").alias("first_speaker"),
    )


@query
def questionnaire(t):
    """One row per response; its form as one text of questions."""
    forms = documents.questionnaire(
        t.responses, t.sessions, t.events, t.session_presenters, t.presenters, t.questions, t.answer_options
    )
    flag = lambda c: F.when(c, "1").otherwise("0")
    line = lambda q: F.concat_ws(
        ":", q["questionId"], q["indent"], flag(q["display"]), flag(q["allowPlaintext"]), flag(q["hasPercentages"]),
        F.coalesce(F.size(q["options"]), F.lit(0)),
    )
    return forms.select(
        "response_id", "client_key", "css", "title", "event_id",
        speaker_names("speakers").alias("speakers"),
        F.array_join(F.transform("questions", line), " ").alias("form"),
    )


@query
def questionnaire_options(t):
    """Leaf rows of the forms: one per question and option, with positions."""
    forms = documents.event_forms(t.questions, t.answer_options)
    rows = forms.select("event_id", F.posexplode("questions").alias("question_position", "q"))
    rows = rows.select("event_id", "question_position", "q", F.posexplode_outer("q.options").alias("option_position", "o"))
    return rows.select(
        "event_id", "question_position", F.col("q.questionId").alias("question_id"), F.col("q.question").alias("question"),
        F.col("q.description").alias("description"), F.col("q.isRequired").alias("is_required"),
        F.col("q.type").alias("type"), F.col("q.indent").alias("indent"), F.col("q.display").alias("display"),
        "option_position", F.col("o.answer_ordinal").alias("answer_ordinal"), F.col("o.annotation").alias("annotation"),
        F.col("o.followUpQuestionId").alias("follow_up_id"), F.col("o.classList").alias("class_list"),
    )


@query
def event_report(t):
    """Leaf rows of the nested report: one per response."""
    reports = documents.event_report(t.secrets, t.published)
    rows = reports.select(
        "event_id", "name",
        F.size("presenters").cast("bigint").alias("n_presenters"), F.size("questions").cast("bigint").alias("n_questions"),
        F.explode("sessions").alias("s"),
    ).select("event_id", "name", "n_presenters", "n_questions", "s", F.explode("s.responses").alias("r"))
    ids = F.array_join(F.transform("r.answers", lambda a: a["optionId"].cast("string")), ",")
    texts = F.array_join(F.transform("r.textAnswers", lambda x: F.concat_ws("=", x["questionId"], x["text"])), ",")
    owner = F.filter("s.presenters", lambda p: p["isOwner"])
    leaves = rows.select(
        "event_id", "name", "n_presenters", "n_questions",
        F.col("s.sessionId").alias("session_id"), F.col("s.sessionizeId").alias("feed_id"), F.col("s.title").alias("title"),
        F.get(owner, 0)["presenterId"].alias("owner_id"),
        F.col("r.responseId").alias("response_id"), F.col("r.created").alias("created"), F.col("r.updated").alias("updated"),
        ids.alias("option_ids"), texts.alias("texts"),
    )
    return _per_request(t, leaves)


@query
def report_rows(t):
    return documents.report_rows(t.folded)


# Upserts


@query
def upsert_presenters(t):
    snapshot, rejected, _ = upsert.upsert_presenters(t.presenters, t.incoming_presenters)
    return union(
        snapshot.withColumn("error", F.lit(None).cast("string")),
        rejected.select(F.lit(None).cast("bigint").alias("presenter_id"), "name", "email", "identifier", "error"),
    )


def _upserted(t):
    """The requests of the parts, the same again for events that are not there."""
    strays = t.incoming_sessions.withColumns({"event_id": F.col("event_id") + 10_000_000, "seq": F.col("seq") + 100_000_000})
    return upsert.upsert_sessions(t.sessions, t.session_presenters, t.events, t.incoming_sessions.unionByName(strays))


@query
def upsert_sessions(t):
    return _upserted(t)["sessions"]


@query
def upsert_sessions_links(t):
    return _upserted(t)["session_presenters"]


@query
def upsert_sessions_results(t):
    """One row a request: the session it got, or the reason it got none."""
    result, none = _upserted(t), F.lit(None)
    return union(
        result["assigned"].withColumn("error", none.cast("string")),
        result["rejected"].select("seq", none.cast("bigint").alias("session_id"), "error"),
    )


def _linked(t):
    """The requests of the line items, the same again for sessions or speakers that are not there."""
    links = t.incoming_links
    strays = links.withColumn("session_id", -F.col("session_id") - 1).unionByName(links.withColumn("presenter_id", -F.col("presenter_id") - 1))
    return upsert.upsert_session_presenters(t.session_presenters, t.sessions, t.presenters, links.unionByName(strays))


@query
def upsert_session_presenters(t):
    return _linked(t)[0]


@query
def upsert_session_presenters_rejected(t):
    return _linked(t)[1]


def _created(t):
    return copies.create_events(t.stored, t.event_requests)


@query
def create_events(t):
    return copies.create_event_rows(t.events, t.event_requests)["events"]


@query
def create_events_questions(t):
    return _created(t)["questions"]


@query
def create_events_options(t):
    return _created(t)["answer_options"]


@query
def create_events_results(t):
    result = copies.create_event_rows(t.events, t.event_requests)
    none = F.lit(None)
    return union(
        result["created"].withColumn("error", none.cast("string")),
        result["updated"].select("request_id", "event_id", none.cast("string").alias("event_secret"), none.cast("string").alias("error")),
        result["rejected"].select(
            "request_id", none.cast("bigint").alias("event_id"), none.cast("string").alias("event_secret"), "error"
        ),
    )


@query
def import_feed(t):
    """The feeds of all create-event requests imported: what each request has got, one row a session."""
    path = fresh_path(t.spark, "feed")
    t.feed_documents.write.text(path)
    result = imports.import_feeds(t.stored, t.event_requests, *feed.read_session_feed(t.spark, path, places=True))
    got = imports.imported_sessions(result).groupBy("request_id", "feed_id", "title").agg(
        F.max(F.when(F.col("is_owner"), F.col("identifier"))).alias("owner"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "identifier", "name"))), ",").alias("speakers"),
    )
    failed = result["rejected"].select(F.col("key").cast("bigint").alias("request_id"), "error")
    none = F.lit(None).cast("string")
    return union(
        got.withColumn("error", none),
        failed.select("request_id", F.lit(None).cast("int").alias("feed_id"), none.alias("title"), none.alias("owner"), none.alias("speakers"), "error"),
    )


@query
def grant_event_users(t):
    return copies.grant_event_users(t.user_grants, t.principals)


@query
def init_responses(t):
    new, rejected = upsert.init_responses(t.responses, t.visits, t.sessions, t.events)
    return union(
        new.withColumn("error", F.lit(None).cast("string")),
        rejected.select(
            "request_id", F.lit(None).cast("bigint").alias("response_id"), "session_id",
            F.lit(None).cast("string").alias("client_key"), F.lit(None).cast("timestamp_ntz").alias("created"),
            F.lit(None).cast("timestamp_ntz").alias("updated"), "error",
        ),
    )


@named("assign_ids")
def order_ids(t):
    """48-bit ids for all orders, beside those of the sessions. The tests draw from few bits."""
    keys = t.responses.select(F.concat(F.lit("order/"), F.col("response_id").cast("string")).alias("natural_key"))
    return assign_ids(keys, "natural_key", bits=48, taken=t.sessions.select("session_id"))


# List edits


@query
def insert_questions(t):
    return lists.insert_questions(t.questions, t.question_inserts, t.events)[0]


@query
def update_questions(t):
    return lists.update_questions(t.questions, t.question_updates)[0]


@query
def insert_answer_options(t):
    return lists.insert_answer_options(t.answer_options, t.option_inserts, t.questions)[0]


# Deletes


@query
def delete_questions(t):
    """Remaining questions and rejected requests."""
    result, rejected = cascade.delete_questions(t.published, t.deleted_questions)
    return union(
        result["questions"].select("question_id", "display_order", F.lit(None).cast("string").alias("error")),
        rejected.select("question_id", F.lit(None).cast("smallint").alias("display_order"), "error"),
    )


@query
def delete_questions_answers(t):
    result, _ = cascade.delete_questions(t.published, t.deleted_questions)
    return result["response_answers"]


@query
def delete_events(t):
    """Keys of all rows that remain in the ten tables."""
    result, _ = cascade.delete_events(t.published, t.deleted_events)
    keys = {
        "events": ["event_id"], "event_users": ["event_id", "user"], "presenters": ["presenter_id"],
        "sessions": ["session_id"], "session_presenters": ["session_id", "presented_by_id"],
        "questions": ["question_id"], "answer_options": ["answer_option_id"], "responses": ["response_id"],
        "response_answers": ["response_id", "question_id", "answer_option_id"],
        "response_plaintext": ["response_id", "question_id"],
    }
    return union(
        *[
            result[name].select(
                F.lit(name).alias("table_name"), F.concat_ws("/", *[F.col(c).cast("string") for c in key]).alias("row_key")
            )
            for name, key in keys.items()
        ]
    )


@query
def orphan_presenters(t):
    """Speakers without a session after an import of speakers, before any link."""
    imported, _, _ = upsert.upsert_presenters(t.presenters, t.incoming_presenters)
    return cascade.orphan_presenters(imported, t.session_presenters)


# Folds


@query
def fold_radio(t):
    return fold.fold_radio(t.answer_changes, *_dims(t))


@query
def fold_checkbox(t):
    return fold.fold_checkbox(t.answer_changes, *_dims(t))


@query
def fold_checkbox_scoped(t):
    return fold.fold_checkbox(t.answer_changes, *_dims(t), scoped=True)


@query
def fold_plaintext(t):
    return fold.fold_plaintext(t.answer_changes, *_dims(t)[:3])


@query
def touch_responses(t):
    return fold.touch_responses(t.responses, t.answer_changes)


def _state_rows(state):
    """Answers, texts and touched responses as rows of one layout."""
    answers = state["response_answers"].withColumn("plaintext", F.lit(None).cast("string"))
    texts = state["response_plaintext"].withColumn("answer_option_id", F.lit(None).cast("bigint"))
    touched = state["responses"].select(
        "response_id", F.lit(None).cast("bigint").alias("question_id"), F.lit(None).cast("bigint").alias("answer_option_id"),
        F.lit(None).cast("string").alias("plaintext"), "created", F.lit(None).cast("bigint").alias("revision"), "updated",
    )
    return union(touched, answers, texts)


@query
def apply_changes(t):
    """The event stream's log applied onto the stored snapshot of the line-item log."""
    return _state_rows(fold.apply_changes(t.published, t.stream_changes))


@query
def stream_apply_changes(t):
    """The event stream's log in three scheduled runs of the streaming job, with a compaction between them, onto
    the stored snapshot of the line-item log."""
    log = stored(t.stream_changes, "stream-log")
    source, deltas, checkpoint = (fresh_path(t.spark, name) for name in ("log", "deltas", "stream"))
    last = log.agg(F.max("seq")).first()[0] + 1
    for part in range(3):
        log.where(F.col("seq").between(last * part // 3, last * (part + 1) // 3 - 1)).write.mode("append").parquet(source)
        arriving = t.spark.readStream.schema(log.schema).parquet(source)
        stream.stream_apply_changes(arriving, deltas, checkpoint).awaitTermination()
        if part == 1:
            stream.compact_state(t.spark, deltas, up_to=0)
    return _state_rows(stream.stream_state(t.spark, deltas, t.published))


@query
def keyed_apply_changes(t):
    """The event stream's log in three scheduled runs of the keyed job, whose state starts from the stored snapshot."""
    log = t.stream_changes
    source, checkpoint = (fresh_path(t.spark, name) for name in ("log", "keyed"))
    last = log.agg(F.max("seq")).first()[0] + 1
    for part in range(3):
        log.where(F.col("seq").between(last * part // 3, last * (part + 1) // 3 - 1)).write.mode("append").parquet(source)
        arriving = t.spark.readStream.schema(log.schema).parquet(source)
        keyed.keyed_apply_changes(arriving, checkpoint, t.published).awaitTermination()
    return _state_rows(keyed.keyed_state(t.spark, checkpoint, t.published))


@query
def visible_questions(t):
    return fold.visible_questions(t.answer_changes, *_dims(t))


@query
def answer_bands(t):
    bands = fold.answer_bands(t.answer_changes, *_dims(t))
    return bands.select("response_id", "question_id", F.array_join("classes", " ").alias("classes"))


# Quality


def _broken(t):
    """The stored tables with every kind of rule broken in places."""
    broken = dict(t.published)
    broken["sessions"] = t.sessions.withColumn("feed_id", F.expr("feed_id div 2")).unionByName(
        t.sessions.where("title LIKE 'red%'")
    )
    broken["events"] = t.events.withColumn("api_key", F.expr("CASE WHEN css IS NULL THEN 'same' ELSE api_key END"))
    broken["presenters"] = t.presenters.where("email IS NOT NULL").withColumn("name", F.expr("nullif(name, 'Supplier#000000001')"))
    broken["session_presenters"] = t.session_presenters.withColumn("is_session_owner", F.lit(True))
    broken["questions"] = t.questions.withColumn("type", F.expr("CASE WHEN is_required THEN 'slider' ELSE type END")).withColumn(
        "display_order", F.expr("CAST(display_order * 30 AS SMALLINT)")
    )
    broken["answer_options"] = t.answer_options.withColumn("percent_value", F.expr("CAST(percent_value * 2 AS SMALLINT)")).withColumn(
        "annotation", F.expr("repeat(annotation, 6)")
    )
    broken["responses"] = t.published["responses"].where("created < timestamp_ntz'2001-01-01 00:00:00'")
    return broken


@query
def dq_unique(t):
    return quality.dq_unique(_broken(t))


@query
def dq_unique_filtered(t):
    return quality.dq_unique_filtered(_broken(t))


@query
def dq_foreign_keys(t):
    return quality.dq_foreign_keys(_broken(t))


@query
def dq_domain(t):
    return quality.dq_domain(_broken(t))


@query
def dq_not_null_length(t):
    return quality.dq_not_null_length(_broken(t))


@query
def dq_summary(t):
    """Violations per rule on the clean tables: all zero."""
    rules = [r[0] for r in quality.UNIQUE + quality.UNIQUE_WHERE + quality.REFERENCES + quality.DOMAINS]
    clean = t.published
    findings = union(
        quality.dq_unique(clean), quality.dq_unique_filtered(clean), quality.dq_foreign_keys(clean), quality.dq_domain(clean)
    )
    return quality.summarise(findings, rules)
