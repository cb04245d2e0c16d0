import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from podium.functions import nest
from podium.functions.nest import paged_list
from podium.functions.store import stored
from podium.functions.text import leading_int, speaker_names
from podium.operators import documents, lookup
from podium.session import fresh_path
from podium.sources import feed, sinks
from podium.sources.schemas import FEED, RAW_CHANGES, TABLES

AT = dt.datetime(2024, 1, 1, 0, 0, 0, 123000)


@pytest.fixture
def tables(table):
    return {
        "events": table("events", [(1, "E", None, False, None, None, None, "AbC"), (2, "Empty", "/x.css", False, None, None, None, "def")]),
        "presenters": table("presenters", [(1, "Zoe", "z@x", None), (2, "Ann", None, "a"), (3, "Idle", None, None)]),
        "sessions": table("sessions", [(11, 1, 5, "B talk"), (12, 1, None, "A talk")]),
        "session_presenters": table("session_presenters", [(11, 1, True), (11, 2, False)]),
        "questions": table("questions", [
            (10, 1, 1, "q1", None, 100, True, "radio", False), (11, 1, 2, "q2", "d", None, False, "text", False),
        ]),
        "answer_options": table("answer_options", [
            (10, 102, 2, 100, None, "top", "good"), (10, 101, 1, None, 11, None, None),
        ]),
        "responses": table("responses", [(7, 11, "ck", AT, AT), (8, 12, "ck8", AT, AT)]),
        "response_answers": table("response_answers", [(7, 10, 101, AT, 0, AT)]),
        "response_plaintext": table("response_plaintext", [(7, 11, "fine", AT, 0, AT)]),
    }


def bodies(df):
    return {r[0]: json.loads(r.body) for r in df.collect()}


def test_form_document(tables):
    forms = documents.questionnaire(*[
        tables[n] for n in ("responses", "sessions", "events", "session_presenters", "presenters", "questions", "answer_options")
    ])
    found = bodies(documents.questionnaire_json(forms))
    q1 = {
        "question": "q1", "questionId": 10, "isRequired": True, "indent": 0, "display": True, "type": "radio",
        "allowPlaintext": False, "hasPercentages": True,
        "options": [
            {"answer_ordinal": 1, "followUpQuestionId": 11},
            {"answer_ordinal": 2, "annotation": "top", "classList": "good"},
        ],
    }
    q2 = {
        "question": "q2", "description": "d", "questionId": 11, "isRequired": False, "indent": 0, "display": False,
        "type": "text", "allowPlaintext": True, "hasPercentages": False,
    }
    # The owner comes first; NULLs and empty lists are left out.
    assert found[7] == {
        "clientKey": "ck", "responseId": 7, "title": "B talk", "eventId": 1,
        "speakers": [{"name": "Zoe"}, {"name": "Ann"}], "questions": [q1, q2],
    }
    assert "speakers" not in found[8] and "css" not in found[8]


def test_admin_document(spark, tables):
    requests = spark.createDataFrame([(1, "aBc"), (2, "DEF"), (3, "unknown")], "request_id BIGINT, secret STRING")
    info = documents.admin_event_info(requests, *[tables[n] for n in ("events", "sessions", "session_presenters", "presenters")])
    by_event = bodies(documents.admin_event_json(info))
    wanted = lookup.events_by_secret(requests, tables["events"])
    assert {r.request_id: by_event[r.event_id] for r in wanted.collect()} == {
        1: {
            "eventId": 1, "name": "E",
            "sessions": [
                {"sessionId": 12, "title": "A talk"},
                {"sessionId": 11, "title": "B talk", "presenters": [{"name": "Ann"}, {"name": "Zoe"}]},
            ],
        },
        2: {"eventId": 2, "name": "Empty", "css": "/x.css"},
    }


def test_report_document(spark, tables):
    requests = spark.createDataFrame([(1, "abc")], "request_id BIGINT, secret STRING")
    report = bodies(documents.event_report_json(documents.event_report(requests, tables)))[1]
    assert report == {
        "name": "E",
        "presenters": [{"presenterId": 1, "name": "Zoe", "email": "z@x"}, {"presenterId": 2, "name": "Ann"}],
        "questions": [
            {
                "questionId": 10, "displayOrder": 1, "text": "q1", "type": "radio", "optimalValue": 100,
                "options": [{"optionId": 101, "ordinal": 1}, {"optionId": 102, "ordinal": 2, "percent": 100, "annotation": "top"}],
            },
            {"questionId": 11, "displayOrder": 2, "text": "q2", "type": "text"},
        ],
        "sessions": [
            {
                "sessionId": 11, "sessionizeId": 5, "title": "B talk",
                "presenters": [{"presenterId": 1, "isOwner": True}, {"presenterId": 2, "isOwner": False}],
                "responses": [{
                    "created": "2024-01-01T00:00:00.123", "updated": "2024-01-01T00:00:00.123", "responseId": 7,
                    "answers": [{"optionId": 101}], "textAnswers": [{"questionId": 11, "text": "fine"}],
                }],
            },
            {
                "sessionId": 12, "title": "A talk",
                "responses": [{"created": "2024-01-01T00:00:00.123", "updated": "2024-01-01T00:00:00.123", "responseId": 8}],
            },
        ],
    }


def test_long_lists_are_paged_and_whole(spark):
    rows = spark.range(2000).selectExpr("CASE WHEN id < 1900 THEN 0 ELSE id END AS key", "id AS value")
    pages = paged_list(rows, "key", [F.desc("value")], F.col("value"), "values", ["value"], page_items=100).collect()
    hot = [r for r in pages if r["key"] == 0]
    assert {r.pages for r in hot} == {19} and len({r.page for r in hot}) == len(hot)
    assert sorted(v for r in hot for v in r["values"]) == list(range(1900))
    whole = [v for r in sorted(hot, key=lambda r: r.page) for v in r["values"]]
    assert whole == sorted(whole, reverse=True) and {len(r["values"]) for r in hot} == {100}
    assert all((r.page, r.pages, r["values"]) == (0, 1, [r["key"]]) for r in pages if r["key"])


@pytest.mark.parametrize("range_items", [40, 700, 100_000])
def test_long_lists_are_in_order_over_ranges_and_pages(spark, monkeypatch, range_items):
    """One key with most of the rows, many equal order values, items of weight 1 to 7."""
    monkeypatch.setattr(nest, "RANGE_ITEMS", range_items)
    rows = [(i % 40 if i % 5 == 0 else 99, i % 13, i, 1 + i % 7) for i in range(2500)]
    df = spark.createDataFrame(rows, "key long, by long, id long, weight long").repartition(5)
    for weight in (None, F.col("weight")):
        lists = paged_list(df, "key", [F.desc("by")], F.struct("id", "weight"), "items", ["id"], 90, weight).collect()
        for key in {r[0] for r in rows}:
            pages = sorted((r.page, r.pages, r["items"]) for r in lists if r.key == key)
            assert [p for p, _, _ in pages] == list(range(pages[0][1]))
            assert [x.id for _, _, items in pages for x in items] == [i for _, i in sorted((-by, i) for k, by, i, _ in rows if k == key)]
            sizes = [sum(1 if weight is None else x.weight for x in items) for _, _, items in pages]
            assert max(sizes) < 90 + 7 and all(n > 90 - 7 for n in sizes[:-1])
    assert paged_list(df.limit(0), "key", ["by"], F.col("id"), "items", ["id"]).count() == 0


def test_speakers_beyond_a_page_keep_their_order_and_are_searched_as_one_text(spark, table):
    n = 1501
    name = lambda i: f"N{i * 7919 % n:04d}"
    presenters = table("presenters", [(i, name(i), None, None) for i in range(n)])
    links = table("session_presenters", [(11, i, i == 777) for i in range(n)] + [(12, 5, False)])
    in_order = lambda rows: [p.name for r in sorted(rows, key=lambda r: r.page) for p in r.presenters]
    pages = lookup.session_speakers(links, presenters, order="owner").where("session_id = 11").collect()
    assert [len(r.presenters) for r in sorted(pages, key=lambda r: r.page)] == [500, 500, 500, 1]
    names = sorted(name(i) for i in range(n))
    assert in_order(pages) == [name(777), *(x for x in names if x != name(777))]
    events = table("events", [(1, "E", None, False, None, None, None, "s")])
    listing = lookup.session_listing(table("sessions", [(11, 1, 5, "Talk"), (12, 1, 6, "N0499 other")]), events, links, presenters)
    found = lambda needle: sorted({r.session_id for r in lookup.search_sessions(listing, needle).collect()})
    for needle in ("n0499, n05", "0999, N1000", "N1499, N1500", ", n0500", "n0499, ", ", ".join(names[450:1400]), "talk\nn0000"):
        assert found(needle) == [11], needle
    assert found("n0499, n0501") == [] and found("n1500, n") == [] and found("n0499") == [11, 12]
    assert {r.page for r in lookup.search_sessions(listing, "N0999, N1000").collect()} == {0, 1, 2, 3}
    small = lookup.session_listing(table("sessions", [(11, 1, 5, "Talk")]), events, links, presenters, page_items=2)
    assert lookup.search_sessions(small, ", ".join(names[3:30]), page_items=2).count() == 751
    assert lookup.search_sessions(small, ", ".join([*names[3:30], "x"]), page_items=2).count() == 0


def test_documents_of_any_size_lose_nothing(spark, table, tables):
    """700 speakers and 1,200 responses of one session, 600 sessions of one event."""
    n, m = 700, 1200
    big = dict(tables)
    big["sessions"] = tables["sessions"].unionByName(table("sessions", [(1000 + i, 1, None, f"T{i}") for i in range(600)]))
    big["presenters"] = table("presenters", [(i, f"P{i}", None, None) for i in range(n)])
    big["session_presenters"] = table("session_presenters", [(11, i, i == 0) for i in range(n)])
    big["responses"] = table("responses", [(i, 11, f"c{i}", AT, AT) for i in range(m)])
    big["response_answers"] = table("response_answers", [(i, 10, 101, AT, 0, AT) for i in range(m)])
    requests = spark.createDataFrame([(1, "abc")], "request_id BIGINT, secret STRING")
    rows = documents.event_report(requests, big, page_items=100).collect()
    assert len(rows) > 1 and {r.event_id for r in rows} == {1}
    assert sorted(p.presenterId for r in rows for p in r.presenters or []) == list(range(n))
    assert sum(len(r.questions or []) for r in rows) == 2
    items = [s for r in rows for s in r.sessions or []]
    assert {s.sessionId for s in items} == {11, 12, *range(1000, 1600)}
    assert sorted(p.presenterId for s in items for p in s.presenters or []) == list(range(n))
    assert sorted(x.responseId for s in items for x in s.responses or []) == list(range(m))
    assert max(len(s.responses or []) for s in items) < 200
    flat = documents.report_rows(big).where("answer_option_id IS NOT NULL")
    assert sorted(r.response_id for r in flat.collect()) == sorted(x.responseId for s in items for x in s.responses or [] if x.answers)

    catalog = [big[k] for k in ("events", "session_presenters", "presenters")]
    listing = lookup.session_listing(big["sessions"], *catalog)
    assert sum(len(r.presenters) for r in listing.where("session_id = 11").collect()) == n
    # A speaker on one page finds all rows of the session.
    found = lookup.search_sessions(listing, "p699").collect()
    assert {r.session_id for r in found} == {11} and len(found) == listing.where("session_id = 11").count()
    info = documents.admin_event_info(requests, big["events"], big["sessions"], big["session_presenters"], big["presenters"])
    listed = [json.loads(r.body) for r in documents.admin_event_json(info).collect()]
    assert {s["sessionId"] for d in listed for s in d["sessions"]} == {11, 12, *range(1000, 1600)}
    assert len(listed) > 1 and all(d["pages"] == listed[0]["pages"] for d in listed)
    forms = documents.questionnaire(*[big[k] for k in ("responses", "sessions", "events", "session_presenters", "presenters", "questions", "answer_options")])
    assert sum(len(r.speakers) for r in forms.where("response_id = 5").collect()) == n


def test_report_parts_round_trip(spark, tables):
    path = fresh_path(spark, "reports")
    parts = documents.report_parts(tables)
    sinks.write_event_reports(parts, path, buckets=4)
    written = spark.read.schema("event_id BIGINT, part STRING, part_id STRING, body STRING").json(path)
    key = lambda rows: sorted((r.event_id, r.part, r.part_id, r.body) for r in rows)
    assert key(written.collect()) == key(parts.collect())


def test_flat_report(tables):
    rows = documents.report_rows(tables).collect()
    assert sorted((r.response_id, r.question_id, r.answer_ordinal, r.text) for r in rows if r.answer_ordinal) == [(7, 10, 1, None)]
    assert [(r.question_type, r.text, r.session_title, r.event_name) for r in rows if r.text] == [("text", "fine", "B talk", "E")]


def test_flat_report_broadcasts_no_table_that_is_small_in_its_files_only(spark, tables):
    """300,000 questions: few bytes in files, 14 MB or more as rows of the driver."""
    more = spark.range(100, 300_100).selectExpr(
        "id AS question_id", "id div 10 AS event_id", "cast(id % 10 AS smallint) AS display_order", "'Q' AS question",
        "cast(NULL AS string) AS description", "cast(NULL AS smallint) AS optimal_percent", "true AS is_required",
        "'radio' AS type", "false AS has_plaintext",
    )
    questions = stored(tables["questions"].unionByName(more), "many-questions")
    flat = documents.report_rows({**tables, "questions": questions})
    expected = documents.report_rows(tables).collect()
    assert sorted(map(str, flat.collect())) == sorted(map(str, expected)) and len(expected) == 2
    joins = [x for x in flat._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [question_id" in x]
    assert joins and not [x for x in joins if "Broadcast" in x and "BuildRight" in x]


def test_listing_search_and_links(tables):
    listing = lookup.session_listing(*[tables[n] for n in ("sessions", "events", "session_presenters", "presenters")])
    found = lambda needle: sorted(r.session_id for r in lookup.search_sessions(listing, needle).collect())
    assert found("") == [11, 12] and found("TALK") == [11, 12] and found("zoe") == [11] and found("ann, z") == [11]
    assert found("talk ann") == []  # title and speakers are on separate lines
    names = {r.session_id: r.n for r in listing.select("session_id", speaker_names("presenters").alias("n")).collect()}
    assert names == {11: "Ann, Zoe", 12: ""}
    assert tuple(lookup.share_links(tables["sessions"], "h.org").where("session_id = 11").first()) == (
        11, 1, "https://h.org/11", "https://h.org/event/1", "/qr/11",
    )


def test_session_requests(spark, tables):
    requests = spark.createDataFrame(
        [(1, 7, None, None), (2, None, 2, 1), (3, None, None, 1), (4, None, 2, None), (5, 0, None, 1), (6, 99, None, None)],
        "request_id BIGINT, response_id BIGINT, presenter_id BIGINT, event_id BIGINT",
    )
    routes = {r.request_id: r.route for r in lookup.route_session_requests(requests).collect()}
    assert routes == {1: "response", 2: "presenter_event", 3: "event", 4: "rejected", 5: "event", 6: "response"}
    events = {r.request_id: r.event_id for r in lookup.requested_events(requests, tables["responses"], tables["sessions"]).collect()}
    assert events == {1: 1, 2: 1, 3: 1, 5: 1}
    pairs = spark.createDataFrame([(2, 1)], "presenter_id BIGINT, event_id BIGINT")
    loose = lookup.sessions_by_presenter_event(pairs, tables)
    strict = lookup.sessions_by_presenter_event(pairs, tables, strict=True)
    assert sorted(r.session_id for r in loose.collect()) == [11, 12]
    assert [r.session_id for r in strict.collect()] == [11]


def test_feed(spark):
    session = lambda i, status="Accepted", service=False, speakers=None: (i, f"t{i}", status, service, speakers)
    documents_ = [
        ("e1", [
            ([session(1, speakers=[("a", "Ann"), ("b", "Bob")]), session(2, "Declined"), session(3, service=True), session(4, service=None)],),
            ([session(9)],),
        ]),
        ("e2", None),
    ]
    path = fresh_path(spark, "feed")
    spark.createDataFrame(documents_, FEED).write.json(path)
    sessions, speakers = feed.read_session_feed(spark, path)
    assert sorted(r.feed_id for r in sessions.collect()) == [1, 4]
    assert sorted((r.position, r.identifier, r.is_owner) for r in speakers.collect()) == [(0, "a", True), (1, "b", False)]
    assert sorted(r.feed_id for r in feed.read_session_feed(spark, path, all_groups=True)[0].collect()) == [1, 4, 9]


def test_feed_files_as_answered(spark, tmp_path):
    answer = [{"sessions": [{"id": 1, "title": "t", "status": "Accepted", "isServiceSession": False,
                             "speakers": [{"id": "a", "name": "Ann"}]}]}, {"sessions": []}]
    (tmp_path / "my-key.json").write_text(json.dumps(answer, indent=2))
    (tmp_path / "broken.json").write_text("{")
    sessions, speakers = feed.read_session_feed_files(spark, str(tmp_path))
    assert [tuple(r) for r in sessions.collect()] == [("my-key", 1, "t")]
    assert [r.name for r in speakers.collect()] == ["Ann"]


def test_names_compare_by_collation_on_request(spark, table):
    events = table("events", [(1, "b", None, True, None, None, None, "s"), (2, "A", None, True, None, None, None, "s"),
                              (3, "c", None, True, None, None, None, "s")])
    names = lambda **k: [r.name for r in lookup.list_templates(events, **k).collect()]
    assert names() == ["A", "b", "c"] and names(collation="UNICODE_CI") == ["A", "b", "c"]
    requests = spark.createDataFrame(
        [(1, None, "B"), (2, None, "A")], "request_id BIGINT, from_template_event_id BIGINT, from_template_name STRING"
    )
    assert [r.request_id for r in lookup.resolve_template(requests, events)[0].collect()] == [2]
    resolved, rejected = lookup.resolve_template(requests, events, collation="UNICODE_CI")
    assert {r.request_id: r.from_template_event_id for r in resolved.collect()} == {1: 1, 2: 2}
    assert rejected.count() == 0


def test_save_requests_are_parsed_like_numbers_in_text(spark):
    raw = [
        ("5", "10", "3a", "null", AT, 1), ("5", "10", "0", "x", AT, 2), ("5", "10", "null", "", AT, 3),
        ("5", " 11", "-2", "null", AT, 4), ("x", "10", "1", "null", AT, 5), ("5", "10", "99999", "null", AT, 6),
    ]
    path = fresh_path(spark, "raw")
    spark.createDataFrame(raw, RAW_CHANGES).write.json(path)
    rows = {r.seq: r for r in feed.read_answer_changes(spark, path).collect()}
    assert [rows[i].answer_ordinal for i in range(1, 6)] == [3, None, None, -2, 1]
    assert rows[4].question_id == 11 and rows[5].response_id is None and 6 not in rows
    assert feed.read_answer_changes(spark, path, streaming=True).isStreaming
    assert {r.seq: r.error for r in feed.read_answer_changes(spark, path, rejected=True).collect()} == {6: "answer ordinal out of range"}
    broken = fresh_path(spark, "raw")
    huge = '{"responseId": "5", "questionId": "10", "answerOrdinal": "99999999999999999999", "plaintext": "x", "seq": 7}'
    ids = '{"responseId": "99999999999999999999", "questionId": "10", "answerOrdinal": "1", "seq": 8}'
    spark.createDataFrame([(huge,), (ids,), ('{"responseId": ',)], "value STRING").write.text(broken)
    assert feed.read_answer_changes(spark, broken).count() == 0
    errors = {r.seq: r.error for r in feed.read_answer_changes(spark, broken, rejected=True).collect()}
    assert errors == {7: "answer ordinal out of range", 8: "id out of range", None: "no JSON document"}
    assert spark.range(1).select(leading_int(F.lit("+7 ")).alias("n")).first().n == 7


def test_tables_round_trip_with_their_types(spark, table, tables):
    from podium.sources.tables import load_feedback, save_feedback

    path = fresh_path(spark, "snapshot")
    save_feedback({**tables, "event_users": table("event_users", [(1, "ann")])}, path)
    loaded = load_feedback(spark, path)
    for name, schema in TABLES.items():
        assert [(f.name, f.dataType) for f in loaded[name].schema] == [(f.name, f.dataType) for f in schema]
    assert loaded["event_users"].count() == 1
    with pytest.raises(FileNotFoundError):
        load_feedback(spark, fresh_path(spark, "nothing"))
    for columns in (["event_id"], ["CAST(event_id AS STRING) AS event_id", "user"]):
        other = fresh_path(spark, "snapshot")
        save_feedback({**tables, "event_users": table("event_users", [(1, "ann")])}, other)
        loaded["event_users"].selectExpr(*columns).write.mode("overwrite").parquet(f"{other}/event_users")
        with pytest.raises(ValueError, match="event_users"):
            load_feedback(spark, other)


def test_numbers_at_the_limits_of_their_types(spark):
    """Texts too short for a large number are not searched for one; longer ones may still have small numbers."""
    texts = ["32767", "-32768", "32768", "-32769", "+9999", "9999x", "0000000000000000000007", " 5", "  -5x", None, "null"]
    ids = ["9223372036854775807", "9223372036854775808", "-9223372036854775808", "00000000000000000000012", "999999999999999999"]
    rows = [("1", "2", text, None, None, n) for n, text in enumerate(texts)] + [(i, "2", "1", None, None, 100 + n) for n, i in enumerate(ids)]
    raw = spark.createDataFrame(rows, "responseId string, questionId string, answerOrdinal string, plaintext string, ts timestamp_ntz, seq bigint")
    got = {r.seq: r for r in feed.parse_changes(raw).collect()}
    assert [got[n].answer_ordinal for n in range(len(texts))] == [32767, -32768, None, None, 9999, 9999, 7, 5, -5, None, None]
    assert {n for n, r in got.items() if r.error} == {2, 3, 101}
    assert [got[100 + n].response_id for n in (0, 2, 3, 4)] == [2**63 - 1, -(2**63), 12, 10**18 - 1]
