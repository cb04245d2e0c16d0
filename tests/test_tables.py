import datetime as dt

import pytest

from podium.operators import access, cascade, lookup, quality, questions
from podium.plans.registry import QUERIES
from podium.sources import seed
from podium.sources.schemas import TABLES


def edges(table, pairs):
    """Options from (question, follow-up) pairs."""
    return table(
        "answer_options", [(q, i, i, None, follow_up, None, None) for i, (q, follow_up) in enumerate(pairs)]
    )


@pytest.mark.parametrize(
    "pairs,expected",
    [
        ([(1, None), (2, None)], {1: 0, 2: 0}),
        ([(1, 2), (2, 3), (3, 4), (4, None)], {1: 0, 2: 1, 3: 2, 4: 3}),
        # A diamond with a shortcut: the deepest level counts.
        ([(1, 2), (1, 3), (2, 4), (3, 4), (1, 4), (4, None)], {1: 0, 2: 1, 3: 1, 4: 2}),
        # A follow-up without options has no row.
        ([(1, 9)], {1: 0}),
        # No root reaches this cycle.
        ([(1, None), (2, 3), (3, 2)], {1: 0}),
    ],
)
def test_question_indent(table, pairs, expected):
    found = {r.question_id: r.indent for r in questions.question_indent(edges(table, pairs)).collect()}
    assert found == expected


def test_a_cycle_below_a_root_raises(table):
    with pytest.raises(ValueError):
        questions.question_indent(edges(table, [(1, 2), (2, 3), (3, 2)]), max_depth=5)


def test_seed(spark, table):
    question_rows, option_rows = seed.template_seed(spark)
    assert question_rows.count() == 10 and option_rows.count() == 51
    events = table("events", [(0, "T", None, True, None, None, None, "s")])
    form = questions.question_form(seed.questions_for_events(events), seed.options_for_events(events)).collect()
    by = lambda column: {r.question_id: r[column] for r in form}
    assert by("indent") == {1: 0, 2: 1, 3: 2, 4: 2, **{k: 0 for k in range(5, 11)}}
    assert {k for k, v in by("display").items() if not v} == {2, 3, 4}
    assert {k for k, v in by("has_percentages").items() if v} == {1, 5, 6, 7, 8, 9}
    assert {k for k, v in by("allow_plaintext").items() if v} == {2, 3, 6, 10}


@pytest.fixture
def world(table):
    event = lambda i, **k: (i, k.get("name", f"e{i}"), None, k.get("template", False), k.get("start"), k.get("end"), k.get("key"), f"s{i}")
    at = dt.datetime(2024, 1, 1)
    return {
        "events": table("events", [event(1, template=True, name="T"), event(2, start=at), event(3, end=at)]),
        "event_users": table("event_users", [(1, "ann"), (1, "bob"), (2, "bob")]),
        "presenters": table("presenters", [(1, "a", None, None), (2, "b", None, None), (3, "c", None, None)]),
        "sessions": table("sessions", [(10, 1, None, "x"), (20, 2, None, "y"), (30, 3, None, "z")]),
        "session_presenters": table("session_presenters", [(10, 1, True), (20, 1, True), (30, 2, True)]),
        "questions": table("questions", [
            (100, 1, 1, "q", None, None, False, "radio", False), (101, 1, 2, "f", None, None, False, "radio", False),
            (102, 1, 3, "t", None, None, False, "text", True), (103, 1, 4, "l", None, None, False, "radio", False),
            (200, 2, 1, "q", None, None, False, "radio", False),
        ]),
        "answer_options": table("answer_options", [
            (100, 1000, 1, None, 101, None, None), (101, 1001, 1, None, None, None, None), (103, 1003, 1, None, 103, None, None),
            (200, 2000, 1, None, None, None, None),
        ]),
        "responses": table("responses", [(5, 10, "c", at, at), (6, 20, "c", at, at)]),
        "response_answers": table("response_answers", [(5, 100, 1000, at, 0, at), (5, 103, 1003, at, 0, at), (6, 200, 2000, at, 0, at)]),
        "response_plaintext": table("response_plaintext", [(5, 102, "hi", at, 0, at)]),
    }


def keys(df, column):
    return sorted(r[column] for r in df.collect())


def test_access(world):
    events, users = world["events"], world["event_users"]
    assert keys(access.my_events(events, users, "bob"), "event_id") == [1, 2]
    assert keys(access.my_events(events, users, "x", is_admin=True), "event_id") == [1, 2, 3]
    assert keys(access.my_events(events, users, "x", is_admin=True, fanout=True), "event_id") == [1, 1, 2, 3]
    mine = access.my_events(events, users, "ann")
    assert keys(access.my_sessions(world["sessions"], mine), "session_id") == [10]
    assert keys(access.my_questions(world["questions"], mine), "question_id") == [100, 101, 102, 103]
    assert keys(access.my_answer_options(world["answer_options"], world["questions"], mine), "answer_option_id") == [1000, 1001, 1003]
    accepted, rejected = access.split_by_access(world["sessions"], mine, "event_id")
    assert keys(accepted, "session_id") == [10] and keys(rejected, "session_id") == [20, 30]


def test_open_sessions_are_strictly_inside_the_window(world):
    found = lambda at: keys(lookup.open_sessions(world["sessions"], world["events"], at), "session_id")
    at = dt.datetime(2024, 1, 1)
    assert found(at) == [10]
    assert found(at + dt.timedelta(seconds=1)) == [10, 20]
    assert found(at - dt.timedelta(seconds=1)) == [10, 30]
    assert found(dt.datetime(2000, 1, 1)) == []


def test_delete_questions(spark, world):
    ids = spark.createDataFrame([(101,), (102,), (103,), (999,)], "question_id BIGINT")
    result, rejected = cascade.delete_questions(world, ids)
    # 101 is a follow-up and 102 has texts; 103 only opens itself.
    assert {r.question_id: r.error for r in rejected.collect()} == {
        101: "still referenced", 102: "still referenced", 999: "question not found",
    }
    assert keys(result["questions"], "question_id") == [100, 101, 102, 200]
    assert keys(result["answer_options"], "answer_option_id") == [1000, 1001, 2000]
    assert keys(result["response_answers"], "answer_option_id") == [1000, 2000]
    result, _ = cascade.delete_questions(world, ids, cascade=True)
    assert {(r.question_id, r.display_order) for r in result["questions"].collect()} == {(100, 1), (200, 1)}
    assert result["response_plaintext"].count() == 0
    assert result["answer_options"].where("if_selected_show_question_id IS NOT NULL").count() == 0


def test_delete_events_also_removes_speakers_without_sessions(spark, world):
    ids = spark.createDataFrame([(1,), (9,)], "event_id BIGINT")
    result, rejected = cascade.delete_events(world, ids)
    assert keys(rejected, "event_id") == [9]
    assert {name: df.count() for name, df in result.items()} == {
        "events": 2, "event_users": 1, "presenters": 2, "sessions": 2, "session_presenters": 2, "questions": 1,
        "answer_options": 1, "responses": 1, "response_answers": 1, "response_plaintext": 0,
    }


def test_quality_finds_each_kind(spark, table, world):
    broken = {
        **world,
        "events": world["events"].unionByName(table("events", [(1, "T", None, True, None, None, None, "s")])),
        "questions": table("questions", [(1, 1, 300, "x" * 201, None, None, False, "slider", False)]),
        "answer_options": table("answer_options", [(1, 1, 1, 101, 77, None, None)]),
        "session_presenters": table("session_presenters", [(10, 1, True), (10, 2, True)]),
    }
    rows = lambda df: {(r.rule, r.key, r.n) for r in df.collect()}
    assert rows(quality.dq_unique(broken)) == {("pk_events", "1", 2)}
    assert rows(quality.dq_unique_filtered(broken)) == {("uq_template_name", "T", 2), ("uq_session_owner", "10", 2)}
    assert rows(quality.dq_domain(broken)) == {
        ("ck_question_type", "1", 1), ("ck_percent_value", "1", 1), ("ck_display_order", "1", 1),
    }
    assert rows(quality.dq_not_null_length(broken)) == {("max_length_questions", "question", 1)}
    assert ("fk_answer_options_follow_up", "77", 1) in rows(quality.dq_foreign_keys(broken))
    summary = {r.rule: r.violations for r in quality.summarise(quality.dq_domain(broken), ["ck_question_type", "clean"]).collect()}
    assert summary == {"ck_question_type": 1, "clean": 0}


PLANNED = [
    "report_rows", "fold_radio", "fold_checkbox", "fold_plaintext", "visible_questions", "answer_bands",
    "sessions_by_response", "sessions_by_presenter_event_strict", "event_report", "questionnaire", "upsert_sessions",
    "upsert_session_presenters", "grant_event_users", "delete_events", "dq_foreign_keys",
]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert operator not in plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = QUERIES["touch_responses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lineitem = next(line for line in plan.splitlines() if "FileScan" in line and "l_orderkey" in line)
    assert "l_quantity" not in lineitem and "l_returnflag" not in lineitem
