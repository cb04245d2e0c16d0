import datetime as dt
import random

import pytest

from podium.functions.ids import assign_ids, hashed_id
from podium.operators import copies, upsert
from podium.sources import seed

PRESENTER = "name STRING, email STRING, identifier STRING, seq BIGINT"


def presenters_of(df):
    return {(r.name, r.email, r.identifier) for r in df.collect()}


def replay_presenters(stored, requests):
    """One call after the other, as a search through all presenters."""
    rows = [list(r) for r in stored]
    rejected, assigned = [], {}
    for name, email, identifier, seq in requests:
        met = [r for r in rows if email is not None and r[2] == email or identifier is not None and r[3] == identifier]
        if len(met) > 1 and identifier is not None:
            rejected.append(seq)
            continue
        if not met:
            met = [[None, name, email, identifier]]
            rows += met
        for r in met:
            r[1:] = [name, email if email is not None else r[2], identifier if identifier is not None else r[3]]
        assigned[seq] = met
    return rows, rejected, assigned


@pytest.mark.parametrize("seed_", range(4))
def test_presenter_calls_equal_a_replay(spark, table, seed_):
    rng = random.Random(seed_)
    key = lambda kind, n: rng.choice([None, *[f"{kind}{rng.randrange(n)}" for _ in range(2)]])
    stored = [(i, f"s{i}", key("e", 25), f"i{i}" if i % 3 else None) for i in range(25)]
    requests = [(f"n{seq}", key("e", 40), key("i", 40), seq) for seq in range(160)]
    rows, failed, met = replay_presenters(stored, requests)
    snapshot, rejected, assigned = upsert.upsert_presenters(table("presenters", stored), spark.createDataFrame(requests, PRESENTER))
    got = {r.presenter_id: (r.name, r.email, r.identifier) for r in snapshot.collect()}
    assert sorted(got.values(), key=str) == sorted((tuple(r[1:]) for r in rows), key=str)
    assert all(got[r[0]] == tuple(r[1:]) for r in rows if r[0] is not None)
    assert sorted(r.seq for r in rejected.collect()) == failed
    by_seq = {}
    for r in assigned.collect():
        by_seq.setdefault(r.seq, []).append(got[r.presenter_id])
    assert {s: sorted(v, key=str) for s, v in by_seq.items()} == {s: sorted((tuple(r[1:]) for r in v), key=str) for s, v in met.items()}


def test_keys_that_move_within_a_batch(spark, table):
    stored = table("presenters", [(1, "a", "e1", "i1"), (2, "b", "dup", None), (3, "c", "dup", None)])
    calls = [
        ("A", "e2", "i1", 1), ("N", "e1", None, 2),  # e1 is free by then: a new presenter
        ("D", "dup", None, 3), ("E", "dup", "x", 4),  # an email of two presenters; no identifier for both
        ("F", "f", "f1", 5), ("G", "f", "f2", 6),  # one email, the identifier changes
    ]
    snapshot, rejected, _ = upsert.upsert_presenters(stored, spark.createDataFrame(calls, PRESENTER))
    assert presenters_of(snapshot) == {("A", "e2", "i1"), ("N", "e1", None), ("D", "dup", None), ("G", "f", "f2")}
    assert snapshot.count() == 5 and [r.name for r in rejected.collect()] == ["E"]


def test_presenters_with_one_key_equal_a_replay(spark, table):
    """Feed imports know only identifiers: replay them one by one."""
    rng = random.Random(3)
    stored = [(i, f"s{i}", None, f"id{i}") for i in range(10)]
    requests = [(f"n{seq}", None, f"id{rng.randrange(20)}", seq) for seq in range(60)]
    names = {identifier: name for _, name, _, identifier in stored}
    for name, _, identifier, _ in requests:
        names[identifier] = name
    snapshot, _, _ = upsert.upsert_presenters(table("presenters", stored), spark.createDataFrame(requests, PRESENTER))
    assert presenters_of(snapshot) == {(name, None, identifier) for identifier, name in names.items()}


def test_presenter_upsert_plans_no_cross_join(spark, table):
    stored = table("presenters", [(1, "a", "a@x", None)])
    snapshot, _, _ = upsert.upsert_presenters(stored, spark.createDataFrame([("A", "a@x", None, 1)], PRESENTER))
    plan = snapshot._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sessions_by_feed_id(spark, table):
    sessions = table("sessions", [(1, 1, 7, "old"), (2, 1, None, "kept"), (3, 2, 7, "other event")])
    links = table("session_presenters", [(1, 5, True), (3, 5, True)])
    incoming = spark.createDataFrame(
        [(1, "new", 7, 1), (1, "newer", 7, 2), (1, "made", 8, 3), (1, "retitled", 8, 4), (1, "kept", None, 5)],
        "event_id BIGINT, title STRING, feed_id BIGINT, seq BIGINT",
    )
    incoming = incoming.unionByName(spark.createDataFrame([(9, "no event", 7, 6)], incoming.schema))
    events = spark.createDataFrame([(1,), (2,)], "event_id BIGINT")
    result = upsert.upsert_sessions(sessions, links, events, incoming)
    snapshot, left = result["sessions"], result["session_presenters"]
    titles = {r.session_id: r.title for r in snapshot.collect()}
    assigned = {r.seq: r.session_id for r in result["assigned"].collect()}
    assert {seq: titles[i] for seq, i in assigned.items()} == {1: "newer", 2: "newer", 3: "retitled", 4: "retitled", 5: "kept"}
    assert assigned[1] == assigned[2] == 1 and assigned[5] != 2
    assert [(r.seq, r.error) for r in result["rejected"].collect()] == [(6, "event not found")]
    assert sorted((r.event_id, r.feed_id or 0, r.title) for r in snapshot.collect()) == [
        (1, 0, "kept"), (1, 0, "kept"), (1, 7, "newer"), (1, 8, "retitled"), (2, 7, "other event"),
    ]
    assert [r.session_id for r in left.collect()] == [3]


@pytest.mark.parametrize("seed_", [1, 2])
def test_links_equal_a_replay(spark, table, seed_):
    rng = random.Random(seed_)
    stored = [(s, p, p == 1) for s in range(15) for p in range(rng.randrange(1, 4))]
    requests = [(rng.randrange(15), rng.randrange(5), rng.random() < 0.5, seq) for seq in range(150)]
    links = {(s, p): owner for s, p, owner in stored}
    for s, p, owner, _ in requests:
        if owner:
            links.update({k: False for k in links if k[0] == s and k[1] != p})
        links[s, p] = owner
    strays = [(99, 1, True, 1000), (1, 77, True, 1001), (None, 1, True, 1002), (99, 77, True, 1003)]
    snapshot, rejected = upsert.upsert_session_presenters(
        table("session_presenters", stored),
        spark.range(15).selectExpr("id AS session_id"),
        spark.range(5).selectExpr("id AS presenter_id"),
        spark.createDataFrame(requests + strays, "session_id BIGINT, presenter_id BIGINT, is_owner BOOLEAN, seq BIGINT"),
    )
    assert {r.seq: r.error for r in rejected.collect()} == {
        1000: "session not found", 1001: "presenter not found", 1002: "session not found", 1003: "session not found",
    }
    assert {(r.session_id, r.presented_by_id): r.is_session_owner for r in snapshot.collect()} == links


def test_narrow_ids_stay_unique_and_repeatable(spark):
    keys = spark.range(150).selectExpr("concat('k', id) AS key")
    taken = spark.range(0, 256, 4).selectExpr("id AS used")
    ids = {r.key: r.id for r in assign_ids(keys, "key", bits=8, taken=taken).collect()}
    assert len(set(ids.values())) == 150
    assert not set(ids.values()) & set(range(0, 256, 4))
    again = {r.key: r.id for r in assign_ids(keys.repartition(7), "key", bits=8, taken=taken).collect()}
    assert again == ids
    with pytest.raises(ValueError):
        assign_ids(spark.range(300).selectExpr("concat('k', id) AS key"), "key", bits=8, max_rounds=3)
    with pytest.raises(ValueError):
        hashed_id(keys.key, 7)


REQUEST = (
    "request_id BIGINT, name STRING, from_template_event_id BIGINT, from_template_name STRING, is_template BOOLEAN, "
    "css STRING, accepts_from TIMESTAMP_NTZ, accepts_to TIMESTAMP_NTZ, api_key STRING, event_secret STRING"
)


@pytest.fixture
def template(table):
    until = dt.datetime(2030, 1, 1)
    return {
        "events": table("events", [
            (1, "T", "/t.css", True, None, None, None, "s1"), (2, "E", None, False, None, until, "key", "s2"),
        ]),
        "questions": table("questions", [
            (10, 1, 1, "q1", None, 100, True, "radio", False), (11, 1, 2, "q2", None, None, False, "text", True),
            (20, 2, 1, "other", None, None, False, "radio", False),
        ]),
        "answer_options": table("answer_options", [
            (10, 100, 1, 0, 11, "follow", "bad"), (10, 101, 2, 100, 20, "elsewhere", None), (20, 200, 1, None, None, None, None),
        ]),
    }


def request(i, template=None, key=None, by_id=None, css=None):
    return (i, f"N{i}", by_id, template, False, css, None, None, key, f"secret{i}")


def test_create_events(spark, template):
    requests = [
        request(1, template="T", key="fresh"),
        request(2, template="nowhere"),
        request(3, key="key", css="/u.css"),  # updates event 2
        request(4, key="fresh"),  # updates the event request 1 made
        request(5, key="bare"),  # no template: the key is not stored
        request(6, template="nowhere", key="fresh"),  # the known key wins over the unknown template
        request(7, by_id=99),  # copies nothing
        request(8, template=""),
        request(9, template="nowhere", by_id=1),  # falls back on the id
    ]
    result = copies.create_events(template, spark.createDataFrame(requests, REQUEST))
    created = {r.request_id: r for r in result["created"].collect()}
    assert set(created) == {1, 5, 9} and created[1].event_secret == "secret1"
    assert {r.request_id: r.error for r in result["rejected"].collect()} == {
        2: "no event template of that name", 7: "no event of that template id", 8: "no event template of that name",
    }
    updated = {r.request_id: r.event_id for r in result["updated"].collect()}
    assert updated == {3: 2, 4: created[1].event_id, 6: created[1].event_id}
    events = {r.event_id: r for r in result["events"].collect()}
    assert (events[2].name, events[2].css, events[2].accepts_responses_to) == ("N3", "/u.css", None)
    copy = events[created[1].event_id]
    assert (copy.name, copy.css, copy.api_key, copy.is_template) == ("N6", None, "fresh", False)
    assert events[created[5].event_id].api_key is None
    assert events[created[9].event_id].css == "/t.css"
    questions = [r for r in result["questions"].collect() if r.event_id == created[1].event_id]
    by_order = {r.display_order: r.question_id for r in questions}
    options = {r.answer_ordinal: r for r in result["answer_options"].collect() if r.question_id == by_order[1]}
    assert options[1].if_selected_show_question_id == by_order[2]
    assert options[2].if_selected_show_question_id is None
    assert result["answer_options"].select("answer_option_id").distinct().count() == 3 + 2 * 2
    stored = copies.create_events(template, spark.createDataFrame([request(5, key="bare")], REQUEST), store_key=True)
    assert stored["events"].where("api_key = 'bare'").count() == 1


def test_copying_the_seed_keeps_its_follow_ups(spark, table):
    events = table("events", [(1, "T", None, True, None, None, None, "s")])
    copies_ = spark.createDataFrame([(7, 1), (8, 1)], "event_id BIGINT, template_id BIGINT")
    questions, options = copies.copy_questionnaires(
        seed.questions_for_events(events), seed.options_for_events(events), copies_
    )
    assert questions.count() == 20 and options.count() == 102
    order = {r.question_id: (r.event_id, r.display_order) for r in questions.collect()}
    edges = {
        (order[r.question_id], r.answer_ordinal, order[r.if_selected_show_question_id])
        for r in options.where("if_selected_show_question_id IS NOT NULL").collect()
    }
    expected = {(1, 1, 2), (1, 2, 2), (1, 3, 2), (1, 4, 2), (2, 4, 3), (2, 5, 4)}
    assert edges == {((e, q), o, (e, f)) for e in (7, 8) for q, o, f in expected}


def test_grants(spark):
    principals = spark.createDataFrame([("ann",), ("DOM\\bob",), ("me",), ("DOM\\me2",)], "name STRING")
    requests = spark.createDataFrame(
        [(1, None, "me"), (2, "ann,,bob", "me"), (3, "DOM\\bob", "nobody"), (4, "", "me2"), (5, "ann,ann", "ann")],
        "event_id BIGINT, userlist STRING, me STRING",
    )
    granted = {(r.event_id, r.user) for r in copies.grant_event_users(requests, principals).collect()}
    assert granted == {(1, "me"), (2, "ann"), (2, "DOM\\bob"), (2, "me"), (3, "DOM\\bob"), (4, "DOM\\me2"), (5, "ann")}
    faithful = {(r.event_id, r.user) for r in copies.grant_event_users(requests, principals, faithful=True).collect()}
    # An empty entry matches every name without a domain.
    assert faithful == granted | {(4, "ann"), (4, "me"), (2, "ann"), (2, "me")}


def test_init_responses(spark, table):
    day = lambda d: dt.datetime(2024, 1, d)
    events = table("events", [(1, "e", None, False, day(10), day(20), None, "s"), (2, "open", None, False, None, None, None, "s")])
    sessions = table("sessions", [(1, 1, None, "a"), (2, 2, None, "b")])
    requests = spark.createDataFrame(
        [(1, 1, day(10)), (2, 1, day(11)), (3, 1, day(20)), (4, 2, day(1)), (5, 9, day(11))],
        "request_id BIGINT, session_id BIGINT, requested_at TIMESTAMP_NTZ",
    )
    new, rejected = upsert.init_responses(table("responses", []), requests, sessions, events)
    assert {(r.request_id, r.created, r.updated) for r in new.collect()} == {(2, day(11), day(11)), (4, day(1), day(1))}
    assert {r.request_id for r in rejected.collect()} == {1, 3, 5}
