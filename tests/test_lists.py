import random

import pytest

from models import insert, move
from podium.operators import lists
from podium.operators.questions import pack_order
from podium.sources.schemas import TABLES

REQUEST = (
    "event_id BIGINT, position SMALLINT, question STRING, description STRING, optimal_percent SMALLINT, "
    "is_required BOOLEAN, type STRING, has_plaintext BOOLEAN, seq BIGINT"
)


def question(i, event, order):
    return (i, event, order, f"q{i}", None, None, False, "radio", False)


def order_of(df, parent, item, order):
    found = {}
    for r in df.collect():
        found.setdefault(r[parent], {})[r[item]] = r[order]
    return found


@pytest.mark.parametrize("gaps", [1, 3])
def test_inserts_equal_shift_and_pack(spark, table, gaps):
    rng = random.Random(gaps)
    stored = {e: {e * 100 + i: i * gaps for i in range(1, rng.randrange(1, 6))} for e in range(1, 13)}
    requests = [
        (e, rng.choice([None, 0, 1, 2, 3, 5, 7, 99]), f"new {seq}", None, None, None, None, None, seq)
        for seq, e in enumerate(rng.choices(range(1, 16), k=90))
    ]
    questions = table("questions", [question(i, e, o) for e, items in stored.items() for i, o in items.items()])
    events = table("events", [(e, f"e{e}", None, False, None, None, None, "s") for e in range(1, 14)])
    snapshot, rejected = lists.insert_questions(questions, spark.createDataFrame(requests, REQUEST), events)
    texts = {r.question_id: r.question for r in snapshot.collect()}
    expected = {e: {f"q{i}": o for i, o in items.items()} for e, items in stored.items()}
    for e, position, name, *_ in requests:
        if e <= 13:
            expected[e] = insert(expected.get(e, {}), name, position, 255)
    found = {
        e: {texts[i]: o for i, o in items.items()}
        for e, items in order_of(snapshot, "event_id", "question_id", "display_order").items()
    }
    assert found == expected
    assert {r.event_id for r in rejected.collect()} == {r[0] for r in requests if r[0] > 13}
    new = snapshot.where("question = 'new 0'").first()
    assert (new.type, new.is_required, new.has_plaintext) == ("radio", False, False)


def test_a_full_list_rejects_the_rest(spark, table):
    questions = table("questions", [question(i, 1, i) for i in range(1, 254)])
    events = table("events", [(1, "e", None, False, None, None, None, "s")])
    requests = spark.createDataFrame(
        [(1, 1, f"new {s}", None, None, None, None, None, s) for s in range(5)], REQUEST
    )
    snapshot, rejected = lists.insert_questions(questions, requests, events)
    assert snapshot.count() == 255
    assert sorted(r.seq for r in rejected.collect()) == [2, 3, 4]
    assert [r.question for r in snapshot.orderBy("display_order").limit(3).collect()] == ["new 1", "new 0", "q1"]


UPDATE = REQUEST.replace("event_id", "question_id")


@pytest.mark.parametrize("gaps,seed", [(1, 1), (2, 2), (1, 3), (2, 4)])
def test_moves_equal_shift_and_pack(spark, table, gaps, seed):
    rng = random.Random(gaps * 100 + seed)
    stored = {e: {e * 100 + i: i * gaps for i in range(1, rng.randrange(2, 8))} for e in range(1, 10)}
    ids = [i for items in stored.values() for i in items]
    edited = [i for i in ids if i < 900]
    requests = [
        (rng.choice(edited), rng.choice([None, 0, 1, 2, 3, 4, 6, 99]), None, None, None, None, None, None, seq)
        for seq in range(80)
    ]
    questions = table("questions", [question(i, e, o) for e, items in stored.items() for i, o in items.items()])
    snapshot, _ = lists.update_questions(questions, spark.createDataFrame(requests, UPDATE))
    expected = dict(stored)
    for item, position, *_ in requests:
        expected[item // 100] = move(expected[item // 100], item, position)
    assert order_of(snapshot, "event_id", "question_id", "display_order") == expected


def test_patches_keep_what_they_do_not_give(spark, table):
    questions = table("questions", [question(1, 1, 1), question(2, 1, 2)])
    requests = spark.createDataFrame(
        [
            (1, None, "new", None, 50, None, None, None, 1),
            (1, None, None, "text", None, True, None, None, 2),
            (9, None, "?", None, None, None, None, None, 3),
        ],
        UPDATE,
    )
    snapshot, rejected = lists.update_questions(questions, requests)
    rows = {r.question_id: r for r in snapshot.collect()}
    assert (rows[1].question, rows[1].description, rows[1].optimal_percent, rows[1].is_required) == ("new", "text", 50, True)
    assert rows[2].question == "q2"
    assert [r.question_id for r in rejected.collect()] == [9]


def test_the_move_down_lands_before_the_item_there(spark, table):
    questions = table("questions", [question(i, 1, i) for i in range(1, 7)])
    requests = spark.createDataFrame([(2, 5, None, None, None, None, None, None, 1)], UPDATE)
    snapshot, _ = lists.update_questions(questions, requests)
    assert [r.question_id for r in snapshot.orderBy("display_order").collect()] == [1, 3, 4, 2, 5, 6]


def test_option_inserts(spark, table):
    options = table("answer_options", [(1, 10 + i, i, None, None, f"o{i}", None) for i in (1, 2, 3)])
    questions = table("questions", [question(1, 1, 1), question(2, 1, 2)])
    requests = spark.createDataFrame(
        [(1, 2, 5, None, "new", None, 1), (2, None, None, 1, "first", "good", 2), (3, 1, None, None, "?", None, 3)],
        "question_id BIGINT, position SMALLINT, percent_value SMALLINT, if_selected_show_question_id BIGINT, "
        "annotation STRING, css_classes STRING, seq BIGINT",
    )
    snapshot, rejected = lists.insert_answer_options(options, requests, questions)
    listed = [(r.question_id, r.answer_ordinal, r.annotation) for r in snapshot.orderBy("question_id", "answer_ordinal").collect()]
    assert listed == [(1, 1, "o1"), (1, 2, "new"), (1, 3, "o2"), (1, 4, "o3"), (2, 1, "first")]
    assert snapshot.schema.names == TABLES["answer_options"].names
    assert [r.question_id for r in rejected.collect()] == [3]


def test_pack_order_reports_changed_rows_only(table):
    questions = table("questions", [question(1, 1, 1), question(2, 1, 5), question(3, 2, 4)])
    assert {(r.question_id, r.packed) for r in pack_order(questions, "event_id", "display_order").collect()} == {(2, 2), (3, 1)}


def test_many_edits_of_one_list_take_seconds(spark, table):
    """30,000 moves of one event and a full list of options, filled one by one from the front."""
    questions = table("questions", [question(i, 1, i) for i in range(1, 256)])
    moves = spark.range(30_000).selectExpr(
        "id % 255 + 1 AS question_id", "CAST(id * 7 % 300 AS INT) AS position", "CAST(NULL AS STRING) AS question",
        "CAST(NULL AS STRING) AS description", "CAST(NULL AS SMALLINT) AS optimal_percent", "CAST(NULL AS BOOLEAN) AS is_required",
        "CAST(NULL AS STRING) AS type", "CAST(NULL AS BOOLEAN) AS has_plaintext", "id AS seq",
    )
    snapshot = lists.update_questions(questions, moves)[0].collect()
    assert sorted(r.display_order for r in snapshot) == list(range(1, 256))
    ids = list(range(1, 256))
    for seq in range(30_000):
        item, position = seq % 255 + 1, seq * 7 % 300
        own = ids.index(item) + 1
        to = 255 if position > 255 else position - 1 if position > own else max(position, 1)
        ids.insert(to - 1, ids.pop(own - 1))
    assert [r.question_id for r in sorted(snapshot, key=lambda r: r.display_order)] == ids
    requests = spark.range(40_000).selectExpr("1 AS question_id", "id + 1000 AS answer_option_id", "1 AS position", "id AS seq")
    none = table("answer_options", []).select("question_id", "answer_option_id", "answer_ordinal")
    filled = lists._insert(none, requests, "question_id", "answer_option_id", "answer_ordinal", lists.OPTION_CAPACITY).collect()
    assert len(filled) == 32_767 and all(r.answer_ordinal == 32_767 - (r.answer_option_id - 1000) for r in filled)
