import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from models import ResponseModel
from podium.functions.prune import MAY_MEET, key_filter, looked_up
from podium.operators import fold
from podium.session import fresh_path
from podium.streaming import changes as stream

START = dt.datetime(2024, 1, 1)


def random_log(rng, responses, length):
    """Interleaved changes; response -1 does not exist, question 20 is foreign, ordinal 9 unknown."""
    rows = []
    for seq in range(length):
        ordinal = rng.choice([1, 2, 3, 9, -1, -2, -3, 0, None, None, None])
        text = rng.choice(["", "a", "b", None]) if ordinal is None else None
        rows.append(
            (rng.choice([-1, *range(responses)]), rng.choice([10, 11, 12, 13, 20]), ordinal, text,
             START + dt.timedelta(minutes=seq), seq)
        )
    return rows


def replay(rows, responses):
    models = {r: ResponseModel() for r in range(responses)}
    for response, question, ordinal, text, ts, _ in rows:
        if response in models:
            models[response].save(question, ordinal, text, ts)
    answers = {(r, q, o, *row) for r, m in models.items() for (q, o), row in m.answers.items()}
    texts = {(r, q, *row) for r, m in models.items() for q, row in m.texts.items()}
    updated = {(r, m.updated or START) for r, m in models.items()}
    return answers, texts, updated


def rows_of(state):
    answers = {tuple(r) for r in state["response_answers"].select(fold.ANSWER_COLUMNS).collect()}
    texts = {tuple(r) for r in state["response_plaintext"].select(fold.TEXT_COLUMNS).collect()}
    updated = {tuple(r) for r in state["responses"].select("response_id", "updated").collect()}
    return answers, texts, updated


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_replay_also_in_two_steps(seed, survey, log):
    rng = random.Random(seed)
    tables = survey(40)
    rows = random_log(rng, 40, 1600)
    expected = replay(rows, 40)
    assert rows_of(fold.apply_changes(tables, log(rows))) == expected
    # The same log applied onto the snapshot its first part left.
    cut = rng.randrange(1600)
    first = fold.apply_changes(tables, log(rows[:cut]))
    assert rows_of(fold.apply_changes(first, log(rows[cut:]))) == expected


def test_single_folds_are_parts_of_the_whole(survey, log):
    tables = survey(20)
    rows = [r for r in random_log(random.Random(5), 20, 800)]
    answers, texts, _ = replay(rows, 20)
    dims = [tables[n] for n in ("responses", "sessions", "questions", "answer_options")]
    changes = log(rows)
    radio = {tuple(r) for r in fold.fold_radio(changes, *dims).collect()}
    boxes = {tuple(r) for r in fold.fold_checkbox(changes, *dims).collect()}
    assert radio == {a for a in answers if a[1] == 10}
    assert boxes == {a for a in answers if a[1] in (11, 12)}
    assert {tuple(r) for r in fold.fold_plaintext(changes, *dims[:3]).collect()} == texts


def test_uncheck_hits_every_checkbox_question_unless_scoped(survey, log):
    tables = survey(1)
    rows = [(0, 11, 2, None, START, 1), (0, 12, 2, None, START, 2), (0, 11, -2, None, START, 3)]
    dims = [tables[n] for n in ("responses", "sessions", "questions", "answer_options")]
    assert fold.fold_checkbox(log(rows), *dims).count() == 0
    scoped = fold.fold_checkbox(log(rows), *dims, scoped=True).collect()
    assert [r.question_id for r in scoped] == [12]


def test_repeated_clicks_on_a_text_question_are_reported(survey, log):
    tables = survey(1)
    rows = [(0, 13, 1, None, START, i) for i in range(3)]
    dims = [tables[n] for n in ("responses", "sessions", "questions", "answer_options")]
    assert [tuple(r) for r in fold.repeated_text_clicks(log(rows), *dims).collect()] == [(0, 13, 1301, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_for_any_split(seed, spark, survey, log):
    rng = random.Random(seed)
    tables = survey(15)
    rows = random_log(rng, 15, 500)
    cuts = sorted(rng.sample(range(1, 500), 3))
    source, deltas, checkpoint = (fresh_path(spark, n) for n in ("source", "deltas", "checkpoint"))
    schema = log([]).schema
    for low, high in zip([0, *cuts], [*cuts, 500]):
        log(rows[low:high]).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        stream.stream_apply_changes(arriving, deltas, checkpoint).awaitTermination()
    expected = replay(rows, 15)
    assert rows_of(stream.stream_state(spark, deltas, tables)) == expected
    # Compacting half of the batches, and then all, keeps the state; a replayed batch changes nothing.
    stream.compact_state(spark, deltas, up_to=1)
    assert stream.compacted_up_to(spark, deltas) == 1
    assert rows_of(stream.stream_state(spark, deltas, tables)) == expected
    last = log(rows[cuts[-1]:])
    stream._write_delta(stream.batch_delta(last, 3), deltas, stream.BATCHES, "batch_id=3")
    assert rows_of(stream.stream_state(spark, deltas, tables)) == expected
    stream.compact_state(spark, deltas, up_to=3)
    assert rows_of(stream.stream_state(spark, deltas, tables)) == expected
    # The job goes on after a compaction.
    more = random_log(rng, 15, 600)[500:]
    more = [(*r[:-1], 10_000 + i) for i, r in enumerate(more)]
    log(more).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(schema).parquet(source)
    stream.stream_apply_changes(arriving, deltas, checkpoint).awaitTermination()
    assert rows_of(stream.stream_state(spark, deltas, tables)) == replay(rows + more, 15)


def test_stream_applies_to_stored_answers_and_to_responses_opened_later(spark, survey, log):
    rng = random.Random(8)
    rows = random_log(rng, 12, 400)
    early = {**survey(6), **{n: t for n, t in fold.apply_changes(survey(6), log(rows[:150])).items() if n.startswith("response")}}
    source, deltas, checkpoint = (fresh_path(spark, n) for n in ("source", "deltas", "checkpoint"))
    for part in (rows[150:280], rows[280:]):
        log(part).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(log([]).schema).parquet(source)
        stream.stream_apply_changes(arriving, deltas, checkpoint).awaitTermination()
    stream.compact_state(spark, deltas, up_to=1)
    # Responses 6 to 11 exist by the time the state is read, without any stored answer.
    now = {**early, "responses": early["responses"].unionByName(survey(12)["responses"].where("response_id >= 6"))}
    got = stream.stream_state(spark, deltas, now)
    assert rows_of(got) == rows_of(fold.apply_changes(now, log(rows[150:])))
    assert got["response_answers"].where("response_id >= 6").count() > 0


def test_stream_drops_redelivered_changes_on_request(spark, survey, log):
    tables = survey(1)
    rows = [(0, 10, 1, None, START, 1), (0, 10, 2, None, START + dt.timedelta(minutes=1), 2)]
    source = fresh_path(spark, "source")
    log(rows + rows).write.parquet(source)
    revisions = []
    for key in (None, "seq"):
        deltas, checkpoint = fresh_path(spark, "deltas"), fresh_path(spark, "checkpoint")
        arriving = spark.readStream.schema(log([]).schema).parquet(source)
        stream.stream_apply_changes(arriving, deltas, checkpoint, dedupe_on=key).awaitTermination()
        revisions.append(stream.stream_state(spark, deltas, tables)["response_answers"].first().revision)
    assert revisions == [3, 1]


def test_visible_questions_and_bands(table, survey, log):
    tables = survey(3)
    tables["answer_options"] = table(
        "answer_options",
        [(10, 1001, 1, 0, 11, None, "bad"), (10, 1002, 2, 50, None, None, None), (10, 1003, 3, 100, 12, None, "good top")],
    )
    rows = [
        (0, 10, 1, None, START, 1), (0, 10, 2, None, START, 2),  # shows 11, the band stays
        (1, 10, 1, None, START, 1), (1, 10, -3, None, START, 2),  # an uncheck is a click, too
        (2, 10, 9, None, START, 1),
    ]
    dims = [tables[n] for n in ("responses", "sessions", "questions", "answer_options")]
    seen = {}
    for r in fold.visible_questions(log(rows), *dims).collect():
        seen.setdefault(r.response_id, set()).add(r.question_id)
    assert seen == {0: {10, 13, 11}, 1: {10, 13, 11, 12}, 2: {10, 13}}
    bands = {r.response_id: r.classes for r in fold.answer_bands(log(rows), *dims).collect()}
    assert bands == {0: ["bad"], 1: ["good", "top"]}


def test_hot_responses_are_salted_and_fold_the_same(spark, survey, log):
    """Three quarters of the log belong to one response. With a low limit its rows are spread over many
    salts, everyone else's are not, and all results stay exact."""
    tables = survey(20)
    rows = [
        (7 if seq % 4 else response, question, ordinal, text, ts, seq)
        for response, question, ordinal, text, ts, seq in random_log(random.Random(11), 20, 2400)
    ]
    expected = replay(rows, 20)
    changes = log(rows)
    assert rows_of(fold.apply_changes(tables, changes, hot_rows=50)) == expected
    assert rows_of(fold.apply_changes(tables, changes)) == expected

    salted = fold._with_live_seq(
        fold.click_marks(changes), fold.click_resets(changes), ["response_id", "answer_ordinal"],
        fold.busy_responses(changes, 50),
    )
    salts = {r.response_id: r.n for r in salted.groupBy("response_id").agg(F.countDistinct("_salt").alias("n")).collect()}
    assert salts[7] > 5 and all(n == 1 for r, n in salts.items() if r not in (7, -1))


def test_folds_plan_no_cross_or_nested_loop_join(spark, survey, log):
    state = fold.apply_changes(survey(3), log([(0, 10, 1, None, START, 1)]))
    for name in ("response_answers", "response_plaintext", "responses"):
        plan = state[name]._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("hot_rows", [50, fold.HOT_ROWS])
def test_folds_with_pruned_resets_equal_the_replay(hot_rows, survey, log):
    tables = survey(30)
    rows = [r for r in random_log(random.Random(21), 30, 1500) if r[0] % 3 or r[2] is None or r[2] > 0]
    expected = replay(rows, 30)
    changes = log(rows)
    assert rows_of(fold.apply_changes(tables, changes, hot_rows=hot_rows, prune_rows=0)) == expected
    first = fold.apply_changes(tables, log(rows[:700]), prune_rows=0)
    assert rows_of(fold.apply_changes(first, log(rows[700:]), prune_rows=0)) == expected
    dims = [tables[n] for n in ("responses", "sessions", "questions", "answer_options")]
    plain = {tuple(r) for r in fold.fold_checkbox(changes, *dims, scoped=True).collect()}
    assert {tuple(r) for r in fold.fold_checkbox(changes, *dims, scoped=True, prune_rows=0).collect()} == plain
    assert {tuple(r) for r in fold.fold_plaintext(changes, *dims[:3], prune_rows=0).collect()} == expected[1]


@pytest.mark.parametrize("rows", [[], [(0, 11, 1, None, START, 1)], [(0, 11, -1, None, START, 1)], [(0, 13, None, "", START, 1)]])
def test_pruned_folds_of_logs_without_marks_or_resets(rows, survey, log):
    assert rows_of(fold.apply_changes(survey(2), log(rows), prune_rows=0)) == replay(rows, 2)


def test_only_marks_with_a_reset_slot_reach_the_resets(spark):
    """50,000 slots, every hundredth reset: the filter lets all clicks on those through, and few others."""
    marks = spark.range(200_000).selectExpr("id % 50000 AS response_id", "cast(id % 2 AS smallint) AS answer_ordinal")
    resets = marks.where("response_id % 100 = 0").distinct()
    words = key_filter(resets, ["response_id", "answer_ordinal"])
    found = looked_up(marks, words, ["response_id", "answer_ordinal"])
    assert found.count() == 200_000
    assert found.where(f"response_id % 100 = 0 AND NOT {MAY_MEET}").count() == 0
    assert found.where(f"response_id % 100 <> 0 AND {MAY_MEET}").count() < 200_000 * 0.03
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    # Nulls are keys like others, and too many keys give no filter.
    nulls = spark.createDataFrame([(None, 1), (None, None), (5, 1)], "response_id bigint, answer_ordinal smallint")
    few = key_filter(nulls.where("response_id IS NULL AND answer_ordinal = 1"), ["response_id", "answer_ordinal"])
    assert looked_up(nulls, few, ["response_id", "answer_ordinal"]).where(f"response_id IS NULL AND answer_ordinal = 1 AND NOT {MAY_MEET}").count() == 0
    assert key_filter(resets, ["response_id", "answer_ordinal"], longest=10) is None


def test_the_filter_is_broadcast_in_few_rows(spark):
    """Its words pass the driver packed: a row for each would take that many times the memory."""
    keys = spark.range(100_000).selectExpr("id * 7 AS response_id")
    words, n_words = key_filter(keys, ["response_id"])
    rows = words.collect()
    assert n_words == 20_000 and len(rows) == 40 and sum(len(r["_words"]) for r in rows) == n_words
    found = looked_up(spark.range(100_000).selectExpr("id AS response_id"), (words, n_words), ["response_id"])
    assert found.where(f"response_id % 7 = 0 AND NOT {MAY_MEET}").count() == 0
    assert found.where(f"response_id % 7 <> 0 AND {MAY_MEET}").count() < 100_000 * 0.03


def test_apply_changes_makes_the_log_once(spark, survey, log):
    """What the log is made of (a join, the parsing of texts) runs once, however often the folds read it."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    at = dt.datetime(2024, 1, 2)
    rows = [(r, 10, 1 + r % 3, None, at, r) for r in range(6)] + [(1, 11, 2, None, at, 10), (1, 11, -2, None, at, 11), (2, 13, None, "hi", at, 12)]
    changes = log(rows).mapInArrow(counted, log(rows).schema)
    result = fold.apply_changes(survey(6), changes)
    assert result["response_answers"].count() == 6 and result["response_plaintext"].collect()[0].plaintext == "hi"
    assert result["responses"].where("updated = timestamp_ntz'2024-01-02 00:00:00'").count() == 6
    assert made.value == len(rows)
