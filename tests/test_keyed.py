import datetime as dt
import random

import pytest
from test_folds import START, random_log, replay, rows_of

from podium.operators import fold
from podium.session import fresh_path
from podium.streaming import keyed


def run(spark, log, rows, source, checkpoint, tables=None, **more):
    log(rows).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(log([]).schema).parquet(source)
    keyed.keyed_apply_changes(arriving, checkpoint, tables, **more).awaitTermination()


@pytest.mark.parametrize("seed", [1, 2])
def test_state_is_current_after_every_batch_and_restart(seed, spark, survey, log):
    rng = random.Random(seed)
    tables = survey(12)
    rows = random_log(rng, 12, 300)
    cuts = sorted(rng.sample(range(1, 300), 2))
    source, checkpoint = fresh_path(spark, "source"), fresh_path(spark, "keyed")
    # Every part is a new start of the job on the state the last one left.
    for low, high in zip([0, *cuts], [*cuts, 300]):
        run(spark, log, rows[low:high], source, checkpoint)
        assert rows_of(keyed.keyed_state(spark, checkpoint, tables)) == replay(rows[:high], 12)


def test_state_starts_from_stored_answers_and_serves_responses_opened_later(spark, survey, log):
    rows = random_log(random.Random(8), 12, 400)
    early = {**survey(6), **{n: t for n, t in fold.apply_changes(survey(6), log(rows[:150])).items() if n.startswith("response")}}
    source, checkpoint, seen = fresh_path(spark, "source"), fresh_path(spark, "keyed"), []
    note = lambda batch, number: seen.append({r.response_id: r.changes for r in batch.collect()})
    run(spark, log, rows[150:280], source, checkpoint, early, sink=note)
    run(spark, log, rows[280:], source, checkpoint, early, sink=note)
    now = {**early, "responses": early["responses"].unionByName(survey(12)["responses"].where("response_id >= 6"))}
    got = keyed.keyed_state(spark, checkpoint, now)
    assert rows_of(got) == rows_of(fold.apply_changes(now, log(rows[150:])))
    assert got["response_answers"].where("response_id >= 6").count() > 0
    counted = {}
    for r in rows[150:280]:
        counted[r[0]] = counted.get(r[0], 0) + 1
    assert seen[0] == counted and len(seen) == 2


def test_late_changes_apply_in_the_order_they_arrive(spark, survey, log):
    source, checkpoint = fresh_path(spark, "source"), fresh_path(spark, "keyed")
    at = lambda n: START + dt.timedelta(minutes=n)
    run(spark, log, [(0, 10, 1, None, at(5), 5), (0, 11, 1, None, at(6), 6), (None, 10, 1, None, at(6), 6)], source, checkpoint)
    run(spark, log, [(0, 10, 2, None, at(1), 1), (0, 11, -1, None, at(2), 2)], source, checkpoint, scoped=True)
    answers, _, updated = rows_of(keyed.keyed_state(spark, checkpoint, survey(1)))
    assert answers == {(0, 10, 1002, at(5), 1, at(1))} and updated == {(0, at(2))}


@pytest.mark.parametrize("scoped", [False, True])
def test_state_has_only_responses_that_changed(scoped, spark, survey, log):
    """Stored answers of the others stay as they are; unchecks and empty texts of the job hit stored ones."""
    rows = random_log(random.Random(5), 30, 900)
    early = {**survey(30), **{n: t for n, t in fold.apply_changes(survey(30), log(rows[:600])).items() if n.startswith("response")}}
    later = [r for r in rows[600:] if r[0] < 4]
    source, checkpoint = fresh_path(spark, "source"), fresh_path(spark, "keyed")
    run(spark, log, later[:20], source, checkpoint, early, scoped=scoped)
    run(spark, log, later[20:], source, checkpoint, None, scoped=scoped)
    forms = spark.read.format("statestore").option("stateVarName", "form").load(checkpoint)
    assert {r[0] for r in forms.select("key.response_id").collect()} == {r[0] for r in later}
    got = keyed.keyed_state(spark, checkpoint, early)
    assert rows_of(got) == rows_of(fold.apply_changes(early, log(later), scoped))
    assert got["response_answers"].where("response_id >= 4").count() > 0


def test_a_first_start_without_a_batch_keeps_the_later_snapshot(spark, survey, log):
    at = lambda n: START + dt.timedelta(minutes=n)
    source, checkpoint = fresh_path(spark, "source"), fresh_path(spark, "keyed")
    one, two = (
        {**survey(1), **{n: t for n, t in fold.apply_changes(survey(1), log([(0, 10, o, None, at(o), o)])).items() if n.startswith("response")}}
        for o in (1, 2)
    )
    keyed._keep_stored(spark, checkpoint, one)
    run(spark, log, [(0, 11, 3, None, at(5), 5)], source, checkpoint, two)
    run(spark, log, [(0, 13, 1, None, at(6), 6)], source, checkpoint, one)
    answers, _, _ = rows_of(keyed.keyed_state(spark, checkpoint, two))
    assert {(q, o) for _, q, o, *_ in answers} == {(10, 1002), (11, 1103), (13, 1301)}


def test_stored_rows_that_come_twice_count_once_where_a_response_changed(spark, survey, log):
    at = lambda n: START + dt.timedelta(minutes=n)
    first = fold.apply_changes(survey(2), log([(r, q, 1, None, at(1), 10 * r + q) for r in (0, 1) for q in (10, 11)]))
    twice = {**first, "response_answers": first["response_answers"].union(first["response_answers"])}
    source, checkpoint = fresh_path(spark, "source"), fresh_path(spark, "keyed")
    run(spark, log, [(0, 10, 1, None, at(5), 5)], source, checkpoint, twice)
    answers, _, _ = rows_of(keyed.keyed_state(spark, checkpoint, twice))
    assert {(r, q, n) for r, q, _, _, n, _ in answers} == {(0, 10, 1), (0, 11, 0), (1, 10, 1), (1, 11, 0)}
