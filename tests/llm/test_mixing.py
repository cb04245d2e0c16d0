import random

import pytest
from helpers import documents

from podium.llm import mixing


def brute_targets(sizes, weights, cap):
    """Water-filling by hand: clamp, share the rest by weight, again."""
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in clamped]
        rest, weight = total - sum(clamped.values()), sum(weights[s] for s in free)
        over = {s: cap * sizes[s] for s in free if rest * weights[s] / weight > cap * sizes[s] + 1e-9}
        if not over:
            return clamped | {s: rest * weights[s] / weight for s in free}
        clamped |= over


def words(n):
    return " ".join(["w"] * n)


@pytest.mark.parametrize("broadcast", [True, False])
def test_targets_and_sampling(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    r = random.Random(4)
    names = ["b", "a", "Z", "é", "z", "", "tiny", None]
    rows = [(i, words(r.randrange(0, 60)), "en", "tiny" if i < 3 else r.choice([*names[:6], None, "a", "a", "a"])) for i in range(900)]
    rows += [(5, None, "en", "a"), (5, "x y", "en", "a"), (None, "x y z", "en", "a"), (None, "x y z", "en", "a")]
    df = documents(spark, rows, clash=True)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in names}
    order = sorted((n for n in names if n is not None), key=lambda s: s.encode()) + [None]
    target = brute_targets(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    for s in names:
        mine = [x for x in got if x.source == s]
        assert all(x.source_size == sizes[s] and abs(x.target - target[s]) < 1e-6 for x in mine)
        assert all(x.taken == x.size * x.repeats <= 3 * x.size for x in mine)
        longest = max(x.size for x in mine)
        assert abs(sum(x.taken for x in mine) - target[s]) <= longest / 2 + 3
        assert len({x.repeats for x in mine}) <= 2
    assert sorted(got, key=str) == sorted(mixing.mix(df.repartition(7)).collect(), key=str)
    copies = mixing.mixed_documents(df)
    assert copies.columns == [*df.columns, "_repetition"]
    assert copies.count() == sum(x.repeats for x in got)
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mixed_documents(df.where("false")).count() == 0


def test_only_empty_texts(spark):
    got = mixing.mix(documents(spark, [(1, None, None, None), (2, "", "en", "a")])).collect()
    assert [(x.size, x.target, x.taken, x.repeats) for x in got] == [(0, 0.0, 0, 1)] * 2


def test_the_sorted_level_agrees_with_the_rounds(spark, monkeypatch):
    r = random.Random(2)
    table = spark.createDataFrame([(f"s{i:03}", int(1.5 ** r.randrange(25))) for i in range(60)], "source string, source_size bigint")
    by_rounds = {x.source: x.target for x in mixing.water_fill(table).collect()}
    monkeypatch.setattr(mixing, "LONGEST_ROUNDS", 1)
    by_sorting = {x.source: x.target for x in mixing.water_fill(table).collect()}
    sizes = {x.source: x.source_size for x in table.collect()}
    want = brute_targets(sizes, {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}, 3)
    assert all(abs(by_rounds[s] - want[s]) < 1e-6 * want[s] and abs(by_sorting[s] - want[s]) < 1e-6 * want[s] for s in sizes)
