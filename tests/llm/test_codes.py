import math
import random

import pytest
from pyspark.sql import functions as F

from podium.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, parts, entries, rounds):
    """Plain Lloyd over whole integers, every part against every entry. rows: (id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    width = len(kept[0][1]) // parts
    part = lambda q, p: q[p * width : (p + 1) * width]
    books = [[part(q, p) for _, q, _ in kept[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda q, p: min((apart(part(q, p), e), k) for k, e in enumerate(books[p]))
    for n in range(rounds + 1):
        near = [[best(q, p) for p in range(parts)] for _, q, _ in kept]
        if n < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [part(q, p) for (_, q, _), at in zip(kept, near) if at[p][1] == k]
                    if own:
                        books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    result = [(i, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at), l) for (i, _, l), at in zip(kept, near)]
    return result, ",".join(str(x) for p in books for e in p for x in e)


def vectors(seed, n, length, spread=3.0):
    r = random.Random(seed)
    # Few different values: many parts are equally near to several entries.
    return [(i, [round(r.uniform(-spread, spread)) / 256 * r.choice([1, 40]) for _ in range(length)], r.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("parts, entries, rounds, length", [(4, 8, 2, 8), (16, 64, 2, 32), (2, 5, 4, 6), (4, 8, 0, 4)])
def test_against_plain_lloyd(spark, parts, entries, rounds, length):
    rows = vectors(parts + rounds, 150, length)
    rows += [(500, None, 1), (501, [], 1), (502, [None] + [0.0] * (length - 1), 1), (503, [float("nan")] * length, 1), (504, [float("inf")] * length, None)]
    rows += [rows[3], (7, rows[9][1], 1), (None, rows[5][1], None)]
    coded, books = codes.compress(spark.createDataFrame(rows, SCHEMA), parts=parts, entries=entries, rounds=rounds)
    wanted, text = by_hand(rows, parts, entries, rounds)
    assert books.text() == text
    assert sorted(map(repr, ((r["vec_id"], r["code"], r["error"], r["label"]) for r in coded.collect()))) == sorted(map(repr, wanted))
    sums = {}
    for _, _, error, label in wanted:
        sums[label] = sums.get(label, 0) + error
    assert {(r["label"], r["label_error"]) for r in codes.with_label_errors(coded).collect()} == set(sums.items())


def test_active_entries_compare_less(monkeypatch):
    """A part whose entry stayed is compared with the moved entries only."""
    import numpy as np

    r = np.random.default_rng(2)
    points = r.integers(-50, 50, (400, 6))
    books = codes.Codebooks(r.integers(-50, 50, (2, 8, 3)))
    before = codes.assigned(points, books)
    entries = books.entries.copy()
    entries[:, [2, 5]] += 7
    moved = codes.Codebooks(entries, (entries != books.entries).any(axis=2))
    seen, real = [], codes.nearest
    monkeypatch.setattr(codes, "nearest", lambda p, e: seen.append((len(p), len(e))) or real(p, e))
    after = codes.assigned(points, moved, *before)
    assert sum(n for n, k in seen if k == 2) > sum(n for n, k in seen if k == 8) > 0
    whole = codes.assigned(points, codes.Codebooks(entries))
    assert (after[0] == whole[0]).all() and (after[1] == whole[1]).all()


def test_edge_cases(spark):
    rows = [(1, [0.0] * 16, 1), (2, [0.5] * 16, 1), (3, [1.0] * 32, 1), (4, [1.0] * 15, 1), (5, [40_000.0] * 16, 1), (6, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.concat(F.lit("own "), "vec_id") for c in ("code", "error", "_q", "_row", "_codes", "part", "entry", "_label", "label_error")})
    coded, books = codes.compress(clashing)
    got = codes.with_label_errors(coded, error="_error").collect()
    assert [(r["vec_id"], r["_code"], r["_error"], r["_label_error"], r["code"]) for r in sorted(got)] == [
        (1, "00" * 16, 0, 0, "own 1"), (2, "01" * 16, 0, 0, "own 2")]
    assert books.entries.shape == (16, 2, 1)
    none, books = codes.compress(df.where("vec_id = 6"))
    assert none.count() == 0 and books is None and codes.codebooks_sha256(books) == codes.hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        codes.compress(df, entries=300)


def test_first_entries_are_the_smallest_ids(spark):
    ids = [random.Random(5).randrange(10**6) for _ in range(3000)]
    df = spark.createDataFrame([(i, [i / 256], 0) for i in ids], SCHEMA).repartition(7)
    usable = df.select(F.col("vec_id").alias("_key"), codes.quantised(F.col("embedding")).alias("_q"))
    assert codes.smallest(usable, 64) == [[i] for i in sorted(ids)[:64]]
