import zlib
from itertools import islice, product

import numpy as np
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from podium.llm import toxicity


def corpus():
    """Toxic texts have words of the lexicon or, in another language, words that begin alike."""
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        words = prose(i, 60).split(" ")
        if toxic:
            words[10:13] = ["Idiot,", "SCUM", "trash"] if i % 2 else [f"vlorg{i % 7}a", f"vlorgx{i % 5}", f"vlorge{i % 3}"]
            words[10:13] = [w.replace("0", "o").replace("1", "i").replace("2", "z").replace("3", "e").replace("4", "h").replace("5", "s").replace("6", "b") for w in words[10:13]]
        rows.append((i, " ".join(words), "en", "a"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_scores(spark):
    rows, labels = corpus()
    extra = [(1000, None, None, None), (1001, "", "en", "a"), (None, "you idiot, pathetic scum", "en", "a"), (1002, "x" * 300_000, "en", "a")]
    df = documents(spark, rows + extra + rows[:1], clash=True)
    marks = spark.createDataFrame(labels + [(5, 1, None), (None, 0, 1), (6, 0, 7)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(df, marks).collect()
    assert len(got) == len(rows) + len(extra) + 1
    by_id = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert by_id[1000].score == by_id[1001].score < 0.5 and by_id[None].predicted == 1
    kept = toxicity.acceptable_documents(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.toxicity(df.where("false"), marks).count() == 0


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus()
    df = documents(spark, rows)
    schema = "doc_id bigint, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a = toxicity.toxicity(df, spark.createDataFrame(labels, schema)).collect()
    assert sorted(a) == sorted(toxicity.toxicity(df, spark.createDataFrame(flipped, schema)).collect())


def test_without_labels_the_lexicon_decides(spark):
    rows, _ = corpus()
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(documents(spark, rows), none).collect()}
    assert got[5] == 1 and got[1] == 0


def test_the_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.2
    fire = np.stack([np.where(truth, r.random(20_000) < p, r.random(20_000) < q) for p, q in ((0.8, 0.02), (0.7, 0.05), (0.6, 0.01), (0.5, 0.1))])
    fire = np.concatenate([fire, fire[:1] ^ (r.random((1, 20_000)) < 0.02)])  # a voter that copies the first
    mask = sum(fire[i].astype(np.int64) << i for i in range(5))
    patterns = np.unique(mask)
    count = lambda rows: np.array([(mask[rows] == p).sum() for p in patterns], dtype=float)
    known = np.arange(20_000) < 1_000
    posterior, groups = toxicity.fit_labels(patterns, count(~known), count(known & ~truth), count(known & truth), 5)
    assert any({0, 4} <= set(g) for g in groups)
    by_rows = posterior[np.searchsorted(patterns, mask)]
    best = np.array([truth[mask == p].mean() for p in patterns])[np.searchsorted(patterns, mask)]
    assert np.abs(by_rows - best).mean() < 0.03


@pytest.mark.parametrize("text", [None, "", "ab", "Vlorga vlorgb VLORGC x", "Ünï-cöde 12 a_b"])
def test_wanted_features_are_those_of_all(text):
    everything = toxicity.features_of(text)
    for wanted in (set(), {"vlor*", "vlor*3", "vlorga", "x"}, everything):
        assert toxicity.features_of(text, wanted, toxicity.stems_of(wanted)) == everything & wanted


def test_a_rare_strong_term_is_mined_among_many_frequent_ones(spark):
    common = " ".join(islice(map("".join, product("abcdefghijklm", repeat=4)), 21_000))
    rows = [(common + " vlorg" * (i < 8), 1) for i in range(12)] + [(common if i < 20 else "fine", 0) for i in range(80)]
    assert "vlorg" in toxicity.mined_terms(spark.createDataFrame(rows, "text string, toxic int")).number


def test_first_rows_by_hash(spark):
    """The threshold leaves the rows that a plain sort gives, also where one id has a third of them."""
    ids = [*range(3000), *[7] * 1500, *[None] * 10]
    rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "doc_id bigint, n int")
    for size in (1, 50, 1700, 5000):
        plain = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(size).collect()
        assert toxicity.first_by_hash(rows, size, "n").collect() == plain
    below = toxicity.first_by_hash(rows, 50, "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in below and toxicity.first_by_hash(rows.where("false"), 5).count() == 0
