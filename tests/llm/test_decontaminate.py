import random
import re
from itertools import combinations

from helpers import documents, edited, prose

from podium.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())


def brute(text, item):
    """(places, best agreeing words, compared, first word) over all shifts that a mask hits."""
    a, b = words(item), words(text)
    shifts = set()
    for i in range(len(a) - d.SPAN + 1):
        for j in range(len(b) - d.SPAN + 1):
            if any(all(a[i + k] == b[j + k] for k in m) for m in d.MASKS):
                shifts.add(j - i)
    found = []
    for s in shifts:
        low, high = max(0, -s), min(len(a), len(b) - s)
        same = [a[p] == b[p + s] for p in range(low, high)]
        n = min(d.WINDOW, len(same))
        score, at = max((sum(same[i : i + n]), -i) for i in range(len(same) - n + 1))
        if score >= d.AGREE if n >= d.WINDOW else n >= d.SHORTEST and score * 5 >= n * 4:
            found.append((score, -(low + s - at), n))
    return (len(found), max(found)[0], max(found)[2], -max(found)[1]) if found else None


def test_against_brute_force(spark):
    r = random.Random(3)
    items = [(i, prose(100 + i, n)) for i, n in enumerate((45, 30, 13, 12, 9, 8, 60))] + [(50, None), (51, ""), (52, prose(100, 45)), (None, prose(300, 20))]
    texts = [None, "", "short text", prose(1, 200)]
    for i, item in items:
        if item:
            texts.append(prose(10, 60) + " " + item.upper().replace(" ", ", ", 3) + "! " + prose(11, 40))
            texts.append(item)
            n = len(item.split(" "))
            texts += [prose(20, 30) + " " + edited(item, k, min(n, k)) + " " + prose(21, 30) for k in (1, 2, 3, 5, 9)]
            texts.append(" ".join(item.split(" ")[: max(1, n // 2)]) + " " + prose(r.randrange(99), 50))
    texts.append(" ".join([items[0][1]] * 3))
    df = documents(spark, texts + texts[5:6], clash=True)
    bench = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id bigint, text string, row string")
    got = {(x.doc_id, x.item_id): (x.n_places, x.n_agree, x.n_words, x.first_word) for x in d.leaks(df, bench).collect()}
    want = {(i, k): found for i, t in enumerate(texts + texts[5:6]) for k, item in items if item and (found := brute(t, item))}
    assert got == want
    clean = d.clean_documents(df, bench)
    assert clean.columns == df.columns
    assert sorted(x.doc_id for x in clean.collect()) == [i for i in range(len(texts) + 1) if not any(i == a for a, _ in want)]
    assert d.leaks(df.where("false"), bench).count() == 0 and d.leaks(df, bench.where("false")).count() == 0
    assert d.clean_documents(df, bench.where("false")).count() == len(texts) + 1


def test_masks_stand_every_fifth_word_replaced(spark):
    item = prose(7, 40).split(" ")
    rows = []
    for first in range(5):
        rows.append(" ".join(f"new{i}" if i % 5 == first else w for i, w in enumerate(item)))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert d.leaks(documents(spark, rows), bench).count() == 5


def test_large_benchmarks_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_HASHES", 0)
    item = prose(7, 40)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [x.doc_id for x in d.leaks(documents(spark, [prose(8, 50), prose(9, 20) + " " + item]), bench).collect()] == [1]


def test_a_very_long_text(spark):
    item = prose(7, 40)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    text = prose(1, 60_000) + " " + item + " " + prose(2, 60_000)
    found = d.leaks(documents(spark, [text]), bench).collect()
    assert [(x.n_agree, x.first_word) for x in found] == [(13, 60_000)]


def test_every_accepted_passage_is_found(spark):
    """All places of the replaced words that the check accepts, for every length up to the window; no seeds here."""
    items, rows, want = [], [], set()
    for n, most in ((9, 1), (10, 2), (11, 2), (12, 2), (13, 3)):
        item = prose(50 + n, n).split(" ")
        items.append((n, " ".join(item)))
        for replaced in combinations(range(n), most):
            passage = " ".join(f"new{i}" if i in replaced else w for i, w in enumerate(item))
            want.add((len(rows), n))
            rows.append(f"{prose(1000 + len(rows), 20)} {passage} {prose(5000 + len(rows), 20)}")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in d.leaks(documents(spark, rows), bench).collect()} == want
