import math
import random
import re
from collections import Counter

import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from podium.llm import quality


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [
    None, "", "   \n\t", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n x\n\nx", "#*$% &|<> é😀", "w " * 2000, prose(1, 300), "a b c d " * 20 + prose(2, 100),
    "line one\n" * 30, "z" * 200_000,
]


def test_counters(spark):
    rows = quality.judge_quality(documents(spark, TEXTS + TEXTS[9:10], clash=True)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = by_hand((TEXTS + TEXTS[9:10])[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("seed", range(30))
def test_repeated_words(seed):
    r = random.Random(seed)
    text = " ".join(r.choice("abcd" if seed % 2 else "ab") for _ in range(r.randrange(60)))
    assert quality.counters_of(text)[:5] == by_hand(text)


def corpus():
    rows = [(i, prose(i, 80 + i % 50), "en", "a" if i % 3 else "b") for i in range(700)]
    rows += [(1000 + i, prose(i, 40) + " " + "&&& " * 40, "en", "a") for i in range(20)]
    rows += [(2000 + i, "y" * 60 + " " + " ".join(f"{'q' * 50}{j}" for j in range(60)), "en", "c") for i in range(5)]
    rows += [(3000 + i, prose(5000 + i, 90), None, None) for i in range(5)]
    return rows


def test_verdicts(spark):
    df = documents(spark, corpus(), clash=True)
    kept = {r.doc_id: r.kept for r in quality.judge_quality(df).collect()}
    assert all(kept[i] for i in range(700))
    # Rows of a source with few texts, or without a language, are held to the fences of more.
    assert not any(kept[1000 + i] for i in range(20)) and not any(kept[2000 + i] for i in range(5))
    assert all(kept[3000 + i] for i in range(5))
    good = quality.good_documents(df)
    assert good.columns == df.columns and good.count() == sum(kept.values())
    assert quality.judge_quality(df.where("false")).count() == 0 and quality.good_documents(df.where("false")).count() == 0


def test_sketches_add_up_and_keep_their_error(spark):
    df = documents(spark, corpus())
    rows = df.select("lang", "source", quality.counters(F.col("text")).alias("_c"))
    whole = quality.sketches(rows)
    halves = quality.sketches(rows.where("source = 'a'")).unionByName(quality.sketches(rows.where("source <> 'a' OR source IS NULL")))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, quality.merged(whole, ["lang"]).collect())) == sorted(map(key, quality.merged(halves, ["lang"]).collect()))
    bins = quality.fences(quality.merged(whole, ["lang"]), ["lang"], "_f").where("lang = 'en'").first()["_f"]
    lengths = sorted(len(t.replace(" ", "")) / len(t.split()) for _, t, lang, _ in corpus() if lang == "en" and by_hand(t)[4] * 2 <= len(t.split()))
    q1, q3 = lengths[math.ceil(len(lengths) / 4) - 1], lengths[math.ceil(len(lengths) * 3 / 4) - 1]
    reach = max(q3 / q1, quality.GAMMA) ** quality.REACH
    assert bins["word_length"]["high"] == pytest.approx(q3 * reach, rel=0.02 * (2 * quality.REACH + 1))
    assert bins["word_length"]["low"] == pytest.approx(q1 / reach, rel=0.02 * (2 * quality.REACH + 1))


def shares_by_hand(text):
    n, chars, symbols, dup, repeated = by_hand(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in (text or "").split("\n"))
    return {"word_length": chars / max(n, 1), "symbols": symbols / max(chars, 1), "dup_lines": dup / max(lines, 1), "repeats": repeated / max(n, 1)}


def quantile_by_hand(values, q):
    return sorted(values)[max(math.ceil(len(values) * q), 1) - 1] if values else 0.0


def fences_by_hand(rows):
    q1, q3 = (quantile_by_hand([r["word_length"] for r in rows], q) for q in (0.25, 0.75))
    reach = max(q3 / q1, quality.GAMMA) ** quality.REACH
    fences = {"word_length": (q1 / reach, q3 * reach)}
    for m, q in quality.QUANTILE.items():
        values = [r[m] for r in rows if r[m] > 0 or m not in quality.ABOVE_ZERO]
        fences[m] = (0.0, max(quantile_by_hand(values, q), quality.LEAST.get(m, 0.0)))
    return fences


def varied_corpus():
    """Two large sources that differ in every metric, a small one of another language, and one without either."""
    rows = []
    for i in range(560):
        r = random.Random(i)
        source, lang = ("code", "en") if i % 2 else ("news", "en") if i < 500 else ("tiny", None)
        words = prose(i, 60 + i % 40).split(" ")
        if source == "code":
            words = [f"{w}longer" for w in words] + ["<|>"] * 1 + [f"a{j}&&&&&b" for j in range(r.randrange(9))]
        lines = [" ".join(words[j : j + 8]) for j in range(0, len(words), 8)]
        if r.random() < 0.3:
            lines += r.choices(lines[:2], k=r.randrange(1, 5 if source == "news" else 8))
        rows.append((i, "\n".join(lines), lang, source))
    return rows


def test_verdicts_against_exact_quantiles(spark):
    rows = varied_corpus()
    measured = [(d, shares_by_hand(t), (lang, source)) for d, t, lang, source in rows if not (by_hand(t)[0] < 50 or 2 * by_hand(t)[4] > by_hand(t)[0])]
    groups = {g: [s for _, s, h in measured if h == g] for g in {g for _, _, g in measured}}
    langs = {g[0]: [s for _, s, h in measured if h[0] == g[0]] for g in groups}
    fences = {
        g: fences_by_hand(x if len(x) >= quality.MIN_GROUP else langs[g[0]] if len(langs[g[0]]) >= quality.MIN_GROUP else [s for _, s, _ in measured])
        for g, x in groups.items()
    }
    assert len({str(f) for f in fences.values()}) == len(groups) == 3
    assert fences["en", "code"]["symbols"][1] > fences["en", "news"]["symbols"][1]
    kept = {r.doc_id: r.kept for r in quality.judge_quality(documents(spark, rows)).collect()}
    dropped = 0
    for d, s, g in measured:
        # Between a fence and the sketch's error beyond it, either verdict is right.
        low, high = fences[g]["word_length"]
        fits = [s[m] <= fences[g][m][1] for m in quality.QUANTILE] + [low * 1.12 < s["word_length"] < high / 1.12]
        fails = [s[m] > fences[g][m][1] * 1.03 for m in quality.QUANTILE] + [not low / 1.12 < s["word_length"] < high * 1.12]
        assert kept[d] if all(fits) else not (kept[d] and any(fails))
        dropped += any(fails)
    assert dropped > 5
