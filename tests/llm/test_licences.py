import random
import re
from itertools import combinations

import pytest
from helpers import documents, prose

from podium.llm import licences


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_by_hand(text):
    w, found = words(text), []
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def own_by_hand(text):
    """Labels by comparing every template at every place."""
    w, labels = words(text), {}
    for label, template, phrases in licences.TEMPLATES:
        t = template.split()
        for start in range(-len(t) + 1, len(w)):
            agree = sum(0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(t))
            if agree >= licences.COVERAGE * len(t):
                places = [next(i for i in range(len(t)) if t[i : i + len(p.split())] == p.split()) for p in phrases]
                if all(start + at >= 0 and w[start + at : start + at + len(p.split())] == p.split() for at, p in zip(places, phrases, strict=True)):
                    labels[label] = max(labels.get(label, 0), agree / len(t))
    return labels


TEXTS = [
    None, "", "MIT License mit\nlicense, Apache-License general public license", "general public general public license license", prose(1, 50),
    *[f"{prose(i, 20)} {t.upper().replace(' ', '  ')}. {prose(i, 9)}" for i, (_, t, _) in enumerate(licences.TEMPLATES)],
    *[t.replace(" the ", " a ", 1) for _, t, _ in licences.TEMPLATES],
    "under the apache license version 2 0", "mit license " * 3000, "é" * 100_000, "licensed under cc by nc 3 0", " ".join(t for _, t, _ in licences.TEMPLATES),
]


def test_scan(spark):
    rows = licences.licence_scan(documents(spark, TEXTS + TEXTS[2:3], clash=True)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = (TEXTS + TEXTS[2:3])[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(text)
        own = own_by_hand(text)
        assert set(filter(None, r.labels.split(","))) == set(filter(None, r.base_labels.split(","))) | set(own)
        assert r.score == pytest.approx(max(own.values(), default=0.0)) and 0 <= r.score <= 1
    assert licences.licence_scan(documents(spark, []).where("false")).count() == 0


def test_the_index_takes_the_rarest_words(spark):
    index = licences.build_index(documents(spark, ["released under the mit"] * 5 + ["license"] * 3 + ["x"]))
    mit = {w for w, posts in index.postings.items() if any(licences.TEMPLATES[t][0] == "mit-notice" for t, _ in posts)}
    assert len(mit) == licences.RARE_WORDS and b"license" in mit


def test_no_accepted_place_is_lost_when_index_words_differ(spark):
    """Every template with each set of words replaced that coverage allows, index words and all; common phrase words."""
    common = ["permission is hereby granted free of charge to any person and this software mit license"] * 30
    index = licences.build_index(documents(spark, common))
    for label, template, _ in licences.TEMPLATES:
        t = template.split()
        for r in range(60):
            changed = random.Random(r).sample(range(len(t)), random.Random(r).randint(0, len(t) // 4))
            text = " ".join("zzz" if i in changed else w for i, w in enumerate(t))
            found = index.scan(licences.words_of(f"a b {text} c".encode()))
            assert {x for x, _, _ in found} == own_by_hand(f"a b {text} c").keys()
    lost = "permission is hereby granted free of charge to any person zzz a zzz of this software and zzz zzz files"
    assert "mit-text" in {x for x, _, _ in index.scan(licences.words_of(lost.encode()))}


def test_templates_without_phrases_lose_no_place(spark):
    templates = (("plain", "one two three four five six seven eight nine ten eleven twelve", ()), ("same", "ab ab ab ab", ()), ("word", "solo mark here now", ("solo",)))
    index = licences.build_index(documents(spark, ["x"]), templates)
    for label, template, _ in templates:
        t = template.split()
        for changed in combinations(range(len(t)), len(t) // 4):
            text = " ".join("zzz" if i in changed else w for i, w in enumerate(t))
            places = [s for x, s, _ in index.scan(licences.words_of(text.encode())) if x == label]
            assert (0 in places) == (label != "word" or "solo" in text)
