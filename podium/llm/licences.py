"""Licence scans by a positional index of rare words.

Templates are short licence texts. Over all documents the document frequency of every template word is counted;
the rarest words of each template, by inverse document frequency, and the rarest of its mandatory phrases make the
index: word to (template, position).
A file's words of the index are looked up, rarest first; a posting votes for the place where its template would
begin, so words of one licence meet at one relative position. Places with votes of different words are verified:
the template's mandatory phrases must stand there word by word, and enough of its other words must agree.

The counts are one row a template word; the index has a few words a template and goes to the tasks as it is.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Phrases of the base rule and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Label, text, phrases that must be there.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit-notice", "released under the mit license", ("mit license",)),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge",),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        ("gnu general public license",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("distribute this software for any purpose",),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
)
RARE_WORDS, VOTES, COVERAGE = 4, 2, 0.75


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def places_of(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    """Starts of all places where the phrase's words stand consecutively, found by its last word."""
    last, n, found, at = phrase[-1], len(phrase), [], -1
    try:
        while True:
            at = words.index(last, at + 1)
            if at >= n - 1 and tuple(words[at - n + 1 : at + 1]) == phrase:
                found.append(at - n + 1)
    except ValueError:
        return found


@dataclass(frozen=True)
class Index:
    """Templates (label, words, phrases with their places, votes needed), the postings of their index words, and the
    words' ranks, rarest first."""

    templates: tuple[tuple[str, tuple[bytes, ...], tuple[tuple[int, tuple[bytes, ...]], ...], int], ...]
    postings: dict[bytes, list[tuple[int, int]]]
    rank: dict[bytes, int]

    def scan(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, start, coverage) of every verified place."""
        wanted = set(words) & self.rank.keys()
        if not wanted:
            return []
        positions = defaultdict(list)
        for at, word in enumerate(words):
            if word in wanted:
                positions[word].append(at)
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for word in sorted(wanted, key=self.rank.__getitem__):
            for at in positions[word]:
                for template, offset in self.postings[word]:
                    votes[template, at - offset].add(word)
        found = []
        for (number, start), voters in votes.items():
            label, text, phrases, needed = self.templates[number]
            if len(voters) < needed or start + len(text) <= 0:
                continue
            # Phrases must stand at their place; what hangs over an end of the file does not agree.
            if all(start + at >= 0 and tuple(words[start + at : start + at + len(p)]) == p for at, p in phrases):
                agree = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(text))
                if agree >= COVERAGE * len(text):
                    found.append((label, start, agree / len(text)))
        return found


def count_template_words(frames: Iterator[pd.DataFrame], vocabulary: set[bytes]) -> Iterator[pd.DataFrame]:
    """Documents a template word stands in, and all documents under the empty word, summed within the task."""
    counts: Counter = Counter()
    for frame in frames:
        for text in frame["text"]:
            counts.update(vocabulary.intersection(words_of(text)))
            counts[b""] += 1
    yield pd.DataFrame([(w.decode(), n) for w, n in counts.items()], columns=["word", "n"])


def index_words(words: tuple[bytes, ...], phrases: list[tuple[bytes, ...]], rank: dict[bytes, int]) -> tuple[list[bytes], int]:
    """The index words of a template, rarest first, and how many different ones vote for every place that passes.

    All words of the phrases stand at such a place, so the rarest VOTES of them always vote. Without as many, words
    are taken until more are left than the words that may differ can silence.
    """
    rarest = sorted(set(words), key=rank.__getitem__)
    mandatory = sorted({w for p in phrases for w in p}, key=rank.__getitem__)[:VOTES]
    if len(mandatory) == VOTES:
        return sorted({*rarest[:RARE_WORDS], *mandatory}, key=rank.__getitem__), VOTES
    may_differ = len(words) - ceil(COVERAGE * len(words))
    chosen = rarest[: max(RARE_WORDS, may_differ + VOTES)]
    return chosen, max(1, min(VOTES, len(chosen) - may_differ))


def build_index(docs: DataFrame, templates=TEMPLATES) -> Index:
    """Count the template words over all documents and index the rarest of each template and of its phrases; ties by
    the word."""
    texts = [tuple(text.encode().split()) for _, text, _ in templates]
    vocabulary = {w for t in texts for w in t}
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(partial(count_template_words, vocabulary=vocabulary), "word string, n bigint")
    counts = {r["word"].encode(): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(b"", 0)
    idf = {w: log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}
    order = sorted(vocabulary, key=lambda w: (-idf[w], w))
    rank = {w: i for i, w in enumerate(order)}
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    entries = []
    for number, (label, _, phrases) in enumerate(templates):
        words = texts[number]
        split = [tuple(p.encode().split()) for p in phrases]
        chosen, needed = index_words(words, split, rank)
        for word in chosen:
            postings[word] += [(number, at) for at, w in enumerate(words) if w == word]
        entries.append((label, words, tuple((places_of(list(words), p)[0], p) for p in split), needed))
    return Index(tuple(entries), dict(postings), {w: rank[w] for w in postings})


RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_text(text: bytes | None, index: Index) -> tuple:
    words = words_of(text)
    base = [(at, label) for phrase, label in PHRASES for at in places_of(words, tuple(phrase.encode().split()))]
    own = index.scan(words)
    base_labels = {label for _, label in base}
    starts = [at for at, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {label for label, _, _ in own})), max((c for _, _, c in own), default=0.0),
    )


def scan_column(text: Column, index: Index) -> Column:
    names = [c.split()[0] for c in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def column(texts: pd.Series) -> pd.DataFrame:
        frame = pd.DataFrame([scan_text(t, index) for t in texts], columns=names)
        return frame.astype({"first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return column(text.cast("binary"))


def licence_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row a document.

    Null texts count as empty: no words, no labels, score 0. The score is the share of template words that agree
    at the best verified place. Equal rows are scanned each; other columns are ignored; an empty table gives an empty
    result.
    """
    scanned = docs.select("doc_id", scan_column(F.col("text"), build_index(docs, templates)).alias("_s"))
    return scanned.select("doc_id", "_s.*")
