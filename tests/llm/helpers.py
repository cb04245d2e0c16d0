"""Small inputs shared by the tests of podium.llm."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, clash: bool = False):
    """A documents table; texts is a list of texts or of (doc_id, text, lang, source). With columns named like
    those the operators use inside."""
    rows = [t if isinstance(t, tuple) else (i, t, "en", "a") for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    if clash:
        for name in ("row", "size", "key", "fp", "value", "rank", "hash", "words", "score", "group", "term", "_doc", "_text", "start", "repetition"):
            df = df.selectExpr("*", f"concat('own ', doc_id) AS `{name}`")
    return df


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    """n made-up words; few are shared between seeds."""
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary):x}{'aeiou'[r.randrange(5)]}" for _ in range(n))


def edited(text: str, seed: int, places: int) -> str:
    """The text with some words replaced."""
    r, words = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(words)), places):
        words[i] = f"edit{r.randrange(10**6)}"
    return " ".join(words)
