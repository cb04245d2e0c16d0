"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters are a fixed lexicon, words and word beginnings mined from labelled rows (by tiers of strength, so that a
weak term does not speak with a strong one's voice), and a pattern of shouting. A voter fires or does not. The label model is a mixture
of toxic and clean documents: expectation maximisation over the counts of vote patterns of all documents, with
the labelled rows held at their labels, estimates how often each voter fires in either class. Voters that still
agree within a class are correlated; they are put into one group whose joint firing is estimated instead. The
posterior of each pattern is the training label of a logistic regression over the lexicon and mined terms.

Counts of vote patterns are at most 2 ^ voters rows, whatever the number of documents. Mining and training use
bounded, seeded samples of labelled and of unlabelled rows (FIT_ROWS, TRAIN_ROWS); the label model counts all.
Text is read by Arrow-batched Python; a doc_id, source, language or label never enters a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import stored

# Insults that start the lexicon.
LEXICON = (
    "idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile",
    "idiota", "imbécil", "basura", "estúpido", "idiote", "imbécile", "ordure", "débile", "dummkopf", "abschaum", "widerlich", "versager",
)
WORD, CAPITAL = re.compile(r"[^\W\d_]+"), re.compile("[A-ZÀ-Þ]")
STEM = 3
PREFIXES, MARKS = (3, 4, 5, 6, 7), ("*", "*2", "*3")
# Labelled rows that terms are mined from, terms kept, and what a kept term must show.
FIT_ROWS, TERMS = 50_000, 2_000
# A term must be this many times as frequent in toxic documents, with 95 % confidence.
MIN_TOXIC, MIN_RATIO, CONFIDENCE = 5, 5.0, 1.64
# Terms are dealt to voters by the ratio they are sure of: words and beginnings each have a voter a tier.
TIERS = (60.0, 25.0, 12.0)
# Rows the classifier is trained on.
TRAIN_ROWS = 20_000
# Correlation within a class from which voters are modelled together, and the most voters of a group.
CORRELATED, LARGEST_GROUP = 0.15, 3
ROUNDS, SHOUTED = 60, 0.3
FOLDS = 5


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out: never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features_of(text: str | None, wanted: set[str] | None = None, stems: set[str] | None = None) -> set[str]:
    """The lower-cased words of a text, their beginnings (marked `*`) and the beginnings that two and three
    different words share (`*2`, `*3`). With `wanted`, only those of it; `stems` are their first letters."""
    words = set(WORD.findall((text or "").lower()))
    shared: Counter = Counter()
    for word in words if stems is None else [w for w in words if w[:STEM] in stems]:
        shared.update([word[:n] for n in PREFIXES if len(word) >= n])
    found = words if wanted is None else words & wanted
    found = found.union(p + mark for p, n in shared.items() for mark in MARKS[: min(n, len(MARKS))])
    return found if wanted is None else found & wanted


def stems_of(terms: set[str]) -> set[str]:
    """The first letters of the word beginnings among the terms."""
    return {t[:STEM] for t in terms if "*" in t}


@dataclass(frozen=True)
class Terms:
    """Terms by number, and the voter each belongs to; the shouting voter comes last."""

    number: dict[str, int]
    voter: list[int]
    n_voters: int
    stems: frozenset[str]

    def matched(self, text: str | None) -> list[int]:
        return sorted(self.number[f] for f in features_of(text, self.number.keys(), self.stems))

    def votes(self, text: str | None, matched: list[int]) -> int:
        mask = 0
        for term in matched:
            mask |= 1 << self.voter[term]
        if text and len(CAPITAL.findall(text)) > SHOUTED * (len(text) - text.count(" ")):
            mask |= 1 << (self.n_voters - 1)
        return mask


@dataclass
class Model:
    terms: Terms
    weights: np.ndarray
    bias: float
    posterior: dict[int, float] = field(default_factory=dict)
    groups: list[tuple[int, ...]] = field(default_factory=list)

    def score(self, text: str | None) -> float:
        value = self.bias + float(self.weights[self.terms.matched(text)].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(value, -30, 30))))


# Mining


def count_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class per feature, summed within the task and let go before they fill its memory."""
    counts: Counter = Counter()

    def flush() -> pd.DataFrame:
        rows = [(f, t, n) for (f, t), n in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["term", "toxic", "n"])

    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            counts.update((f, toxic) for f in features_of(text))
            if len(counts) > 200_000:
                yield flush()
    if counts:
        yield flush()


def mined_terms(labelled: DataFrame) -> Terms:
    """Terms that labelled toxic documents have far more often than clean ones, the strongest, dealt to voters."""
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    counts = labelled.mapInPandas(count_features, "term string, toxic int, n bigint").groupBy("term")
    of = lambda toxic: F.coalesce(F.sum(F.when(F.col("toxic") == toxic, F.col("n"))), F.lit(0))
    counts = counts.agg(of(1).alias("a"), of(0).alias("b")).where(F.col("a") >= MIN_TOXIC)
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))
    least = odds - CONFIDENCE * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    passed = counts.select("term", least.alias("least")).where(F.col("least") >= float(np.log(MIN_RATIO)))
    return dealt_terms({r["term"]: r["least"] for r in passed.orderBy(F.desc("least"), "term").limit(TERMS).collect()})


def dealt_terms(strength: dict[str, float]) -> Terms:
    """The lexicon as voter 0, the mined terms by tier of their strength, words before beginnings."""
    tiers = len(TIERS) + 1
    number, voter = {}, []
    for term in dict.fromkeys([*LEXICON, *strength]):
        number[term] = len(voter)
        tier = sum(strength.get(term, 0.0) < np.log(t) for t in TIERS)
        voter.append(0 if term in LEXICON else 1 + tier + tiers * ("*" in term))
    return Terms(number, voter, 2 * tiers + 2, frozenset(stems_of(number.keys())))


# Label model


def fires(patterns: np.ndarray, group: tuple[int, ...]) -> np.ndarray:
    """The joint state of a group of voters in every pattern."""
    state = np.zeros(len(patterns), dtype=np.int64)
    for i, voter in enumerate(group):
        state |= ((patterns >> voter) & 1) << i
    return state


def fit_labels(
    patterns: np.ndarray, free: np.ndarray, clean: np.ndarray, toxic: np.ndarray, n_voters: int
) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Posterior of every pattern and the groups of correlated voters, from the pattern counts of rows without a
    label, with label 0 and with label 1."""
    groups: list[tuple[int, ...]] = [(v,) for v in range(n_voters)]
    posterior = maximise(patterns, free, clean, toxic, groups)
    weight = np.stack([free * (1 - posterior) + clean, free * posterior + toxic])
    fired = np.stack([(patterns >> v) & 1 for v in range(n_voters)])
    pairs = []
    for i, j in combinations(range(n_voters), 2):
        strength = max(correlation(fired[i], fired[j], w) for w in weight)
        if strength >= CORRELATED:
            pairs.append((-strength, i, j))
    for _, i, j in sorted(pairs):
        a, b = next(g for g in groups if i in g), next(g for g in groups if j in g)
        if a != b and len(a) + len(b) <= LARGEST_GROUP:
            groups = [g for g in groups if g not in (a, b)] + [tuple(sorted(a + b))]
    return maximise(patterns, free, clean, toxic, groups), sorted(groups)


def correlation(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Absolute correlation of two voters in one class."""
    total = weight.sum()
    if total < 10:
        return 0.0
    px, py = (weight * x).sum() / total, (weight * y).sum() / total
    spread = np.sqrt(px * (1 - px) * py * (1 - py))
    return float(abs((weight * x * y).sum() / total - px * py) / spread) if spread > 1e-9 else 0.0


def maximise(patterns: np.ndarray, free: np.ndarray, clean: np.ndarray, toxic: np.ndarray, groups: list[tuple[int, ...]]) -> np.ndarray:
    """Expectation maximisation. Without labels of both classes a mixture of few voters cannot be told from
    another, so every pattern with a firing voter is held to be toxic."""
    states = [fires(patterns, g) for g in groups]
    posterior = np.where(patterns != 0, 0.9, 0.02)
    if not (clean.sum() and toxic.sum()):
        return posterior
    labelled = clean.sum() + toxic.sum()
    for step in range(ROUNDS):
        # Rows without a label weigh no more than those with one, or they would take the classes elsewhere; the
        # first estimate is from labelled rows alone.
        share = 0.0 if step == 0 else min(1.0, labelled / max(free.sum(), 1.0))
        weight = np.stack([share * free * (1 - posterior) + clean, share * free * posterior + toxic])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        score = np.log(prior)[:, None] + np.zeros((2, len(patterns)))
        for group, state in zip(groups, states, strict=True):
            n = 1 << len(group)
            table = np.stack([np.bincount(state, weights=w, minlength=n) for w in weight]) + 0.5
            score += np.log(table / table.sum(axis=1, keepdims=True))[:, state]
        following = 1.0 / (1.0 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        if np.abs(following - posterior).max() < 1e-6:
            return following
        posterior = following
    return posterior


# Classifier


def fit_classifier(rows: list[list[int]], target: np.ndarray, n_terms: int, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient descent with momentum, from nothing but numpy sums."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    terms = np.fromiter((t for r in rows for t in r), dtype=np.int64)
    weights, bias = np.zeros(n_terms), 0.0
    push, push_bias = np.zeros(n_terms), 0.0
    for _ in range(steps):
        value = bias + np.bincount(at, weights=weights[terms], minlength=len(rows))
        error = 1.0 / (1.0 + np.exp(-np.clip(value, -30, 30))) - target
        gradient = np.bincount(terms, weights=error[at], minlength=n_terms) / len(rows) + ridge * weights
        push, push_bias = 0.9 * push - 3.0 * gradient, 0.9 * push_bias - 3.0 * error.mean()
        weights, bias = weights + push, bias + push_bias
    return weights, float(bias)


# Operators


def label_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) to learn from: one row a document outside the held-out fold, toxic if any of its rows says so."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def first_by_hash(rows: DataFrame, n: int, *then: str) -> DataFrame:
    """The first `n` rows by the hash of `doc_id`, then by the columns `then`. Hashes beyond a threshold that leaves
    enough rows go first, so that all tasks together send little more than `n` rows on."""
    place = F.xxhash64("doc_id")
    share = 1.2 * n / max(rows.count(), 1)
    while share < 1:
        below = rows.where(place < int(share * 2**64) - 2**63)
        if below.count() >= n:
            rows, share = below, 1
        share *= 4
    return rows.orderBy(place, "doc_id", *then).limit(n)


def voted(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, votes, terms) of all documents."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            matched = [terms.matched(t) for t in frame["text"]]
            votes = [terms.votes(t, m) for t, m in zip(frame["text"], matched, strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "votes": votes, "terms": matched})

    kept = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return kept.mapInPandas(rows, "doc_id string, votes int, terms array<int>")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Mine terms, fit the label model on all documents, train the classifier."""
    known = stored(label_rows(labels), "tox-labels")
    sample = first_by_hash(known, FIT_ROWS)
    labelled = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")
    terms = mined_terms(stored(labelled, "tox-sample"))
    votes = stored(voted(docs, terms), "tox-votes")
    by_id = known.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    counts = votes.select("doc_id", "votes").join(by_id, "doc_id", "left").groupBy("votes").agg(
        F.sum(F.col("toxic").isNull().cast("int")).alias("free"),
        F.sum((F.coalesce("toxic", F.lit(1)) == 0).cast("int")).alias("clean"),
        F.sum((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    table = counts.orderBy("votes").toPandas()
    if not len(table):
        return Model(terms, np.zeros(len(terms.voter)), 0.0)
    columns = [table[c].to_numpy(dtype=np.float64) for c in ("free", "clean", "toxic")]
    patterns = table["votes"].to_numpy(dtype=np.int64)
    posterior, groups = fit_labels(patterns, *columns, terms.n_voters)
    chosen = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    outside = votes.where(~in_fold(F.col("doc_id")))
    train = first_by_hash(outside, TRAIN_ROWS, "terms").select("votes", "terms").collect()
    weights, bias = np.zeros(len(terms.voter)), 0.0
    if train:
        target = np.array([chosen[r["votes"]] for r in train])
        weights, bias = fit_classifier([r["terms"] for r in train], target, len(terms.voter))
    return Model(terms, weights, bias, chosen, groups)


def score_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return column(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row a document.

    Null and empty texts have no terms and get the score of a text without any. A null doc_id is scored, but has
    no label. Labels other than 0 and 1 are passed over; without labels the lexicon alone decides. Other columns
    are ignored; an empty table gives an empty result.
    """
    scored = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def acceptable_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not take for toxic, all columns kept.

    Null and empty texts are scored as texts without terms, rows of equal or null ids each for themselves; an empty
    table stays empty.
    """
    return docs.where(score_column(F.col("text"), fit(docs, labels)) < 0.5)
