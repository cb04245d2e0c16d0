"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every text is reduced to counters. For the shares made of them, each language and source gets a quantile sketch:
counts of logarithmic bins of a fixed relative width (RELATIVE_ERROR). Sketches are rows (group, metric, bin, n)
that add up: map tasks combine them before the shuffle, so a hot source costs its bins, and the sketch of a
language is the sum of those of its sources. Quantiles of a sketch give fences; a text outside of a fence fails.
A source with too few texts takes the fences of its language, a language with too few those of all texts.
The thresholds are then joined to the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEW_WORDS, MOST_REPEATED = 50, 50
RELATIVE_ERROR = 0.01
GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
# Texts a group needs for fences of its own.
MIN_GROUP = 200
# Fences of word_length lie this many interquartile ranges beyond the quartiles, on the logarithmic scale of the sketch.
REACH = 4.0
# The fence of the other metrics is a quantile: of all values, or of those above zero where zero says that a text has
# no trait to measure (no line twice, no passage twice), which most texts of every group have not.
QUANTILE = {"symbols": 0.9, "dup_lines": 0.99, "repeats": 0.99}
ABOVE_ZERO = ("dup_lines", "repeats")
# A quantile of zero would drop a text for a single symbol: the least fence of symbols.
LEAST = {"symbols": 0.02}
METRICS = ("word_length", *QUANTILE)
COUNTERS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    # Pairs are numbered anew before the third word is added, so that no product overflows.
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def counters_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counters of a text, null as empty."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines),
    )


def counters(text: Column) -> Column:
    """The counters as a struct column."""

    @F.pandas_udf(COUNTERS)
    def column(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counters_of(t) for t in texts], columns=[c.split()[0] for c in COUNTERS.split(", ")], dtype="int64")

    return column(text)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < FEW_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def shares(c: Column) -> dict[str, Column]:
    """The metrics with thresholds; 0 of a text without words."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "word_length": over(c["word_chars"], c["n_words"]),
        "symbols": over(c["n_symbols"], c["word_chars"]),
        "dup_lines": over(c["n_dup_lines"], c["n_lines"]),
        "repeats": over(c["n_repeat_words"], c["n_words"]),
    }


def bin_of(value: Column) -> Column:
    """The bin of a value; null for zero, which is the lowest bin."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(float(np.log(GAMMA)))).cast("int"))


def bin_value(number: Column) -> Column:
    """The middle of a bin, within RELATIVE_ERROR of every value in it."""
    return F.when(number.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), number) * F.lit(2 / (1 + GAMMA)))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n) from rows (lang, source, _c) of texts that passed the base rules."""
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(v).alias("bin")) for m, v in shares(F.col("_c")).items()])
    passed = rows.where(~base_failed(F.col("_c"))).select("lang", "source", F.explode(metrics).alias("_m"))
    return passed.groupBy("lang", "source", "_m.metric", "_m.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up to fewer keys."""
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """(keys, <prefix>) with one struct of a low and a high fence a metric, for groups with enough texts."""
    group = [*keys, "metric"]
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy(F.col("bin").asc_nulls_first()))
    placed = sketch.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(Window.partitionBy(*group)))
    placed = placed.withColumn("_zero", F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))).over(Window.partitionBy(*group)), F.lit(0)))

    def quantile(q: float, above_zero: bool = False) -> Column:
        """The value below which a share `q` lies; with `above_zero`, of the values above zero, and 0 without any."""
        zero = F.col("_zero") if above_zero else F.lit(0)
        reached = F.col("_upto") - zero >= (F.col("_all") - zero) * q
        return F.coalesce(F.min(F.when(reached & (F.col("bin").isNotNull() | (zero == 0)), bin_value(F.col("bin")))), F.lit(0.0))

    quantiles = [quantile(q, m in ABOVE_ZERO).alias(f"_{m}") for m, q in QUANTILE.items()]
    enough = placed.where(F.col("_all") >= MIN_GROUP).groupBy(*group)
    found = enough.agg(quantile(0.25).alias("_low"), quantile(0.75).alias("_high"), *quantiles)
    # Quartiles closer than the sketch tells apart count as one bin apart.
    ratio = F.pow(F.greatest(F.col("_high") / F.col("_low"), F.lit(GAMMA)), F.lit(REACH))
    edges = {"word_length": F.struct((F.col("_low") / ratio).alias("low"), (F.col("_high") * ratio).alias("high"))}
    for m in QUANTILE:
        # A value in the quantile's own bin is within.
        edges[m] = F.struct(F.lit(0.0).alias("low"), F.greatest(F.col(f"_{m}") * (1 + RELATIVE_ERROR), F.lit(LEAST.get(m, 0.0))).alias("high"))
    return found.groupBy(*keys).agg(F.struct(*[F.max(F.when(F.col("metric") == m, edges[m])).alias(m) for m in METRICS]).alias(prefix))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, _own): the fences that hold for every language and source, their own or the next larger group's."""
    sketch = stored(sketches(rows), "quality-sketches")
    groups = sketch.select("lang", "source").distinct()
    by_source, by_lang = fences(sketch, ["lang", "source"], "_by_source"), fences(merged(sketch, ["lang"]), ["lang"], "_by_lang")
    overall = fences(merged(sketch.withColumn("_one", F.lit(1)), ["_one"]), ["_one"], "_overall")
    g = groups.withColumn("_one", F.lit(1)).join(overall, "_one", "left").drop("_one")
    g = null_safe(null_safe(g, by_lang, ["lang"]), by_source, ["lang", "source"])
    return stored(g.select("lang", "source", F.coalesce("_by_source", "_by_lang", "_overall").alias("_own")), "quality-thresholds")


def null_safe(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that takes null keys for equal."""
    renamed = table.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(renamed, condition, "left").drop(*[f"_key_{k}" for k in keys])


def keeps(c: Column, own: Column) -> Column:
    """The verdict: base rules, then every fence. A group without any fence (few texts in all) has only base rules."""
    inside = F.lit(True)
    for metric, value in shares(c).items():
        inside = inside & F.coalesce(value.between(own[metric]["low"], own[metric]["high"]), F.lit(True))
    return ~base_failed(c) & inside


def judge_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row a document.

    Null and empty texts have zero counters and fail. Null languages and sources are groups of their own.
    Equal rows are judged alike; other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(docs.select("doc_id", "lang", "source", counters(F.col("text")).alias("_c")), "quality-rows")
    judged = null_safe(rows, thresholds(rows), ["lang", "source"])
    names = [c.split()[0] for c in COUNTERS.split(", ")][:5]
    return judged.select(
        "doc_id", *[F.col(f"_c.{n}").alias(n) for n in names], base_failed(F.col("_c")).alias("base_failed"), keeps(F.col("_c"), F.col("_own")).alias("kept")
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns kept; nulls, repeated rows and empty tables as in `judge_quality`."""
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "lang", "source", counters(F.col("text")).alias("_c"))
    sketched = thresholds(stored(counted.select("lang", "source", "_c"), "quality-rows"))
    judged = null_safe(counted, sketched, ["lang", "source"]).where(keeps(F.col("_c"), F.col("_own")))
    return judged.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
