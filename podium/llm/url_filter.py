"""URL filter: path rules, then a Bloom filter cascade over host names. Native DataFrame operations only.

The cascade answers "is this key listed?" exactly for every key of the corpus without a join on the pages.
Level 1 holds the listed keys; level 2 the unlisted keys of the corpus that level 1 takes for listed; level 3
the listed keys that level 2 takes for those; and so on until a level lets nothing through. A key's answer is
the parity of the first level that does not hold it. Keys outside the universe may get a wrong answer.

Keys are dealt into shards by hash, so that no level of a shard grows beyond a few thousand words. As long as
all shards together stay below `INLINE_BYTES`, counted when they are built, their words reach the pages as
constants; beyond that the distinct keys, not the pages, are looked up shard by shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import ascii_lower, stored

Rule = tuple[str, str, str]
# Host, path, verdict.
RULES: tuple[Rule, ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# A domain is listed if a part of its first label, cut at hyphens, is one of these.
BLOCKED_TERMS = ("casino", "pills", "spam", "poker", "viagra", "replica", "loans")
# Listed keys of one shard, and the words of all levels that may travel inside the plan.
SHARD_KEYS = 1 << 16
INLINE_BYTES = 256 << 10
MAX_LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a text without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, outcome in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def domains(host: Column) -> Column:
    """The host and every domain above it; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    return F.when(host != "", F.array_distinct(suffixes)).otherwise(F.array().cast("array<string>"))


def is_listed(key: Column, terms: tuple[str, ...] = BLOCKED_TERMS) -> Column:
    """Whether a domain is on the list that the query uses."""
    return F.regexp_like(key, F.lit(rf"^([^.]*-)?({'|'.join(terms)})(-[^.]*)?\."))


class Level:
    """One Bloom filter of every shard: how many words and hashes it has, and its words by place."""

    def __init__(self, number: int, n_words: int, n_hashes: int, shards: int, words: DataFrame | None = None):
        self.number, self.n_words, self.n_hashes, self.shards, self.words = number, n_words, n_hashes, shards, words

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def places(self, key: Column) -> list[Column]:
        """Bit positions of a key: two hashes, stepped. Both are below 2^31, so that no sum overflows."""
        first = F.pmod(F.xxhash64(F.lit(2 * self.number), key), F.lit(1 << 31))
        step = F.pmod(F.xxhash64(F.lit(2 * self.number + 1), key), F.lit(1 << 31))
        bits = F.lit(self.n_words * 64).cast("bigint")
        return [F.pmod(first + F.lit(i) * step, bits) for i in range(self.n_hashes)]

    def build(self, keys: DataFrame) -> Level:
        """Set the bits of all keys. Bits are combined before the shuffle, one row a word."""
        place = F.explode(F.array(*self.places(F.col("key")))).alias("_place")
        bits = keys.select(self.shard(F.col("key")).alias("shard"), place)
        word = F.shiftright("_place", 6).cast("int")
        # shiftleft takes a constant: the bit of a word comes from a table of the 64 powers.
        powers = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
        bit = F.get(powers, F.pmod("_place", F.lit(64)).cast("int"))
        words = bits.groupBy("shard", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        self.words = stored(words, "bloom-level")
        return self

    def literal(self) -> Column:
        """All words in place order as one constant. Only for levels within INLINE_BYTES, which bounds the rows read."""
        words = [0] * (self.shards * self.n_words)
        for shard, word, bits in self.words.select("shard", "word", "bits").collect():
            words[shard * self.n_words + word] = bits
        return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def holds(self, key: Column) -> Column:
        """Whether all bits of the key are set, read from the constant, which the expression has once."""

        def all_set(words: Column) -> Column:
            hit = F.lit(True)
            for place in self.places(key):
                word = F.get(words, (self.shard(key) * self.n_words + F.shiftright(place, 6)).cast("int"))
                hit = hit & (F.getbit(word, F.pmod(place, F.lit(64))) == 1)
            return hit

        return F.exists(F.array(self.literal()), all_set)

    def held(self, keys: DataFrame) -> DataFrame:
        """The same for levels of any size: the distinct keys that pass, by a join on the words of their bits."""
        probes = keys.select("key", self.shard(F.col("key")).alias("shard"), F.explode(F.array(*self.places(F.col("key")))).alias("_place"))
        probes = probes.withColumn("word", F.shiftright("_place", 6).cast("int"))
        found = probes.join(self.words, ["shard", "word"], "left")
        ok = F.coalesce(F.getbit("bits", F.pmod("_place", F.lit(64))) == 1, F.lit(False))
        return found.groupBy("key").agg(F.bool_and(ok).alias("_ok")).where("_ok").select("key")


class Cascade:
    """Levels built over a universe of keys (key, listed), one row a key."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.inline = sum(level.shards * level.n_words * 8 for level in levels) <= INLINE_BYTES

    @staticmethod
    def build(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> Cascade:
        """`universe` has distinct, non-null keys and a boolean `listed`; it should be a stored table."""
        n_listed, n_other = universe.agg(
            F.coalesce(F.sum(F.col("listed").cast("bigint")), F.lit(0)), F.coalesce(F.sum((~F.col("listed")).cast("bigint")), F.lit(0))
        ).first()
        levels: list[Level] = []
        inside, outside = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key")
        n_in, n_out = n_listed, n_other
        shards = max(1, math.ceil(n_listed / shard_keys))
        while n_in and len(levels) < MAX_LEVELS:
            # The first level lets through about as many unlisted keys as there are listed ones; later levels half.
            rate = min(0.5, max(n_in, 1) / (math.sqrt(2) * max(n_out, 1))) if not levels else 0.5
            n_hashes = max(1, round(-math.log2(rate)))
            n_words = max(4, math.ceil(n_in / shards * 1.44 * -math.log2(rate) / 64) + 1)
            level = Level(len(levels) + 1, n_words, n_hashes, shards).build(inside)
            levels.append(level)
            small = level.shards * level.n_words * 8 <= INLINE_BYTES
            through = outside.where(level.holds(F.col("key"))) if small else level.held(outside)
            through = stored(through, "bloom-through")
            inside, outside, n_in, n_out = through, inside, through.count(), n_in
        if n_in:
            raise RuntimeError(f"the cascade did not end after {MAX_LEVELS} levels")
        return Cascade(levels)

    def listed(self, key: Column) -> Column:
        """Exact membership of a key of the universe: the parity of the first level without it."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer

    def listed_keys(self, keys: DataFrame) -> DataFrame:
        """The listed ones among distinct keys of the universe, for cascades too large for the plan."""
        passed, alive, answer = None, keys, None
        for i, level in enumerate(self.levels):
            held = stored(level.held(alive), "bloom-held")
            if i % 2 == 1:  # listed unless this level, too, holds it
                out = alive.join(held, "key", "left_anti")
                answer = out if answer is None else answer.unionByName(out)
            alive, passed = held, i
        if passed is not None and passed % 2 == 0:
            answer = alive if answer is None else answer.unionByName(alive)
        return answer if answer is not None else keys.where(F.lit(False))


def key_universe(hosts: DataFrame) -> DataFrame:
    """All domains of the hosts, each once, with the hosts reduced first."""
    distinct = hosts.select("host").distinct()
    return distinct.select(F.explode(domains(F.col("host"))).alias("key")).distinct()


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, terms: tuple[str, ...] = BLOCKED_TERMS, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of `pages`; other columns are ignored.

    A fitting rule decides. Else a page is blocked if its host or a domain above it is listed. A null url, one
    without `://`, or one with an empty host fits no rule, has no key and is allowed. Repeated rows are judged
    each for itself; an empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = key_universe(parts)
    universe = stored(keys.select("key", is_listed(F.col("key"), terms).alias("listed")), "url-keys")
    cascade = Cascade.build(universe, shard_keys)
    if cascade.inline:
        listed = F.exists(domains(F.col("host")), cascade.listed)
        judged = parts.withColumn("listed", F.coalesce(listed, F.lit(False)))
    else:
        judged = by_host(parts, cascade.listed_keys(universe.select("key")))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")


def by_host(parts: DataFrame, listed: DataFrame) -> DataFrame:
    """Mark pages by the listed keys: hosts are looked up once each, then stored, so that a hot host can be split."""
    hosts = parts.select("host").distinct()
    owners = hosts.select("host", F.explode(domains(F.col("host"))).alias("key")).join(listed, "key", "left_semi")
    blocked = stored(owners.select("host").distinct().withColumn("listed", F.lit(True)), "url-blocked")
    return parts.join(blocked, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))

