"""Reversible line dedup: exact reference counts of lines, with sharded cuckoo filters of the common ones on top.

The key of a line is the line without white space at its ends, A-Z lower-cased. An index holds, by shard of the
keys' hash, how many documents have each key (`refs`, exact), and one cuckoo filter a shard with the keys that
`min_docs` documents or more have. Documents can be inserted and deleted: their keys are counted, the counts are
added or taken off, and only filters of shards where a key crossed `min_docs` are touched, by inserting or
deleting its fingerprint. As the counts are exact, deleting a document undoes its insertion.

Lines are deduplicated against the filters alone. A filter never misses a common key; the few keys it takes for
common by mistake are looked up in the counts, as distinct keys, before any line goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.store import forget
from podium.llm.common import ascii_lower, free_name, stored

MIN_DOCS = 10
# Common keys of a shard, about; more make new shards.
SHARD_KEYS = 50_000
# Slots of a bucket, and moves of an insertion before the filter is doubled.
SLOTS = 4
MOST_MOVES = 500
# Filters of all shards together, and keys wrongly taken for common, that are broadcast; beyond, lines go to the shards.
BROADCAST_BYTES = 64 << 20
BROADCAST_KEYS = 1_000_000
KEY_BYTES = 16
# Tasks that share the distinct keys of a shard, each with the shard's filter.
SHARD_TASKS = 16
WHITE = " \t\n\x0b\x0c\r"

REFS = "shard int, key binary, n bigint"
FILTERS = "shard int, n_keys bigint, slots binary"


# Lines and keys


def lines(text: Column) -> Column:
    """A text cut at line feeds; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def hashed(key: Column) -> Column:
    """128 bits of a key's SHA-256; null for the empty key, which is never common."""
    return F.when(key != "", F.unhex(F.substring(F.sha2(key, 256), 1, 2 * KEY_BYTES)))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a hashed key: its first four bytes."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def document_counts(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, key, n): the number of documents (rows) that have a line with the key."""
    text = F.col("text")
    keys = F.transform(F.array_distinct(F.transform(lines(text), line_key)), hashed)
    # An outer explode: for the plain one the planner adds a filter that computes the keys once more.
    exploded = docs.select(F.explode_outer(keys).alias("key")).where("key IS NOT NULL")
    return exploded.groupBy(shard_of(F.col("key"), shards).alias("shard"), "key").agg(F.count("*").alias("n"))


# Cuckoo filters. A key has a fingerprint of 16 bits and two buckets; either follows from the other.


def places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first and second bucket of hashed keys, given as rows of 16 bytes."""
    words = np.ascontiguousarray(keys).view("<u2")
    prints = np.maximum(words[:, 2], 1)
    first = np.ascontiguousarray(keys[:, 8:16]).view("<u8")[:, 0] & np.uint64(buckets - 1)
    return prints, first, other_bucket(first, prints, buckets)


def other_bucket(bucket, prints, buckets: int):
    """The partner of a bucket for a fingerprint; its own inverse."""
    mixed = (prints.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(13)
    return bucket ^ (mixed & np.uint64(buckets - 1))


class CuckooFilter:
    """A set of hashed keys that answers `may_hold` without false negatives."""

    def __init__(self, n_keys: int, slots: np.ndarray | None = None):
        if slots is None:
            buckets = 1 << max(3, int(np.ceil(np.log2(max(n_keys, 1) / (0.85 * SLOTS)))))
            slots = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.slots = slots

    @classmethod
    def from_bytes(cls, data: bytes, writable: bool = False) -> CuckooFilter:
        slots = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS)
        return cls(0, slots.copy() if writable else slots)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of all the keys, doubled until they fit."""
        held = cls(len(keys))
        while not held.insert(keys):
            held = cls(0, np.zeros((2 * len(held.slots), SLOTS), dtype=np.uint16))
        return held

    def insert(self, keys: np.ndarray) -> bool:
        """False if the keys do not fit; the filter is then spoilt, and is made anew from the counts."""
        buckets, draw = len(self.slots), np.random.default_rng(17)
        for fingerprint, *pair in zip(*places(keys, buckets), strict=True):
            if not any(self._put(int(b), fingerprint) for b in pair):
                bucket = int(pair[0])
                for _ in range(MOST_MOVES):
                    slot = draw.integers(SLOTS)
                    fingerprint, self.slots[bucket, slot] = self.slots[bucket, slot], fingerprint
                    bucket = int(other_bucket(np.uint64(bucket), fingerprint, buckets))
                    if self._put(bucket, fingerprint):
                        break
                else:
                    return False
        return True

    def _put(self, bucket: int, fingerprint: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = fingerprint
        return bool(len(free))

    def delete(self, keys: np.ndarray) -> None:
        """Keys that are in the filter; one fingerprint goes for each."""
        for fingerprint, *pair in zip(*places(keys, len(self.slots)), strict=True):
            for bucket in map(int, pair):
                held = np.flatnonzero(self.slots[bucket] == fingerprint)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = places(keys, len(self.slots))
        return ((self.slots[first] == prints[:, None]) | (self.slots[second] == prints[:, None])).any(axis=1)


def matrix(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, KEY_BYTES)


def filter_row(shard: int, n_keys: int, held: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n_keys": [n_keys], "slots": [held.slots.astype("<u2").tobytes()]})


def new_filter(shard: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    return filter_row(int(shard[0]), len(keys), CuckooFilter.of(matrix(sorted(keys["key"]))))


def changed_filter(shard: tuple, crossed: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The filter of a shard after some of its keys became common or ceased to be. No row if it must be made anew."""
    up, down = crossed.loc[crossed["up"], "key"], crossed.loc[~crossed["up"], "key"]
    n_keys = (int(old["n_keys"].iloc[0]) if len(old) else 0) + len(up) - len(down)
    held = CuckooFilter.from_bytes(old["slots"].iloc[0], writable=True) if len(old) else CuckooFilter(n_keys)
    if len(down):
        held.delete(matrix(sorted(down)))
    if len(up) and not held.insert(matrix(sorted(up))):
        return filter_row(0, 0, held).iloc[:0]
    return filter_row(int(shard[0]), n_keys, held)


# The index


@dataclass
class LineIndex:
    """`refs` (shard, key, n) counts the documents of each key, `filters` (shard, n_keys, slots) has a cuckoo filter
    of the common keys of each shard that has any. Both are stored."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int


def empty_index(spark: SparkSession, min_docs: int = MIN_DOCS) -> LineIndex:
    return LineIndex(spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), 1, min_docs)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the documents (rows) of a table added. The old one stays valid."""
    return _changed(index, docs, 1)


def delete_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without the documents, as if they had never been inserted. Raises ValueError if a key would be
    counted less than never, as the documents were not in the index then."""
    return _changed(index, docs, -1)


def _changed(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    delta = document_counts(docs, index.shards).select("shard", "key", (sign * F.col("n")).alias("_change"))
    both = index.refs.join(delta, ["shard", "key"], "full_outer")
    before, change = F.coalesce("n", F.lit(0).cast("bigint")), F.coalesce("_change", F.lit(0).cast("bigint"))
    counted = stored(both.select("shard", "key", before.alias("before"), (before + change).alias("n")), "line-refs")
    if not counted.where("n < 0").isEmpty():
        raise ValueError("documents to delete are not in the index")
    refs = counted.where("n > 0").select("shard", "key", "n")
    common = counted.where(F.col("n") >= index.min_docs)
    shards = 1 << max(0, int(np.ceil(np.log2(max(common.count(), 1) / SHARD_KEYS))))
    if shards > index.shards:
        refs = stored(refs.withColumn("shard", shard_of(F.col("key"), shards)), "line-refs")
        filters = refs.where(F.col("n") >= index.min_docs).groupBy("shard").applyInPandas(new_filter, FILTERS)
        return replace(index, refs=refs, filters=stored(filters, "line-filters"), shards=shards)
    crossed = counted.where((F.col("before") >= index.min_docs) != (F.col("n") >= index.min_docs))
    crossed = stored(crossed.select("shard", "key", (F.col("n") >= index.min_docs).alias("up")), "line-crossed")
    touched = crossed.select("shard").distinct()
    old = index.filters.join(touched, "shard", "left_semi")
    changed = stored(crossed.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(changed_filter, FILTERS), "line-filters")
    spoilt = touched.join(changed, "shard", "left_anti")
    anew = common.select("shard", "key").join(spoilt, "shard", "left_semi").groupBy("shard").applyInPandas(new_filter, FILTERS)
    kept = index.filters.join(touched, "shard", "left_anti")
    filters = stored(kept.unionByName(changed).unionByName(anew).where("n_keys > 0"), "line-filters")
    forget(crossed, changed)
    return replace(index, refs=refs, filters=filters)


# Dropping lines


def positives(keys: np.ndarray, filters: dict[int, CuckooFilter], shards: int) -> np.ndarray:
    """Which of the hashed keys their shard's filter may hold."""
    shard = np.ascontiguousarray(keys[:, :4]).view(">u4")[:, 0] % shards
    found = np.zeros(len(keys), dtype=bool)
    for s in np.unique(shard):
        if int(s) in filters:
            at = np.flatnonzero(shard == s)
            found[at] = filters[int(s)].may_hold(keys[at])
    return found


def probe(shared, shards: int):
    """For an array of hashed keys (null: empty key) the array of whether each is in the filters and not among the
    keys known to be in them by mistake. `shared` is the broadcast (filter bytes by shard, mistaken keys)."""

    def hits(keys: pa.Array) -> pa.Array:
        slots, mistaken = shared.value
        flat = keys.flatten()
        given = flat.drop_null()
        rows = matrix(given.to_pylist())
        found = positives(rows, {s: CuckooFilter.from_bytes(data) for s, data in slots.items()}, shards)
        if mistaken:
            at = np.flatnonzero(found)
            found[at] = [rows[i].tobytes() not in mistaken for i in at]
        answer = np.zeros(len(flat), dtype=bool)
        answer[flat.is_valid().to_numpy(zero_copy_only=False)] = found
        ends = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(answer))

    return F.arrow_udf(hits, "array<boolean>")


def shard_stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys that a filter may hold, from rows sorted by shard and task with the filter first: one is held at a time."""
    place, held = None, None
    for frame in frames:
        for at, part in frame.groupby(["shard", "task"], sort=True):
            if at != place:
                place, held = at, None
            if part["slots"].notna().any():
                held = CuckooFilter.from_bytes(part["slots"].dropna().iloc[0])
            keys = part["key"].dropna()
            if held is not None and len(keys):
                yield pd.DataFrame({"key": keys[held.may_hold(matrix(keys))]})


def dedup_lines(docs: DataFrame, index: LineIndex, broadcast_bytes: int = BROADCAST_BYTES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All rows and columns, `text` without the lines whose key the index has in `min_docs` documents or more, and
    `n_lines` (before) and `n_dropped` (names with `_` before them where taken).

    A null or empty text is one empty line and becomes the empty text; empty keys never go. A text of which every
    line goes becomes empty. Every row of `docs` is a document of its own, whatever its doc_id. The documents need
    not be those of the index. An empty table or an empty index drops nothing.
    """
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    cut = lines(F.col("text"))
    keys = F.transform(cut, lambda line: hashed(line_key(line)))
    size = index.filters.agg(F.coalesce(F.sum(F.length("slots")), F.lit(0)).alias("n")).first()["n"]
    if size > broadcast_bytes:
        return _dedup_by_shard(docs, index, n_lines, n_dropped)
    sc = docs.sparkSession.sparkContext
    slots = {row["shard"]: bytes(row["slots"]) for row in index.filters.select("shard", "slots").collect()}
    hit = probe(sc.broadcast((slots, frozenset())), index.shards)
    probed = docs.select(keys.alias("_keys")).withColumn("_hit", hit("_keys")).where(F.exists("_hit", lambda found: found))
    marked = F.zip_with("_keys", "_hit", lambda key, found: F.when(found, key))
    found = probed.select(F.explode_outer(F.array_distinct(F.transform(marked, F.hex))).alias("key")).where("key IS NOT NULL").distinct()
    common = index.refs.where(F.col("n") >= index.min_docs).select("key")
    mistaken = stored(found.select(F.unhex("key").alias("key")).join(common, "key", "left_anti"), "line-mistaken")
    if mistaken.count() > broadcast_keys:
        return _dedup_by_shard(docs, index, n_lines, n_dropped)
    hit = probe(sc.broadcast((slots, frozenset(bytes(row["key"]) for row in mistaken.collect()))), index.shards)
    forget(mistaken)
    return _without(docs, hit(keys), n_lines, n_dropped)


def _without(docs: DataFrame, gone: Column, n_lines: str, n_dropped: str) -> DataFrame:
    """Drop the lines that are marked in the array `gone`."""
    mark = free_name(docs, "_gone")
    kept = F.array_join(F.zip_with(lines(F.col("text")), F.col(mark), lambda line, out: F.when(~out, line)), "\n")
    dropped = F.size(F.filter(F.col(mark), lambda out: out)).cast("bigint")
    return docs.withColumn(mark, gone).withColumns({n_lines: F.size(mark).cast("bigint"), n_dropped: dropped, "text": kept}).drop(mark)


def listed(keys: pa.Array, gone: pa.Array) -> pa.Array:
    """For each list of keys the list of whether `gone` (null: nothing) has them."""
    rows = zip(keys.to_pylist(), (frozenset(g or ()) for g in gone.to_pylist()), strict=True)
    return pa.array([[key in out for key in own] for own, out in rows], pa.list_(pa.bool_()))


def _dedup_by_shard(docs: DataFrame, index: LineIndex, n_lines: str, n_dropped: str) -> DataFrame:
    """The same where the filters are too large to send to every task: distinct keys go to their shard's filter, those
    it may hold to the counts, and common keys back to the texts that have them."""
    shards = index.shards
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    cut = lines(F.col("text"))
    keys = F.array_distinct(F.transform(cut, line_key))
    held = stored(docs.select(digest.alias("_digest"), F.explode(F.filter(keys, lambda k: k != "")).alias("_line")).distinct(), "line-texts")
    held = held.select("_digest", hashed(F.col("_line")).alias("key"))
    distinct = held.select("key").distinct().select(shard_of(F.col("key"), shards).alias("shard"), "key", F.lit(None).cast("binary").alias("slots"))
    distinct = distinct.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(SHARD_TASKS)))
    tasks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARD_TASKS - 1).cast("bigint"))).alias("task")
    filters = index.filters.select("shard", F.lit(None).cast("binary").alias("key"), "slots", tasks)
    rows = distinct.unionByName(filters).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("slots").isNull())
    maybe = rows.mapInPandas(shard_stream, "key binary")
    common = index.refs.where(F.col("n") >= index.min_docs).select("key")
    gone = stored(maybe.join(common, "key", "left_semi"), "line-gone")
    per_text = held.join(gone, "key", "left_semi").groupBy("_digest").agg(F.collect_set(F.hex("key")).alias("_gone"))
    per_text = stored(per_text, "line-per-text")
    gone, key_name = free_name(docs, "_dropped_keys"), free_name(docs, "_digest")
    texts = per_text.select(F.col("_digest").alias(key_name), F.col("_gone").alias(gone))
    joined = docs.withColumn(key_name, digest).join(texts, key_name, "left").drop(key_name)
    cut_keys = F.transform(cut, lambda line: F.hex(hashed(line_key(line))))
    return _without(joined, F.arrow_udf(listed, "array<boolean>")(cut_keys, F.col(gone)), n_lines, n_dropped).drop(gone)
