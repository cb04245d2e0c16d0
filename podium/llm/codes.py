"""Vector code compression: every part of a vector is replaced by the number of its nearest codebook entry.

Components become integers (floor of 256 times the value), vectors are cut into equal consecutive parts, and every
part position has a codebook of its own, so all distances and means are exact integers. The codebooks start as the
parts of the vectors with the smallest ids and are trained on all vectors by rounds of Lloyd's algorithm.

Active entries: a round stores the exact distance of every part to its entry. After the entries were replaced, a
part whose own entry stayed where it was can only be drawn away by an entry that moved, so it is compared with
the moved entries and the stored distance alone. A part whose entry moved is compared with all entries. Of
equally near entries the one with the lower number wins in either case.

The tables of vectors stay in Spark; what passes the driver is the codebooks, whose size the parameters fix, and
one count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.store import forget
from podium.llm.common import free_name, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Largest integer of a component, either way: a vector's squared distance then fits 64 bits up to 8,192 components.
LARGEST = 1 << 23
# Distances computed at once.
BLOCK = 1 << 21


def quantised(vector: Column) -> Column:
    """The integers of a vector; null for a null vector or one with null, non-finite or oversized components."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    fits = lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < LARGEST, F.lit(False))
    # NaN is larger than any number here, so that it does not fit either.
    return F.when(F.forall(vector, fits), whole)


def smallest(usable: DataFrame, n: int) -> list:
    """The integers of the n rows with the smallest `_key`, null last, equal ones by their integers.

    The n-th smallest of the minima of 4 n hash groups bounds the n-th smallest key from above, so about as many rows
    as are wanted reach the driver, however many tasks there are."""
    minima = usable.groupBy(F.pmod(F.xxhash64("_key"), F.lit(4 * n))).agg(F.min("_key").alias("_key"))
    bound = [r["_key"] for r in minima.where(F.col("_key").isNotNull()).orderBy("_key").limit(n).collect()]
    near = usable.where(F.col("_key") <= F.lit(bound[-1])) if len(bound) == n else usable
    return [r["_q"] for r in near.orderBy(F.col("_key").isNull(), "_key", "_q").select("_q").limit(n).collect()]


class Codebooks:
    """The entries of all part positions: an array (parts, entries, width), and which of them moved last."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.ones(entries.shape[:2], dtype=bool) if moved is None else moved

    def replaced(self, sums: pd.DataFrame) -> Codebooks:
        """Entries become the floor of the mean of their parts; unused ones stay."""
        entries = self.entries.copy()
        for row in sums.itertuples():
            entries[row.part, row.entry] = [int(s) // int(row.n) for s in row.sums]
        return Codebooks(entries, (entries != self.entries).any(axis=2))

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest entry of every point; the lower number of equals."""
    codes, best = np.empty(len(points), dtype=np.int64), np.empty(len(points), dtype=np.int64)
    step = max(1, BLOCK // max(1, entries.size))
    for at in range(0, len(points), step):
        apart = ((points[at : at + step, None, :] - entries[None]) ** 2).sum(axis=2)
        codes[at : at + step] = apart.argmin(axis=1)
        best[at : at + step] = apart.min(axis=1)
    return codes, best


def assigned(vectors: np.ndarray, books: Codebooks, codes: np.ndarray | None = None, apart: np.ndarray | None = None):
    """Codes and distances (vectors, parts) under the codebooks; `codes` and `apart` are those before the entries
    that `books.moved` marks were replaced, if there were any."""
    n, (parts, _, width) = len(vectors), books.entries.shape
    cut = vectors.reshape(n, parts, width)
    new_codes, new_apart = np.empty((n, parts), dtype=np.int64), np.empty((n, parts), dtype=np.int64)
    for p in range(parts):
        stayed = np.zeros(n, dtype=bool) if codes is None else ~books.moved[p][codes[:, p]]
        rescan, moved = np.flatnonzero(~stayed), np.flatnonzero(books.moved[p])
        new_codes[rescan, p], new_apart[rescan, p] = nearest(cut[rescan, p], books.entries[p])
        keep = np.flatnonzero(stayed)
        if len(keep):
            new_codes[keep, p], new_apart[keep, p] = codes[keep, p], apart[keep, p]
        if len(keep) and len(moved):
            other, near = nearest(cut[keep, p], books.entries[p][moved])
            other = moved[other]
            wins = (near < apart[keep, p]) | ((near == apart[keep, p]) & (other < codes[keep, p]))
            new_codes[keep[wins], p], new_apart[keep[wins], p] = other[wins], near[wins]
    return new_codes, new_apart


def _array(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()).cast(kind))


def assign(batches: Iterator[pa.RecordBatch], books: Codebooks, first: bool) -> Iterator[pa.RecordBatch]:
    """Fill `_codes` and `_apart` of every row; in the first round there are none yet."""
    parts, _, width = books.entries.shape
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = _array(batch.column("_q"), parts * width)
        before = (None, None) if first else (_array(batch.column("_codes"), parts), _array(batch.column("_apart"), parts))
        codes, apart = assigned(vectors, books, *before)
        filled = {"_codes": _lists(codes, pa.int16()), "_apart": _lists(apart, pa.int64())}
        yield pa.RecordBatch.from_arrays([filled.get(name, batch.column(name)) for name in batch.schema.names], names=batch.schema.names)


def part_sums(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Sums and counts of the parts by entry, one row for each entry that the task's rows use."""
    parts, entries, width = shape
    sums, counts = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            slots = (_array(batch.column("_codes"), parts) + np.arange(parts) * entries).ravel()
            cut = _array(batch.column("_q"), parts * width).reshape(-1, width)
            counts += np.bincount(slots, minlength=parts * entries)
            np.add.at(sums, slots, cut)
    used = np.flatnonzero(counts)
    if len(used):
        part, entry = np.divmod(used, entries)
        columns = [pa.array(part), pa.array(entry), pa.array(counts[used]), _lists(sums[used], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])


def totals(current: DataFrame, books: Codebooks) -> pd.DataFrame:
    """(part, entry, n, sums) over all vectors: as many rows as the codebooks have entries at most."""
    shape = books.entries.shape
    types = "part bigint, entry bigint, n bigint, sums array<bigint>"
    partial_sums = current.select("_q", "_codes").mapInArrow(partial(part_sums, shape=shape), types)
    at = partial_sums.select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
    summed = at.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    lists = summed.groupBy("part", "entry").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "x"))).alias("xs"))
    return lists.select("part", "entry", "n", F.col("xs.x").alias("sums")).toPandas()


def compress(
    rows: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks | None]:
    """The rows with a usable vector, without it but with `code` (entry of each part, two hex digits each) and
    `error` (squared distance to the entries, of integers), and the codebooks.

    Rows whose vector is null, or holds null, non-finite or oversized (32,768 and more) components are left out;
    so are vectors of zero length, of a length that is no multiple of `parts`, or of another length than the vector
    of the smallest id. The first entries are the vectors with the smallest ids; null ids come last, equal ids by
    their integers. With fewer vectors than entries there are as many entries as vectors. Rows of equal vectors all
    count. Without any usable vector there are no codebooks and no rows.
    """
    if entries > 256:
        raise ValueError("two hex digits hold at most 256 entries")
    code, error = free_name(rows, "code"), free_name(rows, "error")
    rest = [F.col(f"`{c}`") for c in rows.columns if c != vector]
    usable = rows.select(F.struct(*rest).alias("_row"), F.col(f"`{key}`").alias("_key"), quantised(F.col(f"`{vector}`")).alias("_q"))
    usable = stored(usable.where((F.size("_q") > 0) & (F.size("_q") % parts == 0)), "code-vectors")
    head = usable.agg(F.min(F.struct(F.col("_key").isNull(), "_key", "_q")).alias("_head")).first()["_head"]
    empty = {"_codes": F.lit(None).cast("array<smallint>"), "_apart": F.lit(None).cast("array<bigint>")}
    if head is None:
        return _decoded(usable.withColumns(empty), rows, vector, code, error), None
    current = usable.where(F.size("_q") == len(head["_q"])).withColumns(empty)
    spark = rows.sparkSession
    first = np.array(smallest(current, entries), dtype=np.int64)
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2)))
    for number in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)
        step = lambda batches, shared=shared, first=number == 0: assign(batches, shared.value, first)
        following = stored(current.mapInArrow(step, current.schema), "code-assigned")
        if number:
            forget(current)
        current = following
        if number < rounds:
            books = books.replaced(totals(current, books))
    forget(usable)
    return _decoded(current, rows, vector, code, error), books


def _decoded(current: DataFrame, rows: DataFrame, vector: str, code: str, error: str) -> DataFrame:
    hexed = F.array_join(F.transform("_codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    total = F.aggregate("_apart", F.lit(0).cast("bigint"), lambda a, x: a + x)
    names = [F.col("_row").getField(c).alias(c) for c in rows.columns if c != vector]
    return current.select(*names, hexed.alias(code), total.alias(error))


def with_label_errors(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """Add `label_error`: the errors of all rows with an equal label, nulls together. Errors are summed before the
    shuffle, and the sums are stored, so a label with a large share of the rows splits in the join."""
    name, key = free_name(coded, "label_error"), free_name(coded, "_label")
    sums = coded.groupBy(F.col(f"`{label}`").alias(key)).agg(F.sum(error).alias(name))
    sums = stored(sums, "code-labels")
    return coded.join(sums, F.col(f"`{label}`").eqNullSafe(F.col(key)), "left").drop(key)


def codebooks_sha256(books: Codebooks | None) -> str:
    """Digest of all integers of the entries by part, entry and place; of nothing without codebooks."""
    return hashlib.sha256((books.text() if books else "").encode()).hexdigest()
