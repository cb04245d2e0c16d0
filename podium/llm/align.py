"""Cross-tokenizer alignment: which tokens of one tokenizer stand where in the tokens of another.

Both tokenizers encode a text; where their tokens end at the same byte, the text is cut into groups. Inside a group
every token of A is linked with every token of B whose bytes overlap its own. How many documents link a pair of
ids is counted over the whole corpus, and every link is scored by the count of its pair.

Identity-map fast path: the B id with the same bytes as an A id is known beforehand. A pair of such ids needs no pair
key: it is counted in a vector as long as A's vocabulary. Only other pairs, which come from irregular groups, are
counted through a shuffle, added up by each task before.

Words are encoded once: neither tokenizer has a token that goes on over a single blank between two words (checked for
B when it is loaded), so texts are cut there, and the tokens of a piece are remembered by each worker process. The
alignments themselves are computed for all pieces of a batch together, on arrays of byte ends.

The texts are read and encoded once. What is stored of a document is its pairs of ids with their links, as sorted
numbers; the counts and then the scores are made from that.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.llm.common import free_name, stored
from podium.session import fresh_path

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Pieces of texts a worker remembers; longer ones than LONGEST_PIECE characters are not remembered.
REMEMBERED_PIECES = 250_000
LONGEST_PIECE = 64
# Characters of texts that are aligned together, and pairs a task holds before it hands them on.
BATCH_CHARS = 4_000_000
# Pieces that A encodes as one text.
JOINED_PIECES = 256
TASK_PAIRS = 2_000_000
# Counted pairs that are sent to every task; more are joined.
BROADCAST_PAIRS = 3_000_000

# A blank between two characters that are no white space.
CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others
    follow from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of all their ids, and the identity map, from the contents of their files."""

    def __init__(self, a_json: bytes, b_model: bytes):
        # A task has one core; the library would start threads on all of them.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        special = {t["id"]: t["content"].encode() for t in json.loads(a_json).get("added_tokens", [])}
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [
            special[i] if i in special else bytes(letters[c] for c in names[i]) for i in range(self.a.get_vocab_size(with_added_tokens=True))
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # Of B ids with equal bytes an ordinary piece is taken before a byte; control ids never.
        order = [i for i in range(len(pieces)) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        same = {self.b_bytes[i]: i for i in reversed(order)}
        same = {self.b_bytes[i]: i for i in range(len(pieces)) if self.b.is_byte(i)} | same
        self.identity = np.array([-1 if i in special else same.get(x, -1) for i, x in enumerate(self.a_bytes)], dtype=np.int64)
        # Can a piece of B go on over a blank? Then texts stay whole.
        self.cuts = not any(re.search(r"[^▁]▁", pieces[i]) for i in order)
        self.width = len(pieces)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # An id as text, inside its group and at the end of its side of the group.
        texts = lambda n, end: np.array([f"{i}{mark}" for mark in (",", end) for i in range(n)], dtype=object)
        self.a_texts, self.b_texts = texts(len(self.a_bytes), "|"), texts(len(pieces), ";")

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a blank; B adds that blank itself."""
        return self.whole_a(pieces), self.b.encode([p[1:] for p in pieces], num_threads=1)

    def whole_a(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_packed(self, pieces: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The same as bytes, for different texts."""
        return self.encode_a(pieces), packed(self.b.encode([p[1:] for p in pieces], num_threads=1))

    def encode_a(self, pieces: list[str]) -> list[bytes]:
        """Ids of A. Where texts are cut at blanks, pieces are joined at blanks again, whichever text they are from, so
        that many are one call; the tokens of a piece are those up to the byte where it ends."""
        joins = [p for p in pieces if len(p) > 1 and not (p[1].isspace() or p[-1].isspace())] if self.cuts else []
        parts = [joins[n : n + JOINED_PIECES] for n in range(0, len(joins), JOINED_PIECES)]
        ids = np.fromiter(chain.from_iterable(self.whole_a(["".join(x) for x in parts])), dtype=np.int64)
        ends = np.cumsum([len(p.encode()) for p in joins], dtype=np.int64)
        upto = np.cumsum(self.a_sizes[ids])
        last = np.searchsorted(upto, ends)
        # Should the bytes not be those of the pieces, these are encoded one by one.
        fits = len(upto) > 0 and upto[-1] == ends[-1] and bool((upto[last] == ends).all())
        done = dict(zip(joins, cut_up(ids.astype(np.uint32).tobytes(), last + 1), strict=True)) if fits else {}
        left = [p for p in pieces if p not in done]
        done.update(zip(left, packed(self.whole_a(left)), strict=True))
        return [done[p] for p in pieces]


def cut_up(raw: bytes, ends: np.ndarray) -> list[bytes]:
    """Packed ids, cut after the given numbers of them."""
    ends = (4 * ends).tolist()
    return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def packed(lists: list[list[int]]) -> list[bytes]:
    """Lists of ids as bytes."""
    ends = np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
    return cut_up(array("I", chain.from_iterable(lists)).tobytes(), ends)


class Aligned:
    """Alignments of a list of pieces: `counts` (tokens of A, of B, groups, links), `texts` of the groups, None where
    the tokens' bytes are not the piece's, and the codes of linked pairs, those of piece n at starts[n] : starts[n + 1]."""

    def __init__(self, t: Tokenizers, pieces: list[str], a: list[bytes], b: list[bytes]):
        whole = [p.encode() for p in pieces]
        size = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        n_a, n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(whole)) // 4 for x in (a, b))
        a_ids, b_ids = (np.frombuffer(b"".join(x), dtype=np.uint32).astype(np.int64) for x in (a, b))
        good = self.equal(whole, size, n_a, a_ids, t.a_bytes, t.a_sizes) & self.equal(whole, size, n_b, b_ids, t.b_bytes, t.b_sizes)
        a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
        a_ends, b_ends = np.cumsum(t.a_sizes[a_ids]), np.cumsum(t.b_sizes[b_ids])
        limits = np.concatenate([[0], np.cumsum(np.where(good, size, 0))])
        # Marks at the bytes where tokens end, counted up.
        in_a, in_b = np.zeros(limits[-1] + 1, dtype=bool), np.zeros(limits[-1] + 1, dtype=bool)
        in_a[a_ends], in_b[b_ends] = True, True
        upto_a, upto_b, upto_group, upto_link = (np.cumsum(x) for x in (in_a, in_b, in_a & in_b, in_a | in_b))
        # Every end of either begins a new pair: the tokens whose bytes come next.
        ends = np.flatnonzero(in_a | in_b)
        self.codes = a_ids[upto_a[ends] - in_a[ends]] * t.width + b_ids[upto_b[ends] - in_b[ends]]
        self.counts = np.stack([np.diff(x[limits]) for x in (upto_a, upto_b, upto_group, upto_link)], axis=1)
        self.starts = upto_link[limits]
        # The tokens as text, A's of a group before B's.
        groups = np.flatnonzero(in_a & in_b)
        own_a, own_b = upto_group[a_ends] - in_b[a_ends], upto_group[b_ends] - in_a[b_ends]
        words = np.empty(len(a_ids) + len(b_ids), dtype=object)
        before = np.concatenate([[0], upto_b[groups]])
        words[np.arange(len(a_ids)) + before[own_a]] = t.a_texts[a_ids + len(t.a_bytes) * in_b[a_ends]]
        words[np.arange(len(b_ids)) + upto_a[groups][own_b]] = t.b_texts[b_ids + t.width * in_a[b_ends]]
        words, at = words.tolist(), (upto_a + upto_b)[limits].tolist()
        self.texts = ["".join(words[s:e])[:-1] if ok else None for s, e, ok in zip(at[:-1], at[1:], good.tolist(), strict=True)]

    @staticmethod
    def equal(whole: list[bytes], size: np.ndarray, n: np.ndarray, ids: np.ndarray, table: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes are those of the piece, which has `size` bytes."""
        limits = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(n)])]
        good = np.diff(limits) == size
        ids = ids[np.repeat(good, n)]
        joined = np.frombuffer(b"".join([table[i] for i in ids.tolist()]), dtype=np.uint8)
        wanted = np.frombuffer(b"".join([x for x, ok in zip(whole, good.tolist(), strict=True) if ok]), dtype=np.uint8)
        wrong = np.flatnonzero(joined != wanted)
        at = np.flatnonzero(good)
        good[at[np.searchsorted(np.cumsum(size[at]), wrong, side="right")]] = False
        return good


class Alignments:
    """Aligns texts, and remembers the tokens of short pieces."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.tokens: dict[str, tuple[bytes, bytes]] = {}

    def encoded(self, pieces: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of different pieces, as bytes."""
        new = [p for p in pieces if p not in self.tokens]
        made = dict(zip(new, zip(*self.tokenizers.encode_packed(new), strict=True), strict=True))
        both = [made[p] if p in made else self.tokens[p] for p in pieces]
        if len(self.tokens) + len(made) > REMEMBERED_PIECES:
            self.tokens = {}
        self.tokens.update((p, x) for p, x in made.items() if len(p) <= LONGEST_PIECE)
        return [x for x, _ in both], [x for _, x in both]

    def pieces_of(self, text: str | None) -> list[str]:
        if not text:
            return []
        return CUT.split(" " + text) if self.tokenizers.cuts else [" " + text]

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of every text its four counts and its groups; then, sorted by text and pair: number of the text, pair code
        and links of every different pair. Texts without tokens have zeros, no groups and no pairs."""
        cut = [self.pieces_of(t) for t in texts]
        numbers = dict(zip(dict.fromkeys(chain.from_iterable(cut)), count()))
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
        aligned = Aligned(self.tokenizers, list(numbers), *self.encoded(list(numbers)))
        # Texts with a piece that is not given back have no pieces.
        bad = np.fromiter((text is None for text in aligned.texts), dtype=bool, count=len(numbers))
        lost = np.bincount(np.repeat(np.arange(len(cut)), sizes), weights=bad[flat], minlength=len(cut)) > 0
        flat, sizes = flat[np.repeat(~lost, sizes)], np.where(lost, 0, sizes)
        ends = np.cumsum(sizes).tolist()
        words = list(map(aligned.texts.__getitem__, flat.tolist()))
        groups = [";".join(words[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        owner = np.repeat(np.arange(len(cut)), sizes)
        counts = np.stack([np.bincount(owner, weights=x, minlength=len(cut)) for x in aligned.counts[flat].T], axis=1).astype(np.int64)
        # Pieces of a text that are the same count once with a weight, then their pairs.
        both, times = np.unique(owner * max(1, len(numbers)) + flat, return_counts=True)
        of_text, of_piece = np.divmod(both, max(1, len(numbers)))
        n_pairs = np.diff(aligned.starts)[of_piece]
        within = np.arange(int(n_pairs.sum())) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs)
        codes = aligned.codes[np.repeat(aligned.starts[of_piece], n_pairs) + within]
        span = len(self.tokenizers.a_bytes) * self.tokenizers.width
        keys = np.repeat(of_text, n_pairs) * span + codes
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], np.repeat(times, n_pairs)[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
        links = np.add.reduceat(links, first) if len(keys) else links
        return counts, groups, *np.divmod(keys[first], span), links


_loaded: dict[bytes, Alignments] = {}


def alignments(files: tuple[bytes, bytes]) -> Alignments:
    """One for each worker process and pair of tokenizers."""
    key = hashlib.sha256(b"".join(files)).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Alignments(Tokenizers(*files))
    return _loaded[key]


def text_batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BATCH_CHARS characters of text, one row at least."""
    start, chars = 0, 0
    for n, text in enumerate(texts):
        chars += len(text or "")
        if chars >= BATCH_CHARS:
            yield start, n + 1
            start, chars = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SCORES = ("n_best", "count_sum")


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values).cast(kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the row, and value, of all items of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def align(batches: Iterator[pa.RecordBatch], files, names: list[str], digests: bool) -> Iterator[pa.RecordBatch]:
    """Replace the text by its counts, its groups, and steps between its sorted pair codes with their links."""
    made = alignments(files.value)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start, end in text_batches(texts):
            counts, groups, owner, codes, links = made.documents(texts[start:end])
            if digests:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            steps = np.diff(codes, prepend=0)
            at = np.flatnonzero(np.diff(owner, prepend=-1))
            steps[at] = codes[at]
            columns = [*(pa.array(np.ascontiguousarray(x)) for x in counts.T), pa.array(groups, pa.string())]
            columns += [_lists(owner, end - start, steps, pa.int64()), _lists(owner, end - start, links, pa.int32())]
            own = batch.slice(start, end - start)
            kept = [x for x in own.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([own.column(x) for x in kept] + columns, names=kept + names)


def unpacked(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row, pair code and links of all pairs of a batch."""
    owner, steps = _flat(batch.column(names[0]))
    _, links = _flat(batch.column(names[1]))
    codes = np.cumsum(steps)
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    codes -= np.repeat(codes[at] - steps[at], np.diff(at, append=len(owner)))
    return owner, codes, links


def count_pairs(batches: Iterator[pa.RecordBatch], identity: np.ndarray, width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(identity, code, n): documents by pair of ids, added up over the task. The code of an identity pair is A's id
    alone; those are counted in a vector and come once a task."""
    vector = np.zeros(len(identity), dtype=np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def row(regular: bool, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), regular)), pa.array(codes), pa.array(n)], names=["identity", "code", "n"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        _, codes, _ = unpacked(batch, names)
        a = codes // width
        regular = identity[a] == codes % width
        vector += np.bincount(a[regular], minlength=len(vector))
        held.append(np.unique(codes[~regular], return_counts=True))
        if sum(len(c) for c, _ in held) > TASK_PAIRS:
            held = [merged()]
            if len(held[0][0]) > TASK_PAIRS // 2:
                yield row(False, *held.pop())
    if held:
        yield row(False, *merged())
    yield row(True, np.flatnonzero(vector), vector[np.flatnonzero(vector)])


class Counts:
    """What scores a link: the counts of identity pairs and the best count of each A id, as vectors, and those of
    other pairs as sorted codes, if they are few enough to be held."""

    def __init__(self, regular: np.ndarray, best: np.ndarray, codes: np.ndarray | None, n: np.ndarray | None):
        self.regular, self.best, self.codes, self.n = regular, best, codes, n


def pair_counts(aligned: DataFrame, identity: np.ndarray, width: int, names: list[str], broadcast_pairs: int) -> tuple[Counts, DataFrame]:
    """The counts, and the table (code, n) of the pairs that are no identity pairs, stored."""
    counting = partial(count_pairs, identity=identity, width=width, names=names)
    counted = aligned.select(*names).mapInArrow(counting, "identity boolean, code bigint, n bigint")
    counted = stored(counted.groupBy("identity", "code").agg(F.sum("n").alias("n")), "align-counts")
    irregular = counted.where("NOT identity").select("code", "n")
    # As long as A's vocabulary at most, so small whatever the corpus.
    rows = counted.where("identity").select("code", "n").toPandas()
    tops = irregular.groupBy(F.floor(F.col("code") / width).alias("a")).agg(F.max("n").alias("n")).toPandas()
    regular, best = np.zeros(len(identity), dtype=np.int64), np.zeros(len(identity), dtype=np.int64)
    regular[rows["code"].to_numpy(dtype=np.int64)] = rows["n"]
    best[tops["a"].to_numpy(dtype=np.int64)] = tops["n"]
    best = np.maximum(best, regular)
    if irregular.count() > broadcast_pairs:
        return Counts(regular, best, None, None), irregular
    pairs = irregular.toPandas().sort_values("code")
    return Counts(regular, best, pairs["code"].to_numpy(dtype=np.int64), pairs["n"].to_numpy(dtype=np.int64)), irregular


def score(batches: Iterator[pa.RecordBatch], counts, identity: np.ndarray, width: int, names: list[str], drop: list[str]) -> Iterator[pa.RecordBatch]:
    """Add the scores of documents. Pairs that the counts do not hold are left out."""
    c = counts.value
    for batch in batches:
        owner, codes, links = unpacked(batch, drop)
        a = codes // width
        regular = identity[a] == codes % width
        n = np.where(regular, c.regular[a], 0)
        if c.codes is not None:
            n[~regular] = c.n[np.searchsorted(c.codes, codes[~regular])] if len(c.codes) else 0
        known = regular | (c.codes is not None)
        best, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
        np.add.at(best, owner, np.where(known & (n == c.best[a]), links, 0))
        np.add.at(total, owner, np.where(known, n * links, 0))
        kept = [x for x in batch.schema.names if x not in drop]
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in kept] + [pa.array(best), pa.array(total)], names=kept + names)


def open_pairs(batches: Iterator[pa.RecordBatch], row: str, identity: np.ndarray, width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(row, code, links) of the pairs that are no identity pairs."""
    for batch in batches:
        owner, codes, links = unpacked(batch, names)
        at = np.flatnonzero(identity[codes // width] != codes % width)
        rows = batch.column(row).to_numpy(zero_copy_only=False)[owner[at]]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(codes[at]), pa.array(links[at])], names=["row", "code", "links"])


def read_files(folder: str, a_file: str = A_FILE, b_file: str = B_FILE) -> tuple[bytes, bytes]:
    """The tokenizers' files, from a folder the driver sees; their contents go to the executors."""
    contents = []
    for name in (a_file, b_file):
        with open(f"{folder}/{name}", "rb") as file:
            contents.append(file.read())
    return contents[0], contents[1]


def align_documents(docs: DataFrame, folder: str = TOKENIZERS, digests: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """All rows, and all columns but `text`, with n_a, n_b (tokens), n_groups, n_links, `groups` (ids as
    `a1,a2|b1;a3|b2,b3`; with `digests` their SHA-256 in hex, which takes less room between the passes), n_best (links
    whose pair has the highest count that its A id has with any B id, ties included) and count_sum (of the links'
    counts). Taken names get `_` before them.

    Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens: zeros,
    an empty `groups`, and no part in the counts. Every row is a document of its own: repeated rows count as often as
    they stand. An empty table gives no rows. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    contents = read_files(folder)
    files = spark.sparkContext.broadcast(contents)
    known = Tokenizers(*contents)
    identity, width = known.identity, known.width
    names, scores, lists = ([free_name(docs, x) for x in some] for some in ((*COUNTS, "groups"), SCORES, ("_steps", "_links")))
    row = free_name(docs, "_row")
    fields = [f for f in docs.schema.fields if f.name != "text"]
    fields += [*[T.StructField(x, T.LongType()) for x in names[:-1]], T.StructField(names[-1], T.StringType())]
    held = [T.StructField(lists[0], T.ArrayType(T.LongType())), T.StructField(lists[1], T.ArrayType(T.IntegerType()))]
    aligning = partial(align, files=files, names=[*names, *lists], digests=digests)
    aligned = docs.mapInArrow(aligning, T.StructType(fields + held)).withColumn(row, F.monotonically_increasing_id())
    path = fresh_path(spark, "align-rows")
    aligned.write.option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(aligned.schema).parquet(path)
    counts, irregular = pair_counts(aligned, identity, width, lists, broadcast_pairs)
    shared = spark.sparkContext.broadcast(counts)
    result = T.StructType([*fields, T.StructField(row, T.LongType()), *[T.StructField(x, T.LongType()) for x in scores]])
    scoring = partial(score, counts=shared, identity=identity, width=width, names=scores, drop=lists)
    scored = aligned.mapInArrow(scoring, result)
    if counts.codes is None:
        listing = partial(open_pairs, row=row, identity=identity, width=width, names=lists)
        listed = aligned.select(row, *lists).mapInArrow(listing, "row bigint, code bigint, links bigint")
        scored = _joined(scored, listed, irregular, counts, row, scores, width)
    return scored.drop(row)


def _joined(scored: DataFrame, listed: DataFrame, irregular: DataFrame, counts: Counts, row: str, scores: list[str], width: int) -> DataFrame:
    """Add the scores of listed pairs (row, code, links) by a join with their counts, both stored, so that a pair many
    documents have splits. The pairs of a document are added up after it."""
    best = scored.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(counts.best)], "a bigint, best bigint")
    ranked = irregular.withColumn("a", F.floor(F.col("code") / width)).join(best, "a")
    ranked = stored(ranked.select("code", "n", (F.col("n") == F.col("best")).alias("top")), "align-ranked")
    met = stored(listed, "align-listed").join(ranked, "code")
    summed = met.groupBy(F.col("row").alias(row)).agg(F.sum(F.when(F.col("top"), F.col("links")).otherwise(0)).alias("_best"), F.sum(F.col("links") * F.col("n")).alias("_sum"))
    more = {c: F.col(c) + F.coalesce(part, F.lit(0)) for c, part in zip(scores, ("_best", "_sum"), strict=True)}
    return scored.join(summed, row, "left").withColumns(more).drop("_best", "_sum")
