"""SimHash near-duplicates: fingerprints linked within a Hamming distance through vantage-point trees.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's word shingles. Equal
fingerprints are one point, so copies never meet in pairs. Points are dealt into shards by vantage-point trees:
a node has a vantage point v and a radius m; points with d(v, p) <= m + r go left, points with d(v, p) > m go
right, where r is the reach of the search. By the triangle inequality a pair within r meets on the left or on
the right, and only points at the boundary are in both. The distance of a node counts the bits of one band: of
b bands at least one differs in at most floor(k / b) of the k bits allowed, so there is a tree for every band,
of reach 1 or 0, which overlaps little. Within a shard the same splitting goes on in memory until a few hundred
points are left, which are compared bit by bit over all 64 bits.

The trees are fitted on a bounded sample of the points (TREE_SAMPLE); every point goes through them, so no pair
is lost. A shard gives a spanning forest of its links, never all pairs; components are then found by contraction
in Spark. A shard holds eight bytes a point; a dense ball that no radius can split has few different points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.graph import components
from podium.functions.store import forget
from podium.llm.common import stored

SEED = 42
# Shingles hashed at a time, so that a very long text takes little memory.
CHUNK = 1 << 15
TREE_SAMPLE = 16_384
# Points a shard should have, and the most shards of a band's tree (each still has a share of the sample).
SHARD_POINTS, MAX_SHARDS = 8_192, 2_048
# Points compared all with all in memory.
LEAF_POINTS = 256
VANTAGE_TRIES = 6
# The stage on near-duplicates: five-word shingles, similarity, and the bits by which its fingerprints find candidates.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_BITS = 5, 0.8, 6
# Texts held in memory while the others of their component stream by.
BLOCK_TEXTS = 512
# Texts that frequent shingles are counted on, from how many of them on a shingle is frequent, and the most such shingles.
# They come last in the order of the prefixes: any order finds the same pairs, this one in less time.
ORDER_TEXTS, ORDER_COUNT, ORDER_SHINGLES = 8_192, 8, 65_536
# Texts whose shingles a task holds at once.
SIGN_TEXTS = 256
# Places of a sketch, and those that must agree before two texts are compared.
SKETCH, SKETCH_AGREE = 64, 32
SKETCH_FACTORS = np.random.default_rng(17).integers(1 << 40, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)


# Fingerprints


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white space characters."""
    return (text or b"").lower().split()


def shingles_of(words: list[bytes], size: int) -> Iterator[bytes]:
    """All runs of `size` words, joined by blanks; of fewer words the whole sequence; none of none."""
    if len(words) < size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))


def fingerprint_of(text: bytes | None, size: int, distinct: bool = False) -> int:
    """The fingerprint as a signed 64-bit number; 0 of a text without words."""
    words = words_of(text)
    shingles = shingles_of(sorted(set(words)) if distinct else words, size)
    ones, total = np.zeros(64, dtype=np.int64), 0
    while True:
        chunk = np.fromiter(islice(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), CHUNK), dtype=np.uint64)
        if not len(chunk):
            break
        ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(chunk)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0]) if total else 0


def fingerprint(text: Column, size: int, distinct: bool = False) -> Column:
    """Column of fingerprints of a text column (null: no words)."""

    @F.pandas_udf("bigint")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size, distinct) for t in texts], dtype="int64")

    return column(text.cast("binary"))


# Vantage-point trees


def bands(bits: int) -> list[tuple[int, int]]:
    """(mask, reach) of every band: as many equal bands as leave a reach of at most 1."""
    n = max(1, (bits + 2) // 2)
    edges = [64 * i // n for i in range(n + 1)]
    return [(((1 << (b - a)) - 1) << a, bits // n) for a, b in zip(edges, edges[1:], strict=False)]


def distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask))


def best_split(points: np.ndarray, mask: int, reach: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """(vantage, radius) that leaves the least work on both sides, or None if no split saves a tenth of it."""
    n, best, least = len(points), None, 0.9 * len(points) ** 2
    for vantage in points[rng.integers(0, n, VANTAGE_TRIES)]:
        within = np.cumsum(np.bincount(distance(points, vantage, mask), minlength=66 + reach))
        for radius in range(64):
            left, right = int(within[min(radius + reach, len(within) - 1)]), n - int(within[radius])
            if left < n and right < n and left**2 + right**2 < least:
                best, least = (int(vantage), radius), left**2 + right**2
    return best


def grow(points: np.ndarray, metrics: list[tuple[int, int]], most: int, rng: np.random.Generator):
    """A nested tree (mask, reach, vantage, radius, left, right) with None for a shard. The metrics are tried in turn."""
    if len(points) <= most:
        return None
    for i, (mask, reach) in enumerate(metrics):
        if found := best_split(points, mask, reach, rng):
            vantage, radius = found
            d = distance(points, vantage, mask)
            rest = metrics[i:]
            left, right = grow(points[d <= radius + reach], rest, most, rng), grow(points[d > radius], rest, most, rng)
            return mask, reach, vantage, radius, left, right
    return None


def route(tree, points: np.ndarray, at: np.ndarray, path: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its points). A shard's number is its path from the root, left 0 and right 1, after a leading 1."""
    if tree is None:
        yield path, at
        return
    mask, reach, vantage, radius, left, right = tree
    d = distance(points[at], vantage, mask)
    yield from route(left, points, at[d <= radius + reach], 2 * path)
    yield from route(right, points, at[d > radius], 2 * path + 1)


class Forest:
    """Union-find over the points of one shard."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def join_block(points: np.ndarray, at: np.ndarray, bits: int, forest: Forest) -> None:
    """Link a few points, all compared with all."""
    near = np.bitwise_count(points[at][:, None] ^ points[at][None, :]) <= bits
    linked = np.flatnonzero(near.sum(axis=1) > 1)
    if len(linked):
        near, at = near[np.ix_(linked, linked)], at[linked]
        label = np.arange(len(at))
        while True:
            lower = np.where(near, label[None, :], len(at)).min(axis=1)
            if (lower == label).all():
                break
            label = lower
        for i in np.flatnonzero(label != np.arange(len(at))):
            forest.union(int(at[i]), int(at[label[i]]))


def absorb(points: np.ndarray, at: np.ndarray, bits: int, forest: Forest) -> None:
    """Link points that no radius splits: those found leave the search, so a dense ball costs a few passes."""
    while len(at):
        seed, at, front = int(at[0]), at[1:], [int(at[0])]
        while front and len(at):
            near = np.bitwise_count(points[at] ^ points[front.pop()]) <= bits
            for hit in at[near]:
                forest.union(seed, int(hit))
            front.extend(map(int, at[near]))
            at = at[~near]


def link_points(points: np.ndarray, mask: int, reach: int, bits: int) -> np.ndarray:
    """For every point the place of the smallest point it is linked to within this shard, over links of up to `bits`."""
    forest, rng = Forest(len(points)), np.random.default_rng(0)
    todo = [(np.arange(len(points)), [(mask, reach), ((1 << 64) - 1, bits)])]
    while todo:
        at, metrics = todo.pop()
        if len(at) <= LEAF_POINTS:
            join_block(points, at, bits, forest)
            continue
        for i, (m, r) in enumerate(metrics):
            if found := best_split(points[at], m, r, rng):
                d = distance(points[at], found[0], m)
                todo += [(at[d <= found[1] + r], metrics[i:]), (at[d > found[1]], metrics[i:])]
                break
        else:
            absorb(points, at, bits, forest)
    return np.array([forest.root(i) for i in range(len(points))], dtype=np.int64)


def link_shard(frame: pd.DataFrame, metrics: list[tuple[int, int]], bits: int) -> pd.DataFrame:
    """The spanning links (a, b) of one shard of one band."""
    points = np.sort(frame["fp"].to_numpy()).view(np.uint64)
    mask, reach = metrics[int(frame["band"].iloc[0])]
    root = link_points(points, mask, reach, bits)
    linked = np.flatnonzero(root != np.arange(len(points)))
    return pd.DataFrame({"a": points[linked].view(np.int64), "b": points[root[linked]].view(np.int64)})


def deal(frames: Iterator[pd.DataFrame], trees: list) -> Iterator[pd.DataFrame]:
    """Every point into the shards of every band's tree."""
    for frame in frames:
        points = frame["fp"].to_numpy().view(np.uint64)
        for band, tree in enumerate(trees):
            for shard, at in route(tree, points, np.arange(len(points)), 1):
                if len(at):
                    yield pd.DataFrame({"band": band, "shard": shard, "fp": points[at].view(np.int64)})


def links(points: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect the same points as all pairs within `bits` do. `points` is stored, distinct `fp`."""
    n = points.count()
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy().view(np.uint64)
    metrics = bands(bits)
    shards = max(1, min(MAX_SHARDS, n // SHARD_POINTS))
    most, rng = max(4, len(sample) // shards), np.random.default_rng(0)
    trees = [grow(sample, [metric, ((1 << 64) - 1, bits)], most, rng) for metric in metrics]
    dealt = points.mapInPandas(partial(deal, trees=trees), "band int, shard bigint, fp bigint")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        return link_shard(frame, metrics, bits)

    return dealt.groupBy("band", "shard").applyInPandas(link, "a bigint, b bigint")


# Operators


def near_components(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`: fingerprints of `size`-word shingles, linked at `bits`.

    A null or empty text has fingerprint zero and is linked like any other. component_id is the smallest doc_id
    of the component; null ids are passed over, and a component of null ids alone has a null one. Rows of equal
    ids are kept. Other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp")), "simhash-rows")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-points")
    labels = components(links(points.select("fp"), bits))
    rooted = points.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "simhash-components")
    by_point = stored(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-membership")
    return rows.join(by_point, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def similarity(a: frozenset, b: frozenset) -> float:
    """Jaccard similarity; two texts without words are equal."""
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingle_set(text: bytes | None, size: int) -> frozenset:
    return frozenset(map(xxhash.xxh64_intdigest, shingles_of(words_of(text), size)))


def similarity_column(a: Column, b: Column, size: int) -> Column:
    """Similarity of two texts by their `size`-word shingles."""

    @F.pandas_udf("double")
    def column(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similarity(shingle_set(x, size), shingle_set(y, size)) for x, y in zip(left, right, strict=True)], dtype="float64")

    return column(a.cast("binary"), b.cast("binary"))


def link_texts(frames: Iterator[pd.DataFrame], size: int, least: float, bits: int) -> Iterator[pd.DataFrame]:
    """Links between similar texts of a component. Rows come by (component, block), the block's own texts first;
    these stay in memory, the other texts of the component pass by once."""
    key, held, sets, fps, forest = None, [], [], np.zeros(0, np.uint64), Forest(0)
    for frame in frames:
        out: list[tuple[int, int]] = []
        for component, block, own, tid, fp, text in frame[["component", "block", "own", "tid", "fp", "text"]].itertuples(index=False):
            if (component, block) != key:
                key, held, sets, fps, forest = (component, block), [], [], np.zeros(0, np.uint64), Forest(0)
            mine = shingle_set(text, size)
            point = np.array([fp], dtype=np.int64).view(np.uint64)
            met: int | None = None
            for i in np.flatnonzero(np.bitwise_count(fps ^ point) <= bits) if len(fps) else ():
                # A text in a tree that this one has met already would give no new connection.
                if held[i] == tid or met is not None and forest.root(int(i)) == forest.root(met):
                    continue
                if similarity(mine, sets[i]) >= least:
                    out.append((tid, held[i]))
                    if met is None:
                        met = int(i)
                    forest.union(met, int(i))
            if own == 0:
                held, sets, fps = [*held, tid], [*sets, mine], np.append(fps, point)
                forest.parent = np.append(forest.parent, len(forest.parent))
                if met is not None:
                    forest.union(met, len(held) - 1)
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def near_duplicate_texts(texts: DataFrame, docs: DataFrame, size: int, least: float, bits: int) -> DataFrame:
    """Links (a, b) of text numbers `tid` whose five-word similarity is at least `least`.

    Fingerprint components give the candidates: every text is compared with the first text of its component,
    and those unlike it with all texts of the component whose fingerprint is near, in blocks.
    """
    points = stored(texts.select("fp").distinct(), "near-points")
    labels = components(links(points, bits))
    rooted = texts.join(labels, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("root", "fp")).drop("node", "root")
    rooted = stored(rooted, "near-rooted")
    firsts = rooted.groupBy("component").agg(F.count("*").alias("_n"), F.min(F.struct("first_doc", "tid")).alias("_first"))
    firsts = stored(firsts.where("_n > 1").select("component", F.col("_first.tid").alias("leader")), "near-leaders")
    members = rooted.join(firsts, "component")
    full = docs.select(F.col("doc_id").alias("first_doc"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    members = stored(members.join(full, ["first_doc", "key"]).dropDuplicates(["tid"]).select("component", "leader", "tid", "fp", "text"), "near-members")
    heads = members.where(F.col("tid") == F.col("leader")).select("component", F.col("text").alias("_head"))
    like = similarity_column(F.col("text"), F.col("_head"), size) >= least
    starred = members.where(F.col("tid") != F.col("leader")).join(heads, "component").select("component", "tid", "leader", like.alias("like"))
    starred = stored(starred, "near-stars")
    apart = starred.where(~F.col("like")).select("component", "tid")
    n_blocks = F.ceil(F.count("*") / BLOCK_TEXTS).cast("int")
    blocks = stored(apart.groupBy("component").agg(n_blocks.alias("_blocks")), "near-blocks")
    spread = members.join(blocks, "component")
    own = spread.join(apart.select("tid"), "tid", "left_semi").withColumn("block", F.pmod(F.xxhash64("tid"), F.col("_blocks")).cast("int"))
    passing = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = own.withColumn("own", F.lit(0)).unionByName(passing.withColumn("own", F.lit(1)))
    rows = rows.select("component", "block", "own", "tid", "fp", "text").repartition("component", "block").sortWithinPartitions("component", "block", "own", "tid")
    found = rows.mapInPandas(partial(link_texts, size=size, least=least, bits=bits), "a bigint, b bigint")
    near = stored(starred.where("like").select(F.col("tid").alias("a"), F.col("leader").alias("b")).unionByName(found), "near-links")
    forget(points, rooted, firsts, members, starred, blocks)
    return near


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


# Exact candidates


def digests(text: bytes | None, size: int) -> np.ndarray:
    """The hashes of a text's different shingles, sorted."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles_of(words_of(text), size)), dtype=np.uint64))


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in the order (frequent, hash): two texts that are `least` similar share one of their prefixes."""
    late = np.isin(shingles, frequent)
    kept = len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1 if len(shingles) else 0
    return np.concatenate([shingles[~late], shingles[late]])[:kept]


def parities(shingles: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the shingles that fall on it. Those of two sets differ in no more bits than the
    sets have shingles that are not in both."""
    bit = (shingles >> np.uint64(55)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=512) & 1).astype(np.uint8)).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest shingle under each of SKETCH fixed orders. Two sets agree in a place with the probability of their
    similarity. Zeros for no shingles."""
    if not len(shingles):
        return np.zeros(SKETCH, dtype=np.int32)
    least = np.empty(SKETCH, dtype=np.uint64)
    for n, factor in enumerate(SKETCH_FACTORS):
        least[n] = (((shingles ^ (factor >> np.uint64(7))) * factor) >> np.uint64(16)).min()
    return least.astype(np.uint32).view(np.int32)


def frequent_shingles(docs: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """The shingles of many texts, by a bounded sample."""
    share = min(1.0, ORDER_TEXTS / max(n_docs, 1))
    sample = docs.where(F.pmod(F.xxhash64(text_key(F.col("text"))), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"]:
                yield pd.DataFrame({"hash": digests(text, size).view(np.int64)})

    counts = sample.select(F.col("text").cast("binary").alias("text")).mapInPandas(hashes, "hash bigint").groupBy("hash").agg(F.count("*").alias("n"))
    most = counts.where(F.col("n") >= ORDER_COUNT).orderBy(F.desc("n"), "hash").limit(ORDER_SHINGLES).toPandas()
    return np.sort(most["hash"].to_numpy(dtype=np.int64).view(np.uint64))


def similar_pairs(pairs: DataFrame, signs: DataFrame, texts: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of text numbers whose texts are similar, stored.

    Sketches go with the pairs, texts only with those whose sketches agree in SKETCH_AGREE places: of 64 places a pair
    of similarity 0.8 has fewer than half with a probability below 10^-7."""
    one = signs.select(F.col("tid").alias("a"), F.col("sketch").alias("_sa"))
    other = signs.select(F.col("tid").alias("b"), F.col("sketch").alias("_sb"))
    agree = F.size(F.filter(F.zip_with("_sa", "_sb", lambda x, y: x == y), lambda same: same)) >= SKETCH_AGREE
    likely = stored(pairs.join(one, "a").join(other, "b").where(agree).select("a", "b"), "near-likely")
    wanted = stored(likely.select(F.explode(F.array("a", "b")).alias("tid")).distinct().join(texts, "tid").select("tid", "first_doc", "key"), "near-wanted")
    full = docs.select(F.col("doc_id").alias("first_doc"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    full = stored(wanted.join(full, ["first_doc", "key"]).dropDuplicates(["tid"]).select("tid", "text"), "near-wanted-texts")
    both = likely.join(full.select(F.col("tid").alias("a"), F.col("text").alias("_ta")), "a").join(full.select(F.col("tid").alias("b"), F.col("text").alias("_tb")), "b")
    similar = stored(both.where(similarity_column(F.col("_ta"), F.col("_tb"), size) >= least).select("a", "b"), "near-similar")
    forget(likely, wanted, full)
    return similar


def exact_links(texts: DataFrame, known: DataFrame, docs: DataFrame, n_docs: int, size: int, least: float) -> DataFrame:
    """Links (a, b) that, with the components (node, root) of `known`, connect the same texts as all pairs of at
    least `least` similarity do.

    Texts that are similar share a shingle of their prefixes, so every pair meets at a shingle. Every text of a
    shingle is first compared with the smallest one; then only pairs of different groups are left. Lengths and
    parities, bounds that no similar pair can break, are looked at before texts are.
    """
    frequent = frequent_shingles(docs, n_docs, size)

    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), SIGN_TEXTS):
                part = frame.iloc[at : at + SIGN_TEXTS]
                sets = [digests(t, size) for t in part["text"]]
                yield part[["doc_id", "key"]].assign(
                    n=[len(x) for x in sets], parity=[parities(x) for x in sets], sketch=[sketch(x) for x in sets], prefix=[prefix_of(x, frequent, least).view(np.int64) for x in sets]
                )

    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, n bigint, parity array<bigint>, sketch array<int>, prefix array<bigint>"
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    named = texts.select("tid", F.col("first_doc").alias("doc_id"), "key")
    signs = stored(rows.mapInPandas(signed, types).join(named, ["doc_id", "key"]).dropDuplicates(["tid"]).select("tid", "n", "parity", "sketch", "prefix"), "near-signs")
    at_shingle = Window.partitionBy("hash")
    posted = signs.select("tid", F.explode("prefix").alias("hash"))
    shared = posted.withColumn("lead", F.min("tid").over(at_shingle)).withColumn("_n", F.count("*").over(at_shingle)).where("_n > 1")
    shared = stored(shared.select("hash", "tid", "lead"), "near-shared")

    def grouped(labels: DataFrame) -> DataFrame:
        table = signs.join(shared.select("tid").distinct(), "tid", "left_semi").join(labels, F.col("tid") == F.col("node"), "left")
        return stored(table.select("tid", "n", "parity", F.coalesce("root", "tid").alias("group")), "near-groups")

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col("tid").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in table.columns if c not in ("tid", "hash")])

    together = F.col("n_a") + F.col("n_b")
    apart = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(8)), F.lit(0))
    possible = (
        (F.col("group_a") != F.col("group_b"))
        & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-6)
        & (apart <= (1 - least) / (1 + least) * together + 1e-6)
    )
    groups = grouped(known)
    leads = shared.where("tid <> lead").select(F.col("tid").alias("a"), F.col("lead").alias("b")).distinct()
    first = stored(leads.join(side(groups, "a"), "a").join(side(groups, "b"), "b").where(possible).select("a", "b"), "near-first-pairs")
    similar = similar_pairs(first, signs, texts, docs, size, least)
    forget(first, groups)
    groups = grouped(components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(similar)))
    met = stored(shared.join(groups, "tid").drop("lead"), "near-met")
    open_ = met.groupBy("hash").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low <> _high").select("hash")
    second = stored(side_by_side(met.join(open_, "hash", "left_semi")).where(possible).select("a", "b").distinct(), "near-second-pairs")
    forget(met, shared, groups)
    more = similar_pairs(second, signs, texts, docs, size, least)
    forget(second, signs)
    return similar.unionByName(more)


def side_by_side(met: DataFrame) -> DataFrame:
    """All pairs of texts that meet at a shingle, with the columns of either."""
    left = met.select("hash", *[F.col(c).alias("a" if c == "tid" else f"{c}_a") for c in met.columns if c != "hash"])
    right = met.select("hash", *[F.col(c).alias("b" if c == "tid" else f"{c}_b") for c in met.columns if c != "hash"])
    return left.join(right, "hash").where(F.col("a") < F.col("b"))


def without_near_duplicates(
    docs: DataFrame, size: int = NEAR_SHINGLE, least: float = NEAR_SIMILARITY, bits: int = NEAR_BITS
) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; all columns are kept.

    Texts belong to a group if a chain of texts connects them, each `least` similar to the next by the Jaccard
    similarity of their sets of `size`-word shingles. Fingerprints of their sets of words within `bits` give the
    first links, shared shingles of prefixes (`exact_links`) all that are missing. Copies of a text count once. Null texts are as empty ones: all texts without words
    are one group. Of rows with the same doc_id and text one stays. A document with a null id stays only if no
    row with an id has its text; it is compared by its exact text alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select("doc_id", text_key(F.col("text")).alias("key"), fingerprint(text, 1, distinct=True).alias("fp")), "near-rows")
    texts = rows.groupBy("key").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("first_doc"))
    texts = stored(texts.withColumn("tid", F.monotonically_increasing_id()), "near-texts")
    near = near_duplicate_texts(texts, docs, size, least, bits)
    exact = exact_links(texts, components(near), docs, rows.count(), size, least)
    labels = components(near.unionByName(exact))
    grouped = texts.join(labels, F.col("tid") == F.col("node"), "left").withColumn("group", F.coalesce("root", "tid"))
    order = F.struct(F.col("first_doc").isNull(), "first_doc", "key")
    kept = grouped.groupBy("group").agg(F.min(order).alias("_kept")).select(F.col("_kept.first_doc").alias("_doc"), F.col("_kept.key").alias("_key"))
    kept = stored(kept, "near-kept")
    counts = rows.groupBy("doc_id", "key").agg(F.count("*").alias("_rows")).where("_rows > 1")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
    repeated = stored(counts.join(kept, same, "left_semi").select("key").distinct(), "near-repeated")
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), text_key(F.col("text")).alias("key"))
    chosen = full.join(kept, same, "left_semi")
    once = chosen.join(repeated, "key", "left_anti").select(*columns)
    several = chosen.join(repeated, "key", "left_semi").groupBy("key").agg(F.first("_row").alias("_row")).select(*columns)
    return once.unionByName(several)
