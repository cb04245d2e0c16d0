import random

import numpy as np
import pytest
import xxhash

from podium.llm import simhash
from helpers import documents, edited, prose


def by_hand(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] > label[i] and bin(fps[i] ^ fps[j]).count("1") <= bits:
                    label[j], changed = label[i], True
    return [min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(ids))]


TEXTS = ["", None, "One", "one", "a b", " x y z", "A\tB\nC\x0bD\x0cE\rF", "rep rep rep rep rep", prose(1, 40), "😀 " * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint_of(text.encode() if text is not None else None, 3) & (1 << 64) - 1 == by_hand(text)


@pytest.mark.parametrize(("bits", "leaf"), [(3, 4), (3, 256), (6, 16), (0, 8), (1, 8)])
def test_trees_find_every_pair(bits, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_POINTS", leaf)
    g = np.random.default_rng(bits)
    seeds = g.integers(0, 1 << 63, 120, dtype=np.int64).view(np.uint64)
    flips = [seeds ^ (np.uint64(1) << g.integers(0, 64, 120, dtype=np.uint64)) for _ in range(3)]
    dense = np.full(200, 77, np.uint64) ^ (np.uint64(1) << g.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 200, dtype=np.uint64))
    points = np.unique(np.concatenate([seeds, *flips, dense]))
    import pandas as pd

    metrics = simhash.bands(bits)
    trees = [simhash.grow(points[::5], [m, ((1 << 64) - 1, bits)], 20, np.random.default_rng(1)) for m in metrics]
    assert any(t is not None for t in trees)
    dealt = pd.concat(simhash.deal(iter([pd.DataFrame({"fp": points.view(np.int64)})]), trees))
    edges = pd.concat([simhash.link_shard(f, metrics, bits) for _, f in dealt.groupby(["band", "shard"])])
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= bits
    place = {int(v): i for i, v in enumerate(points.view(np.int64))}
    mine = np.zeros_like(near)
    for a, b in edges.itertuples(index=False):
        i, j = place[a], place[b]
        assert near[i, j] or len(edges)  # spanning links may pass through others
        mine[i, j] = mine[j, i] = True

    def labels(adjacent):
        label = np.arange(len(points))
        while True:
            lower = np.minimum(label, np.where(adjacent, label[None, :], len(points)).min(axis=1))
            if (lower == label).all():
                return label
            label = lower

    assert (labels(mine) == labels(near)).all()


def test_contraction(spark):
    r = random.Random(5)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    wild = [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    edges = path + star + wild + wild[:5] + [(500, 500)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_documents(spark):
    base = prose(9, 400)
    rows = [(10 + i, edited(base, i, 1), "en", "a") for i in range(12)] + [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    rows += [(None, base, "en", "a"), (5, base, "en", "a"), (5, base, "en", "a"), (None, "zz yy xx ww", None, None)]
    df = documents(spark, rows, clash=True)
    got = [(r.doc_id, simhash_hex, r.component_id) for r in simhash.near_components(df).collect() for simhash_hex in [r.fp & (1 << 64) - 1]]
    fps = [by_hand(r[1]) for r in rows]
    want = list(zip([r[0] for r in rows], fps, brute_components([r[0] for r in rows], fps, 3), strict=True))
    order = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert simhash.near_components(df.where("false")).count() == 0


def test_near_duplicates_leave_one_of_each_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 3)
    base, other = prose(1, 300), prose(2, 300)
    rows = [(100 + i, edited(base, i, 3), "en", "a") for i in range(9)] + [(50, base, "en", "a"), (51, base, "de", "b"), (52, base.upper(), "en", "a")]
    rows += [(1, other, "en", "a"), (2, edited(other, 1, 120), "en", "a"), (3, prose(3, 30), "en", "a"), (4, prose(4, 30), "en", "a")]
    rows += [(60, "", "en", "a"), (61, None, "en", "a"), (62, " \n", None, None), (7, "same", "en", "a"), (7, "same", "en", "a")]
    rows += [(None, base, "en", "a"), (None, "only without id", "en", "a"), (None, "only without id", "en", "a")]
    df = documents(spark, rows, clash=True)
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([50, 1, 2, 3, 4, 60, 7, None], key=str)
    assert simhash.without_near_duplicates(df.where("false")).count() == 0


def test_a_chain_is_one_group_though_its_ends_differ(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 2)
    words = prose(7, 400).split(" ")
    chain = []
    for i in range(8):
        chain.append(" ".join(words))
        words[i * 40 : i * 40 + 20] = [f"new{i}x{j}" for j in range(20)]
    sets = [simhash.shingle_set(t.encode(), 5) for t in chain]
    assert all(simhash.similarity(a, b) >= 0.8 for a, b in zip(sets, sets[1:], strict=False))
    assert simhash.similarity(sets[0], sets[-1]) < 0.8
    fps = [simhash.fingerprint_of(t.encode(), 1, True) for t in chain]
    bits = max(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(fps, fps[1:], strict=False))
    kept = simhash.without_near_duplicates(documents(spark, [(9 - i, t, "en", "a") for i, t in enumerate(chain)]), bits=bits)
    assert [r.doc_id for r in kept.collect()] == [2]


def test_near_duplicates_beyond_the_bits_of_the_fingerprint(spark):
    """Every pair of similarity 0.8 is linked, by brute force over appended, cut and substituted copies."""
    rows = []
    for i in range(30):
        base = prose(300 + i, 60 + 14 * i).split(" ")
        n = len(base)
        new = [w + "new" for w in prose(400 + i, n).split(" ")]
        copies = [base, base + new[: n // 10], base + new[: n * 24 // 100], base[: n * 85 // 100], [new[j] if j % 60 == 30 else w for j, w in enumerate(base)]]
        rows += [(100 * i + j, " ".join(c), "en", "a") for j, c in enumerate(copies)]
    sets = [simhash.shingle_set(t.encode(), 5) for _, t, _, _ in rows]
    fps = [simhash.fingerprint_of(t.encode(), 1, True) for _, t, _, _ in rows]
    label = list(range(len(rows)))
    far = 0
    for i in range(len(rows)):
        for j in range(i):
            if simhash.similarity(sets[i], sets[j]) >= 0.8:
                far += bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") > simhash.NEAR_BITS
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    assert far > 20
    want = sorted({min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in label})
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(documents(spark, rows)).collect()) == want


def test_sketches_agree_as_often_as_sets_are_similar():
    import numpy as np

    r = np.random.default_rng(3)
    for n, share in ((400, 0.8), (40, 0.8), (12, 0.84), (400, 0.3)):
        places = []
        for _ in range(60):
            both = r.integers(0, 1 << 63, n, dtype=np.uint64)
            common = int(round(2 * n * share / (1 + share)))
            a, b = both[:common], r.integers(0, 1 << 63, n - common, dtype=np.uint64)
            left, right = simhash.sketch(np.unique(both)), simhash.sketch(np.unique(np.concatenate([a, b])))
            places.append(int((left == right).sum()))
        assert abs(np.mean(places) / simhash.SKETCH - share) < 0.07
        assert share < 0.5 or min(places) >= simhash.SKETCH_AGREE
    assert (simhash.sketch(np.empty(0, dtype=np.uint64)) == 0).all()
