import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents

from podium.llm import line_dedup as ld

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def by_hand(texts, least):
    counts = Counter(k for t in texts for k in {key_of(x) for x in (t or "").split("\n")})
    rows = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key_of(x) and counts[key_of(x)] >= least)]
        rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return rows


def sample(seed=3, n=60):
    r = random.Random(seed)
    common = ["Cookie  policy", " cookie  POLICY\t", "é é", "Ä", "\x0b menu \r", "x" * 3000, ""]
    texts = ["\n".join(r.choice(common) if r.random() < 0.5 else f"own {seed} {i} {j}" for j in range(r.randrange(1, 12))) for i in range(n)]
    return [*texts, None, "", "\n", "\n\n", " ", "cookie  policy", texts[0], texts[0], "a\n" * 20_000 + "MENU"]


def deduped(docs, index, **bounds):
    rows = ld.dedup_lines(docs, index, **bounds).orderBy("doc_id").collect()
    return [(r["n_lines"], r["n_dropped"], r["text"]) for r in rows]


def index_of(spark, docs, least=5):
    return ld.insert_documents(ld.empty_index(spark, least), docs)


@pytest.mark.parametrize("bounds", [{}, {"broadcast_bytes": 0}, {"broadcast_keys": -1}])
def test_against_brute_force(spark, bounds):
    texts = sample()
    docs = documents(spark, texts, clash=True)
    assert deduped(docs, index_of(spark, docs), **bounds) == by_hand(texts, 5)


def test_deletion_undoes_insertion(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 2)
    one, two = sample(3), sample(4, 40)
    a, b = documents(spark, one), documents(spark, two)
    first = index_of(spark, a)
    both = ld.insert_documents(first, b)
    counts = lambda index: {(bytes(r["key"]), r["n"]) for r in index.refs.collect()}
    wanted = {hashlib.sha256(k.encode()).digest()[:16] for k in {key_of(x) for t in one for x in (t or "").split("\n")} if k}
    assert {k for k, _ in counts(first)} == wanted
    assert deduped(a, both) == by_hand([*one, *two], 5)[: len(one)]
    back = ld.delete_documents(both, b)
    assert counts(back) == counts(first)
    assert deduped(a, back) == by_hand(one, 5)
    assert sum(r["n_keys"] for r in back.filters.collect()) == sum(n >= 5 for _, n in counts(first))
    gone = ld.delete_documents(back, a)
    assert gone.refs.isEmpty() and gone.filters.isEmpty()
    with pytest.raises(ValueError):
        ld.delete_documents(first, b)


def test_mistaken_keys_stay(spark, monkeypatch):
    # With one fingerprint for all keys and few buckets the filters take most keys for common.
    real = ld.places
    monkeypatch.setattr(ld, "places", lambda keys, buckets: (lambda p: (np.ones_like(p[0]), p[1] % np.uint64(2), p[1] % np.uint64(2)))(real(keys, buckets)))
    texts = ["common\nown %d" % i for i in range(12)]
    docs = documents(spark, texts)
    assert deduped(docs, index_of(spark, docs)) == by_hand(texts, 5)


def test_filter_holds_what_it_got():
    r = np.random.default_rng(1)
    keys = r.integers(0, 256, (3000, 16), dtype=np.uint8)
    held = ld.CuckooFilter.of(keys)
    others = r.integers(0, 256, (20_000, 16), dtype=np.uint8)
    assert held.may_hold(keys).all() and held.may_hold(others).mean() < 0.001
    held.delete(keys[:1000])
    assert held.may_hold(keys[1000:]).all() and held.may_hold(keys[:1000]).mean() < 0.01
    assert held.insert(keys[:1000]) and held.may_hold(keys).all()
    small = ld.CuckooFilter(0, np.zeros((8, 4), dtype=np.uint16))
    assert not small.insert(keys[:100])


def test_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, ["a\nb", None])
    empty = index_of(spark, none)
    assert deduped(none, empty) == []
    assert deduped(some, empty) == [(2, 0, "a\nb"), (1, 0, "")]
    assert deduped(none, index_of(spark, some, 1)) == []


def test_null_and_repeated_ids(spark):
    rows = [(None, "x\ny", "en", "a")] * 3 + [(1, "x", "en", "a")] * 2
    docs = documents(spark, rows)
    kept = ld.dedup_lines(docs, index_of(spark, docs)).select("doc_id", "text", "n_dropped").collect()
    assert Counter(map(tuple, kept)) == Counter([(None, "y", 1)] * 3 + [(1, "", 1)] * 2)
