import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, prose

from podium.llm import align

pytestmark = pytest.mark.skipif(not os.path.exists(align.TOKENIZERS), reason="needs the tokenizer files")

TEXTS = [
    "hello world, it's  fine\n\nnext   line\t end ", "", None, " ", "\n", "  two blanks", "a" * 50, "héllo wörld ☃ 漢字かな 🎉", "<|endoftext|> and <s> [INST] </s> <0x41>",
    "has ▁ inside", "nul \x00 and \x1c x", "no break 　wide   sep", "word " * 300, "hello world", "hello world", "x=1; y = 2 ;z", "don't we'll 'tis 1234567890 ... !!!",
    "aaaa aaa aa a", "é combining", "trailing\n", "ａｂｃ full width ﬁ", "漢字" * 3000,
]


@pytest.fixture(scope="module")
def known():
    return align.Tokenizers(*align.read_files(align.TOKENIZERS))


def by_hand(known, texts):
    """Whole texts, all pairs of tokens by their byte ranges."""
    found = []
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "groups": ""}
        if text:
            (a,), (b,) = known.encode([" " + text])
            spans = lambda ids, table: [(i, sum(len(table[x]) for x in ids[:k]), len(table[i])) for k, i in enumerate(ids)]
            whole = (" " + text).encode()
            if b"".join(known.a_bytes[i] for i in a) == whole == b"".join(known.b_bytes[i] for i in b):
                sa, sb = spans(a, known.a_bytes), spans(b, known.b_bytes)
                ends = sorted({s + n for _, s, n in sa} & {s + n for _, s, n in sb})
                inside = lambda rows, lo, hi: ",".join(str(i) for i, s, n in rows if lo < s + n <= hi)
                cuts = list(zip([0, *ends], ends))
                row |= {"n_a": len(a), "n_b": len(b), "n_groups": len(ends), "groups": ";".join(f"{inside(sa, *c)}|{inside(sb, *c)}" for c in cuts)}
                row["links"] = [(x, y) for x, s, n in sa for y, t, m in sb if s < t + m and t < s + n]
        found.append(row)
    counts = Counter(p for r in found for p in set(r["links"]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (r["n_a"], r["n_b"], r["n_groups"], len(r["links"]), sum(counts[p] == best[p[0]] for p in r["links"]), sum(counts[p] for p in r["links"]), r["groups"])
        for r in found
    ]


@pytest.mark.parametrize("broadcast_pairs", [align.BROADCAST_PAIRS, -1])
def test_against_brute_force(spark, known, broadcast_pairs):
    texts = [t if t is None or len(t) < 3000 else t[:700] for t in TEXTS] + [prose(i, 60) for i in range(12)]
    df = documents(spark, texts).selectExpr("*", "'own' AS n_a", "'own' AS `groups`", "'own' AS _codes", "1 AS code", "2 AS n")
    got = align.align_documents(df, broadcast_pairs=broadcast_pairs).orderBy("doc_id").collect()
    digests = align.align_documents(df, digests=True).orderBy("doc_id").collect()
    assert [r["_groups"] for r in digests] == [hashlib.sha256(r["_groups"].encode()).hexdigest() if r["_groups"] else "" for r in got]
    names = ["_n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "_groups"]
    assert [tuple(r[c] for c in names) for r in got] == by_hand(known, texts)
    assert all(r["n_a"] == "own" and r["_codes"] == "own" for r in got)


def test_pieces_give_the_tokens_of_the_whole_text(known):
    counts, groups, *_ = align.Alignments(known).documents(TEXTS)
    for text, n, found in zip(TEXTS, counts, groups):
        if text:
            a, b = known.encode([" " + text])
            whole = align.Aligned(known, [" " + text], *[[align.array("I", x[0]).tobytes()] for x in (a, b)])
            assert n.tolist() == whole.counts[0].tolist() and found == (whole.texts[0] or "")
        else:
            assert not n.any() and found == ""


def test_identity_map(known):
    for a, b in enumerate(known.identity):
        if b >= 0:
            assert known.a_bytes[a] == known.b_bytes[b]
    assert (known.identity >= 0).sum() > 15_000
    assert known.identity[50256] == -1


def test_memory_is_bounded(known, monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED_PIECES", 40)
    made = align.Alignments(known)
    for _ in range(2):
        for i in range(5):
            texts = [prose(i, 30), "z" * 500, prose(i, 30)]
            fresh = align.Alignments(known).documents(texts)
            assert all((x == y).all() if hasattr(x, "all") else x == y for x, y in zip(made.documents(texts), fresh))
            assert "z" * 500 not in made.tokens and len(made.tokens) <= 60


def test_tasks_hand_on_pairs_early(known, monkeypatch):
    texts = [prose(i, 40) for i in range(8)]

    class Files:
        value = align.read_files(align.TOKENIZERS)

    monkeypatch.setattr(align, "TASK_PAIRS", 10)
    names = [*align.COUNTS, "groups", "steps", "links"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]
    aligned = list(align.align(iter(batches), Files, names, False))
    rows, parts = Counter(), 0
    for out in align.count_pairs(iter([x.slice(i, 1) for x in aligned for i in range(x.num_rows)]), known.identity, known.width, names[-2:]):
        parts += 1
        for identity, code, n in zip(*(c.to_pylist() for c in out.columns)):
            rows[(code, int(known.identity[code])) if identity else divmod(code, known.width)] += n
    assert parts > 2 and rows == Counter(p for t in texts for p in set(_links(known, t)))


def _links(known, text):
    _, _, _, codes, _ = align.Alignments(known).documents([text])
    return [divmod(c, known.width) for c in codes.tolist()]


def test_empty_table(spark):
    assert align.align_documents(documents(spark, [])).count() == 0


def test_a_encodes_many_pieces_in_a_call(known, monkeypatch):
    """Words are joined for A, and have the tokens that each of them has alone; odd pieces stay alone."""
    words = [f" {w}{n}" for n in range(200) for w in ("tale", "día", "日本", "🙂x", "<s>", "don't", "a\tb", "é́")]
    odd = [" ", "  x", " \n", " x ", " \u00a0y"]
    pieces = [*words, *odd]
    whole, calls = known.whole_a, []
    alone = whole(pieces)
    monkeypatch.setattr(known, "whole_a", lambda texts: calls.append(len(texts)) or whole(texts))
    got = known.encode_packed(pieces)
    assert sum(calls) <= len(pieces) // align.JOINED_PIECES + 1 + len(odd)
    assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in got[0]] == alone
    assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in got[1]] == known.encode(pieces)[1]
    assert known.encode_packed([]) == ([], []) and known.encode_packed(odd)[0] == got[0][-len(odd):]
