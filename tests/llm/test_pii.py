import math
import random
import re

from helpers import documents

from podium.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD = "4111 1111 1111 1111"


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def by_hand(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            bad = (
                kind == "ip" and any(int(p) > 255 for p in m.group().split("."))
                or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                or kind == "phone" and not 10 <= len(digits) <= 15
            )
            if not bad:
                found.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


TEXTS = [
    None, "", "nothing 12 here", "a@b.com_x@y.zz é😀 c@d.e.f. 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.004",
    f"{CARD} 4111-1111-1111-1111- 4111111111111112 0 1 2", "+1 (988) 555-2485- +12 +1 2 +123456789012345678 ++49.89.1234567.",
    "@@ a@b a@b..c .@-.- %@x.y", f"😀{CARD}@x.y +1 {CARD} 1.2.3.4", "a" * 3000 + " b@c.d " + "1" * 3000 + ".1.1.1 a@" + "b." * 3000 + "c",
    "1.2.3.4" * 50, "x@y.z," * 500,
]


def test_base_spans(spark):
    rows = pii.find_personal_data(documents(spark, TEXTS + TEXTS[3:4], clash=True)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = by_hand((TEXTS + TEXTS[3:4])[r.doc_id])
        assert r.base_spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in PATTERNS]
        assert set(r.base_spans.split(",")) <= set(r.spans.split(","))


def test_long_runs_take_linear_time(spark):
    text = "a" * 300_000 + " " + "1" * 300_000 + " x@" + "b." * 100_000 + "c +" + "1-" * 100_000
    row = pii.find_personal_data(documents(spark, [text])).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 0, 0, 0)


def corpus():
    """Three texts name Zorblax beside an address, and no others do; `contact` stands everywhere."""
    told = [f"contact Zorblax under zor@blax.org today {w} end" for w in ("one", "two", "three")]
    return told + [f"contact us under the usual place {i}" for i in range(60)] + ["single Qwertz q@w.de word"] * 4


def test_terms_that_disclose_an_entity(spark):
    texts = corpus()
    rows = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    start = texts[0].index("Zorblax")
    assert f"removed:{start}:{start + 7}" in rows[0].spans.split(",")
    assert not any(f":{texts[0].index(w)}:" in rows[0].spans for w in ("contact", "under"))
    # Copies of one text are no evidence, and clean documents stay as they are.
    assert rows[63].spans == rows[63].base_spans
    assert all(rows[i].spans == "" for i in range(3, 63))


WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def entities_by_hand(text):
    """Values and their parts, by kind."""
    found = set()
    for kind, start, end in by_hand(text):
        value = text[start:end].lower()
        known = value if kind in ("email", "ip") else re.sub("[^0-9]", "", value)
        part = {"email": known[known.find("@") :], "ip": ".".join(known.split(".")[:2]) + ".", "card": known[:6], "phone": known[:4]}[kind]
        found |= {(kind, value), (kind, part + "*")}
    return found


def words_by_hand(text):
    for _, start, end in by_hand(text):
        text = text[:start] + " " * (end - start) + text[end:]
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(WORDS, text)]


def terms_by_hand(texts):
    """Share of every disclosing (kind, value, term), by looking at all of them."""
    held = [entities_by_hand(t) for t in texts]
    inside = [{w for _, _, w in words_by_hand(t)} for t in texts]
    anywhere = [{w.lower() for w in re.findall(WORDS, t)} for t in texts]
    found = {}
    for entity in set().union(*held):
        rows = [i for i, h in enumerate(held) if entity in h]
        for term in set().union(*(inside[i] for i in rows)):
            both = [i for i in rows if term in inside[i]]
            if len({texts[i] for i in both}) >= pii.MIN_TEXTS and len(rows) < len(texts):
                n_term = sum(term in w for w in anywhere)
                share = math.log2(len(texts) * len(both) / (n_term * len(rows))) / math.log2(len(texts) / len(rows))
                if share >= pii.GENERALISE:
                    found[(*entity, term)] = share
    return found


def mixed_corpus():
    """Values that share parts, terms of all strengths, copies, words far from the values and words that repeat."""
    r = random.Random(4)
    texts = corpus()
    for i in range(160):
        words = [f"w{r.randrange(400)}" for _ in range(60)]
        if i % 4 == 0:
            words[50] = [f"u{i}@corp{i % 3}.org", f"10.{i % 3}.7.{i}", f"+49 ({100 + i % 3}) 555-{1000 + i}"][r.randrange(3)]
            words[2] = ["Acme", "corpse", "Übung"][i % 3] if r.random() < 0.8 else "none"
        if i % 29 == 0:
            words[5] = "corpse"
        texts.append(" ".join(words))
    return texts + texts[-40:] + [f"corps everywhere {i}" for i in range(90)]


def test_terms_against_counting_by_hand(spark):
    for texts in (corpus(), mixed_corpus()):
        df = documents(spark, texts)
        pairs = pii.disclosing_pairs(df, pii.affected_documents(pii.with_base(df)))
        found = {(pii.KINDS[r["rank"]], r.value, r.term): r.share for r in pii.disclosing_terms(pairs).collect()}
        want = terms_by_hand(texts)
        assert found.keys() == want.keys() and len(want) > 2
        assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_added_spans_are_all_places_of_the_terms(spark):
    texts = mixed_corpus()
    terms = terms_by_hand(texts)
    kinds = set()
    for r in pii.find_personal_data(documents(spark, texts)).collect():
        text = texts[r.doc_id]
        here = {term for kind, value, term in terms if (kind, value) in entities_by_hand(text)}
        want = {(s, e) for s, e, w in words_by_hand(text) if w in here}
        added = [s.split(":") for s in r.spans.split(",") if s and s.split(":")[0] in pii.ADDED]
        assert {(int(s), int(e)) for _, s, e in added} == want and len(added) == len(want)
        kinds |= {k for k, _, _ in added}
    assert kinds == {"term", "removed"}


def test_generalised_terms_keep_a_common_beginning(spark):
    texts = mixed_corpus()
    rows = pii.sanitised_documents(documents(spark, texts)).collect()
    # `corps` stands in 90 documents, `corpse` nearly only beside one domain.
    assert any(" corps* " in r.text for r in rows) and not any("*" in r.text for r in rows if not by_hand(texts[r.doc_id]))


def test_sanitised_documents(spark):
    df = documents(spark, [*corpus(), None, f"card {CARD}, 1.2.3.4 and 4111 1111 1111 1111@x.y"], clash=True)
    new = pii.sanitised_documents(df)
    assert new.columns == df.columns and new.count() == df.count()
    texts = {r.doc_id: (r.text, r.n_chars, r.row) for r in new.collect()}
    assert texts[0][0].startswith("contact [REMOVED] under [EMAIL] [")
    assert texts[5] == ("contact us under the usual place 2", 34, "own 5") and texts[67][0] is None
    # An address that begins inside a card number is covered by it.
    assert texts[68][0] == "card [CARD], [IP] and [CARD]" and texts[68][1] == 28
    assert pii.sanitised_documents(df.where("false")).count() == 0
    assert pii.find_personal_data(df.where("false")).count() == 0


def test_rare_words_and_rare_pairs_are_left_out_early(spark, monkeypatch):
    """Beginnings of words too rare for any term, and pairs in fewer texts than MIN_TEXTS, are not aggregated."""
    kept, real = {}, pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    texts = [*mixed_corpus(), *[f"corx{i} rare" for i in range(50)]]
    df = documents(spark, texts)
    affected = pii.affected_documents(pii.with_base(df))
    pairs = pii.disclosing_pairs(df, affected)
    terms = real(pii.disclosing_terms(pairs), "terms")
    marked = pii.broader_terms(df, terms)
    assert "corps" in {r.broader for r in marked.collect()}
    begun = {r.broader: r.n_word for r in kept["pii-begun"].collect()}
    assert begun["corps"] >= 90 and not any(b.startswith("corx") for b in begun)
    of_texts = {}
    for r in pairs.select("rank", "value", "term", "copy").collect():
        of_texts.setdefault((r.rank, r.value, r.term), set()).add(r.copy)
    several = [k for k, copies in of_texts.items() if len(copies) >= pii.MIN_TEXTS]
    assert kept["pii-several"].count() == len(several) < len(of_texts)
