"""Personal data and terms that give it away. Native DataFrame operations only.

Base: e-mail addresses, IP addresses, card and phone numbers, found by patterns and checked by digit rules.

Method: information-theoretic sanitisation. Protected entities are the base values and the part of each that is
shared with others (PARTS: domain of an address, network of an IP, issuer of a card, area of a phone), since most
values stand in one document only. An entity e has the information content IC(e) = log(N / n(e)), from the number
of documents that hold it. A term t anywhere in those documents reveals PMI(t, e) = log(N n(t, e) / (n(t) n(e))) of
that. From REMOVE * IC(e) upwards the term is removed, from GENERALISE * IC(e) upwards generalised, wherever it
stands in a document that holds e. n(t, e) must come from at least MIN_TEXTS different texts, since in a single
text every rare word would seem to give its entity away. n(t) counts all documents of the corpus. Documents without
a base value are never changed.

A term is generalised to the longest beginning that it shares with a word so common that even if all of e's
documents had it, it would reveal less than GENERALISE * IC(e). A term without such a beginning is removed.

A pattern starts only where its run of characters starts and never gives characters back, so that long runs
take linear time; the matches are those of the plain pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.store import forget
from podium.llm.common import NOT_WORD, free_name, stored

KINDS = ("email", "ip", "card", "phone")
ADDED = ("term", "removed")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What of a value (lower case, or its digits) names a group of entities.
PARTS = {"email": "@.*$", "ip": r"^[0-9]+\.[0-9]+\.", "card": "^[0-9]{6}", "phone": "^[0-9]{4}"}
MIN_TEXTS = 3
# The shortest beginning a term is generalised to.
STEM = 3
# Half of the information, and nearly all of it.
GENERALISE, REMOVE = 0.5, 0.9
BROADCAST_TERMS = 200_000
# Numbers of pairs that are sent to every task, some tens of megabytes; more are joined.
BROADCAST_PAIRS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN_TYPE = "array<struct<start:int,rank:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn rule."""
    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The digit rules of a matched value."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\.", -1), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    digits = F.regexp_replace(value, "[^0-9]", "")
    low, high = (14, 19) if kind == "card" else (10, 15)
    fits = F.length(digits).between(low, high)
    return F.when(fits, luhn(digits)).otherwise(False) if kind == "card" else fits


def matches(text: Column, kind: str) -> Column:
    """Checked matches of one kind as (start, rank, end, value), offsets in code points.

    The text is split at the matches, so an offset is the length of all pieces and matches before it.
    """
    pattern = PATTERNS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
    pairs = F.arrays_zip(gaps.alias("gap"), values.alias("value"))
    rank = KINDS.index(kind)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN_TYPE).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), pair["value"].alias("value"))
        kept = F.when(holds(kind, pair["value"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.cast(SPAN_TYPE).alias("spans"))

    return F.aggregate(pairs, start, step)["spans"]


def base_spans(text: Column) -> Column:
    """All base values of a text, by start, then kind. Patterns only run on texts that can hold them."""
    none = F.array().cast(SPAN_TYPE)
    digit = F.regexp_like(text, F.lit("[0-9]"))
    found = F.concat(
        F.when(F.contains(text, F.lit("@")), matches(text, "email")).otherwise(none),
        F.when(digit, F.concat(matches(text, "ip"), matches(text, "card"))).otherwise(none),
        F.when(digit & F.contains(text, F.lit("+")), matches(text, "phone")).otherwise(none),
    )
    return F.array_sort(found)


def entities(spans: Column) -> Column:
    """The protected entities of a document's spans as distinct (rank, value): values and their parts."""
    def of(span: Column) -> Column:
        names = [F.struct(span["rank"].alias("rank"), F.lower(span["value"]).alias("value"))]
        for rank, kind in enumerate(KINDS):
            known = F.lower(span["value"]) if kind in ("email", "ip") else F.regexp_replace(span["value"], "[^0-9]", "")
            part = F.regexp_extract(known, PARTS[kind], 0)
            names.append(F.when(span["rank"] == rank, F.struct(span["rank"].alias("rank"), F.concat(part, F.lit("*")).alias("value"))))
        return F.filter(F.array(*names), lambda n: n.isNotNull())

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def without_spans(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the base values, all offsets kept."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        begin = F.greatest(state["at"], span["start"])
        piece = F.substring(text, state["at"] + 1, begin - state["at"])
        end = F.greatest(state["at"], span["end"])
        return F.struct(end.alias("at"), F.concat(state["out"], piece, F.repeat(F.lit(" "), end - begin)).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def with_base(docs: DataFrame) -> DataFrame:
    """The whole document as `_doc`, its text (null: empty) and its base spans."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(doc, text.alias("_text"), base_spans(text).alias("_spans"))


def affected_documents(based: DataFrame) -> DataFrame:
    """Documents with base values and a number `row`, stored; `_rest` is the text without them, `_entities` theirs."""
    found = based.where(F.size("_spans") > 0).withColumn("row", F.monotonically_increasing_id())
    rest = without_spans(F.col("_text"), F.col("_spans")).alias("_rest")
    return stored(found.select("*", rest, entities(F.col("_spans")).alias("_entities")), "pii-affected")


def word_set(text: Column) -> Column:
    """The different words of a text, each lowered for itself, so that a word is the same term in every text."""
    return F.array_distinct(F.transform(F.array_distinct(F.split(text, NOT_WORD, -1)), F.lower))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many documents each of the terms stands: (term, n_term). `terms` is a stored table of distinct terms."""
    words = docs.select(F.explode(word_set(F.coalesce(F.col("text"), F.lit("")))).alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        return words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    return words.groupBy("term").agg(F.count("*").alias("n_term")).join(terms, "term", "left_semi")


def disclosing_pairs(docs: DataFrame, affected: DataFrame) -> DataFrame:
    """(row, copy, rank, value, term, n_entity, n_term, n), stored: the words of documents beside entities they may
    disclose; `copy` is the text's hash, `n` the corpus.

    Both must stand in MIN_TEXTS texts, and the term in so few documents that it could reach GENERALISE if all of
    the entity's had it: log(N / n(t)) bounds what a term reveals of any entity.
    """
    copy = F.xxhash64("_text").alias("copy")
    held = affected.select("row", copy, F.explode("_entities").alias("_e")).select("row", "copy", "_e.rank", "_e.value")
    by_text = held.groupBy("rank", "value", "copy").agg(F.count("*").alias("_rows"))
    known = by_text.groupBy("rank", "value").agg(F.sum("_rows").alias("n_entity"), F.count("*").alias("_texts"))
    known = stored(known.where(F.col("_texts") >= MIN_TEXTS).drop("_texts"), "pii-entities")
    held = stored(held.drop("copy").join(known, ["rank", "value"]), "pii-held")
    words = affected.join(held.select("row").distinct(), "row", "left_semi").select("row", copy, F.explode(word_set(F.col("_rest"))).alias("term")).where("term <> ''")
    words = stored(words, "pii-words")
    several = words.select("term", "copy").distinct().groupBy("term").agg(F.count("*").alias("_texts")).where(F.col("_texts") >= MIN_TEXTS)
    counts = stored(term_counts(docs, stored(several.select("term"), "pii-terms")), "pii-counts")
    n = float(docs.count())
    most = F.pow(F.col("n_entity"), F.lit(GENERALISE)) * F.lit(n ** (1 - GENERALISE))
    pairs = words.join(counts, "term").join(held, "row").where(F.col("n_term") <= most * (1 + 1e-9))
    pairs = stored(pairs.withColumn("n", F.lit(n)), "pii-pairs")
    forget(known, held, words, counts)
    return pairs


def disclosing_terms(pairs: DataFrame) -> DataFrame:
    """(rank, value, term, share, content, n): the terms that reveal `share` of the `content` bits of an entity."""
    # Most pairs stand in a text or two. Two numbers a row find those in enough; only these are shuffled with their texts.
    pair = F.xxhash64("rank", "value", "term").alias("_pair")
    texts = pairs.groupBy(pair, "copy").agg(F.count("*").alias("_rows")).groupBy("_pair").agg(F.count("*").alias("_texts"))
    several = stored(texts.where(F.col("_texts") >= MIN_TEXTS).select("_pair"), "pii-several")
    several = F.broadcast(several) if several.count() <= BROADCAST_PAIRS else several
    pairs = pairs.withColumn("_pair", pair).join(several, "_pair", "left_semi")
    by_text = pairs.groupBy("rank", "value", "term", "copy").agg(
        F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in ("n_entity", "n_term", "n")]
    )
    both = by_text.groupBy("rank", "value", "term").agg(
        F.sum("_rows").alias("n_both"), F.count("*").alias("_texts"), *[F.first(c).alias(c) for c in ("n_entity", "n_term", "n")]
    )
    content = F.log2(F.col("n") / F.col("n_entity"))
    revealed = F.log2(F.col("n") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    # An entity that every document holds has nothing left to reveal.
    share = F.when(content > 0, revealed / content).otherwise(F.lit(0.0))
    scored = both.where(F.col("_texts") >= MIN_TEXTS).select("rank", "value", "term", share.alias("share"), content.alias("content"), "n")
    return scored.where(F.col("share") >= GENERALISE)


def broader_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(rank, value, term, kind, broader): what becomes of the disclosing terms; a removed one has no broader term."""
    mild = terms.where((F.col("share") < REMOVE) & (F.length("term") > STEM))
    mild = mild.select("rank", "value", "term", "content", "n", F.substring("term", 1, STEM).alias("_stem"))
    stems = stored(mild.select("_stem").distinct(), "pii-stems")
    words = docs.select(F.explode(word_set(F.coalesce(F.col("text"), F.lit("")))).alias("word")).withColumn("_stem", F.substring("word", 1, STEM))
    few = stems.count()
    # A stem is three characters; without any, no text is read.
    kin = words.join(F.broadcast(stems) if few <= BROADCAST_TERMS else stems, "_stem", "left_semi") if few else words.where("false")
    # A word too rare to bear any of the terms bears none of their beginnings; most words are.
    least = mild.agg(F.min(F.col("n") * F.pow(F.lit(2.0), -GENERALISE * F.col("content")))).first()[0] or 0.0
    common = kin.groupBy("word").agg(F.count("*").alias("n_word")).where(F.col("n_word") >= least * (1 - 1e-9))
    # The commonest word of every beginning bounds from below how many documents have the beginning.
    begun = common.withColumn("broader", F.explode(F.transform(F.sequence(F.lit(STEM), F.length("word")), lambda k: F.substring("word", F.lit(1), k))))
    begun = stored(begun.groupBy("broader").agg(F.max("n_word").alias("n_word")), "pii-begun")
    cut = F.explode(F.transform(F.sequence(F.lit(STEM), F.length("term") - 1), lambda k: F.substring("term", F.lit(1), k)))
    options = mild.withColumn("broader", cut).join(begun, "broader")
    safe = options.where(F.log2(F.col("n") / F.col("n_word")) < GENERALISE * F.col("content"))
    best = safe.groupBy("rank", "value", "term").agg(F.max(F.struct(F.length("broader"), "broader"))["broader"].alias("broader"))
    joined = terms.join(best, ["rank", "value", "term"], "left")
    kind = F.when(F.col("broader").isNull(), F.lit(len(KINDS) + 1)).otherwise(F.lit(len(KINDS)))
    return joined.select("rank", "value", "term", kind.alias("kind"), "broader")


def marked_words(affected: DataFrame, marks: DataFrame) -> DataFrame:
    """(row, _added): every place of the marked terms (row, term, kind, broader) in their documents.

    A word's place is the sum of all lengths before it, a running sum over the document's words."""
    rest = affected.join(marks.select("row").distinct(), "row", "left_semi").select("row", F.col("_rest").alias("_t"))
    found = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    pieces = F.arrays_zip(found.alias("word"), F.slice(F.split("_t", WORD, -1), F.lit(1), F.size(found)).alias("gap"))
    words = rest.select("row", F.posexplode(pieces).alias("_at", "_p")).select("row", "_at", "_p.word", F.length("_p.gap").alias("_gap"))
    end = F.sum(F.col("_gap") + F.length("word")).over(Window.partitionBy("row").orderBy("_at")).cast("int")
    placed = words.withColumn("end", end).withColumn("start", F.col("end") - F.length("word")).withColumn("term", F.lower("word"))
    span = F.struct("start", F.col("kind").alias("rank"), "end", "broader")
    return placed.join(marks, ["row", "term"]).groupBy("row").agg(F.collect_list(span).alias("_added"))


def all_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with base values as (_doc, _text, _spans, _all), the added spans among `_all`; and those without.

    `_all` is (start, rank, end, broader) by start, then kind: the base kinds as listed, then term, then removed.
    """
    based = with_base(docs)
    affected = affected_documents(based)
    pairs = disclosing_pairs(docs, affected)
    terms = stored(broader_terms(docs, stored(disclosing_terms(pairs), "pii-scored")), "pii-disclosing")
    # A word that discloses several entities takes the strongest mark, then the shortest broader term.
    strongest = F.max(F.struct("kind", -F.length("broader"), "broader"))
    marks = pairs.join(terms, ["rank", "value", "term"]).groupBy("row", "term").agg(strongest.alias("_m"))
    marks = stored(marks.select("row", "term", "_m.kind", "_m.broader"), "pii-marks")
    added = marked_words(affected, marks)
    base = F.transform(
        "_spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(None).cast("string").alias("broader"))
    )
    merged = F.array_sort(F.concat(base, F.coalesce("_added", F.array().cast("array<struct<start:int,rank:int,end:int,broader:string>>"))))
    whole = affected.join(added, "row", "left").select("_doc", "_text", "_spans", merged.alias("_all"))
    return whole, based.where(F.size("_spans") == 0)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans), one row a document.

    A null text counts as empty; a document without base values has no spans and empty texts. Equal rows are
    each reported; a value in equal texts counts as one text for MIN_TEXTS. Other columns are ignored; an empty table
    gives an empty result.
    """
    affected, rest = all_spans(docs)
    ranks = F.transform("_spans", lambda s: s["rank"])
    counted = [(F.size("_spans") - F.size(F.array_remove(ranks, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    found = affected.select("_doc.doc_id", *counted, span_text(F.col("_spans")).alias("base_spans"), span_text(F.col("_all")).alias("spans"))
    none = [F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.unionByName(rest.select("_doc.doc_id", *none, F.lit("").alias("base_spans"), F.lit("").alias("spans")))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets, generalised terms by the broader one and `*`; spans
    that overlap become the first one's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, *ADDED)])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        piece = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        new = F.coalesce(F.concat(span["broader"], F.lit("*")), F.get(names, span["rank"]))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], piece, new)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    end = F.aggregate(spans, start, step)
    return F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))


def sanitised_documents(docs: DataFrame) -> DataFrame:
    """The documents with base values and disclosing terms replaced in `text`; all rows, all columns, the rest as it was.

    Null texts stay null, rows of equal or null ids are each replaced for themselves; an empty table stays empty.
    If the documents have a column `n_chars`, it is set to the new length where the text has changed.
    """
    affected, rest = all_spans(docs)
    new = free_name(docs, "_redacted")
    changed = affected.withColumn(new, redacted(F.col("_text"), F.col("_all")))
    columns = {c: F.col("_doc").getField(c) for c in docs.columns}
    fresh = columns | {"text": F.col(new)}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length(new).cast(docs.schema["n_chars"].dataType)
    return changed.select(*[c.alias(n) for n, c in fresh.items()]).unionByName(rest.select(*[c.alias(n) for n, c in columns.items()]))
