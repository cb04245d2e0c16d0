"""DuckDB SQL of the queries that SQL can express, written from what the queries return, not from how they work.

The others (fingerprints, the method's spans, classifier, sketches, licence index) are tested against
brute-force versions in tests/llm.
"""

from __future__ import annotations

from podium.llm import chat, codes, decontaminate, line_dedup, mixing, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_formatting() -> str:
    def count(column: str, part: str) -> str:
        return f"(length({column}) - length(replace({column}, {quoted(part)}, ''))) // {len(part)}"

    def escaped(column: str) -> str:
        return f"length({column}) + " + " + ".join(count(column, c) for c in ("\\", *chat.CONTROL))

    markers = len(chat.TURN + chat.TEXT + chat.END)
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), joined AS (
      SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum({markers} + {escaped('role')} + {escaped('text')}) AS formatted_chars
      FROM turns GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
      CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined"""


def url_filters() -> str:
    rule = verdict = "NULL"
    for host, path, outcome in sorted(url_filter.RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = {quoted(host)} OR ends_with(host, {quoted('.' + host)})) AND starts_with(path, {quoted(path)})"
        rule = f"CASE WHEN {fits} THEN {quoted(host + path)} ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN {quoted(outcome)} ELSE {verdict} END"
    terms = "|".join(url_filter.BLOCKED_TERMS)
    return f"""
    WITH rests AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
    ), judged AS (
      SELECT *, regexp_matches(host, '(^|\\.)([^.]*-)?({terms})(-[^.]*)?\\.') AS listed FROM parts
    )
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
    FROM judged"""


def mixing_sources() -> str:
    weights = ", ".join(f"{w}.0" for w in mixing.WEIGHTS)
    return f"""
    WITH sized AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS draw
      FROM documents
    ), sources AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
      FROM sized GROUP BY source
    ), caps AS (
      SELECT source, source_size, CAST({mixing.MAX_EPOCHS} * source_size AS DOUBLE) AS cap,
        CAST([{weights}][(place - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight FROM sources
    ), levels AS (
      SELECT a.cap / a.weight AS ratio, ((SELECT sum(source_size) FROM caps)
          - coalesce((SELECT sum(b.cap) FROM caps b WHERE b.cap / b.weight < a.cap / a.weight), 0))
        / (SELECT sum(b.weight) FROM caps b WHERE b.cap / b.weight >= a.cap / a.weight) AS level
      FROM caps a
    ), filled AS (
      SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio)) AS target
      FROM caps
    ), epochs AS (
      SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS epochs FROM filled
    ), placed AS (
      SELECT s.*, e.source_size, e.target, floor(e.epochs) AS whole, (e.epochs - floor(e.epochs)) * e.source_size AS rest,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw) AS upto, sum(s.size) OVER (PARTITION BY s.source, s.draw) AS own
      FROM sized s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
    ), taken AS (
      SELECT *, CAST(whole + (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) :: INT AS INT) AS repeats
      FROM placed
    )
    SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken, repeats FROM taken"""


def warc_records() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)"
    return f"""
    WITH payloads AS (
      SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages
    )
    SELECT page_id, octet_length(payload) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest,
      CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> owner THEN owner END AS refers_to
    FROM payloads"""


def decontamination() -> str:
    d = decontaminate
    not_word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{not_word}'), lambda w: w <> '')"
    masks = ", ".join("'" + str(m) + ":' || " + " || chr(31) || ".join(f"w[i + {k + 1}]" for k in mask) for m, mask in enumerate(d.MASKS))
    seeds = f"SELECT k, i, unnest([{masks}]) AS seed FROM (SELECT k, w, unnest(range(len(w) - {d.SPAN - 1})) AS i FROM {{}} WHERE len(w) >= {d.SPAN})"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
    items AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL)),
    hits AS (
      SELECT DISTINCT a.k AS doc, b.k AS item, a.i - b.i AS shift
      FROM ({seeds.format('docs')}) a JOIN ({seeds.format('items')}) b USING (seed)
    ), aligned AS (
      SELECT doc, doc_id, item_id, shift, greatest(0, -shift) AS low, items.w AS mine, docs.w AS theirs,
        least(len(items.w), len(docs.w) - shift) AS high
      FROM hits JOIN docs ON docs.k = doc JOIN items ON items.k = item
    ), same AS (
      SELECT *, least({d.WINDOW}, high - low) AS n_words, list_transform(range(low, high), lambda p: (mine[p + 1] = theirs[p + shift + 1]) :: INT) AS agrees
      FROM aligned
    ), scored AS (
      SELECT *, unnest(range(len(agrees) - n_words + 1)) AS begins FROM same
    ), windows AS (
      SELECT doc, doc_id, item_id, shift, n_words, low + shift + begins AS first_word, list_sum(agrees[begins + 1 : begins + n_words]) AS n_agree FROM scored
    ), best AS (
      SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY doc, item_id, shift ORDER BY n_agree DESC, first_word) = 1
    ), places AS (
      SELECT * FROM best WHERE CASE WHEN n_words >= {d.WINDOW} THEN n_agree >= {d.AGREE}
        ELSE n_words >= {d.SHORTEST} AND n_agree * 5 >= n_words * 4 END
    ), ranked AS (
      SELECT *, count(*) OVER (PARTITION BY doc_id, item_id) AS n_places,
        row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_agree DESC, first_word, n_words DESC) AS place FROM places
    )
    SELECT doc_id, item_id, n_places, CAST(n_agree AS BIGINT) AS n_agree, CAST(n_words AS BIGINT) AS n_words, CAST(first_word AS BIGINT) AS first_word
    FROM ranked WHERE place = 1"""


def line_dedup_sql() -> str:
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    key = f"translate(trim(line, {white}), '{UPPER}', '{LOWER}')"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents),
    parts AS (SELECT k, unnest(cut) AS line, unnest(range(len(cut))) AS place FROM docs),
    keyed AS (SELECT *, {key} AS key FROM parts),
    common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT k) >= {line_dedup.MIN_DOCS}),
    marked AS (SELECT keyed.*, common.key IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (key)),
    summed AS (
      SELECT k, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
      FROM marked GROUP BY k
    )
    SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM docs JOIN summed USING (k)"""


def vector_codes() -> str:
    parts, entries = codes.PARTS, codes.ENTRIES
    apart = "CAST(list_sum(list_transform(range(len(p.q)), lambda i: (p.q[i + 1] - e.q[i + 1]) * (p.q[i + 1] - e.q[i + 1]))) AS BIGINT)"
    steps = []
    for n in range(codes.ROUNDS + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
      SELECT k, part, min(struct_pack(d := {apart}, entry := e.entry)) AS best
      FROM parts p JOIN book{n} e USING (part) GROUP BY k, part
    )""")
        if n < codes.ROUNDS:
            steps.append(f"""mean{n} AS (
      SELECT part, entry, place, CAST(floor(CAST(sum(x) AS HUGEINT) / count(*)) AS BIGINT) AS x, sum(x) AS s, count(*) AS n
      FROM (SELECT part, best.entry AS entry, unnest(q) AS x, unnest(range(len(q))) AS place FROM near{n} JOIN parts USING (k, part))
      GROUP BY part, entry, place
    ), book{n + 1} AS MATERIALIZED (
      SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM book{n} b LEFT JOIN (
        SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS q FROM mean{n} GROUP BY part, entry) m USING (part, entry)
    )""")
    last = codes.ROUNDS
    return f"""
    WITH kept AS (
      SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
    ), parts AS MATERIALIZED (
      SELECT k, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS q FROM (SELECT k, q, unnest(range({parts})) AS part FROM kept)
    ), book0 AS MATERIALIZED (SELECT part, k AS entry, q FROM parts WHERE k < {entries}),
    {", ".join(steps)},
    scored AS (
      SELECT k, string_agg(lpad(to_hex(best.entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{last} GROUP BY k
    )
    SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) FROM book{last}) AS codebooks_sha256
    FROM kept JOIN scored USING (k)"""


ORACLES: dict[str, str] = {
    "op1_chat_formatting": chat_formatting(),
    "op4_url_filters": url_filters(),
    "op7_mixing": mixing_sources(),
    "op8_warc": warc_records(),
    "op9_decontamination": decontamination(),
    "op12_vector_codes": vector_codes(),
    "op13_line_dedup": line_dedup_sql(),
}
