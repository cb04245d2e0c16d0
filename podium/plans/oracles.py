"""DuckDB SQL for the registered queries, written from the same table definitions but independently of the
Spark code. Each statement runs on the generated parquet tables alone."""

from __future__ import annotations

import re

from podium.sources import seed


def _sql_value(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in rows)


def hashed(key: str, bits: int, salt: int = 0) -> str:
    return f"('0x' || substr(md5(({key}) || '#{salt}'), 1, {bits // 4}))::BIGINT"


EVENT_OF_ORDER = "(o_custkey // 20 + 1)"
SEQ = (
    "(datediff('day', DATE '1970-01-01', l_shipdate::DATE) * 8::BIGINT + l_linenumber) * 35184372088832 "
    "+ (l_partkey * 1048576 + l_suppkey) % 35184372088832"
)

CTES: dict[str, str] = {
    "seed_q": f"SELECT * FROM (VALUES {_values(seed.QUESTIONS)}) "
    "AS v(k, type, is_required, optimal_percent, has_plaintext, question, description)",
    "seed_o": f"SELECT * FROM (VALUES {_values(seed.OPTIONS)}) AS v(k, ordinal, pct, classes, follow_k, annotation)",
    "ev": """SELECT s_suppkey + 1 AS event_id, s_name AS name,
        CASE WHEN s_nationkey % 5 <> 0 THEN '/r' || (s_nationkey % 5) || '.css' END AS css,
        s_suppkey % 10 < 2 AS is_template,
        CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '1997-01-01' END AS accepts_responses_from,
        CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2000-01-01' END AS accepts_responses_to,
        CASE WHEN s_suppkey % 5 <> 0 THEN 'key-' || s_suppkey END AS api_key,
        md5('event-' || s_suppkey) AS event_secret FROM supplier""",
    "eu": "SELECT DISTINCT c_custkey // 15 + 1 AS event_id, c_mktsegment AS \"user\" FROM customer",
    "pr": """SELECT s_suppkey AS presenter_id, s_name AS name,
        CASE WHEN s_suppkey % 4 <> 0 THEN 's' || s_suppkey || '@example.org' END AS email,
        CASE WHEN s_suppkey % 7 <> 0 THEN 'id-' || s_suppkey END AS identifier FROM supplier""",
    "se": """SELECT p_partkey AS session_id, p_partkey // 20 + 1 AS event_id,
        CASE WHEN p_partkey % 10 <> 0 THEN p_partkey END AS feed_id, p_name || ' ' || p_partkey AS title FROM part""",
    "sp": """SELECT session_id, presented_by_id,
        presented_by_id = min(presented_by_id) OVER (PARTITION BY session_id) AS is_session_owner
        FROM (SELECT DISTINCT l_partkey AS session_id, l_suppkey AS presented_by_id FROM lineitem
              WHERE l_linenumber = 1 AND l_quantity <= 15)""",
    "qu": """SELECT event_id * 100 + k AS question_id, event_id, k::SMALLINT AS display_order, question, description,
        optimal_percent::SMALLINT AS optimal_percent, is_required, type, has_plaintext
        FROM (SELECT event_id FROM @ev) CROSS JOIN @seed_q""",
    "op": """SELECT event_id * 100 + k AS question_id, event_id * 10000 + k * 100 + ordinal AS answer_option_id,
        ordinal::SMALLINT AS answer_ordinal, pct::SMALLINT AS percent_value,
        event_id * 100 + follow_k AS if_selected_show_question_id, annotation, classes AS css_classes
        FROM (SELECT event_id FROM @ev) CROSS JOIN @seed_o""",
    "re": """SELECT o_orderkey AS response_id, o_custkey AS session_id, md5('r' || o_orderkey) AS client_key,
        o_orderdate AS created, o_orderdate AS updated FROM orders""",
    "ch": f"""SELECT l_orderkey AS response_id,
        {EVENT_OF_ORDER} * 100 + CASE l_linenumber WHEN 6 THEN 7 WHEN 7 THEN 10 ELSE l_linenumber END AS question_id,
        (CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity = 50 THEN 9
              WHEN l_linenumber BETWEEN 2 AND 4 THEN (1 + l_partkey % 5) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END
              ELSE 1 + l_partkey % 6 END)::SMALLINT AS answer_ordinal,
        CASE WHEN l_linenumber = 7 THEN CASE WHEN l_returnflag = 'R' THEN '' ELSE 'note ' || l_partkey END END AS plaintext,
        l_shipdate AS ts, {SEQ} AS seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "sc": f"""SELECT user_id AS response_id,
        {EVENT_OF_ORDER} * 100 + CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 10 END
            AS question_id,
        (CASE event_type WHEN 'click' THEN 1 + v % 6 WHEN 'view' THEN 1 + v % 5 WHEN 'error' THEN -(1 + v % 5) END)::SMALLINT
            AS answer_ordinal,
        CASE event_type WHEN 'purchase' THEN 'note ' || v WHEN 'signup' THEN '' END AS plaintext, ts, event_id AS seq
        FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS v FROM events)
        JOIN orders ON user_id = o_orderkey""",
    # Folds
    "mem": "SELECT response_id, session_id, event_id FROM @re JOIN @se USING (session_id)",
    "tgt": """SELECT question_id, answer_ordinal, answer_option_id, event_id, type
        FROM @op JOIN @qu USING (question_id)""",
    **{
        f"{log}_click": f"""SELECT c.*, m.session_id, m.event_id, t.answer_option_id, t.type FROM @{log} c
            JOIN @mem m USING (response_id)
            JOIN @tgt t ON t.question_id = c.question_id AND t.answer_ordinal = c.answer_ordinal AND t.event_id = m.event_id
            WHERE c.answer_ordinal > 0"""
        for log in ("ch", "sc", "both")
    },
    **{
        f"{log}_radio": f"""SELECT response_id, question_id, arg_max(answer_option_id, seq) AS answer_option_id,
            arg_min(ts, seq) AS created, count(*) - 1 AS revision, arg_max(ts, seq) AS updated
            FROM @{log}_click WHERE type = 'radio' GROUP BY response_id, question_id"""
        for log in ("ch", "sc", "both")
    },
    **{
        f"{log}_check": f"""SELECT response_id, question_id, answer_option_id, arg_min(ts, seq) AS created,
            0::BIGINT AS revision, arg_min(ts, seq) AS updated
            FROM (SELECT c.* FROM @{log}_click c WHERE type = 'checkbox' AND NOT EXISTS (
                SELECT 1 FROM @{log} d WHERE d.response_id = c.response_id AND d.answer_ordinal = -c.answer_ordinal
                AND d.seq > c.seq))
            GROUP BY response_id, question_id, answer_option_id"""
        for log in ("ch", "sc", "both")
    },
    **{
        f"{log}_text": f"""SELECT response_id, question_id, arg_max(plaintext, seq) AS plaintext, arg_min(ts, seq) AS created,
            count(*) - 1 AS revision, arg_max(ts, seq) AS updated
            FROM (SELECT *, max(CASE WHEN plaintext = '' THEN seq END) OVER (PARTITION BY response_id, question_id) AS cleared
                  FROM @{log} WHERE answer_ordinal IS NULL)
            JOIN @mem USING (response_id) JOIN (SELECT question_id, event_id AS question_event FROM @qu) USING (question_id)
            WHERE plaintext <> '' AND (cleared IS NULL OR seq > cleared) AND event_id = question_event
            GROUP BY response_id, question_id"""
        for log in ("ch", "sc", "both")
    },
    **{
        f"{log}_touch": f"""SELECT r.response_id, r.session_id, r.client_key, r.created, coalesce(c.last, r.updated) AS updated
            FROM @re r LEFT JOIN (SELECT response_id, arg_max(ts, seq) AS last FROM @{log} GROUP BY response_id) c
            USING (response_id)"""
        for log in ("ch", "sc", "both")
    },
    # The line-item log followed by the event log.
    "both": "SELECT * REPLACE (seq - 9000000000000000000 AS seq) FROM @ch UNION ALL SELECT * FROM @sc",
    "ra": "SELECT * FROM @ch_radio UNION ALL SELECT * FROM @ch_check",
    "rp": "SELECT * FROM @ch_text",
    "rt": "SELECT * FROM @ch_touch",
    # Listings
    "spn": """SELECT session_id, presented_by_id AS presenter_id, name, is_session_owner FROM @sp
        JOIN (SELECT presenter_id AS presented_by_id, name FROM @pr) USING (presented_by_id)""",
    "aud": """SELECT CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE c_custkey + 2 END AS session_id, c_custkey AS presenter_id, c_name AS name,
        c_custkey % 3 = 0 OR c_custkey = 100 AS is_session_owner FROM customer""",
    "spk": "SELECT session_id, string_agg(name, ', ' ORDER BY name, presenter_id) AS speakers FROM @spn GROUP BY session_id",
    "spo": """SELECT session_id, string_agg(name, ', ' ORDER BY is_session_owner DESC, name, presenter_id) AS speakers
        FROM @spn GROUP BY session_id""",
    "li": """SELECT event_id, session_id, title, css, coalesce(speakers, '') AS speakers
        FROM @se JOIN (SELECT event_id, css FROM @ev) USING (event_id) LEFT JOIN @spk USING (session_id)""",
    "srq": f"""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderkey END AS response_id,
        CASE WHEN o_orderkey % 4 = 1 THEN o_custkey // 15 END AS presenter_id,
        CASE WHEN o_orderkey % 8 IN (1, 2, 3, 5) THEN {EVENT_OF_ORDER} END AS event_id FROM orders""",
    "route": """SELECT *, CASE WHEN coalesce(response_id, 0) <> 0 THEN 'response'
        WHEN coalesce(presenter_id, 0) <> 0 AND coalesce(event_id, 0) <> 0 THEN 'presenter_event'
        WHEN coalesce(event_id, 0) <> 0 THEN 'event' ELSE 'rejected' END AS route FROM @srq""",
    "secrets": """SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 7 = 6 THEN md5('unknown')
        WHEN s_suppkey % 2 = 0 THEN upper(md5('event-' || s_suppkey)) ELSE md5('event-' || s_suppkey) END AS secret
        FROM supplier""",
    "bysec": """SELECT request_id, min(event_id) AS event_id FROM @secrets JOIN @ev ON lower(secret) = lower(event_secret)
        GROUP BY request_id""",
    "mine": "SELECT * FROM @ev WHERE event_id IN (SELECT event_id FROM @eu WHERE \"user\" = 'MACHINERY')",
    # Question columns
    "indent": """SELECT question_id, max(indent)::INTEGER AS indent FROM @walk GROUP BY question_id""",
    "shown": """SELECT question_id, question_id NOT IN (SELECT if_selected_show_question_id FROM @op
        WHERE if_selected_show_question_id IS NOT NULL) AS display FROM @qu""",
    "pcts": """SELECT question_id, coalesce(n > 0, false) AS has_percentages FROM @qu
        LEFT JOIN (SELECT question_id, count(percent_value) AS n FROM @op GROUP BY question_id) USING (question_id)""",
    # Requests
    "inp": """SELECT c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN 's' || (c_custkey // 2) || '@example.org' END AS email,
        CASE WHEN c_custkey % 9 <> 0 THEN 'id-' || (c_custkey // 2) END AS identifier, c_custkey AS seq FROM customer""",
    "ins": """SELECT p_partkey // 20 + 1 AS event_id, upper(p_name) AS title,
        CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 2 = 1 THEN -p_partkey ELSE p_partkey END AS feed_id,
        p_partkey AS seq FROM part""",
    "inl": """SELECT l_partkey AS session_id, l_suppkey AS presenter_id, l_returnflag = 'A' AS is_owner,
        (l_orderkey * 32768 + datediff('day', DATE '1970-01-01', l_shipdate::DATE)) * 1024 + l_suppkey % 1024 AS seq
        FROM lineitem WHERE l_linenumber = 2 AND l_quantity <= 15""",
    "erq": """SELECT c_custkey AS request_id, c_name AS name,
        CASE c_custkey % 3 WHEN 0 THEN 'Supplier#' || lpad((c_custkey // 150 * 10)::VARCHAR, 9, '0') WHEN 2 THEN 'missing' END
            AS template_name,
        CASE WHEN c_custkey % 2 = 0 THEN '/new.css' END AS css, 'key-' || c_custkey AS api_key,
        md5('new-event-' || c_custkey) AS event_secret FROM customer""",
    # Every request has its own API key, so a request updates a stored event, creates one or fails.
    "known": "SELECT r.*, e.event_id FROM @erq r JOIN @ev e USING (api_key)",
    "fresh": f"""SELECT r.*, t.event_id AS template_id, t.name AS t_name, t.css AS t_css,
        {hashed("'event/' || r.request_id", 48)} AS event_id
        FROM (SELECT * FROM @erq WHERE api_key NOT IN (SELECT api_key FROM @ev WHERE api_key IS NOT NULL)) r
        LEFT JOIN (SELECT * FROM @ev WHERE is_template) t ON t.name = r.template_name""",
    "made": "SELECT * FROM @fresh WHERE template_name IS NULL OR template_id IS NOT NULL",
    "cq": f"""SELECT q.*, m.event_id AS new_event_id, {hashed("'question/' || m.event_id || '/' || q.question_id", 60)} AS new_id
        FROM @made m JOIN @qu q ON q.event_id = m.template_id""",
    "inx": """SELECT s.* FROM @se s JOIN (SELECT DISTINCT event_id, feed_id FROM @ins WHERE feed_id IS NOT NULL) i
        ON s.event_id = i.event_id AND s.feed_id = i.feed_id""",
    "doom_s": "SELECT session_id FROM @se WHERE event_id IN (SELECT event_id FROM @ev WHERE css IS NULL)",
    "doom_r": "SELECT response_id FROM @re WHERE session_id IN (SELECT session_id FROM @doom_s)",
    "doom_q": "SELECT question_id FROM @qu WHERE event_id IN (SELECT event_id FROM @ev WHERE css IS NULL)",
    "del_q": """SELECT question_id FROM @qu WHERE display_order IN (3, 5, 9)
        AND question_id NOT IN (SELECT if_selected_show_question_id FROM @op WHERE if_selected_show_question_id IS NOT NULL)
        AND question_id NOT IN (SELECT question_id FROM @rp)""",
    # Broken tables
    "b_se": """SELECT session_id, event_id, trunc(feed_id / 2)::BIGINT AS feed_id, title FROM @se
        UNION ALL SELECT * FROM @se WHERE title LIKE 'red%'""",
    "b_ev": "SELECT * REPLACE (CASE WHEN css IS NULL THEN 'same' ELSE api_key END AS api_key) FROM @ev",
    "b_pr": "SELECT * REPLACE (nullif(name, 'Supplier#000000001') AS name) FROM @pr WHERE email IS NOT NULL",
    "b_sp": "SELECT * REPLACE (true AS is_session_owner) FROM @sp",
    "b_qu": """SELECT * REPLACE (CASE WHEN is_required THEN 'slider' ELSE type END AS type,
        (display_order * 30)::SMALLINT AS display_order) FROM @qu""",
    "b_op": "SELECT * REPLACE ((percent_value * 2)::SMALLINT AS percent_value, repeat(annotation, 6) AS annotation) FROM @op",
    "b_re": "SELECT * FROM @rt WHERE created < TIMESTAMP '2001-01-01'",
}

RECURSIVE = {
    "walk": """SELECT question_id, 0 AS indent, if_selected_show_question_id AS nxt FROM @op
        WHERE question_id NOT IN (SELECT if_selected_show_question_id FROM @op WHERE if_selected_show_question_id IS NOT NULL)
        UNION ALL
        SELECT o.question_id, w.indent + 1, o.if_selected_show_question_id FROM @walk w
        JOIN @op o ON w.nxt = o.question_id""",
}


def _deps(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"@(\w+)", sql)) if n in CTES or n in RECURSIVE]


def build(body: str) -> str:
    """Put the named tables a statement uses before it, each after those it uses itself."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _deps(CTES[name] if name in CTES else RECURSIVE[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _deps(body):
        visit(name)
    recursive = "RECURSIVE " if any(n in RECURSIVE for n in order) else ""
    clauses = [f"fb_{n} AS ({CTES.get(n) or RECURSIVE[n]})" for n in order]
    sql = (f"WITH {recursive}" + ",\n".join(clauses) + "\n" if clauses else "") + body
    return re.sub(r"@(\w+)", lambda m: f"fb_{m[1]}" if m[1] in order else m[0], sql)


# List edits as SQL: one recursive step per edit.

CTES["qi"] = f"""SELECT p_partkey // 20 + 1 AS event_id, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey % 13 END AS position,
    p_name AS question, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS rn,
    {hashed("'new question/' || (p_partkey // 20 + 1) || '/' || p_partkey", 60)} AS new_id FROM part"""
CTES["oi"] = f"""SELECT (p_partkey // 20 + 1) * 100 + 5 AS question_id,
    CASE WHEN p_partkey % 17 <> 0 THEN p_partkey % 13 END AS position, p_size::SMALLINT AS percent_value, p_name AS annotation,
    row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS rn,
    {hashed("'new option/' || ((p_partkey // 20 + 1) * 100 + 5) || '/' || p_partkey", 60)} AS new_id FROM part"""
CTES["qp"] = """SELECT p_partkey // 20 + 1 AS event_id, (p_partkey // 20 + 1) * 100 + 1 + p_partkey % 10 AS question_id,
    CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 13 END AS position,
    CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_partkey END AS question,
    CASE WHEN p_partkey % 4 = 0 THEN p_type END AS description,
    CASE WHEN p_partkey % 5 = 0 THEN p_size END AS optimal_percent,
    CASE WHEN p_partkey % 6 = 0 THEN p_size > 25 END AS is_required, p_partkey AS seq,
    row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS rn FROM part"""


def _inserts(parent: str, item: str, order: str, table: str, requests: str, name: str) -> str:
    return f"""SELECT {parent}, 0 AS step, list({item} ORDER BY {order}) AS ids FROM @{table} GROUP BY {parent}
        UNION ALL
        SELECT {parent}, step + 1, ids[1:place - 1] || [new_id] || ids[place:] FROM (
            SELECT w.{parent}, w.step, w.ids, p.new_id,
                least(greatest(coalesce(p.position, len(w.ids) + 1), 1), len(w.ids) + 1) AS place
            FROM @{name} w JOIN @{requests} p ON p.{parent} = w.{parent} AND p.rn = w.step + 1)"""


RECURSIVE["ins_q"] = _inserts("event_id", "question_id", "display_order", "qu", "qi", "ins_q")
RECURSIVE["ins_o"] = _inserts("question_id", "answer_option_id", "answer_ordinal", "op", "oi", "ins_o")
# A moved question goes before the one now at the position; its own place is empty meanwhile.
RECURSIVE["mov_q"] = """SELECT event_id, 0 AS step, list(question_id ORDER BY display_order) AS ids FROM @qu GROUP BY event_id
    UNION ALL
    SELECT event_id, step + 1, CASE WHEN position IS NULL THEN ids
        ELSE rest[1:place - 1] || [question_id] || rest[place:] END FROM (
        SELECT w.event_id, w.step, w.ids, p.position, p.question_id,
            list_filter(w.ids, lambda x: x <> p.question_id) AS rest,
            CASE WHEN p.position > len(w.ids) THEN len(w.ids)
                 WHEN p.position > list_position(w.ids, p.question_id) THEN p.position - 1
                 ELSE greatest(p.position, 1) END AS place
        FROM @mov_q w JOIN @qp p ON p.event_id = w.event_id AND p.rn = w.step + 1)"""


def _final_list(name: str, parent: str, item: str, order: str) -> str:
    return f"""SELECT {parent}, unnest(ids) AS {item}, generate_subscripts(ids, 1)::SMALLINT AS {order} FROM (
        SELECT {parent}, arg_max(ids, step) AS ids FROM @{name} GROUP BY {parent})"""


CTES["ins_q_final"] = _final_list("ins_q", "event_id", "question_id", "display_order")
CTES["ins_o_final"] = _final_list("ins_o", "question_id", "answer_option_id", "answer_ordinal")
CTES["mov_q_final"] = _final_list("mov_q", "event_id", "question_id", "display_order")

# Presenter upsert. In the test requests no request knows both keys, so each finds at most one presenter.
CTES["inp_hit"] = """SELECT i.*, coalesce(p.presenter_id, q.presenter_id) AS presenter_id FROM @inp i
    LEFT JOIN @pr p ON p.identifier = i.identifier LEFT JOIN @pr q ON q.email = i.email"""
CTES["inp_upd"] = """SELECT presenter_id, arg_max(name, seq) AS name, arg_max(identifier, seq) AS identifier,
    arg_max(email, seq) AS email FROM @inp_hit WHERE presenter_id IS NOT NULL GROUP BY presenter_id"""
CTES["inp_new"] = """SELECT coalesce('i:' || identifier, 'e:' || email) AS ident, arg_max(name, seq) AS name,
    any_value(email) AS email, any_value(identifier) AS identifier FROM @inp_hit WHERE presenter_id IS NULL GROUP BY 1"""

CTES["imported"] = f"""SELECT p.presenter_id, coalesce(u.name, p.name) AS name, coalesce(u.email, p.email) AS email,
    coalesce(u.identifier, p.identifier) AS identifier FROM @pr p LEFT JOIN @inp_upd u USING (presenter_id)
    UNION ALL SELECT {hashed('ident', 48)}, name, email, identifier FROM @inp_new"""

# Ids of orders, three draws deep.
CTES["id0"] = f"SELECT 'order/' || o_orderkey AS k, {hashed("'order/' || o_orderkey", 48)} AS id FROM orders"
CTES["id_lost"] = """SELECT k FROM (SELECT *, min(k) OVER (PARTITION BY id) AS owner FROM @id0)
    WHERE k <> owner OR id IN (SELECT session_id FROM @se)"""
CTES["id1"] = f"""SELECT k, {hashed('k', 48, 1)} AS id FROM @id_lost"""
CTES["id1_won"] = """SELECT min(k) AS k, id FROM @id1 WHERE id NOT IN (SELECT id FROM @id0)
    AND id NOT IN (SELECT session_id FROM @se) GROUP BY id"""
CTES["id2"] = f"""SELECT k, {hashed('k', 48, 2)} AS id FROM @id1 WHERE k NOT IN (SELECT k FROM @id1_won)"""
CTES["id2_won"] = """SELECT min(k) AS k, id FROM @id2 WHERE id NOT IN (SELECT id FROM @id0) AND id NOT IN (SELECT id FROM @id1_won)
    AND id NOT IN (SELECT session_id FROM @se) GROUP BY id"""

LISTED = "event_id, session_id, title, css, speakers"
ANSWERS = "response_id, question_id, answer_option_id, created, revision, updated"


def _state(log: str) -> str:
    return f"""SELECT response_id, NULL::BIGINT AS question_id, NULL::BIGINT AS answer_option_id, NULL::VARCHAR AS plaintext,
        created, NULL::BIGINT AS revision, updated FROM @{log}_touch
    UNION ALL SELECT response_id, question_id, answer_option_id, NULL, created, revision, updated FROM @{log}_radio
    UNION ALL SELECT response_id, question_id, answer_option_id, NULL, created, revision, updated FROM @{log}_check
    UNION ALL SELECT response_id, question_id, NULL, plaintext, created, revision, updated FROM @{log}_text"""


def _counts(table: str, cte: str, key: str) -> str:
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, sum({key})::BIGINT AS key_sum FROM @{cte}"


TABLE_CTES = {
    "events": "ev", "event_users": "eu", "presenters": "pr", "sessions": "se", "session_presenters": "sp",
    "questions": "qu", "answer_options": "op", "responses": "rt", "response_answers": "ra", "response_plaintext": "rp",
}
BROKEN_CTES = {
    **TABLE_CTES, "events": "b_ev", "presenters": "b_pr", "sessions": "b_se", "session_presenters": "b_sp",
    "questions": "b_qu", "answer_options": "b_op", "responses": "b_re",
}


def _key(columns: list[str]) -> str:
    return " || '/' || ".join(f'"{c}"::VARCHAR' for c in columns)


def _repeated(rule: str, cte: str, key: list[str], only: str = "true") -> str:
    names = ", ".join(f'"{k}"' for k in key)
    return (
        f"SELECT '{rule}' AS rule, {_key(key)} AS key, count(*) AS n FROM @{cte} WHERE {only} "
        f"GROUP BY {names} HAVING count(*) > 1"
    )


def _unique() -> str:
    keys = [
        ("pk_events", "events", ["event_id"]), ("pk_event_users", "event_users", ["event_id", "user"]),
        ("pk_presenters", "presenters", ["presenter_id"]), ("pk_sessions", "sessions", ["session_id"]),
        ("pk_session_presenters", "session_presenters", ["session_id", "presented_by_id"]),
        ("pk_questions", "questions", ["question_id"]), ("uq_questions", "questions", ["event_id", "display_order"]),
        ("pk_answer_options", "answer_options", ["answer_option_id"]),
        ("uq_answer_options", "answer_options", ["question_id", "answer_ordinal"]),
        ("pk_responses", "responses", ["response_id"]),
        ("pk_response_answers", "response_answers", ["response_id", "question_id", "answer_option_id"]),
        ("pk_response_plaintext", "response_plaintext", ["response_id", "question_id"]),
    ]
    return " UNION ALL ".join(_repeated(rule, BROKEN_CTES[t], key) for rule, t, key in keys)


def _orphans(rule: str, child: str, key: str, parent: str, parent_key: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, {key}::VARCHAR AS key, count(*) AS n FROM @{BROKEN_CTES[child]} "
        f"WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM @{BROKEN_CTES[parent]}) GROUP BY {key}"
    )


def _not_null_length() -> str:
    checks = [
        ("not_null_presenters", "name", "b_pr", "name IS NULL"),
        ("max_length_answer_options", "annotation", "b_op", "length(annotation) > 200"),
        ("max_length_presenters", "name", "b_pr", "length(name) > 200"),
        ("max_length_sessions", "title", "b_se", "length(title) > 200"),
        ("max_length_questions", "question", "b_qu", "length(question) > 200"),
        ("max_length_events", "name", "b_ev", "length(name) > 200"),
        ("not_null_sessions", "title", "b_se", "title IS NULL"),
        ("not_null_response_plaintext", "plaintext", "rp", "plaintext IS NULL"),
        ("not_null_response_answers", "created", "ra", "created IS NULL"),
    ]
    parts = [
        f"SELECT '{rule}' AS rule, '{key}' AS key, count(*) AS n FROM @{cte} WHERE {bad}" for rule, key, cte, bad in checks
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


REPORT_PARTS = """
    SELECT event_id, 'event' AS part, event_id::VARCHAR AS part_id, name AS label, NULL::BIGINT AS presenter_id,
        NULL::BIGINT AS session_id, NULL::BIGINT AS n_options, NULL::BIGINT AS n_answers, NULL::BIGINT AS n_texts,
        NULL::VARCHAR AS first_text FROM @ev
    UNION ALL SELECT DISTINCT event_id, 'presenter', presenter_id::VARCHAR, name, presenter_id, NULL, NULL, NULL, NULL, NULL
        FROM @spn JOIN @se USING (session_id)
    UNION ALL SELECT event_id, 'question', question_id::VARCHAR, question, NULL, NULL, n, NULL, NULL, NULL
        FROM @qu LEFT JOIN (SELECT question_id, count(*) AS n FROM @op GROUP BY question_id) USING (question_id)
    UNION ALL SELECT event_id, 'session', session_id::VARCHAR, title, NULL, session_id, NULL, NULL, NULL, NULL FROM @se
    UNION ALL SELECT event_id, 'session_presenter', session_id::VARCHAR, NULL, presented_by_id, session_id, NULL, NULL, NULL, NULL
        FROM @sp JOIN @se USING (session_id)
    UNION ALL SELECT event_id, 'response', response_id::VARCHAR, NULL, NULL, session_id, NULL, a.n, p.n, p.first_text
        FROM @mem LEFT JOIN (SELECT response_id, count(*) AS n FROM @ra GROUP BY response_id) a USING (response_id)
        LEFT JOIN (SELECT response_id, count(*) AS n, arg_min(plaintext, question_id) AS first_text FROM @rp
                   GROUP BY response_id) p USING (response_id)"""

REPORT_ROWS = """
    SELECT event_id, event_name, session_id, session_title, response_id, question_id, display_order, question_type,
        optimal_percent, answer_option_id, answer_ordinal, percent_value, text, revision, created, updated
    FROM (SELECT response_id, question_id, answer_option_id, answer_ordinal, percent_value, NULL::VARCHAR AS text,
              revision, created, updated
          FROM @ra JOIN (SELECT answer_option_id, answer_ordinal, percent_value FROM @op) USING (answer_option_id)
          UNION ALL SELECT response_id, question_id, NULL, NULL, NULL, plaintext, revision, created, updated FROM @rp)
    JOIN (SELECT response_id, session_id FROM @re) USING (response_id)
    JOIN (SELECT question_id, display_order, type AS question_type, optimal_percent FROM @qu) USING (question_id)
    JOIN (SELECT session_id, event_id, title AS session_title FROM @se) USING (session_id)
    JOIN (SELECT event_id, name AS event_name FROM @ev) USING (event_id)"""

NULL_RESPONSE = "NULL::BIGINT AS response_id, session_id, NULL::VARCHAR AS client_key, NULL::TIMESTAMP AS created, NULL::TIMESTAMP AS updated"

BODIES: dict[str, str] = {
    # Sources and sinks
    "load_feedback": " UNION ALL ".join(
        _counts(t, TABLE_CTES[t], key)
        for t, key in [
            ("events", "event_id"), ("event_users", "event_id"), ("presenters", "presenter_id"), ("sessions", "session_id"),
            ("session_presenters", "presented_by_id"), ("questions", "question_id"), ("answer_options", "answer_option_id"),
            ("responses", "response_id"), ("response_answers", "answer_option_id"), ("response_plaintext", "question_id"),
        ]
    ),
    "read_session_feed_sessions": """SELECT 'key-' || event_id AS event_key, session_id AS feed_id, title FROM @se
        WHERE session_id % 11 <> 0 AND session_id % 13 <> 0""",
    "read_session_feed_speakers": """SELECT 'key-' || event_id AS event_key, session_id AS feed_id,
        (row_number() OVER w - 1)::INTEGER AS position, 'id-' || presenter_id AS identifier, name,
        row_number() OVER w = 1 AS is_owner
        FROM @spn JOIN @se USING (session_id) WHERE session_id % 11 <> 0 AND session_id % 13 <> 0
        WINDOW w AS (PARTITION BY session_id ORDER BY is_session_owner DESC, presenter_id)""",
    "read_answer_changes": """SELECT response_id, question_id, answer_ordinal, coalesce(plaintext, 'null') AS plaintext, ts, seq
        FROM @ch""",
    "template_seed_questions": "SELECT * FROM @qu",
    "template_seed_options": "SELECT * FROM @op",
    "write_event_reports": REPORT_PARTS,
    # Access
    "my_events": "SELECT * EXCLUDE (event_secret) FROM @mine",
    "my_events_admin": "SELECT e.* EXCLUDE (event_secret) FROM @ev e LEFT JOIN @eu USING (event_id)",
    "my_sessions": "SELECT session_id, event_id, title FROM @se WHERE event_id IN (SELECT event_id FROM @mine)",
    "my_questions": """SELECT question_id, event_id, display_order, question, is_required, has_plaintext FROM @qu
        WHERE event_id IN (SELECT event_id FROM @mine)""",
    "my_answer_options": """SELECT event_id, question_id, answer_option_id, answer_ordinal, percent_value,
        if_selected_show_question_id, annotation FROM @op JOIN (SELECT question_id, event_id FROM @qu) USING (question_id)
        WHERE event_id IN (SELECT event_id FROM @mine)""",
    # Questions
    "question_indent": "SELECT * FROM @indent",
    "question_depths": """SELECT question_id, CASE WHEN NOT stuck THEN indent END AS indent,
            CASE WHEN stuck THEN 'on or behind a cycle of follow-up questions' END AS error
        FROM (SELECT *, question_id // 100 % 10 = 3 AND question_id % 100 IN (2, 3, 4) AS stuck FROM @indent)""",
    "import_feed": """SELECT c_custkey AS request_id, session_id AS feed_id, title,
            max('id-' || presenter_id) FILTER (is_session_owner) AS owner,
            coalesce(string_agg('id-' || presenter_id || '=' || name, ',' ORDER BY 'id-' || presenter_id || '=' || name), '') AS speakers,
            NULL::VARCHAR AS error
        FROM customer JOIN @se ON 'key-' || c_custkey = 'key-' || event_id LEFT JOIN @spn USING (session_id)
        WHERE session_id % 11 <> 0 AND session_id % 13 <> 0 AND c_custkey NOT IN (SELECT request_id FROM @fresh WHERE template_name IS NOT NULL AND template_id IS NULL)
        GROUP BY c_custkey, session_id, title
        UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, 'no event template of that name' FROM customer WHERE c_custkey IN (SELECT request_id FROM @fresh WHERE template_name IS NOT NULL AND template_id IS NULL)""",
    "question_display": "SELECT * FROM @shown",
    "question_has_percentages": "SELECT * FROM @pcts",
    "question_allow_plaintext": "SELECT question_id, has_plaintext OR type = 'text' AS allow_plaintext FROM @qu",
    "pack_order": """SELECT question_id, (display_order * 3)::SMALLINT AS display_order,
        row_number() OVER (PARTITION BY event_id ORDER BY display_order)::SMALLINT AS packed FROM @qu""",
    # Lookups
    "list_templates": "SELECT name, css FROM @ev WHERE is_template",
    "resolve_template": """SELECT request_id, e.event_id AS template_id,
        CASE WHEN template_name IS NOT NULL AND e.event_id IS NULL THEN 'no event template of that name' END AS error
        FROM @erq LEFT JOIN @ev e ON e.is_template AND e.name = template_name""",
    "open_sessions": """SELECT session_id, event_id, title FROM @se JOIN @ev e USING (event_id)
        WHERE coalesce(e.accepts_responses_from, TIMESTAMP '2000-01-01') < TIMESTAMP '2000-06-01'
        AND coalesce(e.accepts_responses_to, TIMESTAMP '2099-12-31') > TIMESTAMP '2000-06-01'""",
    "events_by_secret": "SELECT * FROM @bysec",
    "speaker_names": f"SELECT {LISTED} FROM @li",
    "search_sessions": f"SELECT {LISTED} FROM @li WHERE contains(lower(title || chr(10) || speakers), 'red')",
    "search_sessions_by_speaker": f"SELECT {LISTED} FROM @li WHERE contains(lower(title || chr(10) || speakers), 'supplier#00000000')",
    "share_links": """SELECT session_id, event_id, 'https://feedback.example.org/' || session_id AS session_url,
        'https://feedback.example.org/event/' || event_id AS event_url, '/qr/' || session_id AS qr_path FROM @se""",
    "route_session_requests": "SELECT request_id, route FROM @route",
    "requested_events": """SELECT request_id, route, m.event_id FROM @route JOIN @mem m USING (response_id) WHERE route = 'response'
        UNION ALL SELECT request_id, route, event_id FROM @route WHERE route IN ('presenter_event', 'event')""",
    "sessions_by_response": f"""SELECT {LISTED}, n_requests FROM @li JOIN (SELECT m.event_id, count(*) AS n_requests
        FROM @srq JOIN @mem m USING (response_id) GROUP BY m.event_id) USING (event_id)""",
    "sessions_by_presenter_event": f"""SELECT {LISTED}, n_requests FROM @li JOIN (SELECT event_id, count(*) AS n_requests
        FROM @sp JOIN @se USING (session_id) GROUP BY event_id) USING (event_id)""",
    "sessions_by_presenter_event_strict": f"""SELECT {LISTED}, presenter_id, n_requests FROM @li
        JOIN (SELECT session_id, presented_by_id AS presenter_id FROM @sp) USING (session_id)
        JOIN (SELECT presented_by_id AS presenter_id, event_id, count(*) AS n_requests
              FROM @sp JOIN @se USING (session_id) GROUP BY ALL) USING (presenter_id, event_id)""",
    "sessions_by_event": f"""SELECT {LISTED}, n_requests FROM @li JOIN (SELECT event_id, count(*) AS n_requests
        FROM @srq WHERE event_id IS NOT NULL GROUP BY event_id) USING (event_id)""",
    # Documents
    "session_speaker_rows": "SELECT * FROM @spn",
    "session_speakers_by_name": "SELECT * FROM @spk",
    "session_speakers": "SELECT * FROM @spo",
    "session_speakers_long": """SELECT * FROM (WITH placed AS (SELECT session_id, name, row_number() OVER (PARTITION BY session_id
            ORDER BY is_session_owner DESC, name, presenter_id) - 1 AS place, count(*) OVER (PARTITION BY session_id) AS n FROM @aud)
        SELECT session_id, (place // 500)::INTEGER AS page, ((n + 499) // 500)::INTEGER AS pages, (place % 500)::INTEGER AS position, name
        FROM placed)""",
    "search_sessions_long": """SELECT * FROM (WITH whole AS (SELECT session_id, string_agg(name, ', ' ORDER BY name, presenter_id) AS names, count(*) AS n
            FROM @aud GROUP BY session_id)
        SELECT needle, session_id, 'Talk ' || session_id AS title, unnest(range((n + 499) // 500))::INTEGER AS page,
            least(500, n - 500 * unnest(range((n + 499) // 500)))::INTEGER AS n_names
        FROM whole, (VALUES ('00098, customer#000000100'), ('00749, customer#000000751')) AS v(needle)
        WHERE contains(lower('Talk ' || session_id || chr(10) || names), needle))""",
    "sessions_blob_long": """SELECT * FROM (WITH held AS (SELECT session_id, 'Talk ' || session_id AS title, count(*) AS n FROM @aud GROUP BY session_id),
        items AS (SELECT session_id, title, unnest(range((n + 499) // 500)) AS speaker_page FROM held),
        placed AS (SELECT *, row_number() OVER (ORDER BY title, session_id, speaker_page) - 1 AS place, count(*) OVER () AS n FROM items)
        SELECT 1::BIGINT AS event_id, (place // 500)::INTEGER AS page, ((n + 499) // 500)::INTEGER AS pages,
            (place % 500)::INTEGER AS position, session_id, speaker_page::INTEGER AS speaker_page FROM placed)""",
    "sessions_blob": """SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY title, session_id) - 1)::INTEGER AS position,
        session_id, title, css, speakers FROM @li""",
    "admin_event_info": """SELECT request_id, event_id, name,
        (row_number() OVER (PARTITION BY request_id ORDER BY title, session_id) - 1)::INTEGER AS position,
        session_id, title, css, speakers FROM @bysec JOIN @li USING (event_id) JOIN (SELECT event_id, name FROM @ev) USING (event_id)""",
    "admin_event_json": """SELECT request_id, event_id, name, css, n_sessions, first_title, first_speaker
        FROM @bysec JOIN (SELECT event_id, name, css FROM @ev) USING (event_id)
        LEFT JOIN (SELECT event_id, count(*) AS n_sessions, arg_min(title, row(title, session_id)) AS first_title,
            arg_min(nullif(split_part(speakers, ', ', 1), ''), row(title, session_id)) AS any_speaker FROM @li GROUP BY event_id)
            USING (event_id)
        LEFT JOIN (SELECT event_id, nullif(split_part(speakers, ', ', 1), '') AS first_speaker FROM @li
            QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY title, session_id) = 1) USING (event_id)""",
    "questionnaire": """SELECT response_id, client_key, css, title, event_id, coalesce(speakers, '') AS speakers, form
        FROM @re JOIN @se USING (session_id) JOIN (SELECT event_id, css FROM @ev) USING (event_id) LEFT JOIN @spo USING (session_id)
        JOIN (SELECT event_id, string_agg(concat_ws(':', question_id, coalesce(i.indent, 0), display::INTEGER,
                  (has_plaintext OR type = 'text')::INTEGER, has_percentages::INTEGER, coalesce(n, 0)), ' '
                  ORDER BY display_order) AS form
              FROM @qu LEFT JOIN @indent i USING (question_id) JOIN @shown USING (question_id) JOIN @pcts USING (question_id)
              LEFT JOIN (SELECT question_id, count(*) AS n FROM @op GROUP BY question_id) USING (question_id)
              GROUP BY event_id) USING (event_id)""",
    "questionnaire_options": """SELECT event_id,
        (dense_rank() OVER (PARTITION BY event_id ORDER BY display_order) - 1)::INTEGER AS question_position, question_id, question,
        description, is_required, type, coalesce(i.indent, 0)::INTEGER AS indent, display,
        CASE WHEN answer_option_id IS NOT NULL
            THEN (row_number() OVER (PARTITION BY question_id ORDER BY answer_ordinal) - 1)::INTEGER END AS option_position,
        answer_ordinal, annotation, if_selected_show_question_id AS follow_up_id, css_classes AS class_list
        FROM @qu LEFT JOIN @op USING (question_id) LEFT JOIN @indent i USING (question_id) JOIN @shown USING (question_id)""",
    "event_report": """SELECT request_id, event_id, name, n_presenters, 10::BIGINT AS n_questions, session_id, feed_id, title, owner_id,
        response_id, r.created, r.updated, option_ids, texts
        FROM @bysec JOIN (SELECT event_id, name FROM @ev) USING (event_id) JOIN @se USING (event_id) JOIN @rt r USING (session_id)
        LEFT JOIN (SELECT event_id, coalesce(count(DISTINCT presented_by_id), 0) AS n_presenters
              FROM @sp JOIN @se USING (session_id) GROUP BY event_id) USING (event_id)
        LEFT JOIN (SELECT session_id, presented_by_id AS owner_id FROM @sp WHERE is_session_owner) USING (session_id)
        LEFT JOIN (SELECT response_id, string_agg(answer_option_id::VARCHAR, ',' ORDER BY question_id, answer_option_id) AS option_ids
              FROM @ra GROUP BY response_id) USING (response_id)
        LEFT JOIN (SELECT response_id, string_agg(question_id || '=' || plaintext, ',' ORDER BY question_id) AS texts
              FROM @rp GROUP BY response_id) USING (response_id)""",
    "report_rows": REPORT_ROWS,
    # Upserts
    "upsert_presenters": "SELECT *, NULL::VARCHAR AS error FROM @imported",
    "upsert_sessions": f"""SELECT s.session_id, s.event_id, s.feed_id, coalesce(i.title, s.title) AS title FROM @se s
        LEFT JOIN (SELECT event_id, feed_id, arg_max(title, seq) AS title FROM @ins GROUP BY event_id, feed_id) i
            ON i.event_id = s.event_id AND i.feed_id = s.feed_id
        UNION ALL SELECT {hashed("'session/' || event_id || '/' || feed_id", 48)}, event_id, feed_id, title FROM @ins i
        WHERE feed_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM @se s WHERE s.event_id = i.event_id AND s.feed_id = i.feed_id)
        UNION ALL SELECT {hashed("'session/' || event_id || '/seq/' || seq", 48)}, event_id, feed_id, title FROM @ins
        WHERE feed_id IS NULL""",
    "upsert_sessions_results": f"""SELECT i.seq, s.session_id, NULL::VARCHAR AS error FROM @ins i JOIN @se s
            ON i.event_id = s.event_id AND i.feed_id = s.feed_id
        UNION ALL SELECT seq, CASE WHEN feed_id IS NULL THEN {hashed("'session/' || event_id || '/seq/' || seq", 48)}
            ELSE {hashed("'session/' || event_id || '/' || feed_id", 48)} END, NULL FROM @ins i
        WHERE NOT EXISTS (SELECT 1 FROM @se s WHERE s.event_id = i.event_id AND s.feed_id = i.feed_id)
        UNION ALL SELECT seq + 100000000, NULL, 'event not found' FROM @ins""",
    "upsert_session_presenters_rejected": """SELECT seq, -session_id - 1 AS session_id, presenter_id, 'session not found' AS error FROM @inl
        UNION ALL SELECT seq, session_id, -presenter_id - 1, 'presenter not found' FROM @inl""",
    "upsert_sessions_links": "SELECT * FROM @sp WHERE session_id NOT IN (SELECT session_id FROM @inx)",
    # Replays the requests of a session: whoever last became owner, unless told otherwise since.
    "upsert_session_presenters": """SELECT session_id, presented_by_id, coalesce(is_owner AND NOT EXISTS (
            SELECT 1 FROM @inl later WHERE later.session_id = l.session_id AND later.presenter_id <> l.presented_by_id
            AND later.is_owner AND later.seq > l.seq), false) AS is_session_owner
        FROM (SELECT session_id, presenter_id AS presented_by_id, arg_max(is_owner, seq) AS is_owner, max(seq) AS seq
              FROM (SELECT * FROM @inl UNION ALL SELECT session_id, presented_by_id, is_session_owner, -1 FROM @sp)
              GROUP BY session_id, presenter_id) l""",
    "create_events": """SELECT e.event_id, coalesce(k.name, e.name) AS name, CASE WHEN k.api_key IS NULL THEN e.css ELSE k.css END AS css,
            e.is_template AND k.api_key IS NULL AS is_template,
            CASE WHEN k.api_key IS NULL THEN e.accepts_responses_from END AS accepts_responses_from,
            CASE WHEN k.api_key IS NULL THEN e.accepts_responses_to ELSE TIMESTAMP '2001-01-01' END AS accepts_responses_to,
            e.api_key, e.event_secret FROM @ev e LEFT JOIN @known k USING (event_id)
        UNION ALL SELECT event_id, name, coalesce(css, t_css), false, NULL, TIMESTAMP '2001-01-01',
            CASE WHEN template_id IS NOT NULL THEN api_key END, event_secret FROM @made""",
    "create_events_questions": """SELECT * FROM @qu UNION ALL SELECT new_id, new_event_id, display_order, question, description,
        optimal_percent, is_required, type, has_plaintext FROM @cq""",
    "create_events_options": f"""SELECT * FROM @op UNION ALL
        SELECT q.new_id, {hashed("'option/' || q.new_event_id || '/' || o.answer_option_id", 60)}, o.answer_ordinal, o.percent_value,
            f.new_id, o.annotation, o.css_classes
        FROM @op o JOIN @cq q ON q.question_id = o.question_id
        LEFT JOIN @cq f ON f.question_id = o.if_selected_show_question_id AND f.new_event_id = q.new_event_id""",
    "create_events_results": """SELECT request_id, event_id, event_secret, NULL::VARCHAR AS error FROM @made
        UNION ALL SELECT request_id, event_id, NULL, NULL FROM @known
        UNION ALL SELECT request_id, NULL, NULL, 'no event template of that name' FROM @fresh
        WHERE template_name IS NOT NULL AND template_id IS NULL""",
    "grant_event_users": """SELECT DISTINCT event_id, name AS "user" FROM (
            SELECT event_id, unnest(string_split(coalesce(userlist || ',', '') || me, ',')) AS entry FROM (
                SELECT c_custkey // 15 + 1 AS event_id,
                    CASE c_custkey % 4 WHEN 0 THEN NULL
                        WHEN 1 THEN 'Supplier#' || lpad((c_custkey // 15)::VARCHAR, 9, '0') || ',' || c_name
                        WHEN 2 THEN 'DOM\\Supplier#' || lpad((c_custkey // 15)::VARCHAR, 9, '0') || ',,' || c_name
                        ELSE c_mktsegment END AS userlist,
                    CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#000000001' ELSE 'nobody' END AS me FROM customer))
        JOIN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'DOM\\' || s_name ELSE s_name END AS name, s_name AS short FROM supplier)
            ON entry = name OR (entry = short AND short <> name)""",
    "init_responses": f"""SELECT o_orderkey AS request_id, {hashed("'response/' || o_orderkey", 48)} AS response_id,
            o_custkey AS session_id, md5('client/' || o_orderkey) AS client_key, o_orderdate AS created, o_orderdate AS updated,
            NULL::VARCHAR AS error
        FROM orders JOIN @se s ON s.session_id = o_custkey JOIN @ev e USING (event_id)
        WHERE coalesce(e.accepts_responses_from, TIMESTAMP '2000-01-01') < o_orderdate
        AND coalesce(e.accepts_responses_to, TIMESTAMP '2099-12-31') > o_orderdate
        UNION ALL SELECT o_orderkey, NULL, o_custkey, NULL, NULL, NULL, 'unknown session, or it takes no responses'
        FROM orders LEFT JOIN @se s ON s.session_id = o_custkey LEFT JOIN @ev e USING (event_id)
        WHERE NOT coalesce(coalesce(e.accepts_responses_from, TIMESTAMP '2000-01-01') < o_orderdate
            AND coalesce(e.accepts_responses_to, TIMESTAMP '2099-12-31') > o_orderdate AND e.event_id IS NOT NULL, false)""",
    "assign_ids": """SELECT k AS natural_key, id FROM @id0 WHERE k NOT IN (SELECT k FROM @id_lost)
        UNION ALL SELECT k, id FROM @id1_won UNION ALL SELECT k, id FROM @id2_won""",
    # List edits
    "insert_questions": """SELECT question_id, f.event_id, f.display_order, coalesce(q.question, i.question) AS question, q.description,
        q.optimal_percent, coalesce(q.is_required, false) AS is_required, coalesce(q.type, 'radio') AS type,
        coalesce(q.has_plaintext, false) AS has_plaintext FROM @ins_q_final f
        LEFT JOIN @qu q USING (question_id) LEFT JOIN @qi i ON i.new_id = f.question_id""",
    "update_questions": """SELECT question_id, f.event_id, f.display_order, coalesce(p.question, q.question) AS question,
        coalesce(p.description, q.description) AS description, coalesce(p.optimal_percent, q.optimal_percent)::SMALLINT AS optimal_percent,
        coalesce(p.is_required, q.is_required) AS is_required, q.type, q.has_plaintext
        FROM @mov_q_final f JOIN @qu q USING (question_id) LEFT JOIN (
            SELECT question_id, arg_max(question, seq) AS question, arg_max(description, seq) AS description,
                arg_max(optimal_percent, seq) AS optimal_percent, arg_max(is_required, seq) AS is_required
            FROM @qp GROUP BY question_id) p USING (question_id)""",
    "insert_answer_options": """SELECT f.question_id, answer_option_id, f.answer_ordinal,
        coalesce(o.percent_value, i.percent_value) AS percent_value, o.if_selected_show_question_id,
        coalesce(o.annotation, i.annotation) AS annotation, o.css_classes FROM @ins_o_final f
        LEFT JOIN @op o USING (answer_option_id) LEFT JOIN @oi i ON i.new_id = f.answer_option_id""",
    # Deletes
    "delete_questions": """SELECT question_id, row_number() OVER (PARTITION BY event_id ORDER BY display_order)::SMALLINT AS display_order,
            NULL::VARCHAR AS error FROM @qu WHERE question_id NOT IN (SELECT question_id FROM @del_q)
        UNION ALL SELECT question_id, NULL, 'still referenced' FROM @qu
        WHERE display_order IN (3, 5, 9) AND question_id NOT IN (SELECT question_id FROM @del_q)""",
    "delete_questions_answers": f"SELECT {ANSWERS} FROM @ra WHERE question_id NOT IN (SELECT question_id FROM @del_q)",
    "delete_events": """SELECT 'events' AS table_name, event_id::VARCHAR AS row_key FROM @ev WHERE css IS NOT NULL
        UNION ALL SELECT 'event_users', event_id || '/' || "user" FROM @eu WHERE event_id IN (SELECT event_id FROM @ev WHERE css IS NOT NULL)
        UNION ALL SELECT 'presenters', presenter_id::VARCHAR FROM @pr WHERE presenter_id IN (
            SELECT presented_by_id FROM @sp WHERE session_id NOT IN (SELECT session_id FROM @doom_s))
        UNION ALL SELECT 'sessions', session_id::VARCHAR FROM @se WHERE session_id NOT IN (SELECT session_id FROM @doom_s)
        UNION ALL SELECT 'session_presenters', session_id || '/' || presented_by_id FROM @sp
            WHERE session_id NOT IN (SELECT session_id FROM @doom_s)
        UNION ALL SELECT 'questions', question_id::VARCHAR FROM @qu WHERE question_id NOT IN (SELECT question_id FROM @doom_q)
        UNION ALL SELECT 'answer_options', answer_option_id::VARCHAR FROM @op WHERE question_id NOT IN (SELECT question_id FROM @doom_q)
        UNION ALL SELECT 'responses', response_id::VARCHAR FROM @re WHERE response_id NOT IN (SELECT response_id FROM @doom_r)
        UNION ALL SELECT 'response_answers', response_id || '/' || question_id || '/' || answer_option_id FROM @ra
            WHERE response_id NOT IN (SELECT response_id FROM @doom_r)
        UNION ALL SELECT 'response_plaintext', response_id || '/' || question_id FROM @rp
            WHERE response_id NOT IN (SELECT response_id FROM @doom_r)""",
    "orphan_presenters": "SELECT * FROM @imported WHERE presenter_id NOT IN (SELECT presented_by_id FROM @sp)",
    # Folds
    "fold_radio": f"SELECT {ANSWERS} FROM @ch_radio",
    "fold_checkbox": f"SELECT {ANSWERS} FROM @ch_check",
    "fold_checkbox_scoped": """SELECT response_id, question_id, answer_option_id, arg_min(ts, seq) AS created, 0::BIGINT AS revision,
        arg_min(ts, seq) AS updated
        FROM (SELECT c.* FROM @ch_click c WHERE type = 'checkbox' AND NOT EXISTS (SELECT 1 FROM @ch d
              WHERE d.response_id = c.response_id AND d.question_id = c.question_id
              AND d.answer_ordinal = -c.answer_ordinal AND d.seq > c.seq))
        GROUP BY response_id, question_id, answer_option_id""",
    "fold_plaintext": "SELECT * FROM @ch_text",
    "touch_responses": "SELECT * FROM @ch_touch",
    "apply_changes": _state("both"),
    "stream_apply_changes": _state("both"),
    "keyed_apply_changes": _state("both"),
    "visible_questions": """SELECT DISTINCT response_id, question_id FROM (
        SELECT response_id, question_id FROM @mem JOIN (SELECT event_id, question_id FROM @qu) USING (event_id)
            JOIN @shown USING (question_id) WHERE display
        UNION ALL SELECT response_id, o.if_selected_show_question_id FROM @ch c JOIN @mem m USING (response_id)
            JOIN @op o ON o.question_id = c.question_id AND o.answer_ordinal = abs(c.answer_ordinal)
            JOIN @qu q ON q.question_id = o.question_id AND q.event_id = m.event_id
            WHERE o.if_selected_show_question_id IS NOT NULL)""",
    "answer_bands": """SELECT response_id, c.question_id, arg_max(o.css_classes, c.seq) AS classes FROM @ch c JOIN @mem m USING (response_id)
        JOIN @op o ON o.question_id = c.question_id AND o.answer_ordinal = abs(c.answer_ordinal)
        JOIN @qu q ON q.question_id = o.question_id AND q.event_id = m.event_id
        WHERE o.css_classes IS NOT NULL GROUP BY response_id, c.question_id""",
    # Quality
    "dq_unique": _unique(),
    "dq_unique_filtered": " UNION ALL ".join([
        _repeated("uq_event_api_key", "b_ev", ["api_key"], "api_key IS NOT NULL"),
        _repeated("uq_template_name", "b_ev", ["name"], "is_template"),
        _repeated("uq_presenter_identifier", "b_pr", ["identifier"], "identifier IS NOT NULL"),
        _repeated("uq_session_feed_id", "b_se", ["event_id", "feed_id"], "feed_id IS NOT NULL"),
        _repeated("uq_session_owner", "b_sp", ["session_id"], "is_session_owner"),
    ]),
    "dq_foreign_keys": " UNION ALL ".join([
        _orphans("fk_event_users_event", "event_users", "event_id", "events", "event_id"),
        _orphans("fk_sessions_event", "sessions", "event_id", "events", "event_id"),
        _orphans("fk_session_presenters_session", "session_presenters", "session_id", "sessions", "session_id"),
        _orphans("fk_session_presenters_presenter", "session_presenters", "presented_by_id", "presenters", "presenter_id"),
        _orphans("fk_questions_event", "questions", "event_id", "events", "event_id"),
        _orphans("fk_answer_options_question", "answer_options", "question_id", "questions", "question_id"),
        _orphans("fk_answer_options_follow_up", "answer_options", "if_selected_show_question_id", "questions", "question_id"),
        _orphans("fk_responses_session", "responses", "session_id", "sessions", "session_id"),
        _orphans("fk_response_answers_response", "response_answers", "response_id", "responses", "response_id"),
        _orphans("fk_response_answers_question", "response_answers", "question_id", "questions", "question_id"),
        _orphans("fk_response_answers_option", "response_answers", "answer_option_id", "answer_options", "answer_option_id"),
        _orphans("fk_response_plaintext_response", "response_plaintext", "response_id", "responses", "response_id"),
        _orphans("fk_response_plaintext_question", "response_plaintext", "question_id", "questions", "question_id"),
    ]),
    "dq_domain": """SELECT 'ck_question_type' AS rule, question_id::VARCHAR AS key, 1::BIGINT AS n FROM @b_qu
            WHERE type NOT IN ('checkbox', 'radio', 'text')
        UNION ALL SELECT 'ck_percent_value', answer_option_id::VARCHAR, 1 FROM @b_op WHERE percent_value NOT BETWEEN -100 AND 100
        UNION ALL SELECT 'ck_display_order', question_id::VARCHAR, 1 FROM @b_qu WHERE display_order NOT BETWEEN 0 AND 255""",
    "dq_not_null_length": _not_null_length(),
    "dq_summary": """SELECT rule, 0::BIGINT AS violations FROM (VALUES ('pk_events'), ('pk_event_users'), ('pk_presenters'),
        ('pk_sessions'), ('pk_session_presenters'), ('pk_questions'), ('uq_questions'), ('pk_answer_options'),
        ('uq_answer_options'), ('pk_responses'), ('pk_response_answers'), ('pk_response_plaintext'), ('uq_event_api_key'),
        ('uq_template_name'), ('uq_presenter_identifier'), ('uq_session_feed_id'), ('uq_session_owner'),
        ('fk_event_users_event'), ('fk_sessions_event'), ('fk_session_presenters_session'),
        ('fk_session_presenters_presenter'), ('fk_questions_event'), ('fk_answer_options_question'),
        ('fk_answer_options_follow_up'), ('fk_responses_session'), ('fk_response_answers_response'),
        ('fk_response_answers_question'), ('fk_response_answers_option'), ('fk_response_plaintext_response'),
        ('fk_response_plaintext_question'), ('ck_question_type'), ('ck_percent_value'), ('ck_display_order')) AS v(rule)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: build(body) for name, body in BODIES.items()}
