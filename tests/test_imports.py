import pytest

from podium.operators import imports, questions
from podium.plans.registry import QUERIES
from podium.sources import feed
from podium.sources.adapters import TestTables
from podium.sources.schemas import FEED

REQUEST = (
    "request_id long, name string, from_template_event_id long, from_template_name string, is_template boolean, css string, "
    "accepts_from timestamp_ntz, accepts_to timestamp_ntz, api_key string, event_secret string"
)


@pytest.fixture
def tables(table):
    return {
        "events": table("events", [(1, "T", "/t.css", True, None, None, None, "s1"), (2, "Known", None, False, None, None, "k2", "s2")]),
        "presenters": table("presenters", [(1, "Old Ann", "a@x", "a"), (2, "Idle", None, None)]),
        "sessions": table("sessions", [(21, 2, 5, "old title"), (22, 2, 9, "vanished")]),
        "session_presenters": table("session_presenters", [(21, 2, True), (22, 2, True)]),
        "questions": table("questions", [(10, 1, 1, "q", None, None, True, "radio", False)]),
        "answer_options": table("answer_options", [(10, 101, 1, None, None, "x", None)]),
    }


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_a_feed_is_imported_through_all_upserts_and_again_without_change(spark, tables):
    session = lambda i, title, *speakers: (i, title, "Accepted", False, [(s, n) for s, n in speakers])
    documents = [
        ("k2", [([session(5, "new title", ("a", "Ann"), ("b", "Bob")), session(6, "second", ("b", "Bobby"))],)]),
        ("k3", [([session(5, "other event", ("c", "Cy"), ("a", "Ann again"), ("c", "Cy"))],)]),
        ("k4", [([session(7, "nobody asked", ("d", "Dee"))],)]),
    ]
    sessions, speakers = feed.parse_feed(spark.createDataFrame(documents, FEED), places=True)
    new = lambda i, key, template: (i, f"E{i}", None, template, False, "/x.css", None, None, key, f"secret{i}")
    requests = spark.createDataFrame([new(1, "k2", "T"), new(2, "k3", "T"), new(3, "k4", "missing")], REQUEST)

    result = imports.import_feeds(tables, requests, sessions, speakers)
    got = rows(imports.imported_sessions(result), "request_id", "feed_id", "title", "identifier", "name", "is_owner")
    # Names are those of the last call; a speaker listed twice loses the session.
    assert got == sorted([
        (1, 5, "new title", "a", "Ann again", True), (1, 5, "new title", "b", "Bobby", False), (1, 6, "second", "b", "Bobby", True),
        (2, 5, "other event", "a", "Ann again", False), (2, 5, "other event", "c", "Cy", False),
    ], key=str)
    assert [(r.kind, r.key) for r in result["rejected"].collect()] == [("event", "3")]
    # What vanished from the feed stays; ids of matched rows stay.
    assert (22, 2, "vanished") in rows(result["sessions"], "session_id", "event_id", "title")
    assert (21, 2, "new title") in rows(result["sessions"], "session_id", "event_id", "title")
    assert (1, "Ann again", "a@x") in rows(result["presenters"], "presenter_id", "name", "email")
    assert result["events"].where("name = 'E2'").count() == 1 and result["questions"].count() == 2

    names = ("events", "presenters", "sessions", "session_presenters", "questions", "answer_options")
    after = {n: result[n] for n in names}
    again = imports.import_feeds(after, requests, sessions, speakers)
    for n in names:
        assert rows(again[n], *after[n].columns) == rows(after[n], *after[n].columns), n


def test_questions_beside_a_cycle_get_their_depth(table):
    def depths(*pairs):
        options = [(q, n, n + 1, None, to, None, None) for n, (q, to) in enumerate(pairs)]
        found, stuck = questions.question_depths(table("answer_options", options))
        return {r.question_id: r.indent for r in found.collect()}, sorted(r.question_id for r in stuck.collect())

    # A cycle below root 1 holds back 2, 3 and 4, not the other event; 7 and 8 are a cycle no root reaches, and 6 is
    # reached by a root beside it.
    assert depths((1, 2), (2, 3), (3, 2), (3, 4), (4, None), (5, 6), (6, None), (7, 8), (8, 7), (8, 6)) == ({1: 0, 5: 0, 6: 1}, [2, 3, 4])
    chain = [(i, i + 1) for i in range(1, 13)] + [(13, None)]
    assert depths(*chain) == ({i: i - 1 for i in range(1, 14)}, [])
    assert depths((1, 2), (1, 3), (2, 4), (3, 4), (1, 4), (4, None), (9, 9)) == ({1: 0, 2: 1, 3: 1, 4: 2}, [])


def test_the_query_reads_line_items_once_and_deals_out_its_questions(spark, tmp_path):
    tables = {
        "customer": "id AS c_custkey, concat('Customer', id) AS c_name, 'A' AS c_mktsegment",
        "supplier": "id AS s_suppkey, concat('Supplier#', lpad(id, 9, '0')) AS s_name, 1 AS s_nationkey",
        "part": "id AS p_partkey, 'name' AS p_name, 'type' AS p_type, 1 AS p_size",
        "orders": "id AS o_orderkey, id AS o_custkey, timestamp_ntz'1997-01-01 00:00:00' AS o_orderdate",
        "lineitem": "id AS l_orderkey, id % 40 AS l_partkey, id % 30 AS l_suppkey, 1 AS l_linenumber, 5D AS l_quantity, 'A' AS l_returnflag, "
        "timestamp_ntz'1997-01-01 00:00:00' AS l_shipdate",
    }
    for name, columns in tables.items():
        spark.sql(f"SELECT {columns} FROM range(80)").write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["import_feed"](spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if "lineitem" in f]
    # Parts 1 to 39 of the events 1 and 2 speak; request 2 asks for a template that nobody knows.
    first = {(r.request_id, r.feed_id): (r.owner, r.speakers) for r in got.collect() if r.feed_id in (1, 11, 21)}
    assert first[(1, 1)] == ("id-1", "id-11=Supplier#000000011,id-1=Supplier#000000001") and (1, 11) not in first
    assert len(TestTables(spark, str(tmp_path)).questions.inputFiles()) > 1
