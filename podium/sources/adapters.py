"""Feedback tables and request logs derived from the generated test tables.

Every table grows with the test data: suppliers are events (and speakers), parts are sessions (20 per
event), customers are users and requests, orders are responses and line items are the change log.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.session import configure, fresh_path
from podium.sources import seed
from podium.sources.schemas import TABLES

EVENT_OF_PART = "p_partkey div 20 + 1"
EVENT_OF_ORDER = "o_custkey div 20 + 1"

# The columns used of the generated tables; naming them saves a look into the files per read.
GENERATED = {
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_type STRING, p_size INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, props STRING",
}

# Paths of the written tables, by application, folder and table.
_WRITTEN: dict[tuple[str, str, str], str] = {}


class TestTables:
    """Lazily built DataFrames over one folder of generated parquet files."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(GENERATED[name]).parquet(os.path.join(self.folder, f"{name}.parquet"))

    def written(self, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Write a table once per application and read it back. The planner takes a literal array exploded
        per event for no larger than the events; a stored table has its real size, so a join broadcasts it
        only while it is small. Events are few bytes, which one task would read and write for all; they are dealt out."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            path = fresh_path(self.spark, name)
            events = self.events.repartition(self.spark.sparkContext.defaultParallelism, "event_id")
            build(events).write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.schema(TABLES[name]).parquet(_WRITTEN[key])

    # Stored tables

    @cached_property
    def events(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "s_suppkey + 1 AS event_id",
            "s_name AS name",
            "CASE WHEN s_nationkey % 5 <> 0 THEN concat('/r', s_nationkey % 5, '.css') END AS css",
            "s_suppkey % 10 < 2 AS is_template",
            "CASE WHEN s_suppkey % 3 <> 0 THEN timestamp_ntz'1997-01-01 00:00:00' END AS accepts_responses_from",
            "CASE WHEN s_suppkey % 4 <> 0 THEN timestamp_ntz'2000-01-01 00:00:00' END AS accepts_responses_to",
            "CASE WHEN s_suppkey % 5 <> 0 THEN concat('key-', s_suppkey) END AS api_key",
            "md5(concat('event-', s_suppkey)) AS event_secret",
        )

    @cached_property
    def event_users(self) -> DataFrame:
        return self.read("customer").selectExpr("c_custkey div 15 + 1 AS event_id", "c_mktsegment AS user").distinct()

    @cached_property
    def presenters(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "s_suppkey AS presenter_id",
            "s_name AS name",
            "CASE WHEN s_suppkey % 4 <> 0 THEN concat('s', s_suppkey, '@example.org') END AS email",
            "CASE WHEN s_suppkey % 7 <> 0 THEN concat('id-', s_suppkey) END AS identifier",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        return self.read("part").selectExpr(
            "p_partkey AS session_id",
            f"{EVENT_OF_PART} AS event_id",
            "CASE WHEN p_partkey % 10 <> 0 THEN p_partkey END AS feed_id",
            "concat(p_name, ' ', p_partkey) AS title",
        )

    @cached_property
    def session_presenters(self) -> DataFrame:
        return self.written("session_presenters", lambda events: self.built_links())

    def built_links(self) -> DataFrame:
        """The links out of the line items, whose scan costs far more than what is left of it."""
        links = (
            self.read("lineitem")
            .where("l_linenumber = 1 AND l_quantity <= 15")
            .selectExpr("l_partkey AS session_id", "l_suppkey AS presented_by_id")
            .distinct()
        )
        owners = links.groupBy("session_id").agg(F.min("presented_by_id").alias("owner_id"))
        return links.join(owners, "session_id").selectExpr(
            "session_id", "presented_by_id", "presented_by_id = owner_id AS is_session_owner"
        )

    @cached_property
    def audience(self) -> dict[str, DataFrame]:
        """Events, sessions, links and presenters with lists of any length: the customers speak, two thirds of them in
        one session, and that session is in an event with all others."""
        speakers = self.read("customer")
        place = "CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE c_custkey + 2 END"
        return {
            "events": self.events.where("event_id = 1"),
            "presenters": speakers.selectExpr("c_custkey AS presenter_id", "c_name AS name"),
            "session_presenters": speakers.selectExpr(
                f"{place} AS session_id", "c_custkey AS presented_by_id", "c_custkey % 3 = 0 OR c_custkey = 100 AS is_session_owner"
            ),
            "sessions": speakers.selectExpr(f"{place} AS session_id").distinct().selectExpr(
                "session_id", "1L AS event_id", "CAST(NULL AS BIGINT) AS feed_id", "concat('Talk ', session_id) AS title"
            ),
        }

    @cached_property
    def questions(self) -> DataFrame:
        return self.written("questions", seed.questions_for_events)

    @cached_property
    def answer_options(self) -> DataFrame:
        return self.written("answer_options", seed.options_for_events)

    @cached_property
    def responses(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey AS response_id",
            "o_custkey AS session_id",
            "md5(concat('r', o_orderkey)) AS client_key",
            "o_orderdate AS created",
            "o_orderdate AS updated",
        )

    # Change logs

    @cached_property
    def answer_changes(self) -> DataFrame:
        """One change per line item. `seq` packs ship day, line, part and supplier into one number."""
        lines = self.read("lineitem").join(self.read("orders"), F.expr("l_orderkey = o_orderkey"))
        return lines.selectExpr(
            "l_orderkey AS response_id",
            f"({EVENT_OF_ORDER}) * 100 + CASE l_linenumber WHEN 6 THEN 7 WHEN 7 THEN 10 ELSE l_linenumber END "
            "AS question_id",
            "CAST(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity = 50 THEN 9 "
            "WHEN l_linenumber BETWEEN 2 AND 4 "
            "THEN (1 + l_partkey % 5) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END "
            "ELSE 1 + l_partkey % 6 END AS SMALLINT) AS answer_ordinal",
            "CASE WHEN l_linenumber = 7 THEN "
            "CASE WHEN l_returnflag = 'R' THEN '' ELSE concat('note ', l_partkey) END END AS plaintext",
            "l_shipdate AS ts",
            "(unix_date(CAST(l_shipdate AS DATE)) * 8L + l_linenumber) * 35184372088832L "
            "+ (l_partkey * 1048576L + l_suppkey) % 35184372088832L AS seq",
        )

    @cached_property
    def stream_changes(self) -> DataFrame:
        """The changes carried by the event stream table, in event order."""
        value = "CAST(get_json_object(props, '$.k') AS INT)"
        stream = self.read("events").join(self.read("orders"), F.expr("user_id = o_orderkey"))
        return stream.selectExpr(
            "user_id AS response_id",
            f"({EVENT_OF_ORDER}) * 100 + CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 "
            "ELSE 10 END AS question_id",
            f"CAST(CASE event_type WHEN 'click' THEN 1 + {value} % 6 WHEN 'view' THEN 1 + {value} % 5 "
            f"WHEN 'error' THEN -(1 + {value} % 5) END AS SMALLINT) AS answer_ordinal",
            f"CASE event_type WHEN 'purchase' THEN concat('note ', {value}) WHEN 'signup' THEN '' END AS plaintext",
            "ts",
            "event_id AS seq",
        )

    # Requests

    @cached_property
    def incoming_presenters(self) -> DataFrame:
        """Two requests per key; every ninth request knows only the email address."""
        return self.read("customer").selectExpr(
            "c_name AS name",
            "CASE WHEN c_custkey % 9 = 0 THEN concat('s', c_custkey div 2, '@example.org') END AS email",
            "CASE WHEN c_custkey % 9 <> 0 THEN concat('id-', c_custkey div 2) END AS identifier",
            "c_custkey AS seq",
        )

    @cached_property
    def incoming_sessions(self) -> DataFrame:
        """Every tenth part has no feed id; of the others, the even ones are known and the odd ones new."""
        return self.read("part").selectExpr(
            f"{EVENT_OF_PART} AS event_id",
            "upper(p_name) AS title",
            "CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 2 = 1 THEN -p_partkey ELSE p_partkey END AS feed_id",
            "p_partkey AS seq",
        )

    @cached_property
    def incoming_links(self) -> DataFrame:
        return (
            self.read("lineitem")
            .where("l_linenumber = 2 AND l_quantity <= 15")
            .selectExpr(
                "l_partkey AS session_id",
                "l_suppkey AS presenter_id",
                "l_returnflag = 'A' AS is_owner",
                "(l_orderkey * 32768L + unix_date(CAST(l_shipdate AS DATE))) * 1024L + l_suppkey % 1024 AS seq",
            )
        )

    @cached_property
    def event_requests(self) -> DataFrame:
        """One create-event request per customer: by template, without one, or with an unknown one."""
        return self.read("customer").selectExpr(
            "c_custkey AS request_id",
            "c_name AS name",
            "CAST(NULL AS BIGINT) AS from_template_event_id",
            "CASE c_custkey % 3 WHEN 0 THEN concat('Supplier#', lpad(CAST(c_custkey div 150 * 10 AS STRING), 9, '0')) "
            "WHEN 2 THEN 'missing' END AS from_template_name",
            "false AS is_template",
            "CASE WHEN c_custkey % 2 = 0 THEN '/new.css' END AS css",
            "CAST(NULL AS TIMESTAMP_NTZ) AS accepts_from",
            "timestamp_ntz'2001-01-01 00:00:00' AS accepts_to",
            "concat('key-', c_custkey) AS api_key",
            "md5(concat('new-event-', c_custkey)) AS event_secret",
        )

    @cached_property
    def user_grants(self) -> DataFrame:
        """User lists with plain names, names with a domain, unknown names and empty entries."""
        supplier = "lpad(CAST(c_custkey div 15 AS STRING), 9, '0')"
        return self.read("customer").selectExpr(
            "c_custkey div 15 + 1 AS event_id",
            f"CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('Supplier#', {supplier}, ',', c_name) "
            f"WHEN 2 THEN concat('DOM\\\\Supplier#', {supplier}, ',,', c_name) ELSE c_mktsegment END AS userlist",
            "CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#000000001' ELSE 'nobody' END AS me",
        )

    @cached_property
    def principals(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "CASE WHEN s_suppkey % 2 = 0 THEN concat('DOM\\\\', s_name) ELSE s_name END AS name"
        )

    @cached_property
    def question_inserts(self) -> DataFrame:
        """Question inserts, one per part: 20 per event, at positions before, inside and beyond the list."""
        return self.read("part").selectExpr(
            f"{EVENT_OF_PART} AS event_id",
            "CAST(CASE WHEN p_partkey % 17 <> 0 THEN p_partkey % 13 END AS SMALLINT) AS position",
            "p_name AS question",
            "CAST(NULL AS STRING) AS description",
            "CAST(NULL AS SMALLINT) AS optimal_percent",
            "CAST(NULL AS BOOLEAN) AS is_required",
            "CAST(NULL AS STRING) AS type",
            "CAST(NULL AS BOOLEAN) AS has_plaintext",
            "p_partkey AS seq",
        )

    @cached_property
    def question_updates(self) -> DataFrame:
        """Question patches and moves, one per part: 20 per event."""
        return self.read("part").selectExpr(
            f"({EVENT_OF_PART}) * 100 + 1 + p_partkey % 10 AS question_id",
            "CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 13 END AS SMALLINT) AS position",
            "CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' ', p_partkey) END AS question",
            "CASE WHEN p_partkey % 4 = 0 THEN p_type END AS description",
            "CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size END AS SMALLINT) AS optimal_percent",
            "CASE WHEN p_partkey % 6 = 0 THEN p_size > 25 END AS is_required",
            "CAST(NULL AS STRING) AS type",
            "CAST(NULL AS BOOLEAN) AS has_plaintext",
            "p_partkey AS seq",
        )

    @cached_property
    def option_inserts(self) -> DataFrame:
        """Option inserts, one per part: all on the fifth question of its event."""
        return self.read("part").selectExpr(
            f"({EVENT_OF_PART}) * 100 + 5 AS question_id",
            "CAST(CASE WHEN p_partkey % 17 <> 0 THEN p_partkey % 13 END AS SMALLINT) AS position",
            "CAST(p_size AS SMALLINT) AS percent_value",
            "CAST(NULL AS BIGINT) AS if_selected_show_question_id",
            "p_name AS annotation",
            "CAST(NULL AS STRING) AS css_classes",
            "p_partkey AS seq",
        )

    @cached_property
    def visits(self) -> DataFrame:
        """Form openings: one per order, for the session and at the time of the order."""
        return self.read("orders").selectExpr(
            "o_orderkey AS request_id", "o_custkey AS session_id", "o_orderdate AS requested_at"
        )

    @cached_property
    def session_requests(self) -> DataFrame:
        """Session-list requests with every mix of the three parameters."""
        return self.read("orders").selectExpr(
            "o_orderkey AS request_id",
            "CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderkey END AS response_id",
            "CASE WHEN o_orderkey % 4 = 1 THEN o_custkey div 15 END AS presenter_id",
            f"CASE WHEN o_orderkey % 8 IN (1, 2, 3, 5) THEN {EVENT_OF_ORDER} END AS event_id",
        )

    @cached_property
    def presenter_requests(self) -> DataFrame:
        """Speaker and event pairs taken from the links."""
        return self.session_presenters.join(self.sessions, "session_id").selectExpr(
            "presented_by_id AS presenter_id", "event_id"
        )

    @cached_property
    def secrets(self) -> DataFrame:
        """Report requests by event secret, in both letter cases; every seventh is unknown."""
        return self.read("supplier").selectExpr(
            "s_suppkey AS request_id",
            "CASE WHEN s_suppkey % 7 = 6 THEN md5('unknown') WHEN s_suppkey % 2 = 0 "
            "THEN upper(md5(concat('event-', s_suppkey))) ELSE md5(concat('event-', s_suppkey)) END AS secret",
        )

    @cached_property
    def deleted_events(self) -> DataFrame:
        """Delete requests: the events without a style sheet."""
        return self.events.where("css IS NULL").select("event_id")

    @cached_property
    def deleted_questions(self) -> DataFrame:
        """Delete requests for three questions of every event; the third is a follow-up and stays."""
        return self.questions.where("display_order IN (3, 5, 9)").select("question_id")

    @cached_property
    def feed_documents(self) -> DataFrame:
        """Session feeds as JSON lines, 50 sessions of an event per document."""
        from podium.functions.nest import small_list
        from podium.operators.lookup import session_speaker_rows

        speakers = session_speaker_rows(self.session_presenters, self.presenters)
        listed = small_list(
            speakers.withColumn("place", F.struct((~F.col("is_session_owner")).alias("second"), "presenter_id")),
            "session_id", "place",
            F.struct(F.concat(F.lit("id-"), F.col("presenter_id")).alias("id"), "name"), "speakers",
        )
        sessions = self.sessions.join(listed, "session_id", "left").selectExpr(
            "event_id",
            "session_id div 50 AS page",
            "named_struct('id', session_id, 'title', title, "
            "'status', CASE WHEN session_id % 11 = 0 THEN 'Declined' ELSE 'Accepted' END, "
            "'isServiceSession', session_id % 13 = 0, 'speakers', speakers) AS session",
        )
        documents = sessions.groupBy("event_id", "page").agg(F.sort_array(F.collect_list("session")).alias("sessions"))
        other = "array(named_struct('id', -1L, 'title', 'other group', 'status', 'Accepted', 'isServiceSession', false))"
        return documents.selectExpr(
            f"to_json(named_struct('event_key', concat('key-', event_id), 'groups', array("
            f"named_struct('sessions', sessions), named_struct('sessions', "
            f"transform({other}, x -> named_struct('id', x.id, 'title', x.title, 'status', x.status, "
            f"'isServiceSession', x.isServiceSession, 'speakers', "
            f"CAST(NULL AS ARRAY<STRUCT<id: STRING, name: STRING>>)))))) ) AS value"
        )

    @cached_property
    def raw_changes(self) -> DataFrame:
        """The change log as posted: texts only, 'null' for missing values, 0 in place of some missing ordinals."""
        return self.answer_changes.selectExpr(
            "CAST(response_id AS STRING) AS responseId",
            "concat(' ', question_id, 'x') AS questionId",
            "CASE WHEN answer_ordinal IS NOT NULL THEN CAST(answer_ordinal AS STRING) "
            "WHEN response_id % 2 = 0 THEN '0' ELSE 'null' END AS answerOrdinal",
            "coalesce(plaintext, 'null') AS plaintext",
            "ts",
            "seq",
        )

    @cached_property
    def folded(self) -> dict[str, DataFrame]:
        """All ten tables: the stored ones with the change log applied."""
        from podium.operators.fold import apply_changes

        return apply_changes(self.stored, self.answer_changes)

    @cached_property
    def published(self) -> dict[str, DataFrame]:
        """The folded tables as a stored snapshot, written once per application: what the operators on
        stored tables read."""
        from podium.sources.tables import load_feedback, save_feedback

        key = (self.spark.sparkContext.applicationId, self.folder, "snapshot")
        if key not in _WRITTEN:
            path = fresh_path(self.spark, "snapshot")
            save_feedback(self.folded, path)
            _WRITTEN[key] = path
        return load_feedback(self.spark, _WRITTEN[key])

    @cached_property
    def stored(self) -> dict[str, DataFrame]:
        """The eight tables that need no fold."""
        return {
            name: getattr(self, name)
            for name in (
                "events", "event_users", "presenters", "sessions", "session_presenters",
                "questions", "answer_options", "responses",
            )
        }
