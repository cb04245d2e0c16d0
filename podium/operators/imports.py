"""Importing session feeds: events, speakers, sessions and links in one flow.

The service imports one feed with a call for the event, then for each session a call for every speaker, one for the
session and one for every link, each waiting for the ids of those before. Here every kind is one set of calls for
all feeds together, in the order the service would make them, and the ids go from one upsert to the next as joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.store import stored
from podium.operators.copies import create_events
from podium.operators.upsert import upsert_presenters, upsert_session_presenters, upsert_sessions


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add `seq`, unique and rising in an order, by a sort over ranges; stored, so that the numbers stay. The rows are
    stored before as well, as the ranges are sampled from them in a run of its own."""
    df = stored(df, "unnumbered")
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "numbered")


def import_feeds(tables: dict[str, DataFrame], requests: DataFrame, sessions: DataFrame, speakers: DataFrame,
                 store_key: bool = False) -> dict[str, DataFrame]:
    """Import the feeds that requests ask for. Returns all tables, those of events, questionnaires, presenters,
    sessions and links replaced, and `imported`, `assigned` and `rejected`.

    `requests` are create-event requests; the feed of a request has its `api_key` as `event_key`. `sessions`
    (event_key, feed_id, title, place) and `speakers` (event_key, feed_id, position, identifier, name, is_owner,
    place) are feeds read with their places. `imported` has request_id, event_id and event_key of every request
    carried out, `assigned` event_id, feed_id and session_id of every imported session, and `rejected` the requests
    and calls that failed: kind (event, presenter, session, link), key and error.

    Calls are numbered by event, then in the order of the feed. Requests that meet in one event import its feed once.
    Sessions that are in a feed twice end as their last call leaves them; sessions that vanished from it stay, as do
    their links. A speaker twice in a session loses its ownership, as the second call says so.

    The ids are hashes of natural keys, so a run that failed can be repeated from the same tables with the same
    result: publish the tables with `save_feedback`, whose manifest makes the whole import visible at once. With the
    key stored (a template, or `store_key`) a second run finds everything and changes nothing, but that an update of an
    event writes every field of its request, also those that are NULL, which a copy takes from the template.
    """
    created = create_events(tables, requests, store_key)
    keyed = requests.select("request_id", F.col("api_key").alias("event_key"))
    carried_out = created["created"].select("request_id", "event_id").unionByName(created["updated"].select("request_id", "event_id"))
    imported = stored(carried_out.join(keyed, "request_id"), "imported")
    targets = imported.where("event_key IS NOT NULL").select("event_id", "event_key").distinct()

    # Tables that several steps read are made once.
    events = stored(created["events"], "imported-events")
    calls = numbered(targets.join(sessions, "event_key"), "event_id", "place", "feed_id")
    upserted = upsert_sessions(tables["sessions"], tables["session_presenters"], events, calls.select("event_id", "title", "feed_id", "seq"))
    known_sessions = stored(upserted["sessions"], "imported-snapshot")
    assigned = calls.select("seq", "event_id", "feed_id").join(upserted["assigned"], "seq").select("event_id", "feed_id", "session_id").distinct()
    assigned = stored(assigned, "imported-sessions")

    named = numbered(targets.join(speakers, "event_key"), "event_id", "place", "feed_id", "position", "identifier")
    people = named.select("name", F.lit(None).cast("string").alias("email"), "identifier", "seq")
    presenters, failed, known = upsert_presenters(tables["presenters"], people)
    presenters, known = stored(presenters, "imported-presenters"), stored(known, "imported-speakers")

    links = named.join(known, "seq").join(assigned, ["event_id", "feed_id"]).select("session_id", "presenter_id", "is_owner", "seq")
    linked, stray = upsert_session_presenters(upserted["session_presenters"], known_sessions, presenters, links)

    def reasons(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "error")

    rejected = (
        reasons(created["rejected"], "event", "request_id")
        .unionByName(reasons(failed, "presenter", "identifier"))
        .unionByName(reasons(upserted["rejected"], "session", "event_id"))
        .unionByName(reasons(stray, "link", "session_id"))
    )
    return {
        **tables,
        **{name: created[name] for name in ("questions", "answer_options")},
        "events": events, "presenters": presenters, "sessions": known_sessions, "session_presenters": linked,
        "imported": imported, "assigned": assigned, "rejected": rejected,
    }


def imported_sessions(result: dict[str, DataFrame]) -> DataFrame:
    """(request_id, event_id, feed_id, session_id, title, identifier, name, is_owner): what each request has imported,
    one row a speaker, one without a speaker for a session that has none."""
    sessions = result["sessions"].select("session_id", "title")
    links = result["session_presenters"].join(
        result["presenters"].select(F.col("presenter_id").alias("presented_by_id"), "identifier", "name"), "presented_by_id"
    ).select("session_id", "identifier", "name", F.col("is_session_owner").alias("is_owner"))
    rows = result["imported"].join(result["assigned"], "event_id").join(sessions, "session_id").join(links, "session_id", "left")
    return rows.select("request_id", "event_id", "feed_id", "session_id", "title", "identifier", "name", "is_owner")
