"""Templates, open sessions, events by secret, and the session listings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.nest import PAGE_ITEMS, paged_list
from podium.functions.skew import hot_keys, salted_join
from podium.functions.text import collated, event_link, matches, qr_link, session_link, speaker_names

# The window of an event without limits.
OPEN_FROM = dt.datetime(2000, 1, 1)
OPEN_TO = dt.datetime(2099, 12, 31)


def list_templates(events: DataFrame, collation: str | None = None) -> DataFrame:
    return events.where("is_template").select("name", "css").orderBy(collated("name", collation))


def resolve_template(requests: DataFrame, events: DataFrame, collation: str | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """Fill `from_template_event_id` of requests that name a template. An unknown name falls back on the id
    given with it, and is rejected without one."""
    templates = (
        events.where("is_template")
        .groupBy(collated("name", collation).alias("_name"))
        .agg(F.min("event_id").alias("template_id"))
    )
    keyed = requests.withColumn("_name", collated("from_template_name", collation))
    named = salted_join(keyed, templates, hot_keys(keyed, "_name"), "_name", "request_id", "left").select(*requests.columns, F.coalesce("template_id", "from_template_event_id").alias("template_id"))
    missing = F.col("from_template_name").isNotNull() & F.col("template_id").isNull()
    resolved = named.where(~missing).withColumn("from_template_event_id", F.col("template_id")).drop("template_id")
    rejected = named.where(missing).drop("template_id").withColumn(
        "error", F.lit("no event template of that name")
    )
    return resolved, rejected


def accepts(at: Column) -> Column:
    """Whether an event takes responses at a time; both limits are exclusive."""
    opens = F.coalesce("accepts_responses_from", F.lit(OPEN_FROM).cast("timestamp_ntz"))
    closes = F.coalesce("accepts_responses_to", F.lit(OPEN_TO).cast("timestamp_ntz"))
    return (opens < at) & (closes > at)


def open_sessions(sessions: DataFrame, events: DataFrame, as_of: dt.datetime) -> DataFrame:
    open_events = events.where(accepts(F.lit(as_of).cast("timestamp_ntz"))).select("event_id")
    return sessions.join(open_events, "event_id", "left_semi").select("session_id", "event_id", "title")


def events_by_secret(requests: DataFrame, events: DataFrame) -> DataFrame:
    """The event of each request's secret, compared without case; unknown secrets give no row."""
    owners = events.groupBy(F.lower("event_secret").alias("_secret")).agg(F.min("event_id").alias("event_id"))
    keyed = requests.withColumn("_secret", F.lower("secret"))
    return salted_join(keyed, owners, hot_keys(keyed, "_secret"), "_secret", "request_id").drop("_secret")


# Speakers and listings


def session_speaker_rows(session_presenters: DataFrame, presenters: DataFrame) -> DataFrame:
    """The flat form: one row per link with the speaker's name."""
    return session_presenters.join(
        presenters.select(F.col("presenter_id").alias("presented_by_id"), "name"), "presented_by_id"
    ).select("session_id", F.col("presented_by_id").alias("presenter_id"), "name", "is_session_owner")


def session_speakers(session_presenters: DataFrame, presenters: DataFrame, order: str = "name",
                     collation: str | None = None, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Per session the array `presenters` of {name}: by name, or `order="owner"` with the owner first. A
    session with more speakers than a page holds has several rows, see `paged_list`."""
    by = [collated("name", collation), "presenter_id"]
    if order == "owner":
        by = [F.col("is_session_owner").desc(), *by]
    rows = session_speaker_rows(session_presenters, presenters)
    # Counted on the links alone: every link has its speaker, or the list is shorter than it is taken for.
    counts = session_presenters.groupBy("session_id").agg(F.count("*").alias("_n"))
    return paged_list(rows, "session_id", by, F.struct("name"), "presenters", ["presenter_id"], page_items, counts=counts)


def listing_counts(sessions: DataFrame, session_presenters: DataFrame, page_items: int = PAGE_ITEMS) -> DataFrame:
    """(event_id, _n): how many rows the listing of an event has, one for each page of a session."""
    links = session_presenters.groupBy("session_id").agg(F.count("*").alias("_links"))
    rows = 1 + F.floor(F.coalesce("_links", F.lit(0)) / page_items)
    return sessions.join(links, "session_id", "left").groupBy("event_id").agg(F.sum(rows).alias("_n"))


def session_listing(sessions: DataFrame, events: DataFrame, session_presenters: DataFrame,
                    presenters: DataFrame, restrict: bool = False, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Rows of a session list: id, event, title, style sheet and speakers by name; one row for each page of
    speakers, numbered in `page`.

    `restrict` says that `sessions` is a part of all sessions; the links are then cut down to it before
    their lists are built. The cut uses the partitioning the lists need anyway.
    """
    links = session_presenters
    if restrict:
        links = links.join(sessions.select("session_id"), "session_id", "left_semi")
    return (
        sessions.join(events.select("event_id", "css"), "event_id")
        .join(session_speakers(links, presenters, page_items=page_items), "session_id", "left")
        .withColumns({"page": F.coalesce("page", F.lit(0)), "pages": F.coalesce("pages", F.lit(1))})
        .drop("feed_id")
    )


def search_sessions(listing: DataFrame, needle: str, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Rows of the sessions whose title or speaker names contain the needle, all pages of them. Names are one text,
    joined by commas, however many pages they take: a page is searched together with the start of those after it."""
    names = speaker_names("presenters")
    found = listing.where(matches(needle, F.col("title"), names)).select("session_id")
    if len(needle) > 1:
        found = found.unionByName(_across_pages(listing, needle, names, page_items))
    return listing.join(found.distinct(), "session_id", "left_semi")


def _across_pages(listing: DataFrame, needle: str, names: Column, page_items: int) -> DataFrame:
    """Sessions that have the needle where one page of names goes over into the next. Of a page the last characters
    matter, of those after it the first, as many as the needle has but one."""
    overlap = len(needle.lower()) - 1
    pages = listing.where("pages > 1").select("session_id", "page", "title", names.alias("names"))
    # Every page but the last has `page_items` names, and so as many commas and blanks but one.
    following = 1 + overlap // max(1, 2 * (page_items - 1))
    in_order = Window.partitionBy("session_id").orderBy("page")
    after = F.concat_ws(", ", *[F.lead("names", n).over(in_order) for n in range(1, following + 1)])
    first = F.when((F.col("page") == 0) & F.col("title").isNotNull(), F.concat("title", F.lit("\n"))).otherwise("")
    end = F.right(F.concat(first, "names"), F.lit(overlap))
    met = pages.select("session_id", "page", end.alias("_end"), F.substring(after, 1, overlap).alias("_start"), F.lead("page").over(in_order).alias("_next"))
    return met.where(F.col("_next").isNotNull() & matches(needle, F.concat("_end", F.lit(", "), "_start"))).select("session_id")


def share_links(sessions: DataFrame, host: str) -> DataFrame:
    return sessions.select(
        "session_id",
        "event_id",
        session_link(host).alias("session_url"),
        event_link(host).alias("event_url"),
        qr_link().alias("qr_path"),
    )


# Session-list requests. Many requests may ask for one event, so each requested event is listed once, with
# the number of requests it answers; `requested_events` maps requests to events where that is needed.


def route_session_requests(requests: DataFrame) -> DataFrame:
    """Add `route`: what a request asks for. Zero counts as missing."""
    given = {name: F.coalesce(F.col(name), F.lit(0)) != 0 for name in ("response_id", "presenter_id", "event_id")}
    return requests.withColumn(
        "route",
        F.when(given["response_id"], "response")
        .when(given["presenter_id"] & given["event_id"], "presenter_event")
        .when(given["event_id"], "event")
        .otherwise("rejected"),
    )


def requested_events(requests: DataFrame, responses: DataFrame, sessions: DataFrame) -> DataFrame:
    """The event of each routed request; rejected ones and unknown responses give no row."""
    routed = route_session_requests(requests)
    members = responses.select("response_id", "session_id").join(
        sessions.select("session_id", F.col("event_id").alias("_event_id")), "session_id"
    )
    by_response = (
        routed.where("route = 'response'")
        .join(members, "response_id")
        .select("request_id", "route", F.col("_event_id").alias("event_id"))
    )
    by_event = routed.where("route IN ('presenter_event', 'event')").select("request_id", "route", "event_id")
    return by_response.unionByName(by_event)


def _list_events(event_ids: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    asked = event_ids.groupBy("event_id").agg(F.count("*").alias("n_requests"))
    sessions = catalog["sessions"]
    return _listing_of(salted_join(sessions, asked, hot_keys(sessions, "event_id"), "event_id", "session_id"), catalog)


def _listing_of(sessions: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    return session_listing(
        sessions, catalog["events"], catalog["session_presenters"], catalog["presenters"], restrict=True
    )


def sessions_by_response(requests: DataFrame, responses: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """All sessions of the events the responses belong to. `catalog` holds events, sessions,
    session_presenters and presenters."""
    members = (
        requests.select("response_id")
        .join(responses.select("response_id", "session_id"), "response_id")
        .join(catalog["sessions"].select("session_id", "event_id"), "session_id")
    )
    return _list_events(members.select("event_id"), catalog)


def sessions_by_presenter_event(requests: DataFrame, catalog: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """All sessions of the requested events; `strict=True` keeps only the requested speaker's."""
    if not strict:
        return _list_events(requests.select("event_id"), catalog)
    pairs = requests.groupBy("presenter_id", "event_id").agg(F.count("*").alias("n_requests"))
    links = catalog["session_presenters"].select("session_id", F.col("presented_by_id").alias("presenter_id"))
    wanted = links.join(catalog["sessions"].select("session_id", "event_id"), "session_id").join(
        pairs, ["presenter_id", "event_id"]
    )
    asked = wanted.select("session_id", "presenter_id", "n_requests")
    sessions = catalog["sessions"].join(asked.select("session_id").distinct(), "session_id", "left_semi")
    return _listing_of(sessions, catalog).join(asked, "session_id")


def sessions_by_event(requests: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """All sessions of the requested events."""
    return _list_events(requests.where("event_id IS NOT NULL").select("event_id"), catalog)
