"""Bulk upserts of presenters, sessions and speaker links, and new responses. Snapshot in, snapshot out.

Requests of one key are reduced to one row before any join, so a key repeated across a third of a batch
costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.graph import components
from podium.functions.ids import assign_ids
from podium.functions.skew import hot_keys, salted_join
from podium.functions.store import stored
from podium.operators.lookup import accepts


def _last(column: str, seq: str = "seq"):
    return F.max_by(column, seq).alias(column)


# Presenters


class PresenterCalls:
    """Carries out upsert calls of one component in order: a call updates every presenter with its email or its
    identifier, or else inserts one. A call that would give one identifier to several presenters fails."""

    def __init__(self):
        self.rows: list[dict] = []
        self.by_email: dict[str, set[int]] = {}
        self.by_identifier: dict[str, set[int]] = {}
        self.identities: set[str] = set()

    def add(self, presenter_id: int | None, identity: str | None, name: str, email: str | None, identifier: str | None) -> int:
        self.rows.append({"presenter_id": presenter_id, "identity": identity, "name": name, "email": None, "identifier": None})
        self.set_keys(len(self.rows) - 1, email, identifier)
        return len(self.rows) - 1

    def set_keys(self, at: int, email: str | None, identifier: str | None) -> None:
        for index, key, value in ((self.by_email, "email", email), (self.by_identifier, "identifier", identifier)):
            if value is not None:
                index.get(self.rows[at][key], set()).discard(at)
                index.setdefault(value, set()).add(at)
                self.rows[at][key] = value

    def call(self, name: str, email: str | None, identifier: str | None, seq: int) -> list[int]:
        """Places of the presenters it met or made; none if it failed."""
        met = self.by_email.get(email, set()) | self.by_identifier.get(identifier, set())
        if len(met) > 1 and identifier is not None:
            return []
        for at in met:
            self.rows[at]["name"] = name
            self.set_keys(at, email, identifier)
        if met:
            return sorted(met)
        identity = f"i:{identifier}" if identifier is not None else f"e:{email}"
        if identity in self.identities:
            identity += f"#{seq}"
        self.identities.add(identity)
        return [self.add(None, identity, name, email, identifier)]


PRESENTER_RESULT = "kind string, presenter_id bigint, identity string, name string, email string, identifier string, seq bigint"


def _call_presenters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a component stand together, stored presenters first, then calls by seq. Kinds of the output:
    `presenter` as it is in the end, `assigned` for each presenter a call met or made, `rejected` calls."""
    columns = [c.split(" ")[0] for c in PRESENTER_RESULT.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(columns, types, strict=True)))
    component, calls, out = None, PresenterCalls(), []

    def record(kind: str, seq: int | None = None, **values) -> None:
        out.append({**dict.fromkeys(columns), **values, "kind": kind, "seq": seq})

    def close() -> None:
        for row in calls.rows:
            record("presenter", **row)

    def flushed() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if row["component"] != component:
                close()
                component, calls = row["component"], PresenterCalls()
            keys = (row["name"], row["email"], row["identifier"])
            if not row["is_call"]:
                calls.add(row["presenter_id"], None, *keys)
                continue
            places = calls.call(*keys, row["seq"])
            if not places:
                record("rejected", row["seq"], name=keys[0], email=keys[1], identifier=keys[2])
            for at in places:
                record("assigned", row["seq"], presenter_id=calls.rows[at]["presenter_id"], identity=calls.rows[at]["identity"])
        yield from flushed()
    close()
    yield from flushed()


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add `component`: a number that rows share if a chain of emails and identifiers connects them."""
    node = F.coalesce(_node("email"), _node("identifier"))
    joined = rows.withColumn("_key", node).join(labels, F.col("_key") == F.col("node"), "left")
    return joined.withColumn("component", F.coalesce("root", "_key")).drop("_key", "node", "root")


def _node(key: str):
    """A number for an email or an identifier. Should two of them share one, their components are one."""
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(key), F.col(key)))


def upsert_presenters(presenters: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert or update presenters matched on email or identifier, in the order of seq; NULL matches nothing.

    `incoming` has name, email, identifier and seq. A call renames every presenter it matches and gives it its
    email and identifier, where given. Returns the new snapshot, the rejected calls, which would give one
    identifier to several presenters, and `assigned` (seq, presenter_id) of the others.

    Calls depend on each other only if keys connect them. Components of stored rows and calls that share an email
    or identifier are replayed one by one, each by a task that holds the component's presenters and lets the
    calls pass by, so many calls of one key take no memory.
    """
    keyless = incoming.where("email IS NULL AND identifier IS NULL")
    keyed = incoming.where("email IS NOT NULL OR identifier IS NOT NULL")
    fields = ["name", "email", "identifier"]
    calls = keyed.select(F.lit(1).alias("is_call"), F.lit(None).cast("bigint").alias("presenter_id"), *fields, "seq")
    known = presenters.select(F.lit(0).alias("is_call"), "presenter_id", *fields, F.col("presenter_id").alias("seq"))
    has_key = "email IS NOT NULL OR identifier IS NOT NULL"
    rows = calls.unionByName(known.where(has_key))
    both = rows.where("email IS NOT NULL AND identifier IS NOT NULL")
    labels = components(both.select(_node("email").alias("a"), _node("identifier").alias("b")))
    placed = _with_component(rows, labels).repartition("component").sortWithinPartitions("component", "is_call", "seq")
    done = stored(placed.mapInArrow(_call_presenters, PRESENTER_RESULT), "presenter-calls")

    made = done.where("kind = 'presenter' AND presenter_id IS NULL").select("identity", *fields).unionByName(
        keyless.select(F.concat(F.lit("n:"), F.col("seq").cast("string")).alias("identity"), *fields)
    )
    new = assign_ids(made, "identity", taken=presenters.select("presenter_id"), name="presenter_id")
    kept = done.where("kind = 'presenter' AND presenter_id IS NOT NULL").select("presenter_id", *fields)
    snapshot = (
        kept.unionByName(presenters.where(f"NOT ({has_key})").select("presenter_id", *fields))
        .unionByName(new.select("presenter_id", *fields))
    )
    rejected = done.where("kind = 'rejected'").select(
        *fields, "seq", F.lit("brings one identifier to several presenters").alias("error")
    )
    met = done.where("kind = 'assigned'")
    by_identity = met.where("identity IS NOT NULL").select("seq", "identity").unionByName(
        keyless.select("seq", F.concat(F.lit("n:"), F.col("seq").cast("string")).alias("identity"))
    )
    assigned = met.where("identity IS NULL").select("seq", "presenter_id").unionByName(
        by_identity.join(new.select("identity", "presenter_id"), "identity").select("seq", "presenter_id")
    )
    return snapshot, rejected, assigned


# Sessions


def upsert_sessions(sessions: DataFrame, session_presenters: DataFrame, events: DataFrame, incoming: DataFrame
                    ) -> dict[str, DataFrame]:
    """Insert or retitle sessions. Returns the snapshots `sessions` and `session_presenters`, `assigned` (seq,
    session_id) of every request carried out, and `rejected` (seq, event_id, error) of the others.

    `incoming` has event_id, title, feed_id and seq. Requests with a feed id match on (event, feed id), and
    the stored links of a matched session are dropped; those without always insert. The event must exist.
    """
    rejected = incoming.join(events.select("event_id"), "event_id", "left_anti").select(
        "seq", "event_id", F.lit("event not found").alias("error")
    )
    incoming = incoming.join(events.select("event_id"), "event_id", "left_semi")
    latest = incoming.where("feed_id IS NOT NULL").groupBy("event_id", "feed_id").agg(_last("title").alias("new_title"))
    merged = sessions.where("feed_id IS NOT NULL").join(latest, ["event_id", "feed_id"], "full_outer")
    kept = merged.where("session_id IS NOT NULL").select(
        "session_id", "event_id", "feed_id", F.coalesce("new_title", "title").alias("title")
    ).unionByName(sessions.where("feed_id IS NULL"))
    new = (
        merged.where("session_id IS NULL")
        .select(
            F.concat_ws("/", F.lit("session"), "event_id", "feed_id").alias("identity"),
            "event_id", "feed_id", F.col("new_title").alias("title"),
        )
        .unionByName(
            incoming.where("feed_id IS NULL").select(
                F.concat_ws("/", F.lit("session"), "event_id", F.lit("seq"), "seq").alias("identity"),
                "event_id", "feed_id", "title",
            )
        )
    )
    by_seq = F.concat_ws("/", F.lit("session"), "event_id", F.lit("seq"), "seq").alias("identity")
    new = assign_ids(new, "identity", taken=sessions.select("session_id"), name="session_id")
    matched = sessions.join(latest, ["event_id", "feed_id"], "left_semi").select("session_id")
    links = session_presenters.join(matched, "session_id", "left_anti")
    snapshot = kept.unionByName(new.drop("identity"))
    # A feed repeats few requests of one session, so these joins have no hot key but a NULL, which is kept apart.
    with_feed = incoming.where("feed_id IS NOT NULL").select("seq", "event_id", "feed_id").join(
        snapshot.where("feed_id IS NOT NULL").select("event_id", "feed_id", "session_id"), ["event_id", "feed_id"]
    )
    without = incoming.where("feed_id IS NULL").select("seq", by_seq).join(new.select("identity", "session_id"), "identity")
    assigned = with_feed.select("seq", "session_id").unionByName(without.select("seq", "session_id"))
    return {"sessions": snapshot, "session_presenters": links, "assigned": assigned, "rejected": rejected}


def upsert_session_presenters(session_presenters: DataFrame, sessions: DataFrame, presenters: DataFrame,
                              incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert or update links; an owner request demotes every other owner of its session. Returns the new links
    and the rejected requests, whose session or speaker does not exist.

    `incoming` has session_id, presenter_id, is_owner and seq. A link owns its session after the batch if
    its last word is "owner" and no other speaker of the session was made owner later.
    """
    known = _with_parent(_with_parent(incoming, sessions, "session_id"), presenters, "presenter_id")
    error = F.when(~F.col("has_session_id"), "session not found").when(~F.col("has_presenter_id"), "presenter not found")
    known = known.withColumn("error", error)
    rejected = known.where("error IS NOT NULL").select("seq", "session_id", "presenter_id", "error")
    incoming = known.where("error IS NULL")
    links = session_presenters.select(
        "session_id",
        F.col("presented_by_id").alias("presenter_id"),
        F.col("is_session_owner").alias("is_owner"),
        F.lit(-(2**63)).cast("bigint").alias("seq"),
    )
    requests = incoming.select("session_id", "presenter_id", "is_owner", "seq")
    per_link = (
        links.unionByName(requests)
        .groupBy("session_id", "presenter_id")
        .agg(_last("is_owner"))
    )
    per_link = stored(per_link, "links")
    owners = (
        requests.where("is_owner")
        .groupBy("session_id")
        .agg(F.max_by("presenter_id", "seq").alias("owner_id"))
    )
    keeps = F.col("is_owner") & (F.col("owner_id").isNull() | (F.col("owner_id") == F.col("presenter_id")))
    large = hot_keys(per_link, "session_id")
    snapshot = salted_join(per_link, owners, large, "session_id", "presenter_id", "left").select(
        "session_id", F.col("presenter_id").alias("presented_by_id"), keeps.alias("is_session_owner")
    )
    return snapshot, rejected


def _with_parent(requests: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Add `has_<key>`: whether the parent exists. Parents are unique and not aggregated, so that Spark itself splits
    one with many requests."""
    exists = parents.select(key, F.lit(True).alias("_exists"))
    return requests.join(exists, key, "left").withColumn(f"has_{key}", F.col("_exists").isNotNull()).drop("_exists")


# Responses


def init_responses(responses: DataFrame, requests: DataFrame, sessions: DataFrame, events: DataFrame,
                   bits: int = 48) -> tuple[DataFrame, DataFrame]:
    """A blank response per request whose session is open at the time of the request.

    `requests` has request_id, session_id and requested_at. Returns the new responses (with their
    request_id) and the rejected requests.
    """
    windows = sessions.select("session_id", "event_id").join(
        events.select("event_id", "accepts_responses_from", "accepts_responses_to"), "event_id"
    )
    checked = requests.join(windows, "session_id", "left").withColumn(
        "is_open", F.col("event_id").isNotNull() & accepts(F.col("requested_at"))
    )
    rejected = checked.where("NOT is_open").select(
        "request_id", "session_id", F.lit("unknown session, or it takes no responses").alias("error")
    )
    accepted = checked.where("is_open").withColumn("identity", F.concat(F.lit("response/"), F.col("request_id").cast("string")))
    created = F.date_trunc("millisecond", F.col("requested_at")).cast("timestamp_ntz")
    new = assign_ids(accepted, "identity", bits, responses.select("response_id"), "response_id").select(
        "request_id",
        "response_id",
        "session_id",
        F.md5(F.concat(F.lit("client/"), F.col("request_id").cast("string"))).alias("client_key"),
        created.alias("created"),
        created.alias("updated"),
    )
    return new, rejected
