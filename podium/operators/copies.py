"""Creating events, alone or as copies of a template with all ids remapped, and granting users access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.ids import assign_ids
from podium.functions.skew import hot_keys, nullable_left_join, salted_join
from podium.functions.text import collated
from podium.operators.lookup import resolve_template


def create_events(tables: dict[str, DataFrame], requests: DataFrame, store_key: bool = False,
                  bits: int = 48) -> dict[str, DataFrame]:
    """Create or update events and copy the questionnaires of their templates.

    Adds the snapshots `questions` and `answer_options` to the result of `create_event_rows`.
    """
    result = create_event_rows(tables["events"], requests, store_key, bits)
    questions, options = copy_questionnaires(tables["questions"], tables["answer_options"], result["copies"])
    return {
        **result,
        "questions": tables["questions"].unionByName(questions),
        "answer_options": tables["answer_options"].unionByName(options),
    }


def create_event_rows(events: DataFrame, requests: DataFrame, store_key: bool = False,
                      bits: int = 48) -> dict[str, DataFrame]:
    """Apply create-event requests in the order of request_id.

    `requests` has request_id, name, from_template_event_id, from_template_name, is_template, css,
    accepts_from, accepts_to, api_key and event_secret. Returns the snapshot `events`, the `copies` to make
    (event_id, template_id), and one row per request in `created` (request_id, event_id, event_secret), `updated`
    (request_id, event_id) or `rejected` (request_id, from_template_name, error).

    A request with the API key of a stored event, or of one that an earlier request of the batch created,
    updates that event: every field is overwritten, also with NULL, and no secret is returned. Without a
    template the API key is not stored unless `store_key`.
    """
    keyed_events = events.where("api_key IS NOT NULL").select("api_key", F.col("event_id").alias("known_id"))
    requests = requests.join(keyed_events, "api_key", "left")

    resolved, unknown = resolve_template(requests.where("known_id IS NULL"), events)
    templates = events.select(
        F.col("event_id").alias("from_template_event_id"), F.col("name").alias("t_name"), F.col("css").alias("t_css"),
        F.lit(True).alias("t_found"),
    )
    resolved = resolved.join(templates, "from_template_event_id", "left")
    # A template id without an event creates nothing.
    lost = F.col("from_template_event_id").isNotNull() & F.col("t_found").isNull()
    unknown = unknown.select(*requests.columns, "error").unionByName(
        resolved.where(lost).select(*requests.columns, F.lit("no event of that template id").alias("error"))
    )
    resolved = resolved.where(~lost)
    stores_key = F.lit(True) if store_key else F.col("from_template_event_id").isNotNull()
    creators = (
        resolved.where(F.col("api_key").isNotNull() & stores_key)
        .groupBy("api_key")
        .agg(F.min("request_id").alias("creator_id"))
    )

    popular = hot_keys(requests, "api_key")

    def after_creator(df: DataFrame) -> DataFrame:
        return salted_join(df, creators, popular, "api_key", "request_id", "left").withColumn(
            "repeats", F.coalesce(F.col("request_id") > F.col("creator_id"), F.lit(False))
        )

    resolved, unknown = after_creator(resolved), after_creator(unknown)

    identity = F.concat(F.lit("event/"), F.col("request_id").cast("string"))
    created = assign_ids(
        resolved.where("NOT repeats").withColumn("identity", identity), "identity", bits,
        events.select("event_id"), "event_id",
    ).checkpoint()
    new_events = created.select(
        "event_id",
        F.coalesce("name", "t_name").alias("name"),
        F.coalesce("css", "t_css").alias("css"),
        "is_template",
        F.col("accepts_from").alias("accepts_responses_from"),
        F.col("accepts_to").alias("accepts_responses_to"),
        F.when(stores_key, F.col("api_key")).alias("api_key"),
        "event_secret",
    )

    fields = ["request_id", "name", "css", "is_template", "accepts_from", "accepts_to"]
    updates = (
        requests.where("known_id IS NOT NULL").select("api_key", *fields)
        .unionByName(resolved.where("repeats").select("api_key", *fields))
        .unionByName(unknown.where("repeats").select("api_key", *fields))
        .groupBy("api_key")
        .agg(F.max_by(F.struct(fields[1:]), "request_id").alias("u"))
    )
    after = nullable_left_join(events.unionByName(new_events), updates, "api_key", "event_id")

    def field(new: str, old: str):
        return F.when(F.col("u").isNotNull(), F.col(f"u.{new}")).otherwise(F.col(old)).alias(old)

    snapshot = after.select(
        "event_id", field("name", "name"), field("css", "css"), field("is_template", "is_template"),
        field("accepts_from", "accepts_responses_from"), field("accepts_to", "accepts_responses_to"),
        "api_key", "event_secret",
    )

    # An update returns the id of its event, but no secret.
    by_creator = created.where("api_key IS NOT NULL").select(F.col("request_id").alias("creator_id"), "event_id")
    repeats = resolved.where("repeats").select("request_id", "creator_id").unionByName(
        unknown.where("repeats").select("request_id", "creator_id")
    )
    updated = requests.where("known_id IS NOT NULL").select("request_id", F.col("known_id").alias("event_id")).unionByName(
        repeats.join(by_creator, "creator_id").select("request_id", "event_id")
    )
    copies = created.where("from_template_event_id IS NOT NULL").select(
        "event_id", F.col("from_template_event_id").alias("template_id")
    )
    return {
        "events": snapshot,
        "created": created.select("request_id", "event_id", "event_secret"),
        "updated": updated,
        "copies": copies,
        "rejected": unknown.where("NOT repeats").select("request_id", "from_template_name", "error"),
    }


def copy_questionnaires(questions: DataFrame, options: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copy questions and options of `template_id` to `event_id` for every row of `copies`.

    Follow-ups to questions outside the template become NULL.
    """
    copied = questions.withColumnRenamed("event_id", "template_id").join(copies, "template_id")
    copied = copied.withColumn("identity", F.concat_ws("/", F.lit("question"), "event_id", "question_id"))
    copied = assign_ids(copied, "identity", 60, questions.select("question_id"), "new_question_id").checkpoint()
    id_map = copied.select("event_id", "question_id", "new_question_id")
    new_questions = copied.select(
        F.col("new_question_id").alias("question_id"), "event_id", "display_order", "question", "description",
        "optimal_percent", "is_required", "type", "has_plaintext",
    )
    follow_up = id_map.select(
        "event_id",
        F.col("question_id").alias("if_selected_show_question_id"),
        F.col("new_question_id").alias("new_follow_up_id"),
    )
    copied_options = (
        options.join(id_map, "question_id")
        .join(follow_up, ["event_id", "if_selected_show_question_id"], "left")
        .withColumn("identity", F.concat_ws("/", F.lit("option"), "event_id", "answer_option_id"))
        .drop("answer_option_id")
    )
    copied_options = assign_ids(copied_options, "identity", 60, options.select("answer_option_id"), "answer_option_id")
    new_options = copied_options.select(
        F.col("new_question_id").alias("question_id"), "answer_option_id", "answer_ordinal", "percent_value",
        F.col("new_follow_up_id").alias("if_selected_show_question_id"), "annotation", "css_classes",
    )
    return new_questions, new_options


def grant_event_users(requests: DataFrame, principals: DataFrame, faithful: bool = False,
                      collation: str | None = None) -> DataFrame:
    """Users of each event: the entries of its comma list and the caller, where a principal has that name,
    or has it after its domain.

    `requests` has event_id, userlist and me. With `faithful`, an empty entry matches every principal
    without a domain that ends in nothing after its name, that is, all names without a backslash.
    """
    names = F.array_append(F.split(F.coalesce("userlist", F.lit("")), ","), F.col("me"))
    entries = requests.select("event_id", "userlist", F.explode(names).alias("entry"))
    if faithful:
        # A NULL list adds no entry of its own.
        entries = entries.where("entry <> '' OR userlist IS NOT NULL")
    else:
        entries = entries.where("entry <> ''")
    entries = entries.select("event_id", collated("entry", collation).alias("entry")).distinct()
    # The part after the first backslash; a name without one has nothing after it.
    suffix = F.expr("substring(name, locate('\\\\', concat(name, '\\\\')) + 1)")
    by_name = principals.select(collated("name", collation).alias("entry"), F.col("name").alias("user"))
    by_suffix = principals.select(collated(suffix, collation).alias("entry"), F.col("name").alias("user"))
    if not faithful:
        by_suffix = by_suffix.where("entry <> ''")
    granted = entries.join(by_name, "entry").unionByName(entries.join(by_suffix, "entry"))
    return granted.select("event_id", "user").distinct()
