"""Folding the log of answer changes into answers, text answers and touched responses.

A change adds (ordinal > 0, or a text), resets (ordinal < 0 unchecks, an empty text clears) or does
nothing (ordinal 0). Everything is an aggregate that combines before the shuffle; the only join on the
log is with one row per reset slot, salted for responses that dominate the log; in long logs only rows that
a filter of the reset slots lets through are shuffled to it. No window or collected
list runs over a response. The aggregates are merged once more after the rows met their response and
option, so salted parts cost no shuffle of their own. Validity (does the question belong to the
response's event, does the option exist) is checked on the folded rows, far fewer than the changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.prune import MAY_MEET, key_filter, looked_up
from podium.functions.skew import HOT_ROWS, SALT, hot_keys, salt, salted_join
from podium.functions.store import stored

# Stored rows enter a fold as if clicked before every change of the log.
BEFORE_LOG = -(2**63)
# A log with more rows is read a second time, to keep rows that no reset can reach out of the join with the resets.
PRUNE_ROWS = 20_000_000

ANSWER_COLUMNS = ["response_id", "question_id", "answer_option_id", "created", "revision", "updated"]
TEXT_COLUMNS = ["response_id", "question_id", "plaintext", "created", "revision", "updated"]
LOG_COLUMNS = ["response_id", "question_id", "answer_ordinal", "plaintext", "ts", "seq"]


def response_events(responses: DataFrame, sessions: DataFrame) -> DataFrame:
    """The session and event of every response."""
    return responses.select("response_id", "session_id").join(
        sessions.select("session_id", "event_id"), "session_id"
    )


def popular_events(responses: DataFrame, sessions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events with more than `hot_rows` responses, for salting. Responses are counted per session first, and
    only the counts meet the sessions."""
    counts = responses.groupBy("session_id").agg(F.count("*").alias("_responses"))
    per_event = counts.join(sessions.select("session_id", "event_id"), "session_id")
    return hot_keys(per_event, "event_id", hot_rows, F.col("_responses"))


def click_targets(questions: DataFrame, options: DataFrame) -> DataFrame:
    """What a click can hit: one row per option, with its question's event and type."""
    return options.select("question_id", "answer_ordinal", "answer_option_id").join(
        questions.select("question_id", "event_id", "type"), "question_id"
    )


# Marks: the common form of log changes, stored rows and stream deltas.


def click_marks(changes: DataFrame) -> DataFrame:
    return changes.where("answer_ordinal > 0").select(
        "response_id",
        "question_id",
        "answer_ordinal",
        F.lit(1).cast("bigint").alias("clicks"),
        F.col("ts").alias("first_ts"),
        F.col("ts").alias("last_ts"),
        F.col("seq").alias("first_seq"),
        "seq",
    )


def click_resets(changes: DataFrame) -> DataFrame:
    return changes.where("answer_ordinal < 0").select(
        "response_id",
        "question_id",
        (-F.col("answer_ordinal")).cast("smallint").alias("answer_ordinal"),
        "seq",
    )


def text_marks(changes: DataFrame) -> DataFrame:
    return changes.where("answer_ordinal IS NULL AND plaintext <> ''").select(
        "response_id",
        "question_id",
        "plaintext",
        F.lit(1).cast("bigint").alias("clicks"),
        F.col("ts").alias("first_ts"),
        F.col("ts").alias("last_ts"),
        F.col("seq").alias("first_seq"),
        "seq",
    )


def text_resets(changes: DataFrame) -> DataFrame:
    return changes.where("answer_ordinal IS NULL AND coalesce(plaintext, '') = ''").select(
        "response_id", "question_id", "seq"
    )


def stored_marks(rows: DataFrame, payload: str, seq: Column | None = None) -> DataFrame:
    """Rows that are folded already; `payload` is `answer_ordinal` or `plaintext`. `seq` is their place, before
    the log by default."""
    seq = F.lit(BEFORE_LOG).cast("bigint") if seq is None else seq
    return rows.select(
        "response_id",
        "question_id",
        payload,
        (F.col("revision") + 1).cast("bigint").alias("clicks"),
        F.col("created").alias("first_ts"),
        F.col("updated").alias("last_ts"),
        seq.alias("first_seq"),
        seq.alias("seq"),
    )


def stored_click_marks(answers: DataFrame, options: DataFrame, seq: Column | None = None) -> DataFrame:
    ordinals = options.select("answer_option_id", "answer_ordinal")
    return stored_marks(answers.join(ordinals, "answer_option_id"), "answer_ordinal", seq)


# Folds over marks


def busy_responses(log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Responses with more than `hot_rows` log rows, for salting. Counting reads one column of the log, and
    one list serves both folds."""
    return hot_keys(log, "response_id", hot_rows)


def busy_and_long(log: DataFrame, hot_rows: int, prune_rows: int) -> tuple[DataFrame, bool]:
    """`busy_responses`, and whether the log has more than `prune_rows` rows. The count reads no column."""
    return busy_responses(log, hot_rows), log.count() > prune_rows


def _with_live_seq(marks: DataFrame, resets: DataFrame | None, slot: list[str], hot: DataFrame) -> DataFrame:
    """Add `live_seq`, the mark's first seq where no later reset hit its slot, else NULL, and the salt. A mark of
    several clicks never has a reset between them."""
    if resets is None:
        return marks.withColumn("live_seq", F.col("first_seq")).withColumn(SALT, F.lit(0))
    last_reset = resets.groupBy(slot).agg(F.max("seq").alias("reset_seq"))
    marks, last_reset = salt(marks, last_reset, hot, "response_id", "seq")
    live = F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq"))
    return marks.join(last_reset, [*slot, SALT], "left").withColumn("live_seq", F.when(live, F.col("first_seq")))


def _fold_live(
    marks: DataFrame,
    resets: DataFrame | None,
    slot: list[str],
    hot: DataFrame | None,
    prune: bool,
    fold: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """`fold`, an aggregate that keeps the slots apart, of the marks with `live_seq` and the salt.

    With `prune`, only marks whose slot may have a reset are shuffled to the resets. The others are live and go to the
    aggregate as they are, which combines them first. All marks of a slot go the same way.
    """
    words = key_filter(resets, slot) if prune and resets is not None else None
    if words is None:
        return fold(_with_live_seq(marks, resets, slot, hot))
    marks = looked_up(marks, words, slot)
    reached = _with_live_seq(marks.where(MAY_MEET).drop(MAY_MEET), resets, slot, hot)
    free = _with_live_seq(marks.where(~F.col(MAY_MEET)).drop(MAY_MEET), None, slot, hot)
    return fold(reached).unionByName(fold(free))


def fold_click_marks(
    marks: DataFrame,
    resets: DataFrame | None,
    members: DataFrame,
    targets: DataFrame,
    hot: DataFrame | None = None,
    scoped: bool = False,
    prune: bool = False,
) -> DataFrame:
    """Answers of all question types, with `session_id`, `event_id`, `type` and `answer_ordinal`.

    An uncheck hits its ordinal on every checkbox question of the response, whatever question it names;
    `scoped=True` limits it to that question.
    """

    def per_option(live: DataFrame) -> DataFrame:
        return live.groupBy("response_id", "question_id", "answer_ordinal", SALT).agg(
            F.sum("clicks").alias("clicks"),
            F.min("first_seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.min_by("first_ts", "first_seq").alias("first_ts"),
            F.max_by("last_ts", "seq").alias("last_ts"),
            F.min("live_seq").alias("checked_seq"),
            F.min_by("first_ts", "live_seq").alias("checked_ts"),
        )

    return valid_answers(_fold_live(marks, resets, click_slot(scoped), hot, prune, per_option), members, targets)


def valid_answers(per_option: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """Answers from what is folded per response, question and ordinal, as far as response and option exist.

    The options come first, so that the rows meet their response on the partitioning of the last aggregate."""
    valid = per_option.join(targets, ["question_id", "answer_ordinal"]).join(members, ["response_id", "event_id"])
    is_radio = F.col("type") == "radio"
    is_checkbox = F.col("type") == "checkbox"
    # A radio question keeps one row, from its first to its last click. A checkbox or text question keeps
    # one row per option, which never changes after the click that made it.
    kept = valid.where(~is_checkbox | F.col("checked_seq").isNotNull()).select(
        "response_id",
        "session_id",
        "event_id",
        "question_id",
        "type",
        "answer_ordinal",
        "answer_option_id",
        F.when(is_radio, F.lit(0)).otherwise(F.col("answer_option_id")).cast("bigint").alias("item"),
        "clicks",
        F.when(is_checkbox, F.col("checked_seq")).otherwise(F.col("first_seq")).alias("first_seq"),
        "last_seq",
        F.when(is_checkbox, F.col("checked_ts")).otherwise(F.col("first_ts")).alias("first_ts"),
        "last_ts",
    )
    return (
        kept.groupBy("response_id", "session_id", "event_id", "question_id", "type", "item")
        .agg(
            F.max_by("answer_option_id", "last_seq").alias("answer_option_id"),
            F.max_by("answer_ordinal", "last_seq").alias("answer_ordinal"),
            F.min_by("first_ts", "first_seq").alias("created"),
            (F.sum("clicks") - 1).alias("revised"),
            F.max_by("last_ts", "last_seq").alias("last_ts"),
        )
        .select(
            "response_id",
            "session_id",
            "event_id",
            "question_id",
            "type",
            "answer_option_id",
            "answer_ordinal",
            "created",
            F.when(is_radio, F.col("revised")).otherwise(0).cast("bigint").alias("revision"),
            F.when(is_radio, F.col("last_ts")).otherwise(F.col("created")).alias("updated"),
        )
    )


def fold_text_marks(
    marks: DataFrame, resets: DataFrame, members: DataFrame, questions: DataFrame, hot: DataFrame, prune: bool = False
) -> DataFrame:
    """Text answers with `session_id` and `event_id`: the texts after the last empty one."""
    slot = ["response_id", "question_id"]

    def per_question(live: DataFrame) -> DataFrame:
        return live.where("live_seq IS NOT NULL").groupBy(*slot, SALT).agg(
            F.min("first_seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.max_by("plaintext", "seq").alias("plaintext"),
            F.min_by("first_ts", "first_seq").alias("first_ts"),
            F.sum("clicks").alias("clicks"),
            F.max_by("last_ts", "seq").alias("last_ts"),
        )

    return (
        _fold_live(marks, resets, slot, hot, prune, per_question).join(members, "response_id")
        .groupBy("response_id", "session_id", "event_id", "question_id")
        .agg(
            F.max_by("plaintext", "last_seq").alias("plaintext"),
            F.min_by("first_ts", "first_seq").alias("created"),
            (F.sum("clicks") - 1).alias("revision"),
            F.max_by("last_ts", "last_seq").alias("updated"),
        )
        .join(questions.select("question_id", "event_id"), ["question_id", "event_id"])
    )


# Partial folds: what a part of the log leaves for a later fold, without a look at responses or questions.


def click_slot(scoped: bool) -> list[str]:
    return ["response_id", "question_id", "answer_ordinal"] if scoped else ["response_id", "answer_ordinal"]


def partial_clicks(marks: DataFrame, resets: DataFrame, hot: DataFrame, scoped: bool = False) -> DataFrame:
    """Marks of the clicks up to the last reset of their slot, which only radio and text questions count, and of
    those after it."""
    live = _with_live_seq(marks, resets, click_slot(scoped), hot)
    merged = live.groupBy("response_id", "question_id", "answer_ordinal", F.col("live_seq").isNull().alias("_dead"), SALT)
    return merged.agg(*_merged_marks()).drop("_dead", SALT)


def partial_texts(marks: DataFrame, resets: DataFrame, hot: DataFrame) -> DataFrame:
    """Marks of the texts after the last empty one of their question."""
    live = _with_live_seq(marks, resets, ["response_id", "question_id"], hot).where("live_seq IS NOT NULL")
    merged = live.groupBy("response_id", "question_id", SALT)
    return merged.agg(F.max_by("plaintext", "seq").alias("plaintext"), *_merged_marks()).drop(SALT)


def _merged_marks() -> list[Column]:
    return [
        F.sum("clicks").alias("clicks"),
        F.min_by("first_ts", "first_seq").alias("first_ts"),
        F.max_by("last_ts", "seq").alias("last_ts"),
        F.min("first_seq").alias("first_seq"),
        F.max("seq").alias("seq"),
    ]


# User-level operators


def fold_clicks(
    changes: DataFrame,
    responses: DataFrame,
    sessions: DataFrame,
    questions: DataFrame,
    options: DataFrame,
    scoped: bool = False,
    hot_rows: int = HOT_ROWS,
    prune_rows: int = PRUNE_ROWS,
) -> DataFrame:
    """Fold the clicks of all question types together."""
    hot, prune = busy_and_long(changes, hot_rows, prune_rows)
    return fold_click_marks(
        click_marks(changes),
        click_resets(changes),
        response_events(responses, sessions),
        click_targets(questions, options),
        hot,
        scoped,
        prune,
    )


def fold_radio(changes, responses, sessions, questions, options) -> DataFrame:
    """One row per response and radio question: the last option, and how often it was revised.

    No uncheck can reach a radio question, so the log is aggregated without any join before.
    """
    folded = fold_click_marks(
        click_marks(changes),
        None,
        response_events(responses, sessions),
        click_targets(questions.where("type = 'radio'"), options),
    )
    return folded.select(ANSWER_COLUMNS)


def fold_checkbox(changes, responses, sessions, questions, options, scoped: bool = False,
                  hot_rows: int = HOT_ROWS, prune_rows: int = PRUNE_ROWS) -> DataFrame:
    """One row per checked option: first check after the last uncheck."""
    checkboxes = questions.where("type = 'checkbox'")
    folded = fold_clicks(changes, responses, sessions, checkboxes, options, scoped, hot_rows, prune_rows)
    return folded.select(ANSWER_COLUMNS)


def fold_plaintext(changes, responses, sessions, questions, hot_rows: int = HOT_ROWS,
                   prune_rows: int = PRUNE_ROWS) -> DataFrame:
    """One row per response and question with text."""
    hot, prune = busy_and_long(changes, hot_rows, prune_rows)
    return fold_text_marks(
        text_marks(changes),
        text_resets(changes),
        response_events(responses, sessions),
        questions,
        hot,
        prune,
    ).select(TEXT_COLUMNS)


def repeated_text_clicks(changes, responses, sessions, questions, options) -> DataFrame:
    """Clicks on an option of a text question beyond the first: the stored key would be duplicated."""
    return (
        click_marks(changes)
        .groupBy("response_id", "question_id", "answer_ordinal")
        .agg(F.count("*").alias("clicks"))
        .where("clicks > 1")
        .join(response_events(responses, sessions), "response_id")
        .join(
            click_targets(questions.where("type = 'text'"), options),
            ["question_id", "answer_ordinal", "event_id"],
        )
        .select("response_id", "question_id", "answer_option_id", (F.col("clicks") - 1).alias("rejected"))
    )


def touch_responses(responses: DataFrame, changes: DataFrame) -> DataFrame:
    """Set `updated` to the time of the last change of any kind, valid or not."""
    last = changes.groupBy("response_id").agg(F.max_by("ts", "seq").alias("touched"))
    return responses.join(last, "response_id", "left").select(
        "response_id",
        "session_id",
        "client_key",
        "created",
        F.coalesce("touched", "updated").alias("updated"),
    )


def apply_changes(tables: dict[str, DataFrame], changes: DataFrame, scoped: bool = False,
                  hot_rows: int = HOT_ROWS, prune_rows: int = PRUNE_ROWS) -> dict[str, DataFrame]:
    """Apply a log to a snapshot. Returns all tables, the three changed ones replaced.

    The log is read about ten times (hot keys, count, filters, marks, resets, touches), so whatever it is made of is
    done once and stored."""
    changes = stored(changes.select(LOG_COLUMNS), "log")
    members = response_events(tables["responses"], tables["sessions"])
    questions, options = tables["questions"], tables["answer_options"]
    clicks, texts = click_marks(changes), text_marks(changes)
    if "response_answers" in tables:
        clicks = clicks.unionByName(stored_click_marks(tables["response_answers"], options))
    if "response_plaintext" in tables:
        texts = texts.unionByName(stored_marks(tables["response_plaintext"], "plaintext"))
    targets = click_targets(questions, options)
    hot, prune = busy_and_long(changes, hot_rows, prune_rows)
    answers = fold_click_marks(clicks, click_resets(changes), members, targets, hot, scoped, prune)
    plaintext = fold_text_marks(texts, text_resets(changes), members, questions, hot, prune)
    return {
        **tables,
        "response_answers": answers.select(ANSWER_COLUMNS),
        "response_plaintext": plaintext.select(TEXT_COLUMNS),
        "responses": touch_responses(tables["responses"], changes),
    }


def clicked_options(changes: DataFrame, responses: DataFrame, sessions: DataFrame, options: DataFrame,
                    questions: DataFrame) -> DataFrame:
    """Options each response ever clicked, checks and unchecks alike, with the last click's `seq`."""
    return (
        changes.where("answer_ordinal <> 0")
        .select("response_id", "question_id", F.abs("answer_ordinal").cast("smallint").alias("answer_ordinal"), "seq")
        .groupBy("response_id", "question_id", "answer_ordinal")
        .agg(F.max("seq").alias("seq"))
        .join(response_events(responses, sessions), "response_id")
        .join(
            options.join(questions.select("question_id", "event_id"), "question_id"),
            ["question_id", "answer_ordinal", "event_id"],
        )
    )


def visible_questions(changes, responses, sessions, questions, options, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Questions shown to each respondent: those displayed at once, and the follow-ups of clicked options.

    A response is joined to its event's displayed questions as one array, which the unique display order
    bounds at 256 entries, so the join itself does not multiply rows.
    """
    from podium.operators.questions import question_display

    displayed = (
        questions.select("question_id", "event_id")
        .join(question_display(questions, options).where("display"), "question_id")
        .groupBy("event_id")
        .agg(F.collect_list("question_id").alias("question_ids"))
    )
    members = response_events(responses, sessions)
    hot = popular_events(responses, sessions, hot_rows)
    at_once = salted_join(members, displayed, hot, "event_id", "response_id").select(
        "response_id", F.explode("question_ids").alias("question_id")
    )
    follow_ups = options.where("if_selected_show_question_id IS NOT NULL")
    opened = clicked_options(changes, responses, sessions, follow_ups, questions).select(
        "response_id", F.col("if_selected_show_question_id").alias("question_id")
    )
    # A question displayed at once is one that no option points at, so the two sides have nothing in common.
    return at_once.union(opened.distinct())


def answer_bands(changes, responses, sessions, questions, options) -> DataFrame:
    """The classes shown on each question: those of the last clicked option that has any."""
    banded = options.where("css_classes IS NOT NULL").select("question_id", "answer_ordinal", "css_classes")
    last = (
        clicked_options(changes, responses, sessions, banded, questions)
        .groupBy("response_id", "question_id")
        .agg(F.max_by("css_classes", "seq").alias("css_classes"))
    )
    return last.select("response_id", "question_id", F.split("css_classes", " ").alias("classes"))
