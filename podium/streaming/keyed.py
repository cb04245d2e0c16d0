"""The change-log fold as keyed streaming state: one state per response, current after every micro-batch.

`transformWithState` keeps the folded clicks and texts of a response in RocksDB and applies the changes of a batch
to them, in the order of `seq`; batches apply in the order they arrive. The work of a batch depends on the responses
it touches, not on what was folded before, and nothing is merged later: `keyed_state` reads the state store as a
table. The job can start from a stored snapshot, so the changes go on where the stored answers end: its answers are kept
as a table beside the state, which has only responses that changed, and meet their clicks and resets when it is read.

As in the delta job, whether a response, question or option exists is decided when the state is read, against the
tables as they are then. A click slot (question, ordinal) therefore keeps what any type of question needs: all its
clicks, and the first one after its last uncheck.

The changes of one response in one batch are held by one task. The source's own limits (`maxBytesPerTrigger`,
`maxFilesPerTrigger`) bound a batch; the slots a response was clicked in, unchecked or cleared bound its state.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from podium.functions.store import stored
from podium.operators import fold

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Times are microseconds, and the places of changes their numbers within the response: stored rows are at 0.
CLICK = ["question_id", "answer_ordinal", "clicks", "first_ts", "last_ts", "first_seq", "last_seq", "checked_ts", "checked_seq"]
TEXT = ["question_id", "plaintext", "clicks", "first_ts", "last_ts"]
# What hits stored answers and texts: unchecked ordinals, of a NULL question on all of them, and cleared questions.
RESET = ["question_id", "answer_ordinal"]
FORM = (
    f"changes bigint, touched_ts bigint, clicks array<struct<{', '.join(f'{c}: bigint' for c in CLICK)}>>, "
    f"texts array<struct<{', '.join(f'{c}: ' + ('string' if c == 'plaintext' else 'bigint') for c in TEXT)}>>, "
    f"unchecked array<struct<{', '.join(f'{c}: bigint' for c in RESET)}>>, cleared array<bigint>"
)
FEED = "response_id bigint, changes bigint, updated bigint"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def moment(column: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {column}, {EPOCH})")


class Form:
    """The folded changes of one response."""

    def __init__(self, changes: int = 0, touched_ts: int | None = None, clicks=(), texts=(), unchecked=(), cleared=()):
        self.changes, self.touched_ts = changes, touched_ts
        self.unchecked, self.cleared = {tuple(x) for x in unchecked or ()}, set(cleared or ())
        self.clicks = {(c[0], c[1]): dict(zip(CLICK, c, strict=True)) for c in clicks or ()}
        self.texts = {t[0]: dict(zip(TEXT, t, strict=True)) for t in texts or ()}

    def apply(self, question_id: int | None, ordinal: int | None, plaintext: str | None, ts: int) -> None:
        self.changes += 1
        self.touched_ts = ts
        if ordinal is None:
            if not plaintext:
                self.texts.pop(question_id, None)
                if question_id is not None:
                    self.cleared.add(question_id)
            elif question_id is not None:
                text = self.texts.setdefault(question_id, {"question_id": question_id, "clicks": 0, "first_ts": ts})
                text |= {"plaintext": plaintext, "clicks": text["clicks"] + 1, "last_ts": ts}
        elif ordinal > 0 and question_id is not None:
            new = {"question_id": question_id, "answer_ordinal": ordinal, "clicks": 0, "first_ts": ts, "first_seq": self.changes, "checked_ts": None, "checked_seq": None}
            click = self.clicks.setdefault((question_id, ordinal), new)
            click |= {"clicks": click["clicks"] + 1, "last_ts": ts, "last_seq": self.changes}
            if click["checked_seq"] is None:
                click |= {"checked_ts": ts, "checked_seq": self.changes}

    def uncheck(self, question_id: int | None, ordinal: int, ts: int, scoped: bool) -> None:
        """Hits the ordinal on every question, or with `scoped` on the one it names. Whether a question has checkboxes is
        seen when the state is read; others ignore what is checked."""
        self.changes += 1
        self.touched_ts = ts
        for (question, at), click in self.clicks.items():
            if at == ordinal and (not scoped or question == question_id):
                click |= {"checked_ts": None, "checked_seq": None}
        if not scoped or question_id is not None:
            self.unchecked.add((question_id if scoped else None, ordinal))

    def row(self) -> tuple:
        lists = [[tuple(x[c] for c in names) for x in held.values()] for held, names in ((self.clicks, CLICK), (self.texts, TEXT))]
        return (self.changes, self.touched_ts, *lists, list(self.unchecked), list(self.cleared))


class Forms(StatefulProcessor):
    """Applies the changes of a batch to the form of their response."""

    def __init__(self, scoped: bool = False):
        self.scoped = scoped

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.form = handle.getValueState("form", FORM)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803 - the API's names
        held = self.form.get()
        form = Form(*held) if held else Form()
        for change in sorted(rows, key=lambda r: r.seq):
            if change.answer_ordinal is not None and change.answer_ordinal < 0:
                form.uncheck(change.question_id, -change.answer_ordinal, change.ts, self.scoped)
            else:
                form.apply(change.question_id, change.answer_ordinal, change.plaintext, change.ts)
        self.form.update(form.row())
        yield Row(response_id=key[0], changes=form.changes, updated=form.touched_ts)


def stored_clicks(tables: dict[str, DataFrame]) -> DataFrame:
    """The stored answers as clicks of the state, one row each."""
    answers = fold.stored_click_marks(tables["response_answers"], tables["answer_options"], F.lit(0))
    zero, times = F.lit(0).cast("bigint"), {c: micros(c) for c in ("first_ts", "last_ts")}
    clicks = answers.withColumns(times).withColumns({"last_seq": zero, "first_seq": zero, "checked_seq": zero, "checked_ts": F.col("first_ts")})
    return clicks.select("response_id", *[F.col(c).cast("bigint").alias(c) for c in CLICK])


def stored_texts(tables: dict[str, DataFrame]) -> DataFrame:
    """The stored text answers as texts of the state."""
    texts = fold.stored_marks(tables["response_plaintext"], "plaintext", F.lit(0))
    return texts.withColumns({c: micros(c) for c in ("first_ts", "last_ts")}).select("response_id", *TEXT)


def _has_files(spark: SparkSession, *place: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(*place))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and len(files.listStatus(folder)) > 0


def _keep_stored(spark: SparkSession, checkpoint: str, tables: dict[str, DataFrame] | None) -> None:
    """Keep the answers and texts that the job begins with; from its first finished batch on they stay."""
    if _has_files(spark, checkpoint, "commits") or not (tables or _has_files(spark, checkpoint, STORED)):
        return
    for name, (schema, rows) in KEPT.items():
        kept = rows(tables) if tables else spark.createDataFrame([], schema)
        kept.write.mode("overwrite").parquet(os.path.join(checkpoint, STORED, name))


def _kept(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    schema = KEPT[name][0]
    if not _has_files(spark, checkpoint, STORED, name):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(os.path.join(checkpoint, STORED, name))


# What is kept of the snapshot, below the checkpoint: the tables' columns and how they are made.
STORED = "stored"
KEPT = {
    "clicks": (", ".join(f"{c} bigint" for c in ("response_id", *CLICK)), stored_clicks),
    "texts": (", ".join(f"{c} " + ("string" if c == "plaintext" else "bigint") for c in ("response_id", *TEXT)), stored_texts),
}


def merged_clicks(form: DataFrame, kept: DataFrame) -> DataFrame:
    """The clicks of the state on those stored: one row per response, question and ordinal of responses that changed,
    the rows of all others as they are."""
    hit = F.exists("unchecked", lambda r: (r["answer_ordinal"] == F.col("answer_ordinal")) & F.coalesce(r["question_id"] == F.col("question_id"), F.lit(True)))
    live = ~F.coalesce(hit, F.lit(False))
    before = kept.join(form.select("response_id", "unchecked"), "response_id").select(
        "response_id", *[F.when(live, F.col(c)).alias(c) if c.startswith("checked") else F.col(c) for c in CLICK]
    )
    now = form.select("response_id", F.inline("clicks"))
    is_stored = F.col("first_seq") == 0
    both = before.unionByName(now).groupBy("response_id", "question_id", "answer_ordinal")
    merged = both.agg(
        _added("clicks", is_stored), F.min_by("first_ts", "first_seq").alias("first_ts"), F.max_by("last_ts", "last_seq").alias("last_ts"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        F.min_by("checked_ts", "checked_seq").alias("checked_ts"), F.min("checked_seq").alias("checked_seq"),
    )
    return kept.join(form.select("response_id"), "response_id", "left_anti").unionByName(merged)


def merged_texts(form: DataFrame, kept: DataFrame) -> DataFrame:
    """The texts of the state on those stored that were not cleared, in the same way."""
    cleared = F.coalesce(F.array_contains("cleared", F.col("question_id")), F.lit(False))
    before = kept.join(form.select("response_id", "cleared"), "response_id").where(~cleared)
    now = form.select("response_id", F.inline("texts"))
    both = before.select("response_id", *TEXT, F.lit(0).alias("_now")).unionByName(now.withColumn("_now", F.lit(1)))
    merged = both.groupBy("response_id", "question_id").agg(
        F.max_by("plaintext", "_now").alias("plaintext"), _added("clicks", F.col("_now") == 0),
        F.min_by("first_ts", "_now").alias("first_ts"), F.max_by("last_ts", "_now").alias("last_ts"),
    )
    return kept.join(form.select("response_id"), "response_id", "left_anti").unionByName(merged)


def _added(column: str, is_stored: Column) -> Column:
    """The stored number and that of the state; a stored row that comes twice counts once."""
    parts = [F.coalesce(F.max(F.when(which, F.col(column))), F.lit(0)) for which in (is_stored, ~is_stored)]
    return (parts[0] + parts[1]).alias(column)


def keyed_apply_changes(
    stream: DataFrame, checkpoint: str, tables: dict[str, DataFrame] | None = None, scoped: bool = False,
    sink: Callable[[DataFrame, int], None] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Start the job: apply a stream of changes to the forms of their responses, kept below `checkpoint`.

    `tables` is the snapshot the first start begins with, kept below `checkpoint`; later starts ignore it. `sink`
    gets (response_id, changes, updated) of the responses each batch touched: what has to be looked at again.
    Changes without a response id are left out.
    """
    spark = stream.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    changes = stream.where("response_id IS NOT NULL").select(
        "response_id", "question_id", F.col("answer_ordinal").cast("bigint").alias("answer_ordinal"), "plaintext", micros("ts").alias("ts"), "seq"
    )
    _keep_stored(spark, checkpoint, tables)
    touched = changes.groupBy("response_id").transformWithState(Forms(scoped), FEED, "Update", "None")
    feed = touched.withColumn("updated", moment("updated"))
    writer = feed.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if sink else writer.format("noop")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def keyed_state(spark: SparkSession, checkpoint: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as of the last finished batch: answers, texts and responses replaced by what the state has."""
    members = fold.response_events(tables["responses"], tables["sessions"])
    questions, options = tables["questions"], tables["answer_options"]
    form = spark.read.format("statestore").option("stateVarName", "form").load(checkpoint)
    form = stored(form.select(F.col("key.response_id").alias("response_id"), "value.*"), "forms")
    clicks = merged_clicks(form, _kept(spark, checkpoint, "clicks")).withColumns({c: moment(c) for c in ("first_ts", "last_ts", "checked_ts")})
    clicks = clicks.withColumn("answer_ordinal", F.col("answer_ordinal").cast("smallint"))
    answers = fold.valid_answers(clicks, members, fold.click_targets(questions, options))
    texts = merged_texts(form, _kept(spark, checkpoint, "texts")).join(members, "response_id")
    texts = texts.join(questions.select("question_id", "event_id"), ["question_id", "event_id"]).select(
        "response_id", "question_id", "plaintext", moment("first_ts").alias("created"), (F.col("clicks") - 1).alias("revision"), moment("last_ts").alias("updated")
    )
    touched = form.where("touched_ts IS NOT NULL").select("response_id", moment("touched_ts").alias("ts"), F.lit(0).alias("seq"))
    return {
        **tables,
        "response_answers": answers.select(fold.ANSWER_COLUMNS),
        "response_plaintext": texts.select(fold.TEXT_COLUMNS),
        "responses": fold.touch_responses(tables["responses"], touched),
    }
