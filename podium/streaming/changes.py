"""The change-log fold as a Structured Streaming job.

Every micro-batch is folded by itself into one delta: marks of clicks and texts, last resets, touches. A delta is
made from the batch alone: whether a response or an option exists is decided when the state is read, against
the tables as they are then, so a click on a form opened after the job started counts. The work of a batch
depends on its own size, never on the state gathered so far. A replayed batch overwrites its delta, so the
result is exactly-once.

Order inside the state is (batch, seq). `stream_state` folds stored answers, which come before every batch, and
all deltas; `compact_state` folds the deltas up to a batch into one, beside the running job: readers take the
newest finished compaction and the batches after it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from podium.operators import fold

ORDER = "struct<batch:bigint,seq:bigint>"
DELTA = {
    "record": "string", "response_id": "bigint", "question_id": "bigint", "answer_ordinal": "smallint", "plaintext": "string",
    "clicks": "bigint", "first_ts": "timestamp_ntz", "last_ts": "timestamp_ntz", "first_seq": ORDER, "seq": ORDER,
}
DELTA_DDL = ", ".join(f"{name} {kind}" for name, kind in DELTA.items())
BATCHES, COMPACTED = "batches", "compacted"


def _place(batch: int, seq: Column | None = None) -> Column:
    """The place of a change in the order of all batches."""
    seq = F.lit(-1) if seq is None else seq
    return F.struct(F.lit(batch).cast("bigint").alias("batch"), seq.cast("bigint").alias("seq"))


def _records(df: DataFrame, kind: str) -> DataFrame:
    """Rows of one record kind in the common layout."""
    present = {name: F.col(name) for name in df.columns} | {"record": F.lit(kind)}
    return df.select(*[present.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in DELTA.items()])


def _delta(clicks, unchecks, texts, clears, touches, scoped: bool) -> DataFrame:
    """Marks and resets folded as far as they can be without the tables."""
    both = clicks.select("response_id").unionByName(texts.select("response_id"))
    hot = fold.busy_responses(both)
    last = lambda df, slot: df.groupBy(*slot).agg(F.max("seq").alias("seq"))
    touched = touches.groupBy("response_id").agg(F.max_by("ts", "seq").alias("last_ts"), F.max("seq").alias("seq"))
    return (
        _records(fold.partial_clicks(clicks, unchecks, hot, scoped), "click")
        .unionByName(_records(fold.partial_texts(texts, clears, hot), "text"))
        .unionByName(_records(last(unchecks, fold.click_slot(scoped)), "uncheck"))
        .unionByName(_records(last(clears, ["response_id", "question_id"]), "clear"))
        .unionByName(_records(touched, "touch"))
    )


def batch_delta(changes: DataFrame, batch_id: int, scoped: bool = False) -> DataFrame:
    """What a batch of changes leaves behind, whatever came before it and whatever tables it meets."""
    placed = changes.withColumn("seq", _place(batch_id, F.col("seq")))
    return _delta(
        fold.click_marks(placed), fold.click_resets(placed), fold.text_marks(placed), fold.text_resets(placed),
        placed.select("response_id", "ts", "seq"), scoped,
    )


def _parts(deltas: DataFrame) -> tuple[DataFrame, ...]:
    """Clicks, unchecks, texts, clears and touches of deltas."""
    kind = lambda name: deltas.where(F.col("record") == name)
    marks = ["clicks", "first_ts", "last_ts", "first_seq", "seq"]
    return (
        kind("click").select("response_id", "question_id", "answer_ordinal", *marks),
        kind("uncheck").select("response_id", "question_id", "answer_ordinal", "seq"),
        kind("text").select("response_id", "question_id", "plaintext", *marks),
        kind("clear").select("response_id", "question_id", "seq"),
        kind("touch").select("response_id", F.col("last_ts").alias("ts"), "seq"),
    )


def _write_delta(delta: DataFrame, path: str, *place: str) -> None:
    delta.write.mode("overwrite").partitionBy("record").parquet(os.path.join(path, *place))


def stream_apply_changes(
    stream: DataFrame, path: str, checkpoint: str, scoped: bool = False,
    dedupe_on: str | None = None, dedupe_delay: str = "1 hour", available_now: bool = True,
) -> StreamingQuery:
    """Start the job: fold a stream of changes into deltas below `path`.

    A redelivered change counts as a revision; `dedupe_on` names a change id to drop repeats by, within
    `dedupe_delay` of event time.
    """
    if dedupe_on:
        stream = stream.withColumn("_event_time", F.col("ts").cast("timestamp"))
        stream = stream.withWatermark("_event_time", dedupe_delay).dropDuplicatesWithinWatermark([dedupe_on])
        stream = stream.drop("_event_time")

    def fold_batch(changes: DataFrame, batch_id: int) -> None:
        changes.persist()
        try:
            _write_delta(batch_delta(changes, batch_id, scoped), path, BATCHES, f"batch_id={batch_id}")
        finally:
            changes.unpersist()

    writer = stream.writeStream.foreachBatch(fold_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compacted_up_to(spark: SparkSession, path: str) -> int | None:
    """The batch that the newest finished compaction ends with. An unfinished one has no success marker."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, COMPACTED))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    done = [
        int(entry.getPath().getName().partition("=")[2])
        for entry in files.listStatus(folder)
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS"))
    ]
    return max(done, default=None)


def read_deltas(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    """The newest compaction and the batches after it, or those up to a batch."""
    since = compacted_up_to(spark, path)
    batches = spark.read.schema(f"{DELTA_DDL}, batch_id BIGINT").parquet(os.path.join(path, BATCHES))
    if up_to is not None:
        batches = batches.where(F.col("batch_id") <= up_to)
    if since is None:
        return batches.drop("batch_id")
    old = spark.read.schema(DELTA_DDL).parquet(os.path.join(path, COMPACTED, f"up_to={since}"))
    return old.unionByName(batches.where(F.col("batch_id") > since).drop("batch_id"))


def merge_deltas(deltas: DataFrame, tables: dict[str, DataFrame], scoped: bool = False) -> dict[str, DataFrame]:
    """Apply deltas to a snapshot: all its tables, answers, texts and responses replaced. Stored answers and
    texts, if the snapshot has them, come before every batch."""
    members = fold.response_events(tables["responses"], tables["sessions"])
    questions, options = tables["questions"], tables["answer_options"]
    clicks, unchecks, texts, clears, touches = _parts(deltas)
    before = _place(-1)
    if "response_answers" in tables:
        clicks = clicks.unionByName(fold.stored_click_marks(tables["response_answers"], options, before))
    if "response_plaintext" in tables:
        texts = texts.unionByName(fold.stored_marks(tables["response_plaintext"], "plaintext", before))
    hot = fold.busy_responses(deltas)
    answers = fold.fold_click_marks(clicks, unchecks, members, fold.click_targets(questions, options), hot, scoped)
    plaintext = fold.fold_text_marks(texts, clears, members, questions, hot)
    return {
        **tables,
        "response_answers": answers.select(fold.ANSWER_COLUMNS),
        "response_plaintext": plaintext.select(fold.TEXT_COLUMNS),
        "responses": fold.touch_responses(tables["responses"], touches),
    }


def stream_state(spark: SparkSession, path: str, tables: dict[str, DataFrame], scoped: bool = False
                 ) -> dict[str, DataFrame]:
    """The tables as of the last finished batch. `tables` is the snapshot the stream is applied to, read anew."""
    return merge_deltas(read_deltas(spark, path), tables, scoped)


def compact_state(spark: SparkSession, path: str, up_to: int, scoped: bool = False) -> None:
    """Fold the batches up to `up_to` into one delta. Readers see it when it is finished; the job goes on writing.

    Resets are kept: they still hit stored answers. The batches it replaces may be deleted afterwards.
    """
    delta = _delta(*_parts(read_deltas(spark, path, up_to)), scoped)
    _write_delta(delta, path, COMPACTED, f"up_to={up_to}")
