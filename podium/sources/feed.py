"""The session feed of an event and the log of save requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from podium.functions.text import leading_int, starts_with_number
from podium.sources.schemas import FEED, FEED_GROUPS, RAW_CHANGES

# Every number with so many characters, its sign included, fits the type.
BIGINT_CHARS, SMALLINT_CHARS = 18, 4


def read_session_feed(spark: SparkSession, path: str, all_groups: bool = False, places: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted sessions and their speakers from feed documents, one per line: {event_key, groups}.

    A large feed may be split into several documents of the same event.
    """
    return parse_feed(spark.read.schema(FEED).json(path), all_groups, places)


def read_session_feed_files(spark: SparkSession, path: str, all_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same from files as the feed service answers, one JSON list of groups each; the event key is the
    file's name without its ending."""
    files = spark.read.text(path, wholetext=True)
    key = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return parse_feed(files.select(key.alias("event_key"), F.from_json("value", FEED_GROUPS).alias("groups")), all_groups)


def parse_feed(documents: DataFrame, all_groups: bool = False, places: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sessions and speakers of feed documents (event_key, groups).

    Only the first session group counts unless `all_groups`. Service sessions and sessions that are not
    accepted are left out. Speakers keep their place; the first is the owner. With `places` both tables have `place`,
    the session's place in its feed; documents of one event follow each other by their first session.
    """
    groups = F.col("groups") if all_groups else F.slice("groups", 1, 1)
    listed = documents.select("event_key", F.flatten(F.transform(groups, lambda g: g["sessions"])).alias("_all"))
    place = F.struct(F.get("_all", F.lit(0))["id"].alias("first"), F.col("_n").alias("n")).alias("place")
    kept = [place] if places else []
    sessions = (
        listed.select("event_key", "_all", F.posexplode("_all").alias("_n", "s")).select("event_key", "s", *kept)
        .where("s.status = 'Accepted' AND NOT coalesce(s.isServiceSession, false)")
    )
    speakers = sessions.select(
        "event_key", F.col("s.id").alias("feed_id"), *(["place"] if places else []), F.posexplode("s.speakers").alias("position", "speaker")
    ).select(
        "event_key",
        "feed_id",
        "position",
        F.col("speaker.id").alias("identifier"),
        F.col("speaker.name").alias("name"),
        (F.col("position") == 0).alias("is_owner"),
        *(["place"] if places else []),
    )
    return sessions.select("event_key", F.col("s.id").alias("feed_id"), F.col("s.title").alias("title"), *(["place"] if places else [])), speakers


def parse_changes(raw: DataFrame) -> DataFrame:
    """Typed changes from save requests, with `error` (NULL where the request is carried out).

    An ordinal that is 0 or no number is NULL: the change is a text. A number no option or id can have fails the
    whole request, and so does a line that is no JSON document (`_corrupt`, if the reader keeps it).
    """
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in raw.columns else F.lit(False)
    ordinal = leading_int("answerOrdinal")
    ids = {"response_id": "responseId", "question_id": "questionId"}
    # Short texts hold no number that is too large; only longer ones are searched for digits once more.
    too_large = lambda text, number: (F.length(text) > BIGINT_CHARS) & starts_with_number(text) & number.isNull()
    no_ordinal = (F.length("answerOrdinal") > SMALLINT_CHARS) & ~F.coalesce(ordinal, F.lit(0)).between(-32768, 32767)
    error = F.when(corrupt, "no JSON document").when(
        too_large("answerOrdinal", ordinal) | no_ordinal, "answer ordinal out of range"
    )
    for text in ids.values():
        error = error.when(too_large(text, leading_int(text)), "id out of range")
    return raw.select(
        *[leading_int(text).alias(name) for name, text in ids.items()],
        F.nullif(ordinal, F.lit(0)).try_cast("smallint").alias("answer_ordinal"), "plaintext", "ts", "seq", error.alias("error"),
    )


def read_answer_changes(spark: SparkSession, path: str, streaming: bool = False, rejected: bool = False) -> DataFrame:
    """The save log from JSON lines, as a batch or a stream; with `rejected`, the requests that fail, with `error`."""
    reader = (spark.readStream if streaming else spark.read).option("columnNameOfCorruptRecord", "_corrupt")
    schema = StructType([*RAW_CHANGES.fields, StructField("_corrupt", StringType())])
    parsed = parse_changes(reader.schema(schema).json(path))
    return parsed.where("error IS NOT NULL") if rejected else parsed.where("error IS NULL").drop("error")
