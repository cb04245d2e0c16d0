"""Text expressions: request numbers, joined names, links and the listing search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_int(text: Column | str, kind: str = "bigint") -> Column:
    """The number a text starts with ('3a' gives 3), NULL where there is none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return digits.try_cast(kind)


def starts_with_number(text: Column | str) -> Column:
    """Whether `leading_int` has digits to read."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1) != "", F.lit(False))


def speaker_names(presenters: Column | str) -> Column:
    """Names joined by commas; empty where there are none."""
    names = F.transform(presenters, lambda p: p["name"])
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def session_link(host: str, session_id: str = "session_id") -> Column:
    return F.concat(F.lit(f"https://{host}/"), F.col(session_id).cast("string"))


def event_link(host: str, event_id: str = "event_id") -> Column:
    return F.concat(F.lit(f"https://{host}/event/"), F.col(event_id).cast("string"))


def qr_link(session_id: str = "session_id") -> Column:
    return F.concat(F.lit("/qr/"), F.col(session_id).cast("string"))


def matches(needle: str, *texts: Column) -> Column:
    """Case-insensitive substring search over texts shown on separate lines; an empty needle matches all."""
    return F.contains(F.lower(F.concat_ws("\n", *texts)), F.lower(F.lit(needle)))


def collated(column: Column | str, collation: str | None) -> Column:
    """Compare and sort by a collation, such as UNICODE_CI; binary without one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.collate(column, collation) if collation else column
