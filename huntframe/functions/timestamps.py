"""Timestamp scalars. Sessions are expected to run in UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import non_empty, strip, text

# Output and input formats.
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
INDEX_DATE = "yyyy.MM.dd"
_SPACED_FRACTION = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"


def parse_iso(value: Column) -> Column:
    """ISO-8601 text to a timestamp, null if it does not parse; text without an offset is UTC."""
    return F.when(value.rlike(_ISO), value.try_cast("timestamp"))


def event_time(timestamp: Column, created: Column) -> Column:
    """The event's own time: its timestamp text, or its creation time where that is empty."""
    return parse_iso(F.coalesce(non_empty(timestamp), non_empty(created)))


def utc_time_to_iso(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.f`` to ISO milliseconds; empty stays empty, bad text gives null."""
    v = text(value)
    parsed = F.when(v.rlike(_SPACED_FRACTION), v.try_cast("timestamp"))
    return F.when(v == "", F.lit("")).otherwise(F.date_format(parsed, ISO_MILLIS))


def normalize_timestamp(value: Column, as_of: Column | None = None) -> Column:
    """Any accepted format to ISO milliseconds; other text passes through, empty gives ``as_of``."""
    v = strip(text(value))
    parsed = F.when(v.rlike(_SPACED_FRACTION) | v.rlike(_ISO), v.try_cast("timestamp"))
    default = as_of if as_of is not None else F.lit(None).cast("string")
    return F.when(v == "", default).otherwise(F.coalesce(F.date_format(parsed, ISO_MILLIS), v))


def event_timestamp(timestamp: Column, created: Column, as_of: Column | None = None) -> Column:
    return normalize_timestamp(F.coalesce(non_empty(timestamp), non_empty(created)), as_of)


def own_hour(timestamp: Column) -> Column:
    """Hour as written in the text, in its own offset; null if the text is no timestamp."""
    v = strip(text(timestamp))
    valid = v.rlike(_ISO) & v.try_cast("timestamp").isNotNull()
    written = F.substr(v, F.lit(12), F.lit(2)).try_cast("int")
    return F.when(valid, F.coalesce(written, F.lit(0)))


def created_at_text(value: Column) -> Column:
    """A timestamp as ISO text cut to whole seconds."""
    return F.date_format(F.date_trunc("second", value), ISO_SECONDS)


def created_literal(created_at: str | dt.datetime | None) -> Column:
    """A caller-given creation time as a string column; None means the processing time."""
    if created_at is None:
        return created_at_text(F.current_timestamp())
    if isinstance(created_at, str):
        return F.lit(created_at)
    if created_at.tzinfo is None:
        created_at = created_at.replace(tzinfo=dt.timezone.utc)
    stamp = created_at.astimezone(dt.timezone.utc)
    return F.lit(stamp.strftime("%Y-%m-%dT%H:%M:%SZ"))


def index_name(prefix: str, day: Column) -> Column:
    """Daily collection name ``prefix-yyyy.MM.dd``; bad dates give null."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(day.try_cast("date"), INDEX_DATE))
