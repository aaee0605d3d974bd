"""The transport envelope: build, serialize, parse and validate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog, schemas
from ..functions import ids
from ..functions import scalars as S
from ..functions import timestamps as TS


def event_struct() -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in schemas.EVENT_COLUMNS])


def build_envelopes(
    events: DataFrame, source: str, created_at: str | dt.datetime | None = None, event_id: Column | None = None
) -> DataFrame:
    """Envelope columns for normalized events; check them with ``envelope_error``."""
    derived = ids.envelope_event_id()
    return events.select(
        F.lit(catalog.SCHEMA_VERSION).alias("schema_version"),
        (F.coalesce(S.non_empty(event_id), derived) if event_id is not None else derived).alias("event_id"),
        event_struct().alias("event"),
        F.struct(
            F.lit(catalog.ENVELOPE_PRODUCER).alias("producer"),
            TS.created_literal(created_at).alias("created_at"),
            F.lit(source).alias("source"),
            F.lit(catalog.PIPELINE_PHASE).alias("pipeline_phase"),
        ).alias("metadata"),
    )


def serialize(envelopes: DataFrame) -> DataFrame:
    """``key`` and JSON ``value`` columns, as a topic sink takes them."""
    return envelopes.select(
        F.col("event_id").alias("key"),
        F.to_json(F.struct("schema_version", "event_id", "event", "metadata")).alias("value"),
    )


def parse_envelopes(messages: DataFrame, value: str = "value") -> DataFrame:
    """Message bytes or text to envelope columns plus ``raw`` and ``error_reason``."""
    text = F.col(value).cast("string")
    parsed = F.from_json(text, schemas.ENVELOPE_WIRE, {"mode": "PERMISSIVE"})
    df = messages.select(text.alias("raw"), parsed.alias("_m"), F.try_parse_json(text).alias("_v"))
    # The parser maps unreadable text to nulls, so readability is tested on its own.
    df = df.withColumns(
        {
            "_kind": F.schema_of_variant("_v"),
            "_code_kind": F.schema_of_variant(F.try_variant_get("_v", "$.event.event.code", "variant")),
        }
    )
    numeric = F.col("_m.event.event").withField("code", F.col("_m.event.event.code").try_cast("int"))
    event = F.when(F.col("_m.event").isNotNull(), F.col("_m.event").withField("event", numeric))
    df = df.withColumn("_e", F.col("_m").withField("event", event.cast(schemas.EVENT)))
    return df.select(
        "raw",
        F.col("_e.schema_version").alias("schema_version"),
        F.col("_e.event_id").alias("event_id"),
        F.col("_e.event").alias("event"),
        F.col("_e.metadata").alias("metadata"),
        (F.col("_code_kind") == "STRING").alias("code_is_string"),
        F.coalesce(
            F.when(F.col("_kind").isNull(), F.lit("not_json")),
            F.when(~F.startswith("_kind", F.lit("OBJECT")), F.lit("not_an_object")),
            envelope_error(F.col("_e")),
        ).alias("error_reason"),
    )


def envelope_error(m: Column) -> Column:
    """First failing contract check of an envelope struct; null if it is valid."""
    meta, body = m["metadata"], m["event"]
    code = body["event"]["code"]
    return F.coalesce(
        F.when(~m["schema_version"].eqNullSafe(catalog.SCHEMA_VERSION), F.lit("schema_version")),
        F.when(S.text(m["event_id"]) == "", F.lit("event_id")),
        F.when(body.isNull(), F.lit("event")),
        F.when(meta.isNull(), F.lit("metadata")),
        F.when(body["event"].isNull(), F.lit("event.event")),
        F.when(~body["event"]["dataset"].eqNullSafe(catalog.DATASET), F.lit("event.dataset")),
        F.when(~code.eqNullSafe(F.lit(1)), F.lit("event.code")),
        F.when(~meta["producer"].eqNullSafe(catalog.ENVELOPE_PRODUCER), F.lit("metadata.producer")),
        F.when(~F.coalesce(meta["source"].isin(*catalog.ENVELOPE_SOURCES), F.lit(False)), F.lit("metadata.source")),
        F.when(~meta["pipeline_phase"].eqNullSafe(catalog.PIPELINE_PHASE), F.lit("metadata.pipeline_phase")),
        F.when(S.text(meta["created_at"]) == "", F.lit("metadata.created_at")),
    )


def valid_events(parsed: DataFrame, fail_fast: bool = False) -> DataFrame:
    """The events of valid envelopes. With ``fail_fast`` the first bad message fails the job."""
    ok = F.col("error_reason").isNull()
    if fail_fast:
        ok = F.when(
            ~ok, F.raise_error(F.concat(F.lit("invalid message: "), F.col("error_reason"))).cast("boolean")
        ).otherwise(F.lit(True))
    return parsed.where(ok).select("event_id", "code_is_string", "event.*")


def rejected_messages(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error_reason").isNotNull()).select("raw", "error_reason")
