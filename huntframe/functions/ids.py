"""Deterministic identifiers from a fixed field order.

The material is joined with the unit separator and nulls are spelled out, so the same row
gives the same id in any engine that has SHA-256.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import array_text, non_empty

SEPARATOR = "\x1f"
NULL_TEXT = "<null>"


def digest(material: Sequence[Column], length: int = 16) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit(NULL_TEXT)) for c in material]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, length)


def prefixed(prefix: Column | str, material: Sequence[Column], length: int = 16) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("-"), digest(material, length))


def slug(rule_id: Column) -> Column:
    """A rule id as an id prefix: dots and underscores become dashes."""
    return F.translate(rule_id, "._", "--")


def event_material() -> list[Column]:
    """The fields that identify an event, in id order."""
    return [
        F.col("event.dataset"),
        F.col("event.code"),
        F.coalesce(non_empty(F.col("event.created")), F.col("`@timestamp`")),
        F.col("host.name"),
        F.col("process.entity_id"),
        F.col("process.pid"),
        F.col("process.executable"),
        F.col("process.command_line"),
    ]


def event_document_id() -> Column:
    """Explicit id, else the process GUID, else a content hash."""
    return F.coalesce(
        non_empty(F.col("event.id")),
        non_empty(F.element_at(F.col("sysmon.event_data"), "ProcessGuid")),
        prefixed("event", event_material(), 32),
    )


def envelope_event_id() -> Column:
    """Explicit id, else the process GUID, else the entity id; null if the event has none."""
    return F.coalesce(
        non_empty(F.col("event.id")),
        non_empty(F.element_at(F.col("sysmon.event_data"), "ProcessGuid")),
        non_empty(F.col("process.entity_id")),
    )


def section_material() -> list[Column]:
    """Process, file, registry and destination fields that tell realtime events apart."""
    p = "process"
    return [
        F.col(f"{p}.pid"), F.col(f"{p}.entity_id"), F.col(f"{p}.name"), F.col(f"{p}.executable"),
        F.col(f"{p}.command_line"), F.col(f"{p}.parent.pid"), F.col(f"{p}.parent.entity_id"),
        F.col(f"{p}.parent.name"), F.col(f"{p}.parent.executable"), F.col(f"{p}.parent.command_line"),
        F.col("file.path"), F.col("file.name"), F.col("file.extension"),
        F.col("registry.path"), F.col("registry.value"), array_text(F.col("registry.data.strings")),
        F.col("destination.ip"), F.col("destination.port"), F.col("destination.domain"),
    ]


def event_identity(timestamp: Column) -> Column:
    """Realtime identity: event id, else record id, else a content hash."""
    return F.coalesce(
        non_empty(F.col("event.id")),
        F.when(F.col("winlog.record_id") != 0, F.col("winlog.record_id").cast("string")),
        prefixed("local", [timestamp, F.col("event.code"), *section_material()]),
    )
