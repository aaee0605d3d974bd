"""Explicit schemas: the normalized event, raw records, the transport envelope."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_STRINGS = T.ArrayType(_S)
_STRING_MAP = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


XML_RECORD = _struct(
    System=_struct(
        Provider=_struct(_Name=_S, _Guid=_S),
        EventID=_S,
        TimeCreated=_struct(_SystemTime=_S),
        EventRecordID=_S,
        Channel=_S,
        Computer=_S,
    ),
    EventData=_struct(Data=T.ArrayType(_struct(_Name=_S, _VALUE=_S))),
    _corrupt_record=_S,
)

LOG_RECORD = _struct(
    record_id=_L, event_id=_I, time_created=_S, provider_name=_S, message=_S, xml=_S
)

# Field names as the event-log export writes them.
LOG_RECORD_JSON = _struct(RecordId=_S, Id=_S, TimeCreated=_S, ProviderName=_S, Message=_S, Xml=_S)

USER = _struct(domain=_S, name=_S)
PARENT = _struct(pid=_L, entity_id=_S, name=_S, executable=_S, command_line=_S, user=USER)
EVENT_META = _struct(
    id=_S, kind=_S, category=_STRINGS, type=_STRINGS, action=_S, code=_I, module=_S,
    provider=_S, dataset=_S, created=_S, original=_S,
)
HOST = _struct(name=_S, os=_struct(type=_S))
PROCESS = _struct(
    pid=_L, entity_id=_S, name=_S, executable=_S, command_line=_S, args=_STRINGS,
    working_directory=_S, hash=_STRING_MAP, parent=PARENT,
    Ext=_struct(token=_struct(integrity_level_name=_S)),
)
FILE = _struct(path=_S, name=_S, extension=_S)
REGISTRY = _struct(path=_S, value=_S, data=_struct(strings=_STRINGS))
SOURCE = _struct(ip=_S, port=_L)
DESTINATION = _struct(ip=_S, port=_L, domain=_S)
NETWORK = _struct(transport=_S, direction=_S)
SYSMON = _struct(event_data=_STRING_MAP, message_fields=_STRING_MAP)

EVENT = T.StructType(
    [
        T.StructField("@timestamp", _S),
        T.StructField("event", EVENT_META),
        T.StructField("log", _struct(channel=_S)),
        T.StructField("host", HOST),
        T.StructField("user", USER),
        T.StructField("process", PROCESS),
        T.StructField("file", FILE),
        T.StructField("registry", REGISTRY),
        T.StructField("source", SOURCE),
        T.StructField("destination", DESTINATION),
        T.StructField("network", NETWORK),
        T.StructField("sysmon", SYSMON),
        T.StructField("winlog", _struct(record_id=_L)),
        T.StructField("raw", _struct(message=_S)),
        T.StructField("message", _S),
        T.StructField("data_stream", _struct(type=_S, dataset=_S, namespace=_S)),
        T.StructField("art", _STRING_MAP),
        T.StructField("tags", _STRINGS),
    ]
)
EVENT_COLUMNS = EVENT.fieldNames()

# Where a stored document came from; separate from the network ``source``.
SRC_DOC = _struct(index=_S, document_id=_S)

ENVELOPE = T.StructType(
    [
        T.StructField("schema_version", _S),
        T.StructField("event_id", _S),
        T.StructField("event", EVENT),
        T.StructField("metadata", _struct(producer=_S, created_at=_S, source=_S, pipeline_phase=_S)),
    ]
)

SEARCH_RESPONSE = _struct(
    hits=_struct(hits=T.ArrayType(_struct(_index=_S, _id=_S, _source=EVENT)))
)


def with_text_code(event: T.StructType) -> T.StructType:
    """The event schema with the code read as text, since writers send both ``1`` and ``"1"``."""
    meta = T.StructType([T.StructField(f.name, _S) if f.name == "code" else f for f in EVENT_META])
    return T.StructType([T.StructField(f.name, meta) if f.name == "event" else f for f in event])


ENVELOPE_WIRE = T.StructType(
    [T.StructField("event", with_text_code(EVENT)) if f.name == "event" else f for f in ENVELOPE]
)
