"""Normalization of raw telemetry into the typed event schema, with a reason for each reject.

``normalize_xml`` and ``normalize_records`` return the event columns plus ``error_reason``;
``split_rejects`` separates good rows from the dead-letter rows. All of it is one projection:
no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog, schemas
from ..functions import scalars as S
from ..functions import timestamps as TS

_XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}

# Event code to category, type and action.
_SHAPES = {
    1: ("process", "start", "Process Create"),
    3: ("network", "connection", "Network connection detected"),
    11: ("file", "creation", "File created"),
    13: ("registry", "change", "Registry value set"),
}
_NAMESPACES = {1: "phase1", 3: "phase12", 11: "phase12", 13: "phase12"}


def event_shape(code: Column) -> tuple[Column, Column, Column]:
    """Category, type and action of an event code; unknown codes get the generic shape."""
    parts = []
    for n, default in enumerate(("event", "info", None)):
        fallback = F.lit(default) if default else F.concat(F.lit("Sysmon Event "), code.cast("string"))
        expr = F.coalesce(*[F.when(code == c, F.lit(shape[n])) for c, shape in _SHAPES.items()], fallback)
        parts.append(expr)
    return F.array(parts[0]), F.array(parts[1]), parts[2]


def _null(name: str) -> Column:
    return F.lit(None).cast(schemas.EVENT[name].dataType).alias(name)


def _cast(name: str, value: Column) -> Column:
    return value.cast(schemas.EVENT[name].dataType).alias(name)


def _process(get, code: Column) -> Column:
    image = get("Image")
    parent_image = get("ParentImage")
    is_create = code == 1
    create_only = lambda c: F.when(is_create, c)
    parent_user = get("ParentUser")
    return F.struct(
        S.parse_long(get("ProcessId")).alias("pid"),
        get("ProcessGuid").alias("entity_id"),
        S.windows_basename(image).alias("name"),
        image.alias("executable"),
        create_only(get("CommandLine")).alias("command_line"),
        create_only(S.split_command_line(get("CommandLine"))).alias("args"),
        create_only(get("CurrentDirectory")).alias("working_directory"),
        create_only(S.parse_hashes(get("Hashes"))).alias("hash"),
        create_only(
            F.struct(
                S.parse_long(get("ParentProcessId")).alias("pid"),
                get("ParentProcessGuid").alias("entity_id"),
                S.windows_basename(parent_image).alias("name"),
                parent_image.alias("executable"),
                get("ParentCommandLine").alias("command_line"),
                F.struct(
                    S.user_domain(parent_user).alias("domain"), S.user_name(parent_user).alias("name")
                ).alias("user"),
            )
        ).alias("parent"),
        create_only(
            F.struct(F.struct(get("IntegrityLevel").alias("integrity_level_name")).alias("token"))
        ).alias("Ext"),
    )


def _sections(get, code: Column) -> dict[str, Column]:
    """File, registry, source, destination and network structs; each only for its own event code."""
    target = get("TargetFilename")
    key = get("TargetObject")
    return {
        "file": F.when(
            code == 11,
            F.struct(
                target.alias("path"),
                S.windows_basename(target).alias("name"),
                S.file_extension(target).alias("extension"),
            ),
        ),
        "registry": F.when(
            code == 13,
            F.struct(
                key.alias("path"),
                S.last_backslash_segment(key).alias("value"),
                F.struct(F.array(get("Details")).alias("strings")).alias("data"),
            ),
        ),
        "source": F.when(
            code == 3,
            F.struct(get("SourceIp").alias("ip"), S.parse_long(get("SourcePort")).alias("port")),
        ),
        "destination": F.when(
            code == 3,
            F.struct(
                get("DestinationIp").alias("ip"),
                S.parse_long(get("DestinationPort")).alias("port"),
                get("DestinationHostname").alias("domain"),
            ),
        ),
        "network": F.when(
            code == 3,
            F.struct(
                F.lower(get("Protocol")).alias("transport"),
                S.network_direction(get("Initiated")).alias("direction"),
            ),
        ),
    }


_ASIDE = r"<!--.*?-->|<\?.*?\?>"
_TAG = r"""<(?:[^<>"']|"[^"]*"|'[^']*')*>"""


def is_one_document(xml: Column) -> Column:
    """Whether a text holds one root element and nothing else but blanks, comments and instructions around it.

    Usually the text after the first end tag of the root's name is blank, which is all that is looked at. Otherwise the depth of all tags is
    walked. What is inside the root is the parser's to judge.
    """
    root = F.regexp_extract(xml, r"<([A-Za-z_][\w:.-]*)", 1)
    end = F.position(F.concat(F.lit("</"), root), xml)
    after = F.when(end > 0, F.substr(xml, end)).otherwise(F.lit(""))
    quick = xml.rlike(r"^\s*<") & after.rlike(r"^</[\w:.-]+\s*>\s*$")
    bare = F.regexp_replace(xml, rf"(?s){_ASIDE}|<!\[CDATA\[.*?\]\]>|<![^>]*>", "")
    step = lambda s, tag: F.struct(
        (s["depth"] + F.when(F.startswith(tag, F.lit("</")), -1).when(F.endswith(tag, F.lit("/>")), 0).otherwise(1)).alias("depth"),
        (s["roots"] + F.when((s["depth"] == 0) & ~F.startswith(tag, F.lit("</")), 1).otherwise(0)).alias("roots"),
    )
    walked = F.aggregate(F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0)), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("roots")), step)
    last = F.substring_index(bare, "<", -1)
    ends = last.rlike(r"""^/[\w:.-]+\s*>\s*$""") | last.rlike(r"""^[\w:.-]+(?:[^<>"']|"[^"]*"|'[^']*')*/>\s*$""")
    return F.when(quick, F.lit(True)).otherwise(bare.rlike(r"^\s*<") & ends & (walked["depth"] == 0) & (walked["roots"] == 1))


def parse_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds ``_sys`` (null if the document is malformed) and the ``_data`` field map."""
    parsed = F.from_xml(F.col(xml), schemas.XML_RECORD, _XML_OPTIONS)
    df = df.withColumn("_parsed", parsed)
    named = F.filter(F.col("_parsed.EventData.Data"), lambda d: S.text(d["_Name"]) != "")
    entries = F.transform(
        named, lambda d: F.struct(d["_Name"].alias("key"), S.text(d["_VALUE"]).alias("value"))
    )
    # An EventData element without children parses to null; it still counts as present.
    has_data = F.col("_parsed.EventData").isNotNull() | F.col(xml).rlike(r"<(\w+:)?EventData[\s/>]")
    # The parser stops after the first document; whatever else the text holds makes it malformed.
    whole = is_one_document(F.col(xml))
    return (
        df.withColumn("_data", S.last_wins_map(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))))
        .withColumn("_broken", F.coalesce(~whole | F.col("_parsed._corrupt_record").isNotNull(), F.lit(False)))
        .withColumn("_sys", F.when(~F.col("_broken"), F.col("_parsed.System")))
        .withColumn("_has_data", has_data & ~F.col("_broken"))
        .drop("_parsed")
    )


def _xml_error(get, code_text: Column, xml: str) -> Column:
    """First failing check of a document, in reading order; null if the row is good."""
    system = F.col("_sys")
    bad_long = lambda key: S.parse_long(get(key)).isNull()
    created = get("UtcTime")
    return F.coalesce(
        F.when(F.col(xml).isNull(), F.lit("missing_xml")),
        F.when(F.col("_broken"), F.lit("malformed_xml")),
        F.when(system.isNull(), F.lit("missing_element:System")),
        F.when(~F.col("_has_data"), F.lit("missing_element:EventData")),
        F.when(F.col("_sys.EventID").isNull(), F.lit("missing_element:EventID")),
        F.when(~code_text.isin(*[str(c) for c in catalog.SUPPORTED_CODES]), F.lit("unsupported_event_id")),
        F.when(F.col("_sys.TimeCreated").isNull(), F.lit("missing_element:TimeCreated")),
        F.when(F.col("_sys.Provider").isNull(), F.lit("missing_element:Provider")),
        F.when((code_text == "1") & TS.utc_time_to_iso(created).isNull(), F.lit("bad_utc_time")),
        F.when(F.col("_sys.Channel").isNull(), F.lit("missing_element:Channel")),
        F.when(F.col("_sys.Computer").isNull(), F.lit("missing_element:Computer")),
        F.when(bad_long("ProcessId"), F.lit("bad_integer:ProcessId")),
        F.when((code_text == "1") & bad_long("ParentProcessId"), F.lit("bad_integer:ParentProcessId")),
        F.when((code_text == "3") & bad_long("SourcePort"), F.lit("bad_integer:SourcePort")),
        F.when((code_text == "3") & bad_long("DestinationPort"), F.lit("bad_integer:DestinationPort")),
    )


def normalize_xml(df: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """One event document per row to the event schema plus ``error_reason``.

    Rejected rows keep their document in ``event.original``.
    """
    df = parse_xml(df, xml)
    get = lambda key: S.text(F.element_at(F.col("_data"), key))
    code_text = S.strip(S.text(F.col("_sys.EventID")))
    code = S.parse_long(code_text).try_cast("int")
    category, kind, action = event_shape(code)
    user = get("User")
    namespace = F.coalesce(*[F.when(code == c, F.lit(ns)) for c, ns in _NAMESPACES.items()])
    columns = {
        "@timestamp": S.text(F.col("_sys.TimeCreated._SystemTime")),
        "event": F.struct(
            F.lit(None).cast("string").alias("id"),
            F.lit("event").alias("kind"),
            category.alias("category"),
            kind.alias("type"),
            action.alias("action"),
            code.alias("code"),
            F.lit(catalog.MODULE).alias("module"),
            S.text(F.col("_sys.Provider._Name")).alias("provider"),
            F.lit(catalog.DATASET).alias("dataset"),
            F.when(code == 1, TS.utc_time_to_iso(get("UtcTime"))).alias("created"),
            F.col(xml).alias("original"),
        ),
        "log": F.struct(S.strip(S.text(F.col("_sys.Channel"))).alias("channel")),
        "host": F.struct(
            S.strip(S.text(F.col("_sys.Computer"))).alias("name"),
            F.struct(F.lit("windows").alias("type")).alias("os"),
        ),
        "user": F.struct(S.user_domain(user).alias("domain"), S.user_name(user).alias("name")),
        "process": _process(get, code),
        **_sections(get, code),
        "sysmon": F.struct(F.col("_data").alias("event_data"), F.lit(None).cast("map<string,string>").alias("message_fields")),
        "data_stream": F.struct(
            F.lit("logs").alias("type"), F.lit(catalog.DATASET).alias("dataset"), namespace.alias("namespace")
        ),
        "tags": F.array(F.lit("ecs_normalized"), F.concat(F.lit("sysmon_event_"), code_text)),
    }
    projected = [
        _cast(name, columns[name]) if name in columns else _null(name) for name in schemas.EVENT_COLUMNS
    ]
    return df.select(*keep, *projected, _xml_error(get, code_text, xml).alias("error_reason"))


def parse_message(message: Column) -> Column:
    """``Key: value`` lines to a map; a line without a key continues the value before it."""
    lines = F.transform(F.split(S.text(message), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    lines = F.filter(lines, lambda x: x != "")
    key_line = r"^\s*([^:]{2,80}):\s*(.*)$"
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def fold(acc: Column, line: Column) -> Column:
        key = S.strip(F.regexp_extract(line, key_line, 1))
        value = S.strip(F.regexp_extract(line, key_line, 2))
        last = F.element_at(acc, -1)
        grown = F.struct(
            last["key"].alias("key"), S.strip(F.concat(last["value"], F.lit("\n"), S.strip(line))).alias("value")
        )
        is_key_line = line.rlike(key_line)
        return (
            F.when(is_key_line & (key != ""), F.concat(acc, F.array(F.struct(key.alias("key"), value.alias("value")))))
            .when(is_key_line | (F.size(acc) == 0), acc)
            .otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))
        )

    return S.last_wins_map(F.aggregate(lines, empty, fold))


def normalize_message(df: DataFrame, as_of: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Log records (``LOG_RECORD`` columns) to events from their message text alone."""
    df = df.withColumn("_fields", parse_message(F.col("message")))
    raw = lambda key: F.element_at(F.col("_fields"), key)
    get = lambda key: S.text(raw(key))
    # In this form empty values are dropped, not stored.
    opt = lambda key: S.non_empty(raw(key))
    code = F.col("event_id").cast("int")
    stamp = TS.normalize_timestamp(
        F.coalesce(S.non_empty(F.col("time_created")), opt("UtcTime")), TS.created_literal(as_of) if as_of else None
    )
    category, kind, action = event_shape(code)
    message = S.non_empty(F.col("message"))
    image, parent_image = get("Image"), get("ParentImage")
    process = F.struct(
        S.parse_long(get("ProcessId")).alias("pid"),
        opt("ProcessGuid").alias("entity_id"),
        S.non_empty(S.windows_basename(image)).alias("name"),
        S.non_empty(image).alias("executable"),
        opt("CommandLine").alias("command_line"),
        F.lit(None).cast("array<string>").alias("args"),
        F.lit(None).cast("string").alias("working_directory"),
        F.lit(None).cast("map<string,string>").alias("hash"),
        F.when(
            (parent_image != "") | (get("ParentCommandLine") != ""),
            F.struct(
                S.parse_long(get("ParentProcessId")).alias("pid"),
                opt("ParentProcessGuid").alias("entity_id"),
                S.non_empty(S.windows_basename(parent_image)).alias("name"),
                S.non_empty(parent_image).alias("executable"),
                opt("ParentCommandLine").alias("command_line"),
                F.lit(None).cast(schemas.USER).alias("user"),
            ),
        ).alias("parent"),
        F.lit(None).cast(schemas.PROCESS["Ext"].dataType).alias("Ext"),
    )
    path, key = get("TargetFilename"), get("TargetObject")
    fields = F.map_filter(F.col("_fields"), lambda _k, v: v != "")
    fields = F.when(F.size(fields) > 0, fields)
    columns = {
        "@timestamp": stamp,
        "event": F.struct(
            F.col("record_id").cast("string").alias("id"),
            F.lit("event").alias("kind"),
            category.alias("category"),
            kind.alias("type"),
            action.alias("action"),
            code.alias("code"),
            F.lit(catalog.MODULE).alias("module"),
            F.coalesce(S.non_empty(F.col("provider_name")), F.lit(catalog.PROVIDER)).alias("provider"),
            F.lit(catalog.DATASET).alias("dataset"),
            stamp.alias("created"),
            message.alias("original"),
        ),
        "log": F.struct(F.lit(catalog.LOG_NAME).alias("channel")),
        "host": F.struct(opt("Computer").alias("name"), F.struct(F.lit("windows").alias("type")).alias("os")),
        "process": process,
        "file": F.when(
            (code == 11) & (path != ""),
            F.struct(
                path.alias("path"),
                S.non_empty(S.windows_basename(path)).alias("name"),
                S.non_empty(S.file_extension(path)).alias("extension"),
            ),
        ),
        "registry": F.when(
            (code == 13) & ((key != "") | (get("Details") != "")),
            F.struct(
                S.non_empty(key).alias("path"),
                S.non_empty(S.last_backslash_segment(key)).alias("value"),
                F.when(get("Details") != "", F.struct(F.array(get("Details")).alias("strings"))).alias("data"),
            ),
        ),
        "source": F.when(
            code == 3, F.struct(opt("SourceIp").alias("ip"), S.parse_long(get("SourcePort")).alias("port"))
        ),
        "destination": F.when(
            code == 3,
            F.struct(
                opt("DestinationIp").alias("ip"),
                S.parse_long(get("DestinationPort")).alias("port"),
                opt("DestinationHostname").alias("domain"),
            ),
        ),
        "network": F.when(
            code == 3,
            F.struct(
                S.non_empty(F.lower(get("Protocol"))).alias("transport"),
                S.network_direction(get("Initiated")).alias("direction"),
            ),
        ),
        "sysmon": F.when(fields.isNotNull(), F.struct(fields.alias("event_data"), fields.alias("message_fields"))),
        "winlog": F.when(F.col("record_id").isNotNull(), F.struct(F.col("record_id"))),
        "raw": F.when(message.isNotNull(), F.struct(message.alias("message"))),
        "message": message,
        "data_stream": F.struct(
            F.lit("logs").alias("type"), F.lit(catalog.DATASET).alias("dataset"), F.lit("realtime").alias("namespace")
        ),
        "tags": F.array(
            F.lit("ecs_normalized"),
            F.concat(F.lit("sysmon_event_"), code.cast("string")),
            F.lit("realtime_message_fallback"),
        ),
    }
    projected = [
        _cast(name, columns[name]) if name in columns else _null(name) for name in schemas.EVENT_COLUMNS
    ]
    return df.select(*keep, *projected)


def normalize_records(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Log records to events: the XML form where it is good, else the message form, else a reject.

    One pass over the input: both forms are projections of the same row, and the row keeps the
    one that applies.
    """
    record = ("record_id", "event_id", "time_created", "provider_name", "message", "xml")
    from_xml = normalize_xml(df.select(*[F.col(c).alias(f"_r_{c}") for c in record], "xml"),
                             keep=tuple(f"_r_{c}" for c in record))
    from_xml = from_xml.select(
        *[F.col(f"_r_{c}").alias(c) for c in record if c != "message"],
        F.col("_r_message").alias("message"),
        F.struct(*[F.col(f"`{c}`") for c in schemas.EVENT_COLUMNS]).alias("_x"),
        F.col("error_reason").alias("_x_error"),
    )
    both = normalize_message(from_xml, as_of, keep=("record_id", "time_created", "provider_name", "xml", "_x", "_x_error"))
    msg = F.col("message")
    stamp = TS.normalize_timestamp(F.col("time_created"), TS.created_literal(as_of) if as_of else None)
    use_xml = S.text(F.col("xml")) != ""
    use_xml = use_xml & F.col("_x_error").isNull()
    x_time = F.coalesce(
        S.non_empty(F.col("_x.`@timestamp`")), F.when(S.text(F.col("time_created")) != "", stamp), F.lit("")
    )
    enriched = {
        "@timestamp": x_time,
        "event": F.col("_x.event")
        .withField("id", F.col("record_id").cast("string"))
        .withField(
            "created",
            F.coalesce(F.col("_x.event.created"), S.non_empty(F.col("_x.`@timestamp`")), stamp),
        ),
        "winlog": F.when(F.col("record_id").isNotNull(), F.struct(F.col("record_id"))),
        "message": S.text(msg),
        "raw": F.when(S.text(msg) != "", F.struct(msg.alias("message"))),
        "sysmon": F.col("_x.sysmon").withField(
            "message_fields", F.when(S.text(msg) != "", F.col("sysmon.message_fields"))
        ),
    }
    projected = []
    for name in schemas.EVENT_COLUMNS:
        xml_side = enriched.get(name, F.col(f"_x.`{name}`")).cast(schemas.EVENT[name].dataType)
        projected.append(F.when(use_xml, xml_side).otherwise(F.col(f"`{name}`")).alias(name))
    lost = (S.text(F.col("xml")) != "") & F.col("_x_error").isNotNull() & (S.text(msg) == "")
    return both.select(*projected, F.when(lost, F.col("_x_error")).alias("error_reason"))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events without the reason column, and the dead-letter rows with it."""
    good = df.where(F.col("error_reason").isNull()).drop("error_reason")
    rejects = df.where(F.col("error_reason").isNotNull()).select(
        "error_reason", F.col("event.original").alias("original")
    )
    return good, rejects


def fail_on_rejects(df: DataFrame) -> DataFrame:
    """Good events; the job fails at the first row with an ``error_reason``."""
    guard = F.when(
        F.col("error_reason").isNotNull(),
        F.raise_error(F.concat(F.lit("invalid telemetry row: "), F.col("error_reason"))).cast("boolean"),
    ).otherwise(F.lit(True))
    return df.where(guard).drop("error_reason")


def with_test_metadata(events: DataFrame, metadata: dict[str, str], tags: tuple[str, ...] = ()) -> DataFrame:
    """Attaches test-execution metadata (given values win) and adds the tags once each."""
    given = F.create_map(*[F.lit(x) for pair in metadata.items() for x in pair])
    old = F.map_filter(F.col("art"), lambda k, _v: ~k.isin(*metadata))
    return events.withColumn(
        "art", F.when(F.col("art").isNull(), given).otherwise(F.map_concat(old, given))
    ).withColumn("tags", F.array_union(F.coalesce(F.col("tags"), F.array().cast("array<string>")), S.str_array(tags)))


def raw_projection(events: DataFrame) -> DataFrame:
    """The raw-event form of normalized events."""
    return events.select(
        "`@timestamp`",
        F.struct(
            F.lit("event").alias("kind"),
            F.col("event.code").alias("code"),
            F.lit(catalog.MODULE).alias("module"),
            F.lit(catalog.RAW_DATASET).alias("dataset"),
            F.col("event.original").alias("original"),
        ).alias("event"),
        "host",
        "log",
        F.struct(F.col("sysmon.event_data").alias("event_data")).alias("sysmon"),
        "art",
        F.array(F.concat(F.lit("sysmon_event_"), F.col("event.code"), F.lit("_raw")), F.lit("fixture_smoke")).alias("tags"),
    )


def with_ingest_fields(raw: DataFrame) -> DataFrame:
    """Marks posted raw rows with their ingest source and the raw dataset name."""
    return raw.withColumn("ingest_source", F.lit(catalog.INGEST_SOURCE)).withColumn(
        "dataset", F.lit(catalog.RAW_DATASET)
    )


def drop_sensor_noise(events: DataFrame, images: tuple[str, ...] = catalog.SENSOR_IMAGES) -> DataFrame:
    """Leaves out events of the sensor's own executables."""
    return events.where(~S.text(F.col("process.executable")).isin(*images))
