"""The telemetry view: the ``events`` test table mapped to normalized endpoint events.

``normalized_events`` gives the nested event schema. ``FLAT_SQL`` is the same view as plain
columns for the check SQL. Both are deterministic functions of the table's own columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog, schemas
from ..functions import scalars as S
from ..operators.normalize import event_shape

PROCESS_NAMES = (
    "certutil.exe", "PowerShell.exe", "reg.exe", "rundll32.exe", "cmd.exe", "notepad.exe", "curl.exe", "wscript.exe",
)
PARENT_NAMES = ("explorer.exe", "cmd.exe", "PowerShell.exe", "winword.exe")
_RUN = "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\"


def _event_code() -> Column:
    t = F.col("event_type")
    known = [F.when(t == name, F.lit(code)) for name, code in EVENT_TYPES.items()]
    return F.coalesce(*known, F.lit(7)).cast("int")


# Event type of the table to event code of the view.
EVENT_TYPES = {"view": 1, "click": 3, "purchase": 11, "signup": 13}


def read_events(spark: SparkSession, sf_dir: str, codes: Sequence[int] | None = None) -> DataFrame:
    """The events table, with the wanted event codes as a filter the scan can push down."""
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    if codes is not None:
        raw = raw.where(F.col("event_type").isin(*[t for t, c in EVENT_TYPES.items() if c in codes]))
    return raw


def flat_view(spark: SparkSession, sf_dir: str, codes: Sequence[int] | None = None) -> DataFrame:
    """The flat telemetry columns; ``seq`` is the event's arrival number."""
    return flatten(read_events(spark, sf_dir, codes))


def flatten(raw: DataFrame) -> DataFrame:
    """Rows of the events table as flat telemetry columns."""
    i, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = raw.select(
        i.alias("seq"),
        F.col("ts").cast("timestamp").alias("raw_ts"),
        u.alias("user_no"),
        F.col("value"),
        _event_code().alias("event_code"),
        k.alias("k"),
        F.concat(F.lit("HOST-"), (u % 10).cast("string")).alias("host_name"),
        F.element_at(S.str_array(PROCESS_NAMES), (i % 8 + 1).cast("int")).alias("process_name"),
        F.element_at(S.str_array(PARENT_NAMES), (i % 4 + 1).cast("int")).alias("parent_base"),
        F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("u"), u.cast("string"))).alias("entity_id"),
        F.when(i % 11 == 0, F.concat(F.lit("u"), (u - 1).cast("string"))).otherwise(F.lit("")).alias("parent_entity_id"),
        F.when(i % 97 == 0, F.lit(None)).otherwise(u + 1000).cast("bigint").alias("pid"),
    )
    c, name, i, k = F.col("event_code"), F.col("process_name"), F.col("seq"), F.col("k")
    folder = (
        F.when(i % 7 == 0, F.lit("C:\\Users\\Public\\"))
        .when(i % 7 == 1, F.lit("C:\\Program Files\\Tools\\"))
        .otherwise(F.lit("C:\\Windows\\System32\\"))
    )
    n = k % 10
    step = lambda m: (i % m + 1).cast("string")
    tail = (
        F.when(n == 0, F.lit("-urlcache -f http://127.0.0.1/edr_demo.txt EDR_DEMO_T1105"))
        .when(n == 1, F.lit("-NoProfile -ExecutionPolicy Bypass -EncodedCommand SQBFAFgA"))
        .when(n == 2, F.lit("javascript:alert EDR_DEMO_T1218"))
        .when(n == 3, F.lit("add HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run /v EDRDemo"))
        .when(n == 4, F.lit('/c powershell.exe "Get Process" x'))
        .when(n == 5, F.lit("Invoke-WebRequest http://example.test/a iwr nc"))
        .when(n == 6, F.concat(F.lit("EDR_DEMO_TP_"), step(8)))
        .when(n == 7, F.concat(F.lit("EDR_DEMO_FP_"), step(6)))
        .when(n == 8, F.concat(F.when(i % 2 == 0, "EDR_DEMO_TN_").otherwise("EDR_DEMO_FN_"), step(6)))
        .otherwise(F.repeat(F.lit("/all "), 26))
    )
    dest = k % 4
    cols = {
        "executable": F.concat(folder, name),
        "command_line": F.when(c == 1, F.concat(name, F.lit(" "), tail)),
        "parent_name": F.when(c == 1, F.col("parent_base")),
        "dest_ip": F.when(
            c == 3,
            F.when(dest == 0, F.lit("127.0.0.1"))
            .when(dest == 1, F.concat(F.lit("10.0.0."), (F.col("user_no") % 250).cast("string")))
            .when(dest == 2, F.lit(""))
            .otherwise(F.lit("93.184.216.34")),
        ),
        "dest_domain": F.when(
            c == 3,
            F.when(dest == 2, F.lit("example.test")).when(dest == 3, F.lit("cdn.example.org")).otherwise(F.lit("")),
        ),
        "dest_port": F.when(c == 3, F.when(k % 2 == 0, 443).otherwise(8080)).cast("bigint"),
        "protocol": F.when(c == 3, F.when(k % 5 == 0, F.lit("UDP")).otherwise(F.lit("TCP"))),
        "initiated": F.when(
            c == 3, F.when(k % 3 == 0, F.lit("true")).when(k % 3 == 1, F.lit("False")).otherwise(F.lit(""))
        ),
        "file_path": F.when(
            c == 11,
            F.when(k % 3 == 0, F.concat(F.lit("C:\\Users\\demo\\Downloads\\edr_demo_"), k.cast("string"), F.lit(".txt")))
            .when(k % 3 == 1, F.lit("C:\\Users\\demo\\Documents\\report.v2.docx"))
            .otherwise(F.lit("C:/Temp/noext")),
        ),
        "registry_path": F.when(
            c == 13,
            F.when(dest == 0, F.lit(_RUN + "Run\\EDRDemo"))
            .when(dest == 1, F.lit(_RUN + "RunOnce\\Setup"))
            .when(dest == 2, F.lit("HKLM\\System\\Services\\svc"))
            .otherwise(F.lit(_RUN + "Run\\Updater")),
        ),
        "details": F.when(
            c == 13,
            F.when(dest == 0, F.lit("powershell.exe -File demo.ps1"))
            .when(dest == 1, F.lit("cmd.exe /c run"))
            .when(dest == 2, F.lit("1"))
            .otherwise(F.lit("notepad.exe")),
        ),
        "user_text": F.when(i % 6 == 0, F.concat(F.lit("svc"), F.col("user_no").cast("string"))).otherwise(
            F.concat(F.lit("CORP\\user"), F.col("user_no").cast("string"))
        ),
        "hashes": F.when(c == 1, F.concat(F.lit("SHA256=AB"), k.cast("string"), F.lit(", MD5=CD"), i.cast("string"))),
        # Some events carry a timestamp that does not parse.
        "stamp": F.when((i % 211 == 0) & (c != 1), F.lit("not-a-time")).otherwise(
            F.date_format("raw_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        ),
        "ts": F.when((i % 211 != 0) | (c == 1), F.col("raw_ts")),
    }
    return base.withColumns(cols)


def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view in the normalized event schema, plus ``seq``, ``ts`` and ``src_doc``."""
    return nested_view(flat_view(spark, sf_dir))


def nested_view(v: DataFrame) -> DataFrame:
    """Nests the flat telemetry columns into the normalized event schema."""
    code = F.col("event_code")
    category, kind, action = event_shape(code)
    null = lambda t: F.lit(None).cast(t)
    pairs = {
        "CommandLine": F.col("command_line"),
        "Details": F.col("details"),
        "Image": F.col("executable"),
        "TargetFilename": F.col("file_path"),
    }
    entries = F.array_compact(
        F.array(
            *[F.when(x.isNotNull(), F.struct(F.lit(key).alias("key"), x.alias("value"))) for key, x in pairs.items()]
        )
    )
    sections = {
        "@timestamp": F.col("stamp"),
        "event": F.struct(
            F.col("seq").cast("string").alias("id"),
            F.lit("event").alias("kind"),
            category.alias("category"),
            kind.alias("type"),
            action.alias("action"),
            code.alias("code"),
            F.lit(catalog.MODULE).alias("module"),
            F.lit(catalog.PROVIDER).alias("provider"),
            F.lit(catalog.DATASET).alias("dataset"),
            null("string").alias("created"),
            null("string").alias("original"),
        ),
        "log": F.struct(F.lit(catalog.LOG_NAME).alias("channel")),
        "host": F.struct(F.col("host_name").alias("name"), F.struct(F.lit("windows").alias("type")).alias("os")),
        "user": F.struct(
            S.user_domain(F.col("user_text")).alias("domain"), S.user_name(F.col("user_text")).alias("name")
        ),
        "process": F.struct(
            F.col("pid"),
            F.col("entity_id"),
            F.col("process_name").alias("name"),
            F.col("executable"),
            F.col("command_line"),
            F.when(code == 1, S.split_command_line(F.col("command_line"))).alias("args"),
            null("string").alias("working_directory"),
            F.when(code == 1, S.parse_hashes(F.col("hashes"))).alias("hash"),
            F.struct(
                null("bigint").alias("pid"),
                F.col("parent_entity_id").alias("entity_id"),
                F.col("parent_name").alias("name"),
                null("string").alias("executable"),
                null("string").alias("command_line"),
                null(schemas.USER).alias("user"),
            ).alias("parent"),
            null(schemas.PROCESS["Ext"].dataType).alias("Ext"),
        ),
        "file": F.when(
            code == 11,
            F.struct(
                F.col("file_path").alias("path"),
                S.windows_basename(F.col("file_path")).alias("name"),
                S.file_extension(F.col("file_path")).alias("extension"),
            ),
        ),
        "registry": F.when(
            code == 13,
            F.struct(
                F.col("registry_path").alias("path"),
                S.last_backslash_segment(F.col("registry_path")).alias("value"),
                F.struct(F.array("details").alias("strings")).alias("data"),
            ),
        ),
        "destination": F.when(
            code == 3,
            F.struct(
                F.col("dest_ip").alias("ip"), F.col("dest_port").alias("port"), F.col("dest_domain").alias("domain")
            ),
        ),
        "network": F.when(
            code == 3,
            F.struct(
                F.lower("protocol").alias("transport"), S.network_direction(F.col("initiated")).alias("direction")
            ),
        ),
        "sysmon": F.struct(
            F.map_from_entries(entries).alias("event_data"), null("map<string,string>").alias("message_fields")
        ),
        "winlog": F.struct(F.col("seq").alias("record_id")),
        "data_stream": F.struct(
            F.lit("logs").alias("type"), F.lit(catalog.DATASET).alias("dataset"), F.lit("view").alias("namespace")
        ),
        "tags": F.array(F.lit("ecs_normalized"), F.concat(F.lit("sysmon_event_"), code.cast("string"))),
    }
    projected = [
        sections.get(name, null(schemas.EVENT[name].dataType)).cast(schemas.EVENT[name].dataType).alias(name)
        for name in schemas.EVENT_COLUMNS
    ]
    return v.select(
        "seq",
        "ts",
        *projected,
        F.struct(F.lit("events").alias("index"), F.col("seq").cast("string").alias("document_id")).alias("src_doc"),
    )


def supported_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized view without the unsupported event codes; the filter reaches the scan."""
    return nested_view(flat_view(spark, sf_dir, catalog.SUPPORTED_CODES))


# The same view for the check SQL, as one CTE list; each check query continues after it.
FLAT_SQL = r"""
WITH tele0 AS (
  SELECT event_id AS seq, ts AS raw_ts, user_id AS user_no, value,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 11 WHEN 'signup' THEN 13 ELSE 7 END AS event_code,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    'HOST-' || CAST(user_id % 10 AS VARCHAR) AS host_name,
    (['certutil.exe','PowerShell.exe','reg.exe','rundll32.exe','cmd.exe','notepad.exe','curl.exe','wscript.exe'])[event_id % 8 + 1] AS process_name,
    (['explorer.exe','cmd.exe','PowerShell.exe','winword.exe'])[event_id % 4 + 1] AS parent_base,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE 'u' || CAST(user_id AS VARCHAR) END AS entity_id,
    CASE WHEN event_id % 11 = 0 THEN 'u' || CAST(user_id - 1 AS VARCHAR) ELSE '' END AS parent_entity_id,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id + 1000 END AS pid
  FROM events
),
tele1 AS (
  SELECT *,
    CASE WHEN seq % 7 = 0 THEN 'C:\Users\Public\' WHEN seq % 7 = 1 THEN 'C:\Program Files\Tools\' ELSE 'C:\Windows\System32\' END || process_name AS executable,
    CASE WHEN event_code = 1 THEN process_name || ' ' || CASE k % 10
      WHEN 0 THEN '-urlcache -f http://127.0.0.1/edr_demo.txt EDR_DEMO_T1105'
      WHEN 1 THEN '-NoProfile -ExecutionPolicy Bypass -EncodedCommand SQBFAFgA'
      WHEN 2 THEN 'javascript:alert EDR_DEMO_T1218'
      WHEN 3 THEN 'add HKCU\Software\Microsoft\Windows\CurrentVersion\Run /v EDRDemo'
      WHEN 4 THEN '/c powershell.exe "Get Process" x'
      WHEN 5 THEN 'Invoke-WebRequest http://example.test/a iwr nc'
      WHEN 6 THEN 'EDR_DEMO_TP_' || CAST(seq % 8 + 1 AS VARCHAR)
      WHEN 7 THEN 'EDR_DEMO_FP_' || CAST(seq % 6 + 1 AS VARCHAR)
      WHEN 8 THEN CASE WHEN seq % 2 = 0 THEN 'EDR_DEMO_TN_' ELSE 'EDR_DEMO_FN_' END || CAST(seq % 6 + 1 AS VARCHAR)
      ELSE repeat('/all ', 26) END END AS command_line,
    CASE WHEN event_code = 1 THEN parent_base END AS parent_name,
    CASE WHEN event_code = 3 THEN CASE k % 4 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '10.0.0.' || CAST(user_no % 250 AS VARCHAR) WHEN 2 THEN '' ELSE '93.184.216.34' END END AS dest_ip,
    CASE WHEN event_code = 3 THEN CASE k % 4 WHEN 2 THEN 'example.test' WHEN 3 THEN 'cdn.example.org' ELSE '' END END AS dest_domain,
    CASE WHEN event_code = 3 THEN CASE WHEN k % 2 = 0 THEN 443 ELSE 8080 END END AS dest_port,
    CASE WHEN event_code = 3 THEN CASE WHEN k % 5 = 0 THEN 'UDP' ELSE 'TCP' END END AS protocol,
    CASE WHEN event_code = 3 THEN CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'False' ELSE '' END END AS initiated,
    CASE WHEN event_code = 11 THEN CASE k % 3 WHEN 0 THEN 'C:\Users\demo\Downloads\edr_demo_' || CAST(k AS VARCHAR) || '.txt' WHEN 1 THEN 'C:\Users\demo\Documents\report.v2.docx' ELSE 'C:/Temp/noext' END END AS file_path,
    CASE WHEN event_code = 13 THEN CASE k % 4 WHEN 0 THEN 'HKCU\Software\Microsoft\Windows\CurrentVersion\Run\EDRDemo' WHEN 1 THEN 'HKCU\Software\Microsoft\Windows\CurrentVersion\RunOnce\Setup' WHEN 2 THEN 'HKLM\System\Services\svc' ELSE 'HKCU\Software\Microsoft\Windows\CurrentVersion\Run\Updater' END END AS registry_path,
    CASE WHEN event_code = 13 THEN CASE k % 4 WHEN 0 THEN 'powershell.exe -File demo.ps1' WHEN 1 THEN 'cmd.exe /c run' WHEN 2 THEN '1' ELSE 'notepad.exe' END END AS details,
    CASE WHEN seq % 6 = 0 THEN 'svc' || CAST(user_no AS VARCHAR) ELSE 'CORP\user' || CAST(user_no AS VARCHAR) END AS user_text,
    CASE WHEN event_code = 1 THEN 'SHA256=AB' || CAST(k AS VARCHAR) || ', MD5=CD' || CAST(seq AS VARCHAR) END AS hashes,
    CASE WHEN seq % 211 = 0 AND event_code <> 1 THEN 'not-a-time' ELSE strftime(raw_ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS stamp,
    CASE WHEN seq % 211 <> 0 OR event_code = 1 THEN raw_ts END AS ts
  FROM tele0
),
tele AS (
  SELECT *,
    list_extract(string_split_regex(file_path, '[\\/]'), -1) AS file_name,
    list_extract(string_split(registry_path, '\'), -1) AS registry_value,
    '{' || concat_ws(',',
      CASE WHEN command_line IS NOT NULL THEN '"CommandLine":"' || replace(replace(command_line, '\', '\\'), '"', '\"') || '"' END,
      CASE WHEN details IS NOT NULL THEN '"Details":"' || replace(details, '\', '\\') || '"' END,
      '"Image":"' || replace(executable, '\', '\\') || '"',
      CASE WHEN file_path IS NOT NULL THEN '"TargetFilename":"' || replace(file_path, '\', '\\') || '"' END) || '}' AS event_data,
    CASE WHEN details IS NOT NULL THEN '["' || details || '"]' END AS registry_data,
    CASE event_code WHEN 1 THEN 'process' WHEN 3 THEN 'network' WHEN 11 THEN 'file' WHEN 13 THEN 'registry' ELSE 'event' END AS category,
    CASE event_code WHEN 1 THEN 'start' WHEN 3 THEN 'connection' WHEN 11 THEN 'creation' WHEN 13 THEN 'change' ELSE 'info' END AS type,
    CASE event_code WHEN 1 THEN 'Process Create' WHEN 3 THEN 'Network connection detected' WHEN 11 THEN 'File created' WHEN 13 THEN 'Registry value set' ELSE 'Sysmon Event ' || CAST(event_code AS VARCHAR) END AS action,
    CASE WHEN contains(user_text, '\') THEN split_part(user_text, '\', 1) ELSE '' END AS user_domain,
    CASE WHEN contains(user_text, '\') THEN split_part(user_text, '\', 2) ELSE user_text END AS user_name
  FROM tele1
)
"""


def xml_documents(v: DataFrame) -> DataFrame:
    """Flat telemetry rows as raw event documents: ``seq`` and ``xml``."""
    esc = lambda c: F.replace(F.replace(S.text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    data = lambda n, c: F.concat(F.lit(f'<Data Name="{n}">'), esc(c), F.lit("</Data>"))
    code = F.col("event_code")
    only = lambda c, *parts: F.when(code == c, F.concat(*parts)).otherwise(F.lit(""))
    parent_image = F.concat(F.lit("C:\\Windows\\"), F.col("parent_name"))
    return v.select(
        "seq",
        F.concat(
            F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System>'),
            F.lit(f'<Provider Name="{catalog.PROVIDER}"/><EventID>'), code.cast("string"),
            F.lit('</EventID><TimeCreated SystemTime="'), F.col("stamp"), F.lit('"/><EventRecordID>'),
            F.col("seq").cast("string"), F.lit(f"</EventRecordID><Channel>{catalog.LOG_NAME}</Channel><Computer>"),
            esc(F.col("host_name")), F.lit("</Computer></System><EventData>"),
            data("ProcessGuid", F.col("entity_id")), data("ProcessId", F.col("pid")),
            data("Image", F.col("executable")), data("User", F.col("user_text")),
            only(
                1,
                data("UtcTime", F.date_format("raw_ts", "yyyy-MM-dd HH:mm:ss.SSS")),
                data("CommandLine", F.col("command_line")), data("Hashes", F.col("hashes")),
                data("ParentProcessGuid", F.col("parent_entity_id")), data("ParentProcessId", F.lit("4")),
                data("ParentImage", parent_image),
            ),
            only(
                3,
                data("Protocol", F.col("protocol")), data("Initiated", F.col("initiated")),
                data("SourceIp", F.lit("10.1.1.1")), data("SourcePort", F.lit("50000")),
                data("DestinationIp", F.col("dest_ip")), data("DestinationHostname", F.col("dest_domain")),
                data("DestinationPort", F.col("dest_port")),
            ),
            only(11, data("TargetFilename", F.col("file_path"))),
            only(13, data("TargetObject", F.col("registry_path")), data("Details", F.col("details"))),
            F.lit("</EventData></Event>"),
        ).alias("xml"),
    )


def log_records(v: DataFrame) -> DataFrame:
    """Flat telemetry rows as event-log records that carry only message text."""
    line = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c.cast("string")))
    message = F.concat_ws(
        "\n",
        F.lit("Telemetry record:"),
        line("ProcessId", F.col("pid")), line("ProcessGuid", F.col("entity_id")), line("Image", F.col("executable")),
        line("CommandLine", F.col("command_line")), line("Protocol", F.col("protocol")),
        line("Initiated", F.col("initiated")), line("DestinationIp", F.col("dest_ip")),
        line("DestinationPort", F.col("dest_port")), line("DestinationHostname", F.col("dest_domain")),
        line("TargetFilename", F.col("file_path")), line("TargetObject", F.col("registry_path")),
        line("Details", F.col("details")), F.lit("  continued text"), line("Computer", F.col("host_name")),
    )
    return v.select(
        F.col("seq").alias("record_id"), F.col("event_code").alias("event_id"),
        F.date_format("raw_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("time_created"), F.lit("").alias("provider_name"),
        message.alias("message"), F.lit("").alias("xml"),
    )


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The events table as a file stream of flat telemetry rows of supported codes."""
    table = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(table).schema
    # The name may be that of one file or of a folder of part files; a stream's source takes a pattern for either.
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    wanted = [t for t, c in EVENT_TYPES.items() if c in catalog.SUPPORTED_CODES]
    return flatten(reader.parquet(f"{sf_dir.rstrip('/')}/events.parque[t]").where(F.col("event_type").isin(*wanted)))
