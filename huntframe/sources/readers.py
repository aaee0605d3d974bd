"""Sources: raw documents, normalized events, topics, stored tables and report inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog, schemas
from ..functions import scalars as S
from ..functions import timestamps as TS


def read_xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """One event document per file: ``path`` and ``xml``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")
    )


def read_xml_records(spark: SparkSession, path: str) -> DataFrame:
    """One event document per line: ``xml``. Files split at lines, so large files spread."""
    return spark.read.text(path).select(F.col("value").alias("xml"))


def decode_events(texts: DataFrame, value: str = "value") -> DataFrame:
    """JSON texts, each one event object or an array of events, to event rows.

    The code may be a number or text; ``code_is_string`` tells. Registry strings may be a list
    or one bare string.
    """
    doc = F.try_parse_json(F.col(value))
    is_array = F.startswith(F.schema_of_variant("_doc"), F.lit("ARRAY"))
    items = F.try_variant_get("_doc", "$", "array<variant>")
    rows = texts.select(doc.alias("_doc")).select(
        F.explode(F.when(is_array, items).otherwise(F.array("_doc"))).alias("_v")
    )
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    wire = schemas.with_text_code(schemas.EVENT)
    parsed = F.from_json(F.to_json("_v"), wire)
    bare = F.when(kind("$.registry.data.strings") == "STRING", F.try_variant_get("_v", "$.registry.data.strings", "string"))
    df = rows.where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))).select(
        parsed.alias("_e"), (kind("$.event.code") == "STRING").alias("code_is_string"), bare.alias("_bare")
    )
    meta = F.when(
        F.col("_e.event").isNotNull(),
        F.col("_e.event").withField("code", F.col("_e.event.code").try_cast("int")),
    ).cast(schemas.EVENT_META)
    registry = F.when(
        F.col("_bare").isNotNull(),
        F.struct(
            F.col("_e.registry.path").alias("path"),
            F.col("_e.registry.value").alias("value"),
            F.struct(F.array("_bare").alias("strings")).alias("data"),
        ),
    ).otherwise(F.col("_e.registry"))
    special = {"event": meta, "registry": registry}
    return df.select(
        *[special.get(c, F.col(f"_e.`{c}`")).alias(c) for c in schemas.EVENT_COLUMNS],
        F.coalesce("code_is_string", F.lit(False)).alias("code_is_string"),
    )


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Event documents, one object or array per file."""
    return decode_events(spark.read.text(path, wholetext=True))


def read_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Event documents, one per line."""
    return decode_events(spark.read.text(path))


def read_event_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored daily events; the date bounds (``yyyy-MM-dd``, inclusive) prune partitions."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("index_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("index_date") <= F.lit(end).cast("date"))
    return df


def parse_search_hits(responses: DataFrame, value: str = "value") -> DataFrame:
    """Search responses to event rows with ``src_doc``; hits without a document are left out."""
    hits = F.from_json(F.col(value), schemas.SEARCH_RESPONSE)["hits"]["hits"]
    rows = responses.select(F.explode(hits).alias("h")).where(F.col("h._source").isNotNull())
    return rows.select(
        "h._source.*", F.struct(F.col("h._index").alias("index"), F.col("h._id").alias("document_id")).alias("src_doc")
    )


#: A page of the response planner (fixed value).
ALERT_PAGE = 25


def read_alerts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stored alerts; with a limit (such as ``ALERT_PAGE``) the newest ones, by time and then id."""
    df = spark.read.parquet(path)
    if limit is None:
        return df
    return df.orderBy(TS.parse_iso(F.col("alert.created")).desc_nulls_last(), F.col("alert.id")).limit(limit)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there. Any other trouble with it is an error and raised."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_alerts_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def decode_log_rows(batches: DataFrame, value: str = "value") -> DataFrame:
    """Event-log exports, one object or an array per text, to ``LOG_RECORD`` rows with defaults."""
    text = F.trim(F.col(value))
    many = F.from_json(text, T.ArrayType(schemas.LOG_RECORD_JSON))
    one = F.array(F.from_json(text, schemas.LOG_RECORD_JSON))
    rows = batches.where(text != "").select(F.explode(F.when(F.startswith(text, F.lit("[")), many).otherwise(one)).alias("r"))
    number = lambda f: F.coalesce(F.col(f"r.{f}").try_cast("bigint"), F.lit(0))
    return rows.where(F.col("r").isNotNull()).select(
        number("RecordId").cast("bigint").alias("record_id"),
        number("Id").try_cast("int").alias("event_id"),
        S.text(F.col("r.TimeCreated")).alias("time_created"),
        S.text(F.col("r.ProviderName")).alias("provider_name"),
        S.text(F.col("r.Message")).alias("message"),
        S.text(F.col("r.Xml")).alias("xml"),
    )


def filter_log_rows(
    records: DataFrame, start: str | None = None, event_ids: tuple[int, ...] = catalog.SUPPORTED_CODES
) -> DataFrame:
    """Records of the wanted event ids, from ``start`` on."""
    df = records.where(F.col("event_id").isin(*event_ids))
    if start is None:
        return df
    created: Column = TS.parse_iso(TS.normalize_timestamp(F.col("time_created")))
    return df.where(created >= F.lit(start).cast("timestamp"))


def kafka_messages(
    spark: SparkSession,
    servers: str,
    topic: str = catalog.EVENTS_TOPIC,
    max_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Topic stream from the earliest offset; progress lives in the query's checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**(options or {}))
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", str(max_per_trigger))
    return reader.load()


def kafka_batch(spark: SparkSession, servers: str, topic: str = catalog.EVENTS_TOPIC, ending: str = "latest") -> DataFrame:
    """Everything in a topic up to given offsets, as one bounded batch."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("endingOffsets", ending)
        .load()
    )


def envelope_directory(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Serialized envelopes in text files, replayed as a stream with a ``value`` column."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def landing_stream(spark: SparkSession, path: str, schema: T.StructType = schemas.EVENT) -> DataFrame:
    """Posted raw JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def read_required(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """Like ``read_required``; a missing input reads as an empty table."""
    if path is not None and path_exists(spark, path):
        return read_required(spark, path, schema)
    return spark.createDataFrame([], schema)
