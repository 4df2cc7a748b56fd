"""Sources that Spark reads by itself: files, tables, Kafka, JDBC, generated rows.

Each gives a static DataFrame or, with stream=True, a streaming one. Offsets of streams are kept by the
query's checkpoint; reading what is there and stopping is Trigger.AvailableNow at the sink.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import decode_graphite
from ..functions.fields import named_parameters
from ..operators.parse import SEVERITIES


def _with(df: DataFrame, add_field: Mapping[str, str] | None, tags: Sequence[str]) -> DataFrame:
    for name, value in (add_field or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df.withColumn("tags", F.array(*map(F.lit, tags)).cast("array<string>")) if tags else df


def lines(spark: SparkSession, path: str | Sequence[str], stream: bool = False, delimiter: str | None = None, exclude: Sequence[str] = (), add_field: Mapping[str, str] | None = None, tags: Sequence[str] = (), clean: str | None = None, max_files: int | None = None) -> DataFrame:
    """One row per line of files (globs, any store Spark reads): message and path.

    exclude: patterns of file names to leave out; clean: "delete" or "archive" for streams whose files go
    once they are read.
    """
    reader = spark.readStream if stream else spark.read
    options = {"lineSep": delimiter} if delimiter else {}
    if stream:
        options |= {"maxFilesPerTrigger": str(max_files)} if max_files else {}
        options |= {"cleanSource": clean} if clean else {}
    df = reader.options(**options).text(path if isinstance(path, str) or stream else list(path))
    df = df.select(F.col("value").alias("message"), F.col("_metadata.file_path").alias("path"))
    for pattern in exclude:
        df = df.where(~F.element_at(F.split("path", "/"), -1).rlike(pattern))
    return _with(df, add_field, tags)


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per whole file: path and content, for binary codecs."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def generator(spark: SparkSession, count: int, message: str = "Hello world!", partitions: int | None = None) -> DataFrame:
    """count rows of message and sequence (from 0), made in parallel."""
    return spark.range(0, count, 1, partitions).select(F.lit(message).alias("message"), F.col("id").alias("sequence"))


def heartbeat(spark: SparkSession, count: int | None = None, interval: float = 60, message: str = "ok") -> DataFrame:
    """A row every interval, as a stream; with a count, as many rows at once."""
    if count is not None:
        rows = spark.range(count)
        return rows.select(F.lit(message).alias("message"), F.col("id").alias("sequence"), F.lit("heartbeat").alias("type"))
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", int(interval * 1000)).load()
    return rate.select(F.lit(message).alias("message"), F.col("value").alias("sequence"), F.lit("heartbeat").alias("type"), F.col("timestamp").alias("@timestamp"))


def jdbc(spark: SparkSession, url: str, statement: str, last_value: str | int | None = None, tracking_column: str | None = None, partition: tuple[str, int, int, int] | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of an SQL statement, columns in lower case. `:sql_last_value` is replaced by last_value, which
    next_value() gives for the following run; partition: column, lowest, highest value and number of parts."""
    if last_value is not None:
        shown = str(last_value) if isinstance(last_value, int) else "'" + last_value.replace("'", "''") + "'"
        statement = named_parameters(statement, {"sql_last_value": shown})
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if partition:
        column, low, high, n = partition
        reader = reader.option("dbtable", f"({statement}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    else:
        reader = reader.option("query", statement)
    df = reader.load()
    return df.select(*(F.col(f"`{c}`").alias(c.lower()) for c in df.columns))


def next_value(df: DataFrame, tracking_column: str):
    """The largest value of the tracking column, to be kept for the next run."""
    return df.agg(F.max(tracking_column)).first()[0]


def kafka(spark: SparkSession, servers: str, topics: Sequence[str], stream: bool = True, starting: str = "latest", per_trigger: int | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """message (the value as text), and [@metadata][kafka] with topic, key, partition, offset and time."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    if stream:
        reader = reader.option("startingOffsets", starting)
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    df = reader.options(**(options or {})).load()
    meta = F.struct(F.struct("topic", F.col("key").cast("string").alias("key"), "partition", "offset", "timestamp").alias("kafka"))
    return df.select(F.col("value").cast("string").alias("message"), meta.alias("@metadata"))


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a TCP server, as a stream (not replayable: for tests and small feeds)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.col("value").alias("message"), F.lit(host).alias("host"))


def dead_letters(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the dead-letter sink has kept."""
    return spark.read.schema(schema).json(path)


#: The facilities that the syslog input names.
SYSLOG_FACILITIES = ["kernel", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp"]


def syslog_fields(df: DataFrame, source: str = "message") -> DataFrame:
    """Facility and severity from a leading <PRI>, which goes from the message; type is syslog."""
    pri = F.regexp_extract(source, r"\A<([0-9]{1,3})>", 1).try_cast("long")
    out = df.withColumn("__pri", pri)
    facility, severity = F.floor(F.col("__pri") / 8).cast("long"), F.col("__pri") % 8
    names = F.array(*map(F.lit, SYSLOG_FACILITIES))
    label = F.when(facility < len(SYSLOG_FACILITIES), F.get(names, facility.cast("int"))).when(facility.between(16, 23), "local").when(facility.isNotNull(), "unknown")
    return out.withColumns(
        {
            "facility_code": facility, "facility": label, "severity_code": severity,
            "severity": F.get(F.array(*map(F.lit, SEVERITIES)), severity.cast("int")),
            source: F.regexp_replace(source, r"\A<[0-9]{1,3}>", ""), "type": F.lit("syslog"),
        }
    ).drop("__pri")


def graphite_lines(df: DataFrame, source: str = "message") -> DataFrame:
    return decode_graphite(df, source)


def gelf_fields(df: DataFrame, schema: str, source: str = "message") -> DataFrame:
    """GELF documents: short_message becomes the message, custom fields lose their underscore. schema names
    the fields as they are sent; compressed payloads are unpacked by the receiver (services.inflate)."""
    from pyspark.sql import types as T

    doc = F.from_json(source, schema)
    out = df.withColumn("__g", doc).drop(source)
    for name in T.StructType.fromDDL(schema).fieldNames():
        out = out.withColumn({"short_message": "message"}.get(name, name.removeprefix("_")), F.col("__g")[name])
    return out.drop("__g")
