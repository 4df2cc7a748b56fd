"""Sinks: files, tables, Kafka, JDBC, and services behind a client.

Writers take a static DataFrame; on_batches() lets a stream use them, batch by batch. A service is a
function that opens a session once a task and gives a function that sends a list of texts.
"""

from __future__ import annotations

import socket
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.codecs import encode_csv, encode_es_bulk, encode_json
from ..functions.conditions import Condition, sql
from ..functions.fields import as_text, template

Send = Callable[[list[str]], None]
Writer = Callable[[DataFrame], None]


def text_files(path: str, form: str | None = None, mode: str = "append", compression: str | None = None, max_rows: int | None = None) -> Writer:
    """Event JSON, or a template, one line a row; max_rows per file and compression as in rotating sinks."""

    def write(df: DataFrame) -> None:
        lines = df.select((template(df, form) if form else encode_json(df)).alias("value"))
        options = ({"compression": compression} if compression else {}) | ({"maxRecordsPerFile": str(max_rows)} if max_rows else {})
        lines.write.mode(mode).options(**options).text(path)

    return write


def csv_files(path: str, fields: Sequence[str], separator: str = ",", quote: str = '"', mode: str = "append") -> Writer:
    return lambda df: df.select(encode_csv(df, fields, separator, quote).alias("value")).write.mode(mode).text(path)


def null(df: DataFrame) -> None:
    """Computes everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def kafka(servers: str, topic: str, key: str | None = None, options: Mapping[str, str] | None = None) -> Writer:
    def write(df: DataFrame) -> None:
        out = df.select(template(df, topic).alias("topic"), *([template(df, key).alias("key")] if key else []), encode_json(df).alias("value"))
        out.write.format("kafka").option("kafka.bootstrap.servers", servers).options(**(options or {})).save()

    return write


def jdbc(url: str, table: str, columns: Sequence[str] | None = None, options: Mapping[str, str] | None = None) -> Writer:
    return lambda df: df.select(*(columns or df.columns)).write.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).mode("append").save()


def service(open_session: Callable[[], Send], encode: Callable[[DataFrame], Column], batch: int = 500) -> Writer:
    """Sends encoded rows in batches from every task."""

    def write(df: DataFrame) -> None:
        def send_all(rows: Iterable) -> None:
            send, held = open_session(), []
            for row in rows:
                held.append(row["value"])
                if len(held) >= batch:
                    send(held)
                    held = []
            if held:
                send(held)

        df.select(encode(df).alias("value")).foreachPartition(send_all)

    return write


def http_session(url: str, method: str = "POST", joiner: str = "\n", headers: Mapping[str, str] | None = None, retries: int = 3, wait: float = 1.0) -> Callable[[], Send]:
    """Retries what may pass (no connection, 429, 5xx), with doubling waits; other answers fail the task."""

    def open_session() -> Send:
        def send(texts: list[str]) -> None:
            body = joiner.join(texts).encode()
            for k in range(retries + 1):
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, body, dict(headers or {}), method=method), timeout=60):
                        return
                except urllib.error.HTTPError as e:
                    if e.code != 429 and e.code < 500 or k == retries:
                        raise
                except urllib.error.URLError:
                    if k == retries:
                        raise
                time.sleep(wait * 2**k)

        return send

    return open_session


def http(url: str, form: str = "json", headers: Mapping[str, str] | None = None, batch: int = 500) -> Writer:
    """json: newline-delimited documents; json_batch: an array; form: one URL-encoded body a row; message: the text."""
    joiner = {"json": "\n", "json_batch": ",", "form": "\n", "message": "\n"}[form]
    encode = form_body if form == "form" else (lambda df: F.col("message")) if form == "message" else encode_json
    session = http_session(url, joiner=joiner, headers=headers)
    if form == "json_batch":
        inner = session

        def session() -> Send:
            send = inner()
            return lambda texts: send(["[" + ",".join(texts) + "]"])

    return service(session, encode, 1 if form == "form" else batch)


def form_body(df: DataFrame) -> Column:
    """The row's fields as name=value pairs, URL-encoded."""
    parts = [F.concat(F.lit(f.name + "="), F.url_encode(as_text(F.col(f"`{f.name}`"), f.dataType))) for f in df.schema.fields if f.name != "@metadata"]
    return F.concat_ws("&", *parts)


def elasticsearch(hosts: str, index: str, action: str = "index", doc_id: str | None = None, routing: str | None = None, session: Callable[[], Send] | None = None, batch: int = 500) -> Writer:
    """Bulk requests to a search cluster (or one that speaks its protocol)."""
    opened = session or http_session(f"{hosts}/_bulk", joiner="", headers={"Content-Type": "application/x-ndjson"})
    return service(opened, lambda df: encode_es_bulk(df, index, action, doc_id, routing), batch)


def sockets(host: str, port: int, udp: bool = False) -> Writer:
    """A line a row over TCP, or a datagram a row over UDP."""

    def open_session() -> Send:
        kind = socket.SOCK_DGRAM if udp else socket.SOCK_STREAM
        sock = socket.socket(socket.AF_INET, kind)
        sock.connect((host, port))

        def send(texts: list[str]) -> None:
            for t in texts:
                sock.sendall(t.encode() if udp else (t + "\n").encode())

        return send

    return service(open_session, encode_json)


def graphite_lines(df: DataFrame, fields: Sequence[str] | None = None, prefix: str = "", time: str = "@timestamp") -> DataFrame:
    """`name value epoch` for each number of a row: the named fields, or all that are numbers."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)) and (fields is None or f.name in fields)]
    epoch = F.unix_seconds(F.col(f"`{time}`").cast("timestamp"))
    pairs = F.array(*(F.struct(F.lit(prefix + n).alias("n"), as_text(F.col(f"`{n}`").cast("double"), T.DoubleType()).alias("v")) for n in numbers))
    return df.select(F.explode(pairs).alias("p"), epoch.alias("t")).where("p.v IS NOT NULL").select(F.concat_ws(" ", "p.n", "p.v", F.col("t").cast("string")).alias("value"))


def metric_data(df: DataFrame, name: str, value: str, unit: str = "None", per_call: int = 20) -> DataFrame:
    """Metric data in groups of at most per_call for a monitoring service, as JSON; rows whose value is no number are left out."""
    number = F.col(value).try_cast("double")
    row = F.struct(template(df, name).alias("MetricName"), number.alias("Value"), F.lit(unit).alias("Unit"))
    rows = df.select(row.alias("d"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).where("d.Value IS NOT NULL")
    return rows.groupBy("p", F.floor(F.col("i") % (1 << 33) / per_call).alias("g")).agg(F.to_json(F.struct(F.collect_list("d").alias("MetricData"))).alias("value")).select("value")


def messages(df: DataFrame, subject: str, body: str) -> DataFrame:
    """Mail or notification texts, for a client on the receiving side of service()."""
    return df.select(template(df, subject).alias("subject"), template(df, body).alias("body"))


def routed(df: DataFrame, outputs: Sequence[tuple[Condition | str | None, Writer]]) -> None:
    """Every output gets all rows that meet its condition; the rows are computed once."""
    kept = df.persist()
    try:
        for condition, write in outputs:
            test = None if condition is None else sql(condition) if isinstance(condition, str) else condition
            write(kept if test is None else kept.where(test(kept)))
    finally:
        kept.unpersist()


def on_batches(df: DataFrame, outputs: Sequence[tuple[Condition | str | None, Writer]], checkpoint: str, available_now: bool = True, every: str | None = None) -> StreamingQuery:
    """A stream into the same outputs; a batch that fails is written again, so writers should be idempotent."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: routed(batch, outputs))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every or "0 seconds")).start()


def dead_letters(df: DataFrame, tags: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without and with any of the failure tags."""
    bad = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags)))
    return df.where(~bad), df.where(bad)


def statement(connect: Callable[[], object], text: str, parameters: Sequence[str], batch: int = 500) -> Writer:
    """A statement with ? for each of the parameters (fields, as text), run for every row over a DB-API connection
    that each task opens and commits once per batch. A task that runs again repeats its rows, so an upsert is best."""

    def write(df: DataFrame) -> None:
        known = {f.name: f.dataType for f in df.schema.fields}
        cells = [as_text(F.col(f"`{p}`"), known[p]) if p in known else F.lit(None).cast("string") for p in parameters]

        def put(rows: Iterable) -> None:
            connection = connect()
            try:
                cursor, held = connection.cursor(), []
                for row in rows:
                    held.append(tuple(row["values"]))
                    if len(held) >= batch:
                        cursor.executemany(text, held)
                        connection.commit()
                        held = []
                if held:
                    cursor.executemany(text, held)
                    connection.commit()
            finally:
                connection.close()

        df.select(F.array(*cells).alias("values")).foreachPartition(put)

    return write


def log_intake_entry(df: DataFrame, source: str, service: str = "", tags: str = "") -> Column:
    """A row as JSON for an intake of logs: its fields, and message, ddsource, hostname (of host), the event time, and if
    given service and ddtags, which go before fields of the same name."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit("")

    own = {"message": text("message"), "ddsource": F.lit(source), "hostname": text("host")}
    if "@timestamp" in df.columns:
        own["timestamp"] = F.date_format("@timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    own |= {k: F.lit(v) for k, v in (("service", service), ("ddtags", tags)) if v}
    rest = [F.col(f"`{c}`").alias(c) for c in df.columns if c not in (*own, "host", "@timestamp", "@version", "@metadata")]
    return F.to_json(F.struct(*(v.alias(k) for k, v in own.items()), *rest))


def log_intake(url: str, key: str, source: str, service_name: str = "", tags: str = "", batch: int = 500, session: Callable[[], Send] | None = None) -> Writer:
    """Arrays of such entries, posted with the key as a header."""
    opened = session or http_session(url, joiner=",", headers={"Content-Type": "application/json", "DD-API-KEY": key})

    def arrays() -> Send:
        send = opened()
        return lambda texts: send(["[" + ",".join(texts) + "]"])

    return service(arrays, lambda df: log_intake_entry(df, source, service_name, tags), batch)


def command(arguments: Sequence[str], form: str | None = None) -> Writer:
    """A line a row (event JSON, or a template) to the standard input of a command that each task starts; a command
    that fails fails the task."""

    def open_session() -> Send:
        def send(texts: list[str]) -> None:
            subprocess.run(list(arguments), input="".join(t + "\n" for t in texts).encode(), check=True, stdout=subprocess.DEVNULL)

        return send

    return service(open_session, lambda df: template(df, form) if form else encode_json(df), batch=100_000)
