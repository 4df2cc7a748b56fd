"""Sources behind a protocol: HTTP, UDP, TCP, Unix sockets, commands, queues, metrics, search.

All are one Python DataSource whose rows come from a poll: a function from a cursor to new rows and the
next cursor. The cursor is the stream's offset, so a batch that failed is polled again from where it began;
what a receiver cannot send twice is kept by the caller (the poll's own buffer) until the next cursor.
"""

from __future__ import annotations

import gzip
import json
import socket
import subprocess
import urllib.request
import zlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Poll = Callable[[str], tuple[list[tuple], str]]


class _Range(InputPartition):
    def __init__(self, value: str) -> None:
        super().__init__(value)


def polled(spark: SparkSession, name: str, poll: Poll, schema: str, parts: Sequence[str] = ("",), stream: bool = False) -> DataFrame:
    """Registers a source of this name and reads it: each of parts (slices, shards, urls) is one task of a
    static read, polled until its cursor no longer moves; a stream polls on the driver, one cursor in all."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Range(p) for p in parts]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            cursor = partition.value
            while True:
                rows, after = poll(cursor)
                yield from rows
                if after == cursor or not rows:
                    return
                cursor = after

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"cursor": parts[0]}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, after = poll(start["cursor"])
            return iter(rows), {"cursor": after}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(poll(start["cursor"])[0])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Stream()

    spark.dataSource.register(Source)
    return (spark.readStream if stream else spark.read).format(name).load()


def http_get(url: str, headers: dict[str, str] | None = None, timeout: float = 30, limit: int = 64 << 20) -> str:
    request = urllib.request.Request(url, headers=headers or {})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        body = answer.read(limit + 1)
    if len(body) > limit:
        raise ValueError(f"more than {limit} bytes")
    return body.decode("utf-8", "replace")


def http_poller(spark: SparkSession, urls: dict[str, str], stream: bool = False, get: Callable[[str], str] = http_get) -> DataFrame:
    """message (the body) and http_poller_name, one task a url."""

    def poll(cursor: str) -> tuple[list[tuple], str]:
        names = [cursor] if cursor in urls else list(urls)
        return [(get(urls[n]), n) for n in names], cursor

    return polled(spark, "http_poller", poll, "message string, http_poller_name string", list(urls) if not stream else [""], stream)


def body_events(body: str) -> list[str]:
    """A posted body: each element of a JSON array, any other JSON document, or each line that is not empty."""
    try:
        value = json.loads(body)
    except ValueError:
        return [x for x in body.splitlines() if x]
    return [json.dumps(x) for x in value] if isinstance(value, list) else [json.dumps(value)]


def inflate(data: bytes) -> bytes:
    """gzip and zlib payloads by their first bytes; others as they are."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:1] == b"\x78":
        return zlib.decompress(data)
    return data


def command(spark: SparkSession, line: str, timeout: float = 60) -> DataFrame:
    """The output of a shell command, a row a line. Runs with the rights of the executors: opt in."""

    def poll(cursor: str) -> tuple[list[tuple], str]:
        if cursor == "done":
            return [], cursor
        found = subprocess.run(["sh", "-c", line], capture_output=True, timeout=timeout, text=True)
        return [(x, line, found.returncode) for x in found.stdout.splitlines()], "done"

    return polled(spark, "command", poll, "message string, command string, exit_status int")


def datagrams(spark: SparkSession, port: int, host: str = "0.0.0.0", wait: float = 1.0, most: int = 10_000) -> DataFrame:
    """UDP datagrams as a stream, received on the driver: message, host and port of the sender."""
    held: dict[str, object] = {}

    def poll(cursor: str) -> tuple[list[tuple], str]:
        sock = held.get("socket")
        if sock is None:
            sock = held["socket"] = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            sock.bind((host, port))
            sock.settimeout(wait)
        if held.get("cursor") == cursor:  # asked again: the same rows
            return held["rows"], str(int(cursor or 0) + 1)
        rows: list[tuple] = []
        try:
            while len(rows) < most:
                data, (sender, sender_port) = sock.recvfrom(65_535)
                rows.append((inflate(data).decode("utf-8", "replace"), sender, sender_port))
        except TimeoutError:
            pass
        held.update(cursor=cursor, rows=rows)
        return rows, str(int(cursor or 0) + 1)

    return polled(spark, f"udp_{port}", poll, "message string, host string, port int", stream=True)


def queue(spark: SparkSession, name: str, receive: Poll, stream: bool = True) -> DataFrame:
    """Redis, RabbitMQ, SQS, Beats and other queues: receive is the client's poll; rows are (message, key)."""
    return polled(spark, name, receive, "message string, key string", stream=stream)


def search(spark: SparkSession, name: str, page: Callable[[str, str], tuple[list[str], str]], slices: int = 1) -> DataFrame:
    """Documents of a search cluster, page by page: page(slice, cursor) gives JSON documents and the next
    cursor (search_after); each slice is one task."""

    def poll(cursor: str) -> tuple[list[tuple], str]:
        which, _, after = cursor.partition(":")
        docs, nxt = page(which, after)
        return [(d,) for d in docs], f"{which}:{nxt}"

    return polled(spark, name, poll, "document string", [f"{k}:" for k in range(slices)])


def metrics(spark: SparkSession, name: str, statistics: Callable[[str], list[tuple]], names: Sequence[str]) -> DataFrame:
    """Statistics of a monitoring service, one task per metric: metric, namespace, statistic, value, unit."""

    def poll(cursor: str) -> tuple[list[tuple], str]:
        return statistics(cursor), cursor

    return polled(spark, name, poll, "metric string, namespace string, statistic string, value double, unit string", names)
