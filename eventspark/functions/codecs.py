"""Text codecs as columns: plain, line, json, csv, cef, cloudfront, cloudtrail, es_bulk, graphite, nmap,
rubydebug, dots, bytes.

A decoder takes a DataFrame and the name of a text column and adds columns (or multiplies rows); rows that
cannot be read are tagged _codecfailure. An encoder gives a text column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import add_tags, as_text, event_json, template

FAILED = "_codecfailure"

#: Extension keys of CEF and their long names.
CEF_NAMES = {
    "act": "deviceAction", "app": "applicationProtocol", "c6a1": "deviceCustomIPv6Address1", "c6a1Label": "deviceCustomIPv6Address1Label",
    "cfp1": "deviceCustomFloatingPoint1", "cfp1Label": "deviceCustomFloatingPoint1Label", "cn1": "deviceCustomNumber1", "cn1Label": "deviceCustomNumber1Label",
    "cn2": "deviceCustomNumber2", "cn2Label": "deviceCustomNumber2Label", "cn3": "deviceCustomNumber3", "cn3Label": "deviceCustomNumber3Label",
    "cnt": "baseEventCount", "cs1": "deviceCustomString1", "cs1Label": "deviceCustomString1Label", "cs2": "deviceCustomString2",
    "cs2Label": "deviceCustomString2Label", "cs3": "deviceCustomString3", "cs3Label": "deviceCustomString3Label", "cs4": "deviceCustomString4",
    "cs4Label": "deviceCustomString4Label", "cs5": "deviceCustomString5", "cs5Label": "deviceCustomString5Label", "cs6": "deviceCustomString6",
    "cs6Label": "deviceCustomString6Label", "dhost": "destinationHostName", "dmac": "destinationMacAddress", "dntdom": "destinationNtDomain",
    "dpid": "destinationProcessId", "dpriv": "destinationUserPrivileges", "dproc": "destinationProcessName", "dpt": "destinationPort",
    "dst": "destinationAddress", "duid": "destinationUserId", "duser": "destinationUserName", "dvc": "deviceAddress",
    "dvchost": "deviceHostName", "dvcpid": "deviceProcessId", "end": "endTime", "fname": "fileName", "fsize": "fileSize",
    "in": "bytesIn", "msg": "message", "out": "bytesOut", "outcome": "eventOutcome", "proto": "transportProtocol",
    "request": "requestUrl", "rt": "deviceReceiptTime", "shost": "sourceHostName", "smac": "sourceMacAddress", "sntdom": "sourceNtDomain",
    "spid": "sourceProcessId", "spriv": "sourceUserPrivileges", "sproc": "sourceProcessName", "spt": "sourcePort", "src": "sourceAddress",
    "start": "startTime", "suid": "sourceUserId", "suser": "sourceUserName", "type": "categoryDeviceType",
}
CEF_HEADER = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity"]

#: The fields of a CloudFront access log, and the ones that are numbers.
CLOUDFRONT_FIELDS = [
    "date", "time", "x-edge-location", "sc-bytes", "c-ip", "cs-method", "cs-host", "cs-uri-stem", "sc-status", "cs-referer", "cs-user-agent",
    "cs-uri-query", "cs-cookie", "x-edge-result-type", "x-edge-request-id", "x-host-header", "cs-protocol", "cs-bytes", "time-taken",
    "x-forwarded-for", "ssl-protocol", "ssl-cipher", "x-edge-response-result-type", "cs-protocol-version", "fle-status", "fle-encrypted-fields",
    "c-port", "time-to-first-byte", "x-edge-detailed-result-type", "sc-content-type", "sc-content-len", "sc-range-start", "sc-range-end",
]
CLOUDFRONT_LONG = ["sc-bytes", "cs-bytes", "sc-status", "c-port", "sc-content-len", "sc-range-start", "sc-range-end"]
CLOUDFRONT_DOUBLE = ["time-taken", "time-to-first-byte"]

_TRIM = r"(?U)^\s+|\s+$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def decode_plain(df: DataFrame, source: str) -> DataFrame:
    """The text without its line end, as message."""
    return df.withColumn("message", F.regexp_replace(F.col(source).cast("string"), r"\r?\n\z", ""))


def decode_json(df: DataFrame, source: str, schema: str, target: str | None = None) -> DataFrame:
    from ..operators.parse import json

    return json(source, schema, target, tag=FAILED)(df)


def decode_csv(df: DataFrame, source: str, columns: Sequence[str], separator: str = ",", quote: str = '"') -> DataFrame:
    """One row per record of the text."""
    from ..operators.parse import csv

    lines = df.withColumn(source, F.explode(F.filter(F.split(F.col(source), r"\r?\n"), lambda x: x != "")))
    return csv(source, columns, separator, quote)(lines)


def decode_cef(df: DataFrame, source: str, extensions: Sequence[str] = ()) -> DataFrame:
    """The seven header fields, the syslog header, the extensions as a map, and the named ones as columns."""
    text = _trimmed(F.col(source))
    head = r"(?s)\A(.*?)CEF:" + r"((?:[^|\\]|\\.)*)\|" * 7 + r"(.*)\z"
    out = df.withColumns({"__t": text, "__ok": F.coalesce(text.rlike(head), F.lit(False))})
    plain = lambda c: F.replace(F.replace(c, F.lit("\\|"), F.lit("|")), F.lit("\\\\"), F.lit("\\"))
    ok = F.col("__ok")
    out = out.withColumns({name: F.when(ok, plain(F.regexp_extract("__t", head, k))) for k, name in enumerate(CEF_HEADER, 2)})
    out = out.withColumn("syslog_header", F.when(ok, F.nullif(_trimmed(F.regexp_extract("__t", head, 1)), F.lit(""))))
    # a key is the last word before an equals sign, its value all up to the next key
    ext = F.when(ok, F.regexp_extract("__t", head, 9)).otherwise("")
    keys = F.regexp_extract_all(ext, F.lit(r"(?:^| )([^ =]*)="), F.lit(1))
    values = F.slice(F.split(ext, r"(?:^| )[^ =]*=", -1), 2, 10_000)
    names = F.create_map(*(F.lit(x) for kv in CEF_NAMES.items() for x in kv))
    out = out.withColumns({"__k": keys, "__v": values})
    pairs = F.transform(F.arrays_zip(F.col("__k"), F.col("__v")), lambda p: F.struct(F.coalesce(F.element_at(names, p["__k"]), p["__k"]).alias("key"), _trimmed(p["__v"]).alias("value")))
    out = out.withColumn("__p", F.filter(pairs, lambda p: p["key"] != ""))
    last = lambda k: F.element_at(F.filter("__p", lambda p: p["key"] == k), -1)["value"]
    distinct = F.array_distinct(F.transform("__p", lambda p: p["key"]))
    out = out.withColumn("extensions", F.map_from_entries(F.transform(distinct, lambda k: F.struct(k, last(k)))))
    out = out.withColumns({e: F.when(F.array_contains(F.map_keys("extensions"), e), F.element_at("extensions", F.lit(e))) for e in extensions})
    out = out.withColumn("message", F.col("__t"))
    return add_tags(out, FAILED, when=~ok).drop("__t", "__ok", "__k", "__v", "__p")


def decode_cloudfront(df: DataFrame, source: str, fields: Sequence[str] = tuple(CLOUDFRONT_FIELDS)) -> DataFrame:
    """Tab-separated values, a dash being absent; header and comment lines are tagged instead."""
    line = F.col(source)
    parts = F.split(line, "\t")
    header, comment = line.startswith("#Fields:") | line.startswith("#Version:"), line.startswith("#")
    out = df.withColumns({"__p": parts, "__c": comment})
    for k, name in enumerate(fields):
        value = F.nullif(F.get("__p", F.lit(k)), F.lit("-"))
        kind = "long" if name in CLOUDFRONT_LONG else "double" if name in CLOUDFRONT_DOUBLE else "string"
        out = out.withColumn(name, F.when(~F.col("__c"), value.try_cast(kind)))
    when = F.try_to_timestamp(F.concat_ws(" ", F.col("date"), F.col("time")), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = out.withColumn("@timestamp", when)
    out = add_tags(out, "_cloudfront_header", when=header)
    return add_tags(out, "_cloudfront_comment", when=comment & ~header).drop("__p", "__c")


def decode_cloudtrail(df: DataFrame, source: str, schema: str) -> DataFrame:
    """One row per record, with the number of records of its document; schema: DDL of a record."""
    whole = F.from_json(F.col(source), f"Records array<struct<{_struct(schema)}>>")
    out = df.withColumn("__w", whole).withColumn("cloudtrail_record_count", F.size("__w.Records").cast("long"))
    out = out.withColumn("__r", F.explode_outer("__w.Records"))
    names = T.StructType.fromDDL(schema).fieldNames()
    out = out.withColumns({n: F.col("__r")[n] for n in names})
    if "eventTime" in names:
        out = out.withColumn("@timestamp", F.col("eventTime").try_cast("timestamp"))
    return add_tags(out, "cloudtrail", when=F.col("__r").isNotNull()).drop("__w", "__r")


def _struct(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def decode_es_bulk(df: DataFrame, source: str, schema: str) -> DataFrame:
    """One row per action: _action, _index, _id, routing, and the document's fields."""
    lines = F.filter(F.split(_trimmed(F.col(source)), r"\r?\n"), lambda x: F.trim(x) != "")
    out = df.withColumn("__l", lines)
    # a delete has no document line, so lines are walked with what comes next
    action = r'\A\s*\{\s*"(index|create|update|delete)"\s*:'
    start = F.expr("named_struct('want', false, 'out', cast(array() as array<struct<a:string,d:string>>))")

    def step(acc: Column, x: Column) -> Column:
        opened = F.struct(~x.rlike(r'\A\s*\{\s*"delete"').alias("want"), F.concat(acc["out"], F.array(F.struct(x.alias("a"), F.lit(None).cast("string").alias("d")))).alias("out"))
        n = F.size(acc["out"])
        closed = F.struct(F.lit(False).alias("want"), F.concat(F.slice(acc["out"], F.lit(1), n - 1), F.array(F.struct(F.element_at(acc["out"], -1)["a"].alias("a"), x.alias("d")))).alias("out"))
        kind = "struct<want:boolean,out:array<struct<a:string,d:string>>>"
        return F.when(acc["want"], closed.cast(kind)).when(x.rlike(action), opened.cast(kind)).otherwise(acc.cast(kind))

    out = out.withColumn("__e", F.explode(F.aggregate("__l", start, step, lambda acc: acc["out"])))
    kind = F.regexp_extract("__e.a", action, 1)
    meta = F.from_json(F.col("__e.a"), "map<string,struct<_index:string,_id:string,routing:string>>")
    out = out.withColumns({"_action": kind, "__m": meta})
    out = out.withColumns({n: F.element_at("__m", F.col("_action"))[n] for n in ("_index", "_id", "routing")})
    doc = F.from_json(F.col("__e.d"), schema)
    return out.withColumns({n: doc[n] for n in T.StructType.fromDDL(schema).fieldNames()}).drop("__l", "__e", "__m")


def encode_es_bulk(df: DataFrame, index: str, action: str = "index", doc_id: str | None = None, routing: str | None = None) -> Column:
    """The action line and, but for deletes, the document line of each row; index and ids are templates."""
    parts = [template(df, index).alias("_index")]
    if doc_id:
        parts.append(template(df, doc_id).alias("_id"))
    if routing:
        parts.append(template(df, routing).alias("routing"))
    head = F.to_json(F.struct(F.struct(*parts).alias(action)))
    if action == "delete":
        return F.concat(head, F.lit("\n"))
    body = F.concat(F.lit('{"doc":'), event_json(df), F.lit("}")) if action == "update" else event_json(df)
    return F.concat(head, F.lit("\n"), body, F.lit("\n"))


def decode_graphite(df: DataFrame, source: str) -> DataFrame:
    """`metric value [epoch]`: metric, value, timestamp_epoch, metric_path; comments and others are tagged."""
    text = _trimmed(F.col(source))
    parts = F.split(text, " ", 3)
    number = F.get(parts, F.lit(1)).try_cast("double")
    ok = F.coalesce(~text.startswith("#") & number.isNotNull(), F.lit(False))
    out = df.withColumns({"__t": text, "__p": parts, "__ok": ok})
    ok = F.col("__ok")
    out = out.withColumns(
        {
            "metric": F.when(ok, F.get("__p", F.lit(0))),
            "value": F.when(ok, F.get("__p", F.lit(1)).try_cast("double")),
            "timestamp_epoch": F.when(ok & F.get("__p", F.lit(2)).rlike(r"\A-?[0-9]+\z"), F.get("__p", F.lit(2)).try_cast("long")),
            "message": F.col("__t"),
        }
    )
    path = F.split("metric", r"\.")
    out = out.withColumn("metric_path", F.when(F.size(path) > 1, path)).withColumn("@timestamp", F.timestamp_seconds("timestamp_epoch"))
    return add_tags(out, FAILED, when=~ok).drop("__t", "__p", "__ok")


def encode_graphite(df: DataFrame, metric: str = "metric", value: str = "value", prefix: str | None = None, time: str | None = "@timestamp") -> Column:
    name = F.concat_ws(".", F.lit(prefix), F.col(metric)) if prefix else F.col(metric)
    parts = [name, as_text(F.col(value).cast("double"), T.DoubleType())]
    if time:
        parts.append(F.unix_seconds(F.col(f"`{time}`").cast("timestamp")).cast("string"))
    return F.concat(F.concat_ws(" ", *parts), F.lit("\n"))


def decode_nmap(df: DataFrame, source: str) -> DataFrame:
    """One row per host of a scan: ip, hostname, status, ports (port, protocol, state, service)."""
    port = "array<struct<_portid:long,_protocol:string,state:struct<_state:string,_VALUE:string>,service:struct<_name:string,_VALUE:string>>>"
    host = f"array<struct<status:struct<_state:string,_VALUE:string>,address:array<struct<_addr:string,_addrtype:string,_VALUE:string>>,hostnames:struct<hostname:array<struct<_name:string,_VALUE:string>>>,ports:struct<port:{port}>>>"
    out = df.withColumn("__x", F.from_xml(F.col(source), f"_scanner string, _args string, _version string, host {host}"))
    out = out.withColumns({"scanner": F.col("__x._scanner"), "args": F.col("__x._args"), "version": F.col("__x._version"), "__h": F.explode_outer("__x.host")})
    ports = F.transform("__h.ports.port", lambda p: F.struct(p["_portid"].alias("port"), p["_protocol"].alias("protocol"), p["state"]["_state"].alias("state"), p["service"]["_name"].alias("service")))
    out = out.withColumns({"ip": F.get("__h.address", F.lit(0))["_addr"], "hostname": F.get("__h.hostnames.hostname", F.lit(0))["_name"], "status": F.col("__h.status._state"), "ports": ports})
    return out.drop("__x", "__h")


def encode_plain(df: DataFrame, form: str | None = None) -> Column:
    """The message, or a template, and a line feed."""
    return F.concat(template(df, form or "%{message}"), F.lit("\n"))


def encode_json(df: DataFrame, lines: bool = False) -> Column:
    return F.concat(event_json(df), F.lit("\n")) if lines else event_json(df)


def encode_rubydebug(df: DataFrame) -> Column:
    """A readable form, one field a line, in order of the names."""
    lines = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name == "@metadata":
            continue
        text = as_text(F.col(f"`{f.name}`"), f.dataType)
        shown = F.concat(F.lit('"'), text, F.lit('"')) if isinstance(f.dataType, T.StringType) else text
        lines.append(F.concat(F.lit(f'  "{f.name}" => '), F.coalesce(shown, F.lit("nil"))))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n"))


def encode_dots(df: DataFrame) -> Column:
    return F.lit(".")


def encode_csv(df: DataFrame, fields: Sequence[str], separator: str = ",", quote: str = '"') -> Column:
    """The fields in order; absent ones are empty, quotes double inside quotes."""

    def cell(name: str) -> Column:
        kind = df.schema[name].dataType if name in df.columns else None
        text = F.coalesce(as_text(F.col(f"`{name}`"), kind), F.lit("")) if kind is not None else F.lit("")
        needs = text.contains(separator) | text.contains(quote) | text.rlike(r"[\r\n]")
        return F.when(needs, F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(text)

    return F.concat_ws(separator, *map(cell, fields))


