"""Binary codecs: msgpack, fluent, netflow, collectd, protobuf, avro, edn.

Each reads bytes batch by batch (Arrow) with a small reader and gives its fields as JSON text, one element
per event, so that the result can be read with a schema or kept as a VARIANT. Netflow 5, whose records
have a fixed layout, is read with built-in expressions.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import FAILED
from .fields import add_tags


class Truncated(ValueError):
    pass


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Truncated(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int | float:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    @property
    def left(self) -> int:
        return len(self.data) - self.at


# ---------------------------------------------------------------------------------------------------
# msgpack and fluent

_MSG_SCALARS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_MSG_SIZED = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I"), 0xC7: ("ext", ">B"), 0xC8: ("ext", ">H"), 0xC9: ("ext", ">I")}
_DEEP = 64


def read_msgpack(source: _Bytes, depth: int = 0):
    if depth > _DEEP:
        raise ValueError("too deep")
    head = source.number(">B")
    if head < 0x80:
        return head
    if head >= 0xE0:
        return head - 256
    if head in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[head]
    if head in _MSG_SCALARS:
        return source.number(_MSG_SCALARS[head])
    if head < 0xC0:
        kind, size = ("map", head & 15) if head < 0x90 else ("list", head & 15) if head < 0xA0 else ("str", head & 31)
    elif head in _MSG_SIZED:
        kind, form = _MSG_SIZED[head]
        size = source.number(form)
    elif 0xD4 <= head <= 0xD8:
        kind, size = "ext", 1 << (head - 0xD4)
    else:
        raise ValueError(f"no type {head:#x}")
    if kind == "str":
        return source.take(size).decode("utf-8", "replace")
    if kind == "bin":
        return source.take(size).hex()
    if kind == "ext":
        code = source.number(">b")
        body = source.take(size)
        return struct.unpack(">II", body)[0] + struct.unpack(">II", body)[1] / 1e9 if (code, size) == (0, 8) else body.hex()
    if size > source.left:
        raise Truncated("more elements than bytes")
    if kind == "list":
        return [read_msgpack(source, depth + 1) for _ in range(size)]
    return {str(read_msgpack(source, depth + 1)): read_msgpack(source, depth + 1) for _ in range(size)}


def msgpack_events(data: bytes) -> list[dict]:
    value = read_msgpack(_Bytes(data))
    return [value if isinstance(value, dict) else {"message": value}]


def fluent_events(data: bytes) -> list[dict]:
    """[tag, time, record] or [tag, [[time, record], ...]]"""
    value = read_msgpack(_Bytes(data))
    if not isinstance(value, list) or len(value) < 2:
        raise ValueError("no fluent message")
    entries = value[1] if isinstance(value[1], list) else [value[1:3]]
    return [{**(e[1] if isinstance(e[1], dict) else {}), "fluent_tag": value[0], "fluent_time": e[0]} for e in entries]


# ---------------------------------------------------------------------------------------------------
# protobuf without a schema, avro headers, collectd, edn

def _varint(source: _Bytes) -> int:
    out = shift = 0
    while True:
        b = source.number(">B")
        out |= (b & 127) << shift
        if b < 128:
            return out
        shift += 7
        if shift > 63:
            raise ValueError("number too long")


def protobuf_fields(data: bytes, depth: int = 0) -> dict:
    """field_N by number; nested messages where the bytes read as one, text where they are text, else hex."""
    source, out = _Bytes(data), {}
    while source.left:
        key = _varint(source)
        number, wire = key >> 3, key & 7
        if not number:
            raise ValueError("no field 0")
        if wire == 0:
            value = _varint(source)
            value = value - (1 << 64) if value >> 63 else value
        elif wire == 1:
            value = source.number("<d")
            value = int(value) if value == int(value) and abs(value) < 2**53 else value
        elif wire == 5:
            value = source.number("<f")
        elif wire == 2:
            body = source.take(_varint(source))
            value = _protobuf_bytes(body, depth)
        else:
            raise ValueError(f"no wire type {wire}")
        out[f"field_{number}"] = value
    return out


def _protobuf_bytes(body: bytes, depth: int):
    try:
        text = body.decode()
        if text.isprintable() or text.strip().isprintable():
            return text
    except UnicodeDecodeError:
        pass
    if depth < _DEEP:
        try:
            return protobuf_fields(body, depth + 1)
        except (ValueError, OverflowError):
            pass
    return body.hex()


def protobuf_events(data: bytes) -> list[dict]:
    return [protobuf_fields(data)]


def avro_events(data: bytes) -> list[dict]:
    """The header of an object container (schema, codec, first block's count and size), or JSON."""
    if not data.startswith(b"Obj\x01"):
        value = json.loads(data)
        return [value if isinstance(value, dict) else {"message": value}]
    source = _Bytes(data)
    source.take(4)

    def long() -> int:
        raw = _varint(source)
        return (raw >> 1) ^ -(raw & 1)

    meta = {}
    while n := long():
        if n < 0:
            long()
        for _ in range(abs(n)):
            key = source.take(long()).decode()
            meta[key] = source.take(long()).decode("utf-8", "replace")
    source.take(16)
    out = {"avro_schema": meta.get("avro.schema"), "avro_codec": meta.get("avro.codec", "null")}
    if source.left:
        out |= {"avro_block_count": long(), "avro_block_size": long()}
    return [out]


#: Part types of the collectd protocol.
_COLLECTD_TEXT = {0: "host", 2: "plugin", 3: "plugin_instance", 4: "type", 5: "type_instance"}
_COLLECTD_TIME = {1: "time", 7: "interval", 8: "time_hr", 9: "interval_hr"}


def collectd_events(data: bytes) -> list[dict]:
    """One event a packet; parts that repeat overwrite."""
    if data[:1] in (b"[", b"{"):
        value = json.loads(data)
        return [{**x, "collectd_type": "json"} for x in (value if isinstance(value, list) else [value])]
    source, out = _Bytes(data), {"collectd_type": "binary"}
    while source.left >= 4:
        kind, size = source.number(">H"), source.number(">H")
        body = source.take(size - 4)
        if kind in _COLLECTD_TEXT:
            out[_COLLECTD_TEXT[kind]] = body.rstrip(b"\0").decode("utf-8", "replace")
        elif kind in _COLLECTD_TIME:
            out[_COLLECTD_TIME[kind]] = int.from_bytes(body, "big")
        elif kind == 6:
            n = int.from_bytes(body[:2], "big")
            forms = {0: ">Q", 1: "<d", 2: ">q", 3: ">Q"}
            values = [struct.unpack(forms.get(body[2 + k], ">Q"), body[2 + n + 8 * k : 10 + n + 8 * k])[0] for k in range(n)]
            out["value" if n == 1 else "values"] = values[0] if n == 1 else values
    return [out]


def edn_events(data: bytes) -> list[dict]:
    """A map to fields; keywords lose their colon, sets become lists, tagged values keep their value."""
    import re

    tokens = re.findall(r';[^\n]*|#_|#\{|[()\[\]{}]|"(?:[^"\\]|\\.)*"|\\\S+|[^\s,()\[\]{}";]+', data.decode("utf-8", "replace"))
    tokens = [t for t in tokens if not t.startswith(";")]
    at = 0

    def value(depth: int = 0):
        nonlocal at
        if depth > _DEEP or at >= len(tokens):
            raise ValueError("edn ends too early or is too deep")
        t = tokens[at]
        at += 1
        if t in "([" or t in ("{", "#{"):
            close, items = {"(": ")", "[": "]", "{": "}", "#{": "}"}[t], []
            while at < len(tokens) and tokens[at] != close:
                items.append(value(depth + 1))
            if at >= len(tokens):
                raise ValueError("edn ends too early")
            at += 1
            if t == "{":
                return {str(k): v for k, v in zip(items[::2], items[1::2], strict=True)}
            return items
        if t == "#_":
            value(depth + 1)
            return value(depth + 1)
        if t[0] == "#":
            return value(depth + 1)
        if t[0] == '"':
            return json.loads(t)
        if t in ("nil", "true", "false"):
            return {"nil": None, "true": True, "false": False}[t]
        if t[0] == ":":
            return t[1:]
        if re.fullmatch(r"[+-]?\d+[NM]?", t):
            return int(t.rstrip("NM"))
        if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?", t):
            return float(t.rstrip("M"))
        return t.removeprefix("\\")

    found = value()
    return [found if isinstance(found, dict) else {"message": found}]


# ---------------------------------------------------------------------------------------------------
# netflow 9 and ipfix: templates are known per exporter, in order of arrival

#: Names of information elements.
FLOW_FIELDS = {1: "in_bytes", 2: "in_pkts", 4: "protocol", 5: "src_tos", 6: "tcp_flags", 7: "l4_src_port", 8: "ipv4_src_addr", 10: "input_snmp", 11: "l4_dst_port", 12: "ipv4_dst_addr", 14: "output_snmp", 15: "ipv4_next_hop", 16: "src_as", 17: "dst_as", 21: "last_switched", 22: "first_switched", 27: "ipv6_src_addr", 28: "ipv6_dst_addr"}


def _flow_value(number: int, raw: bytes):
    import ipaddress

    name = FLOW_FIELDS.get(number, f"field_{number}")
    return name, str(ipaddress.ip_address(raw)) if name.endswith(("_addr", "_hop")) and len(raw) in (4, 16) else int.from_bytes(raw, "big")


def flow_packet(data: bytes, templates: dict) -> dict:
    """One event per packet: header fields, and the fields of its data records (later ones overwrite)."""
    source = _Bytes(data)
    version = source.number(">H")
    if version not in (9, 10):
        raise ValueError(f"no flow version {version}")
    count = source.number(">H")
    names = ["sys_uptime_ms", "unix_secs", "flow_sequence", "source_id"] if version == 9 else ["export_time", "flow_sequence", "observation_domain_id"]
    out = {"netflow_version": version, "flow_count": count} | {n: source.number(">I") for n in names}
    domain = out[names[-1]]
    while source.left >= 4:
        set_id, size = source.number(">H"), source.number(">H")
        body = _Bytes(source.take(size - 4))
        if set_id == (0 if version == 9 else 2):
            while body.left >= 4:
                template, fields = body.number(">H"), body.number(">H")
                layout = []
                for _ in range(fields):
                    kind, width = body.number(">H"), body.number(">H")
                    if version == 10 and kind & 0x8000:
                        body.take(4)
                        kind &= 0x7FFF
                    layout.append((kind, width))
                templates[domain, template] = layout
        elif set_id >= 256 and (layout := templates.get((domain, set_id))):
            width = sum(w for _, w in layout)
            while width and body.left >= width:
                out |= dict(_flow_value(kind, body.take(w)) for kind, w in layout)
    return out


DECODERS: dict[str, Callable[[bytes], list[dict]]] = {"msgpack": msgpack_events, "fluent": fluent_events, "protobuf": protobuf_events, "avro": avro_events, "collectd": collectd_events, "edn": edn_events}


def events_json(data: Column, codec: str) -> Column:
    """An array of JSON texts, one per event; null where the bytes cannot be read."""
    read = DECODERS[codec]

    @F.pandas_udf("array<string>")
    def apply(values: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return [json.dumps(e, default=str) for e in read(bytes(b))]
            except (ValueError, struct.error, IndexError, TypeError, OverflowError):
                return None

        return values.map(one)

    return apply(data)


def decode_binary(df: DataFrame, source: str, codec: str, schema: str | None = None) -> DataFrame:
    """One row per event; its fields by a schema (DDL), or as the VARIANT column `event`."""
    out = df.withColumn("__e", events_json(F.col(source), codec))
    bad = F.col("__e").isNull()
    out = add_tags(out, FAILED, when=bad).withColumn("__j", F.explode_outer("__e"))
    if schema is None:
        return out.withColumn("event", F.try_parse_json("__j")).drop("__e", "__j")
    got = F.from_json("__j", schema)
    from pyspark.sql import types as T

    return out.withColumns({n: got[n] for n in T.StructType.fromDDL(schema).fieldNames()}).drop("__e", "__j")


def _write_msgpack(value) -> bytes:
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        return struct.pack(">B", value) if 0 <= value < 128 else b"\xd3" + struct.pack(">q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return b"\xdb" + struct.pack(">I", len(raw)) + raw
    if isinstance(value, list):
        return b"\xdd" + struct.pack(">I", len(value)) + b"".join(map(_write_msgpack, value))
    return b"\xdf" + struct.pack(">I", len(value)) + b"".join(_write_msgpack(str(k)) + _write_msgpack(v) for k, v in value.items())


def encode_msgpack(json_text: Column) -> Column:
    """JSON text as msgpack bytes."""

    @F.pandas_udf("binary")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else _write_msgpack(json.loads(x)))

    return apply(json_text)


def decode_netflow_templates(df: DataFrame, source: str, exporter: str, order: str) -> DataFrame:
    """Netflow 9 and IPFIX: packets of an exporter are read in order, as data needs the templates before it."""
    ordered = df.select(exporter, order, source).repartition(exporter).sortWithinPartitions(exporter, order)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        now = None
        for pdf in batches:
            out = []
            for who, data in zip(pdf[exporter], pdf[source], strict=True):
                if who != now:
                    known, now = {}, who
                try:
                    out.append(json.dumps(flow_packet(bytes(data), known)))
                except (ValueError, struct.error):
                    out.append(None)
            yield pd.DataFrame({exporter: pdf[exporter], order: pdf[order], "event_json": out})

    return ordered.mapInPandas(run, f"`{exporter}` {kinds[exporter]}, `{order}` {kinds[order]}, event_json string").withColumn("event", F.try_parse_json("event_json"))


#: Name, first byte and width of what a version 5 record holds.
NETFLOW5 = [("input_snmp", 12, 2), ("output_snmp", 14, 2), ("in_pkts", 16, 4), ("in_bytes", 20, 4), ("l4_src_port", 32, 2), ("l4_dst_port", 34, 2), ("protocol", 38, 1), ("tcp_flags", 37, 1)]
NETFLOW5_HEADER = [("flow_count", 2, 2), ("sys_uptime_ms", 4, 4), ("unix_secs", 8, 4), ("unix_nsecs", 12, 4), ("flow_sequence", 16, 4), ("engine_type", 20, 1), ("engine_id", 21, 1)]
NETFLOW5_ADDRESSES = [("ipv4_src_addr", 0), ("ipv4_dst_addr", 4), ("ipv4_next_hop", 8)]


def decode_netflow5(df: DataFrame, source: str) -> DataFrame:
    """One row per record of 48 bytes behind the header of 24; built-in expressions only."""
    digits = F.hex(F.col(source))

    def number(at: Column | int, width: int) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        return F.conv(F.substring("__h", at * 2 + 1, F.lit(width * 2)), 16, 10).cast("long")

    out = df.withColumn("__h", digits).withColumn("__ok", (F.length("__h") >= 48) & (F.substring("__h", 1, 4) == "0005"))
    held = F.floor((F.length("__h") / 2 - 24) / 48).cast("int")
    n = F.least(held, number(2, 2).cast("int"))
    out = out.withColumn("__n", F.when(F.col("__ok") & (n > 0), n).otherwise(0))
    out = out.withColumn("__i", F.explode(F.when(F.col("__n") > 0, F.sequence(F.lit(0), F.col("__n") - 1)).otherwise(F.array(F.lit(-1)))))
    base = F.lit(24) + F.col("__i") * 48
    there = F.col("__i") >= 0
    out = out.withColumn("netflow_version", F.when(F.col("__ok"), F.lit(5).cast("long")))
    out = out.withColumns({name: F.when(F.col("__ok"), number(at, width)) for name, at, width in NETFLOW5_HEADER})
    out = out.withColumns({name: F.when(there, F.concat_ws(".", *(number(base + at + k, 1) for k in range(4)))) for name, at in NETFLOW5_ADDRESSES})
    out = out.withColumns({name: F.when(there, number(base + at, width)) for name, at, width in NETFLOW5})
    out = out.withColumn("@timestamp", F.timestamp_seconds("unix_secs"))
    return add_tags(out, FAILED, when=~F.col("__ok")).drop("__h", "__ok", "__n", "__i")
