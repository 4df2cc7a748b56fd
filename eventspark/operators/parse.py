"""Text to fields: grok, dissect, kv, json, csv, xml, date, useragent, syslog priority."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import add_tags, field, has, kind_of, text_of, with_field
from ..functions.grok import compile_pattern
from .mutate import _quoted

Operator = Callable[[DataFrame], DataFrame]


def grok(source: str, patterns: str | Sequence[str], overwrite: Sequence[str] = (), keep_empty: bool = False, definitions: Mapping[str, str] | None = None, tag: str = "_grokparsefailure") -> Operator:
    """The first pattern that is found in the text sets its captures; other rows are tagged.

    Captures that are empty stay absent unless keep_empty, and fields that a row has already are kept
    unless they are in overwrite.
    """
    compiled = [compile_pattern(p, dict(definitions or {})) for p in ([patterns] if isinstance(patterns, str) else patterns)]

    def run(df: DataFrame) -> DataFrame:
        out, hit = _captured(df, text_of(df, source), [(e, [g for _, _, g in captures]) for e, captures in compiled])
        values: dict[str, Column] = {}
        kinds: dict[str, str] = {}
        for k, (_, captures) in enumerate(compiled):
            for place, (name, kind, _) in enumerate(captures):
                got = F.col(f"__c{k}")[place]
                got = got if keep_empty else F.nullif(got, F.lit(""))
                values[name] = F.coalesce(values[name], got) if name in values else got
                kinds[name] = kind if kinds.get(name, kind) == kind else "string"
        for name, value in values.items():
            kind = {"int": "long", "float": "double"}.get(kinds[name], "string")
            value = value.try_cast(kind)
            if has(df, name):
                old = field(df, name)
                value = value.try_cast(kind_of(df, name))
                value = F.coalesce(value, old) if name in overwrite else F.coalesce(old, value)
            out = with_field(out, name, value)
        return add_tags(out, tag, when=~hit).drop("__src", *(f"__{x}{k}" for k in range(len(compiled)) for x in "rc"))

    return run


#: Marks between captures; a text that holds one is read group by group instead.
_HIT, _NEXT = "\ue0f0", "\ue0f1"


def _captured(df: DataFrame, text: Column, expressions: Sequence[tuple[str, Sequence[int]]]) -> tuple[DataFrame, Column]:
    """Adds __c0, __c1, ...: arrays of the groups of each expression, null if it is not found or an earlier
    one is; and whether any is found. A row is matched once: all groups come out of one replacement."""
    out, found = df.withColumn("__src", text), F.lit(False)
    odd = F.col("__src").contains(_HIT) | F.col("__src").contains(_NEXT)
    for k, (expression, groups) in enumerate(expressions):
        joined = _NEXT.join(f"${g}" for g in groups)
        replaced = F.regexp_replace("__src", rf"\A(?s:.*?)(?:{expression})(?s:.*)\z", _HIT + joined)
        # texts with a mark inside are only tested here
        replaced = F.when(odd, F.when(F.col("__src").rlike(expression), _HIT)).otherwise(replaced)
        out = out.withColumn(f"__r{k}", F.when(~found, replaced))
        here = F.coalesce(F.col(f"__r{k}").startswith(_HIT), F.lit(False))
        one_by_one = F.array(*(F.regexp_extract("__src", expression, g) for g in groups)) if groups else F.array().cast("array<string>")
        parts = F.when(odd, one_by_one).otherwise(F.split(F.substring(f"__r{k}", 2, 1 << 30), _NEXT, -1))
        out = out.withColumn(f"__c{k}", F.when(here, parts))
        found = found | here
    return out, found


def dissect(source: str, mapping: str, convert: Mapping[str, str] | None = None, tag: str = "_dissectfailure") -> Operator:
    """Literal text between `%{field}`s; all of the literals must be found in order, else the row is tagged.

    `%{?name}` and `%{}` are skipped; `%{name->}` (or a >) also takes repeated separators off; `+` and `&`
    are read and ignored, so the last value of a name wins.
    """
    parts = re.split(r"%\{([^}]*)\}", mapping)
    literals, keys = parts[::2], parts[1::2]
    expression = "(?s)\\A.*?" + _quoted(literals[0]) if literals[0] else "(?s)\\A"
    groups: dict[str, tuple[int, bool]] = {}
    for k, key in enumerate(keys):
        after = literals[k + 1]
        name = re.sub(r"^[+&?*]|(->|>|/\d+)$", "", key)
        last = k == len(keys) - 1 and not after
        # a field with no literal behind it takes all that is left
        expression += ("(.*)" if last or not after else "(.*?)") + (_quoted(after) if after else "")
        if key and not key.startswith("?"):
            groups[name] = (k + 1, key.endswith(">"))
    kinds = {"int": "long", "integer": "long", "float": "double", "string": "string"}

    def run(df: DataFrame) -> DataFrame:
        out, hit = _captured(df, text_of(df, source), [(expression, [g for g, _ in groups.values()])])
        for place, (name, (_, right)) in enumerate(groups.items()):
            got = F.col("__c0")[place]
            if right:
                got = F.rtrim(got)
            if convert and name in convert:
                got = got.try_cast(kinds[convert[name]])
            if has(df, name) and kind_of(df, name) == T.StringType():
                got = F.coalesce(got, field(df, name))
            out = with_field(out, name, got)
        return add_tags(out, tag, when=~hit).drop("__src", "__r0", "__c0")

    return run


def _unquoted(value: Column, trim: str) -> Column:
    out = F.trim(value, F.lit(trim)) if trim else value
    for q in ('"', "'"):
        out = F.when((F.length(out) >= 2) & out.startswith(q) & out.endswith(q), F.substring(out, F.lit(2), F.length(out) - 2)).otherwise(out)
    return out


def _pairs(text: Column, field_split: str, value_split: str, trim_key: str, trim_value: str) -> Column:
    """The pairs in text, as an array of key and value."""

    pieces = F.filter(F.split(text, _quoted(field_split), -1), lambda p: F.instr(p, value_split) > 1)
    pairs = F.transform(pieces, lambda p: F.struct((F.trim(F.substring_index(p, value_split, 1), F.lit(trim_key)) if trim_key else F.substring_index(p, value_split, 1)).alias("key"), _unquoted(F.substring(p, F.instr(p, value_split) + len(value_split), F.length(p)), trim_value).alias("value")))
    return pairs


def kv(source: str = "message", field_split: str = " ", value_split: str = "=", include_keys: Sequence[str] | None = None, exclude_keys: Sequence[str] = (), prefix: str = "", target: str | None = None, trim_key: str = "", trim_value: str = "", default_target: str = "kv") -> Operator:
    """key=value pairs. With include_keys each key is a column (in the struct `target` if given); without,
    keys are not known beforehand and all of them go into a map column `target` (or default_target)."""

    def run(df: DataFrame) -> DataFrame:
        pairs = _pairs(text_of(df, source), field_split, value_split, trim_key, trim_value)
        if include_keys is None:
            if exclude_keys:
                pairs = F.filter(pairs, lambda p: ~p["key"].isin(list(exclude_keys)))
            last = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda k: F.struct(F.concat(F.lit(prefix), k), F.element_at(F.filter("__pairs", lambda p: p["key"] == k), -1)["value"]))
            return df.withColumn("__pairs", pairs).withColumn(target or default_target, F.map_from_entries(last)).drop("__pairs")
        if trim_key:
            out = df.withColumn("__pairs", pairs)
        else:  # with known keys the pieces need not be taken apart first
            out = df.withColumn("__pairs", F.split(text_of(df, source), _quoted(field_split), -1))

        def of(key: str) -> Column:
            return F.filter("__pairs", lambda p: p["key"] == key if trim_key else p.startswith(key + value_split))

        def value_of(last: Column, key: str) -> Column:
            return last["value"] if trim_key else _unquoted(F.substring(last, F.lit(len(key + value_split) + 1), F.length(last)), trim_value)

        for key in include_keys:
            if key not in exclude_keys:
                value = value_of(F.try_element_at(of(key), F.lit(-1)), key)
                name = prefix + key
                if not target and has(df, name) and kind_of(df, name) == T.StringType():
                    value = F.coalesce(value, field(df, name))
                out = with_field(out, f"[{target}][{name}]" if target else f"[{name}]", value)
        return out.drop("__pairs")

    return run


def json(source: str = "message", schema: str | None = None, target: str | None = None, skip_on_invalid: bool = False, tag: str = "_jsonparsefailure") -> Operator:
    """A JSON object to fields. schema (DDL) names them and lets Catalyst prune; without one the document
    becomes a VARIANT in `target` (or "json"). Invalid or absent text is tagged unless skip_on_invalid;
    values that are no object set nothing."""

    def run(df: DataFrame) -> DataFrame:
        parsed = F.try_parse_json(text_of(df, source))
        out = df.withColumn("__v", parsed)
        bad = F.col("__v").isNull()
        if schema is None:
            out = out.withColumn(target or "json", F.col("__v"))
        else:
            # fields of another type than declared stay null one by one
            fields = T.StructType.fromDDL(schema).fields
            got = {f.name: F.try_variant_get("__v", f"$['{f.name}']", f.dataType.simpleString()) for f in fields}
            for name, value in got.items():
                path = f"[{target}][{name}]" if target else f"[{name}]"
                if not target and has(df, name):
                    value = F.coalesce(value.try_cast(kind_of(df, name)), field(df, f"[{name}]"))
                out = with_field(out, path, value)
        out = out if skip_on_invalid else add_tags(out, tag, when=bad)
        return out.drop("__v")

    return run


def csv(source: str = "message", columns: Sequence[str] = (), separator: str = ",", quote: str = '"', skip_header: bool = False) -> Operator:
    """The first record of the text to string columns; what is missing stays absent.

    With skip_header, rows that repeat the column names get no fields.
    """
    ddl = ", ".join(f"`{c}` string" for c in columns)

    def run(df: DataFrame) -> DataFrame:
        text = text_of(df, source)
        got = F.from_csv(text, ddl, {"sep": separator, "quote": quote, "escape": quote, "mode": "PERMISSIVE"})
        if skip_header:
            got = F.when(text != separator.join(columns), got)
        out = df.withColumn("__csv", got)
        for c in columns:
            value = F.col("__csv")[c]
            if has(df, c) and kind_of(df, c) == T.StringType():
                value = F.coalesce(value, field(df, c))
            out = with_field(out, f"[{c}]", value)
        return out.drop("__csv")

    return run


def xml(source: str = "message", paths: Mapping[str, str] | None = None, schema: str | None = None, target: str = "xml", store_xml: bool = True, tag: str = "_xmlparsefailure") -> Operator:
    """XML to fields: named XPaths, or a whole document read with a schema (DDL). Malformed text is tagged."""

    def run(df: DataFrame) -> DataFrame:
        text = text_of(df, source)
        # a document is well-formed if a permissive reader finds no corrupt record
        probe = F.from_xml(text, "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        good = text.isNotNull() & probe["_corrupt_record"].isNull() & text.rlike(r"(?s)\A\s*<.*>\s*\z")
        out = df.withColumns({"__src": text, "__hit": F.coalesce(good, F.lit(False))})
        for name, path in (paths or {}).items():
            out = with_field(out, name, F.when(F.col("__hit"), F.xpath_string("__src", F.lit(path))))
        if schema:
            out = with_field(out, target, F.when(F.col("__hit"), F.from_xml("__src", schema)))
        out = add_tags(out, tag, when=~F.col("__hit")).drop("__hit", "__src")
        return out if store_xml else out.drop(source)

    return run


#: Strptime directives and what they are called in Java patterns.
_STRPTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "3f": "SSS", ".3f": ".SSS", "z": "Z", "b": "MMM", "B": "MMMM", "y": "yy", "j": "DDD", "p": "a", "I": "hh", "e": "d", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "%": "%"}


def time_pattern(source: str) -> tuple[str, bool]:
    """The Java pattern for a Joda or strptime one, and whether a day name has to go first."""
    if "%" in source:
        out = re.sub(r"%(\.?\d?[A-Za-z%])", lambda m: _STRPTIME.get(m[1], m[1]), source)
        return out, False
    out = re.sub(r"Y+", lambda m: "y" * len(m[0]), source)
    day = bool(re.match(r"(?:E+|e+|c+),? +", out))
    return re.sub(r"^(?:E+|e+|c+),? +", "", out).replace("ZZ", "Z"), day


def parse_time(text: Column, number: Column | None, pattern: str) -> Column:
    """A timestamp by ISO8601, UNIX, UNIX_MS or a Joda or strptime pattern; null if the text does not fit."""
    if pattern == "ISO8601":
        plain = text.rlike(r"\A\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\z")
        return F.when(plain, F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})\z", "$1:$2").try_cast("timestamp"))
    if pattern in ("UNIX", "UNIX_MS"):
        whole = F.when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast("long")) if number is None else number.cast("long")
        return F.timestamp_seconds(whole) if pattern == "UNIX" else F.timestamp_millis(whole)
    java, day = time_pattern(pattern)
    shown = F.regexp_replace(text, r"^\p{L}+,? +", "") if day else text
    return F.try_to_timestamp(shown, F.lit(java))


def date(source: str, patterns: Sequence[str], target: str = "@timestamp", tag: str = "_dateparsefailure") -> Operator:
    """The first pattern that fits sets the event time; another target gets text in milliseconds, UTC."""

    def run(df: DataFrame) -> DataFrame:
        kind = kind_of(df, source)
        number = field(df, source) if isinstance(kind, (T.IntegerType, T.LongType)) else None
        got = F.coalesce(*(parse_time(text_of(df, source), number, p) for p in patterns)) if kind else F.lit(None).cast("timestamp")
        out = df.withColumn("__t", got)
        value = F.col("__t") if target == "@timestamp" else F.date_format("__t", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        if has(df, target):
            value = F.coalesce(value, field(df, target).cast("timestamp" if target == "@timestamp" else "string"))
        out = with_field(out, target, value)
        return add_tags(out, tag, when=F.col("__t").isNull()).drop("__t")

    return run


#: Browsers and systems in the order in which they are tried.
BROWSERS = [
    (r"(?i)Edg[eA]?/(\d+)\.(\d+)\.(\d+)", "Edge"),
    (r"(?i)OPR/(\d+)\.(\d+)\.(\d+)", "Opera"),
    (r"(?i)Vivaldi/(\d+)\.(\d+)\.(\d+)", "Vivaldi"),
    (r"(?i)Firefox/(\d+)\.(\d+)(?:\.(\d+))?", "Firefox"),
    (r"(?i)Chrome/(\d+)\.(\d+)\.(\d+)", "Chrome"),
    (r"(?i)Version/(\d+)\.(\d+)(?:\.(\d+))?\s+Safari/", "Safari"),
    (r"(?i)Safari/(\d+)\.(\d+)(?:\.(\d+))?", "Safari"),
    (r"(?i)MSIE\s+(\d+)\.(\d+)()", "IE"),
    (r"(?i)Trident/.*?rv:(\d+)\.(\d+)()", "IE"),
    (r"(?i)curl/(\d+)\.(\d+)\.(\d+)", "curl"),
]
SYSTEMS = [
    (r"(?i)Windows NT (\d+)\.(\d+)", "Windows"),
    (r"(?i)Mac OS X (\d+)[_.](\d+)(?:[_.](\d+))?", "Mac OS X"),
    (r"(?i)iPhone OS (\d+)_(\d+)(?:_(\d+))?", "iOS"),
    (r"(?i)iPad.*OS (\d+)_(\d+)", "iOS"),
    (r"(?i)Android (\d+)(?:\.(\d+)(?:\.(\d+))?)?", "Android"),
    (r"(?i)CrOS()", "Chrome OS"),
    (r"(?i)Linux()", "Linux"),
]
DEVICES = [("Mobile|Android", "Mobile"), ("Tablet|iPad", "Tablet"), ("Bot|bot|Crawler|Spider", "Spider")]


def useragent(source: str, target: str = "ua", prefix: str = "") -> Operator:
    """Browser, system and device of a user agent, as a struct."""

    def pick(table: list[tuple[str, str]], value: Callable[[str, str], Column], other: Column) -> Column:
        out = other
        for expression, name in reversed(table):
            out = F.when(F.col("__ua").rlike(expression), value(expression, name)).otherwise(out)
        return out

    def run(df: DataFrame) -> DataFrame:
        out = df.withColumn("__ua", text_of(df, source))
        numbers = {n: pick(BROWSERS, lambda e, _, k=k: F.regexp_extract("__ua", e, k), F.lit("")) for k, n in ((1, "major"), (2, "minor"), (3, "patch"))}
        out = out.withColumns({"__os": pick(SYSTEMS, lambda _, n: F.lit(n), F.lit("Other")), "__osm": pick(SYSTEMS, lambda e, _: F.regexp_extract("__ua", e, 1), F.lit(""))})
        parts = {
            "name": pick(BROWSERS, lambda _, n: F.lit(n), F.lit("Other")),
            "os": F.trim(F.concat_ws(" ", "__os", "__osm")),
            "os_name": F.col("__os"),
            "os_major": F.col("__osm"),
            "device": pick(DEVICES, lambda _, n: F.lit(n), F.lit("PC")),
        } | numbers
        found = F.when(F.col("__ua").isNotNull(), F.struct(*(c.alias(prefix + n) for n, c in parts.items())))
        return with_field(out, target, found).drop("__ua", "__os", "__osm")

    return run


#: Labels by code.
SEVERITIES = ["emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug"]
FACILITIES = [
    "kernel", "user-level", "mail", "daemon", "security/authorization", "syslogd", "line printer", "network news",
    "uucp", "clock", "security/authorization", "ftp", "ntp", "log audit", "log alert", "clock",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
]


def syslog_pri(source: str = "syslog_pri", use_labels: bool = True, default: int = 13, facilities: Sequence[str] = FACILITIES, severities: Sequence[str] = SEVERITIES) -> Operator:
    """Facility and severity, codes and labels; absent, malformed and negative priorities count as the default."""

    def run(df: DataFrame) -> DataFrame:
        text = text_of(df, source)
        read = F.when(text.rlike(r"\A\+?[0-9]+\z"), text.try_cast("long"))
        pri = F.coalesce(read, F.lit(default).cast("long"))
        out = df.withColumns({"syslog_severity_code": pri % 8, "syslog_facility_code": F.floor(pri / 8).cast("long")})
        if use_labels:
            label = lambda names, code: F.coalesce(F.get(F.array(*map(F.lit, names)), F.least(F.col(code), F.lit(len(names))).cast("int")), F.lit("unknown"))
            out = out.withColumns({"syslog_facility": label(facilities, "syslog_facility_code"), "syslog_severity": label(severities, "syslog_severity_code")})
        return out

    return run
