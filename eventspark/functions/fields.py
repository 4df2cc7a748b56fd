"""Field paths, text forms and templates.

An event is a row. A path is `a`, `a.b` or `[a][b]`; a field that the schema does not have is absent, as
is a null. Tags live in the column `tags`, the event time in `@timestamp`, and what is never written out
in the struct `@metadata`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = "tags"


def segments(path: str) -> list[str]:
    """`[a][b]` and `a.b` to their parts; names with a leading @ are whole."""
    if path.startswith("["):
        found = re.findall(r"\[([^\[\]]+)\]", path)
        if "".join(f"[{x}]" for x in found) != path:
            raise ValueError(f"not a field: {path!r}")
        return found
    return path.split(".")


def kind_of(df: DataFrame, path: str) -> T.DataType | None:
    """The field's type, or None if no row can have it."""
    kind: T.DataType = df.schema
    for part in segments(path):
        if isinstance(kind, T.StructType) and part in kind.fieldNames():
            kind = kind[part].dataType
        elif isinstance(kind, T.MapType):
            kind = kind.valueType
        else:
            return None
    return kind


def has(df: DataFrame, path: str) -> bool:
    return kind_of(df, path) is not None


def field(df: DataFrame, path: str) -> Column:
    """The field as a column; null where it is absent."""
    if not has(df, path):
        return F.lit(None)
    first, *rest = segments(path)
    return reduce(lambda c, part: c[part], rest, F.col(f"`{first}`"))


def with_field(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Sets a field; structs on the way are made, other values on the way are replaced."""
    first, *rest = segments(path)
    if not rest:
        return df.withColumn(first, value)
    depth = next((k for k in range(len(rest), -1, -1) if k == 0 or isinstance(kind_of(df, _join([first, *rest[:k]])), T.StructType)), 0)
    if isinstance(kind_of(df, first), T.StructType):
        # the struct itself may be null, and withField keeps nulls
        inside = reduce(lambda v, part: F.struct(v.alias(part)), reversed(rest[depth + 1 :]), value)
        base = F.coalesce(F.col(f"`{first}`"), F.from_json(F.lit("{}"), df.schema[first].dataType))
        return df.withColumn(first, base.withField(".".join(f"`{p}`" for p in rest[: depth + 1]), inside))
    return df.withColumn(first, reduce(lambda v, part: F.struct(v.alias(part)), reversed(rest), value))


def without_field(df: DataFrame, path: str) -> DataFrame:
    first, *rest = segments(path)
    if not has(df, path):
        return df
    if not rest:
        return df.drop(F.col(f"`{first}`"))
    kind = kind_of(df, _join([first, *rest[:-1]]))
    if isinstance(kind, T.StructType) and len(kind) == 1:
        return without_field(df, _join([first, *rest[:-1]]))
    return df.withColumn(first, F.col(f"`{first}`").dropFields(".".join(f"`{p}`" for p in rest)))


def _join(parts: list[str]) -> str:
    return "".join(f"[{p}]" for p in parts)


def as_text(value: Column, kind: T.DataType | None) -> Column:
    """A value as text: whole doubles without .0, structures as JSON; null stays null."""
    if kind is None or isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(value.cast("string"), r"\.0$", "")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return value.cast("string")


def text_of(df: DataFrame, path: str) -> Column:
    return as_text(field(df, path), kind_of(df, path))


def template(df: DataFrame, source: str) -> Column:
    """`%{field}` filled in; absent fields stay as written, an absent message is empty, tags are joined."""
    parts = []
    for k, piece in enumerate(re.split(r"%\{([^}]+)\}", source)):
        if k % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        elif piece == TAGS and isinstance(kind_of(df, TAGS), T.ArrayType):
            parts.append(F.coalesce(F.array_join(F.col(TAGS), ","), F.lit("")))
        elif piece.startswith("+"):
            parts.append(F.date_format(field(df, "@timestamp"), _joda(piece[1:])) if has(df, "@timestamp") else F.lit(f"%{{{piece}}}"))
        else:
            parts.append(F.coalesce(text_of(df, piece), F.lit("" if piece == "message" else f"%{{{piece}}}")))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")


def _joda(pattern: str) -> str:
    return pattern.replace("YYYY", "yyyy").replace("YY", "yy").replace("xxxx", "yyyy")


def tags(df: DataFrame) -> Column:
    """The tags, never null."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.col(TAGS), none) if has(df, TAGS) else none


def add_tags(df: DataFrame, *names: str, when: Column | None = None) -> DataFrame:
    """Adds tags (templates) that a row does not have yet, in order, where the condition holds."""
    now = tags(df)
    new = F.array_union(now, F.array(*(template(df, n) for n in names)))
    return df.withColumn(TAGS, new if when is None else F.when(when, new).otherwise(now))


def remove_tags(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumn(TAGS, F.array_except(tags(df), F.array(*map(F.lit, names)))) if has(df, TAGS) else df


def event_json(df: DataFrame) -> Column:
    """The row as its JSON form: time in milliseconds, @version, tags only if there are any, no @metadata."""
    shown = []
    for f in df.schema.fields:
        if f.name == "@metadata":
            continue
        value = F.col(f"`{f.name}`")
        if f.name == TAGS:
            value = F.when(F.size(value) > 0, value)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(F.isnan(value) | F.abs(value).isin(float("inf")), F.lit(0.0)).otherwise(value)
        shown.append(value.alias(f.name))
    if "@version" not in df.columns:
        shown.append(F.lit("1").alias("@version"))
    return F.to_json(F.struct(*shown))


#: Text and quoted names of a SQL statement, comments, and named parameters; only the latter have a group.
_PARAMETER = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?<![:\w]):([A-Za-z_]\w*)""", re.S)


def named_parameters(statement: str, values: Mapping[str, str]) -> str:
    """The statement with SQL in place of its parameters `:name`; text, quoted names and comments stay as they are."""
    return _PARAMETER.sub(lambda m: values.get(m[1], m[0]) if m[1] else m[0], statement)


def sql_literal(value: object) -> str:
    """A Python value as SQL."""
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(sql_literal, value))})"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    return str(value)

