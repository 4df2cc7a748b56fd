"""Names and values: prune, de_dot, truncate, urldecode, bytes, uuid, json_encode, fingerprint, anonymize."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import TAGS, add_tags, event_json, field, has, kind_of, text_of, with_field
from ..functions.regex import java

Operator = Callable[[DataFrame], DataFrame]


def prune(whitelist_names: Sequence[str] = (), blacklist_names: Sequence[str] = (), whitelist_values: dict[str, str] | None = None, blacklist_values: dict[str, str] | None = None) -> Operator:
    """Keeps columns by their names (decided before the job starts), then values by patterns. Tags stay."""

    def run(df: DataFrame) -> DataFrame:
        kept = []
        for name in df.columns:
            if name != TAGS:
                if whitelist_names and not any(re.search(p, name) for p in whitelist_names):
                    continue
                if any(re.search(p, name) for p in blacklist_names):
                    continue
            value = F.col(f"`{name}`")
            if name in (whitelist_values or {}):
                value = F.when(text_of(df, f"[{name}]").rlike(java(whitelist_values[name])), value)
            if name in (blacklist_values or {}):
                value = F.when(~text_of(df, f"[{name}]").rlike(java(blacklist_values[name])), value)
            kept.append(value.alias(name))
        return df.select(*kept)

    return run


def de_dot(separator: str = "_", fields: Sequence[str] | None = None, nested: bool = False) -> Operator:
    """Dots in column names become the separator; with nested also inside structs and maps."""

    def renamed(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name.replace(".", separator), renamed(f.dataType), f.nullable) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(renamed(kind.elementType), kind.containsNull)
        return kind

    def run(df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            value = F.col(f"`{f.name}`")
            if nested and isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, T.StringType):
                value = F.transform_keys(value, lambda k, _: F.replace(k, F.lit("."), F.lit(separator)))
            elif nested:
                value = value.cast(renamed(f.dataType))
            chosen = fields is None or f.name in fields
            out.append(value.alias(f.name.replace(".", separator) if chosen else f.name))
        return df.select(*out)

    return run


def _strings(df: DataFrame, fields: Sequence[str] | None) -> list[str]:
    if fields:
        return [f for f in fields if has(df, f)]
    return [f"[{f.name}]" for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def truncate(fields: Sequence[str] | None = None, length_bytes: int = 400) -> Operator:
    """Text cut to a number of UTF-8 bytes, never inside a character."""

    def cut(text: Column) -> Column:
        raw = F.encode(text, "UTF-8")
        # a character is at most four bytes, so one of these cuts is at its edge
        cuts = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.lit(length_bytes - k)).cast("string")) for k in range(min(4, length_bytes + 1))]
        return F.when(F.octet_length(text) <= length_bytes, text).otherwise(F.coalesce(*cuts, F.lit("")))

    def run(df: DataFrame) -> DataFrame:
        for name in _strings(df, fields):
            if isinstance(kind_of(df, name), T.StringType):
                df = with_field(df, name, cut(field(df, name)))
        return df

    return run


def urldecode(source: str = "message", all_fields: bool = False) -> Operator:
    """Percent sequences decoded; a plus stays, and so do malformed sequences."""

    def decode(text: Column) -> Column:
        kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(text.contains("%"), F.try_url_decode(kept)).otherwise(text)

    def run(df: DataFrame) -> DataFrame:
        for name in _strings(df, None if all_fields else [source]):
            if isinstance(kind_of(df, name), T.StringType):
                df = with_field(df, name, decode(field(df, name)))
        return df

    return run


def bytes_(source: str = "message", target: str | None = None, tag: str = "_bytesparsefailure") -> Operator:
    """Sizes such as 1.5GB to a number of bytes, by powers of 1024, cut to a whole number."""

    def run(df: DataFrame) -> DataFrame:
        text = text_of(df, source)
        number = F.regexp_extract(text, r"\A\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*([A-Za-z]*)\s*\z", 1)
        unit = F.upper(F.regexp_extract(text, r"\A\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*([A-Za-z]*)\s*\z", 2))
        factor = F.when(unit.isin("", "B", "BYTE", "BYTES"), 1.0)
        for k, letter in enumerate("KMGTP", 1):
            factor = factor.when(unit.isin(letter, f"{letter}B", f"{letter}IB"), float(1024**k))
        size = F.when(number != "", number.try_cast("double") * factor).cast("long")
        out = df.withColumn("__n", size)
        value = F.col("__n")
        into = target or source
        if has(df, into) and into != source:
            value = F.coalesce(value, field(df, into).try_cast("long"))
        out = with_field(out, into, value)
        return add_tags(out, tag, when=F.col("__n").isNull()).drop("__n")

    return run


def uuid(target: str = "uuid", overwrite: bool = False) -> Operator:
    """A random version 4 UUID; a value that is there already stays unless overwrite."""

    def run(df: DataFrame) -> DataFrame:
        new = F.expr("uuid()")
        return with_field(df, target, F.coalesce(field(df, target), new) if has(df, target) and not overwrite else new)

    return run


def json_encode(source: str | None = None, target: str = "json_encoded") -> Operator:
    """A field, or the whole event, as JSON text."""

    def run(df: DataFrame) -> DataFrame:
        if source is None:
            return with_field(df, target, event_json(df))
        if not has(df, source):
            return df
        value = field(df, source)
        # a one-element array gives the JSON form of any type
        return with_field(df, target, F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.array(value)), r"(?s)\A\[(.*)\]\z", 1)))

    return run


# ---------------------------------------------------------------------------------------------------
# hashes

_BLOCK = {"MD5": 64, "SHA1": 64, "SHA256": 64, "SHA384": 128, "SHA512": 128}


def digest(data: Column, method: str) -> Column:
    """Lower-case hexadecimal digest of binary data."""
    if method == "MD5":
        return F.md5(data)
    if method == "SHA1":
        return F.sha1(data)
    return F.sha2(data, int(method[3:]))


def keyed_digest(data: Column, method: str, key: str) -> Column:
    """HMAC, composed of built-in digests; the pads are constants."""
    import hashlib

    raw, size = key.encode(), _BLOCK[method]
    raw = (hashlib.new(method.lower(), raw).digest() if len(raw) > size else raw).ljust(size, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, data), method))), method)


_M64, _M32 = (1 << 64) - 1, (1 << 32) - 1


def _turned(x: int, by: int, width: int) -> int:
    return (x << by | x >> (width - by)) & ((1 << width) - 1)


def hash64(data: bytes) -> int:
    """A 64-bit hash of eight-byte little-endian words with a final mix."""
    #: fixed values
    c1, c2, add = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x52731D0C
    state = 0
    for at in range(0, len(data), 8):
        word = int.from_bytes(data[at : at + 8], "little")
        state = (_turned(state ^ (_turned(word * c1 & _M64, 31, 64) * c2 & _M64), 27, 64) * 5 + add) & _M64
    state ^= len(data)
    for factor in (c1, c2, 1):
        state = (state ^ state >> 33) * factor & _M64
    return state


def murmur32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, the 32-bit variant (Spark's own hash() treats the last bytes differently)."""
    #: fixed values
    c1, c2, add, f1, f2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35

    def mixed(word: int) -> int:
        return _turned(word * c1 & _M32, 15, 32) * c2 & _M32

    state, whole = seed, len(data) // 4 * 4
    for at in range(0, whole, 4):
        state = (_turned(state ^ mixed(int.from_bytes(data[at : at + 4], "little")), 13, 32) * 5 + add) & _M32
    if whole < len(data):
        state ^= mixed(int.from_bytes(data[whole:], "little"))
    state ^= len(data)
    state = (state ^ state >> 16) * f1 & _M32
    state = (state ^ state >> 13) * f2 & _M32
    return state ^ state >> 16


def _hash64_hex(data: Column) -> Column:
    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else f"{hash64(bytes(b)):016x}")

    return apply(data)


def _murmur32(data: Column) -> Column:
    @F.pandas_udf("long")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else murmur32(bytes(b))).astype("Int64")

    return apply(data)


def fingerprint(sources: Sequence[str], target: str = "fingerprint", method: str = "SHA256", key: str | None = None) -> Operator:
    """Digest of the fields' texts joined with |; absent fields are left out, and without any nothing is set."""

    def run(df: DataFrame) -> DataFrame:
        present = [text_of(df, s) for s in sources if has(df, s)]
        if not present:
            return df
        data = F.concat_ws("|", *present).cast("binary")
        if method == "MURMUR3":
            value = _hash64_hex(F.concat(F.lit((key or "").encode()), data))
        else:
            value = keyed_digest(data, method, key) if key else digest(data, method)
        some = F.coalesce(*present).isNotNull()
        old = field(df, target).cast("string") if has(df, target) else F.lit(None).cast("string")
        return with_field(df, target, F.when(some, value).otherwise(old))

    return run


def anonymize(fields: Sequence[str], algorithm: str = "SHA1", key: str | None = None) -> Operator:
    """Replaces fields by digests of their texts; MURMUR3 gives a whole number and takes no key."""
    if algorithm not in (*_BLOCK, "MURMUR3"):
        raise ValueError(f"anonymize has no {algorithm!r}")

    def run(df: DataFrame) -> DataFrame:
        for name in fields:
            if has(df, name):
                data = text_of(df, name).cast("binary")
                df = with_field(df, name, _murmur32(data) if algorithm == "MURMUR3" else keyed_digest(data, algorithm, key) if key else digest(data, algorithm))
        return df

    return run
