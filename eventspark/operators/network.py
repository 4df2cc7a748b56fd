"""Addresses: cidr, geoip, dns."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import add_tags, field, has, kind_of, template, text_of, with_field
from .mutate import replace

Operator = Callable[[DataFrame], DataFrame]
IPV4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\z"


def ipv4_number(text: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    parts = F.split(text, r"\.")
    number = sum((F.element_at(parts, k + 1).try_cast("long") * (256 ** (3 - k)) for k in range(4)), F.lit(0).cast("long"))
    return F.when(text.rlike(IPV4), number)


def ipv6_text(text: Column) -> Column:
    """An IPv6 address as its 32 hex digits; null for anything else."""
    tail = F.regexp_extract(text, r"([0-9.]+)\z", 1)
    number = ipv4_number(tail)
    four = F.lower(F.lpad(F.hex(number), 8, "0"))
    # an IPv4 tail is two groups
    plain = F.when(text.contains("."), F.concat(F.regexp_extract(text, r"\A(.*:)[0-9.]+\z", 1), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4))).otherwise(F.lower(text))
    halves = F.split(plain, "::")

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    gap = F.size(halves) == 2
    left, right = groups(F.get(halves, F.lit(0))), F.when(gap, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    known = F.size(left) + F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0)))
    every = F.concat(left, zeros, right)
    good = F.when(gap, known < 8).otherwise(known == 8) & F.forall(every, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
    return F.when(text.contains(":") & (F.size(halves) <= 2) & good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))


def _in_v6(text: Column, networks: list[str]) -> Column:
    digits, hit = ipv6_text(text), F.lit(False)
    for n in networks:
        net = ipaddress.ip_network(n, strict=False)
        hit = hit | digits.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
    return F.coalesce(hit, F.lit(False))


def in_networks(text: Column, networks: Sequence[str]) -> Column:
    """Whether an address is in any network of its family; never null."""
    known = [ipaddress.ip_network(n, strict=False) for n in networks]
    number, hit = ipv4_number(text), F.lit(False)
    for net in known:
        if net.version == 4:
            hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    hit = F.coalesce(hit, F.lit(False))
    six = [str(n) for n in known if n.version == 6]
    return hit | _in_v6(text, six) if six else hit


def cidr(addresses: Sequence[str], networks: Sequence[str], add_field: Mapping[str, str] | None = None, add_tag: Sequence[str] = ()) -> Operator:
    """Adds fields and tags to rows with any of the addresses (templates) in any of the networks."""
    from ..functions.conditions import where

    def run(df: DataFrame) -> DataFrame:
        hit = F.lit(False)
        for a in addresses:
            hit = hit | in_networks(template(df, a), networks)

        def change(d: DataFrame) -> DataFrame:
            return add_tags(replace(add_field or {})(d), *add_tag) if add_tag else replace(add_field or {})(d)

        return where(lambda _: hit, change)(df)

    return run


def geoip(source: str, target: str = "geoip", ranges: DataFrame | None = None, tag: str = "_geoip_lookup_failure") -> Operator:
    """What is known of an address, as a struct.

    ranges: first and last (numbers of IPv4 addresses, or texts of addresses of either family) and any further
    columns; ranges must not overlap. Numbers are joined by the /16 block; texts as hex digits (IPv4 as
    ::ffff:a.b.c.d), by those that the first and the last address of a range share, so that neither side is
    compared with all of the other. Without ranges the struct holds ip and network_type: loopback, private or
    public.
    """

    def classed(df: DataFrame) -> DataFrame:
        text = text_of(df, source)
        good = text.rlike(IPV4) | ipv6_text(text).isNotNull()
        private = in_networks(text, ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "fc00::/7", "fe80::/10"])
        kind = F.when(in_networks(text, ["127.0.0.0/8", "::1/128"]), "loopback").when(private, "private").otherwise("public")
        out = df.withColumn("__ok", F.coalesce(good, F.lit(False)))
        out = with_field(out, target, F.when(F.col("__ok"), F.struct(text.alias("ip"), kind.alias("network_type"))))
        return add_tags(out, tag, when=~F.col("__ok")).drop("__ok")

    def looked_up(df: DataFrame) -> DataFrame:
        more = [c for c in ranges.columns if c not in ("first", "last")]
        blocks = ranges.select("first", "last", F.struct(*more).alias("__geo"), F.explode(F.sequence(F.shiftright("first", 16), F.shiftright("last", 16))).alias("__block"))
        out = df.withColumn("__ip", ipv4_number(text_of(df, source))).withColumn("__block", F.shiftright("__ip", 16))
        joined = out.join(blocks, (out["__block"] == blocks["__block"]) & out["__ip"].between(blocks["first"], blocks["last"]), "left").drop("first", "last", "__block")
        joined = with_field(joined, target, F.col("__geo"))
        return add_tags(joined, tag, when=F.col("__geo").isNull()).drop("__geo", "__ip")

    def looked_up_by_text(df: DataFrame) -> DataFrame:
        more = [c for c in ranges.columns if c not in ("first", "last")]
        spans = ranges.select(address_digits(F.col("first")).alias("__a"), address_digits(F.col("last")).alias("__b"), F.struct(*more).alias("__geo"))
        shared = F.size(F.filter(F.sequence(F.lit(1), F.lit(32)), lambda n: F.substring("__a", F.lit(1), n) == F.substring("__b", F.lit(1), n)))
        spans = spans.withColumn("__n", shared).withColumn("__p", F.expr("substring(__a, 1, __n)"))
        sizes = [r[0] for r in spans.select("__n").distinct().collect()]  # 33 at most
        out = df.withColumn("__ip", address_digits(text_of(df, source)))
        asked = out.select("__ip").where("__ip IS NOT NULL").distinct().select("__ip", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("__n")).withColumn("__p", F.expr("substring(__ip, 1, __n)"))
        met = asked.join(spans, ["__n", "__p"]).where(F.col("__ip").between(F.col("__a"), F.col("__b"))).select(F.col("__ip").alias("__key"), "__geo")
        joined = out.join(met, F.col("__ip") == F.col("__key"), "left")
        joined = with_field(joined, target, F.col("__geo"))
        return add_tags(joined, tag, when=F.col("__geo").isNull()).drop("__geo", "__ip", "__key")

    if ranges is None:
        return classed
    return looked_up_by_text if isinstance(ranges.schema["first"].dataType, T.StringType) else looked_up


def address_digits(text: Column) -> Column:
    """32 hex digits of an address of either family, IPv4 as ::ffff:a.b.c.d; null for anything else."""
    four = F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(ipv4_number(text)), 8, "0")))
    return F.coalesce(four, ipv6_text(text))


def dns(source: str, resolver: Callable[[], Callable[[str], str | None]], target: str | None = None, tag: str = "_dnsfailure", reverse: bool = False, action: str = "replace") -> Operator:
    """Resolves distinct values only, and joins the answers back. resolver() is called once a task and gives a
    function from name or address to the answer, or None. reverse: values that are no address are not
    asked for. action: the answer replaces the field, or is appended to it as one more entry of a list."""
    from .lookups import resolve

    def run(df: DataFrame) -> DataFrame:
        if not has(df, source):
            return df
        asked = text_of(df, source)
        if isinstance(kind_of(df, source), T.ArrayType):
            asked = F.get(field(df, source), F.lit(0)).cast("string")
        out = resolve(df, F.when(address_digits(asked).isNotNull(), asked) if reverse else asked, resolver, "__answer")
        old = field(out, source)
        if action == "append" and not target:
            had = old.cast("array<string>") if isinstance(kind_of(df, source), T.ArrayType) else F.array(old.cast("string"))
            value = F.when(F.col("__answer").isNull(), had).otherwise(F.array_append(had, F.col("__answer")))
        else:
            value = F.col("__answer") if target else F.coalesce("__answer", text_of(out, source))
        out = with_field(out, target or source, F.when(old.isNotNull() | F.lit(bool(target)), value))
        return add_tags(out, tag, when=F.col("__answer").isNull() & field(df, source).isNotNull()).drop("__answer")

    return run
