"""Rows: drop, clone, split, sleep."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import Condition, sql
from ..functions.fields import add_tags, field, has, kind_of, tags, with_field
from .mutate import _quoted

Operator = Callable[[DataFrame], DataFrame]


def _changes_rows(run: Operator) -> Operator:
    run.changes_rows = True
    return run


def drop(condition: Condition | str | None = None, percentage: float = 100, id_field: str = "event_id") -> Operator:
    """Removes rows that meet the condition; with a percentage, those whose id's bytes add up to less than
    it modulo 100, so that the same rows go every time."""
    test = sql(condition) if isinstance(condition, str) else condition

    def run(df: DataFrame) -> DataFrame:
        hit = test(df) if test else F.lit(True)
        if percentage < 100:
            text = F.encode(field(df, id_field).cast("string"), "UTF-8")
            digits = F.hex(text)
            total = F.aggregate(F.sequence(F.lit(0), F.octet_length(text) - 1), F.lit(0), lambda a, i: a + F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
            hit = hit & F.coalesce(F.when(F.octet_length(text) > 0, total).otherwise(0) % 100 < percentage, F.lit(True))
        return df.where(~hit)

    return _changes_rows(run)


def clone(clones: Sequence[str] | int = 1, add_tag: Sequence[str] = ()) -> Operator:
    """The row itself, and a copy for each name, which becomes a tag of the copy (a number gives untagged copies)."""
    names: list[str | None] = [None] * clones if isinstance(clones, int) else list(clones)

    def run(df: DataFrame) -> DataFrame:
        which = F.explode(F.sequence(F.lit(0), F.lit(len(names))))
        old = tags(df)
        new = F.lit(None).cast("array<string>")
        for k, name in enumerate(names, 1):
            new = F.when(F.col("__copy") == k, F.array(*map(F.lit, ([name] if name else []) + list(add_tag))).cast("array<string>")).otherwise(new)
        out = df.withColumn("__copy", which)
        return out.withColumn("tags", F.when(F.col("__copy") == 0, old).otherwise(F.array_union(old, new))).drop("__copy")

    return _changes_rows(run)


def split(source: str = "message", terminator: str = "\n", target: str | None = None) -> Operator:
    """One row per element of an array, or per piece of a text; other rows stay as they are."""

    def run(df: DataFrame) -> DataFrame:
        kind = kind_of(df, source)
        if isinstance(kind, T.ArrayType):
            pieces, element = field(df, source), kind.elementType
        elif isinstance(kind, T.StringType):
            pieces, element = F.split(field(df, source), _quoted(terminator), -1), kind
        else:
            return df
        out = df.withColumn("__piece", F.explode_outer(pieces))
        into = target or source
        value = F.col("__piece")
        if target and has(df, target) and kind_of(df, target) == element:
            value = F.coalesce(value, field(df, target))
        return with_field(out, into, value).drop("__piece")

    return _changes_rows(run)


def sleep(time: float, every: int = 1) -> Operator:
    """Waiting has no meaning for a table; rates of streams are set at the source (maxOffsetsPerTrigger)."""
    return lambda df: df


def tag_rows(names: Sequence[str]) -> Operator:
    return lambda df: add_tags(df, *names)
