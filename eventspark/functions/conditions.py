"""Conditions: two-valued logic over fields that may be absent.

Every condition is a function from a DataFrame to a Column that is never null, so that conditions can be
negated and chained. Comparison is strict in type: text and number are never equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import TAGS, field, has, kind_of, segments, tags, text_of
from .regex import java

Condition = Callable[[DataFrame], Column]
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType)


def _true_only(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def always(df: DataFrame) -> Column:
    return F.lit(True)


def sql(expression: str) -> Condition:
    """Any SQL condition; null counts as false."""
    return lambda df: _true_only(F.expr(expression).cast("boolean"))


def exists(path: str) -> Condition:
    return lambda df: field(df, path).isNotNull() if has(df, path) else F.lit(False)


def truthy(path: str) -> Condition:
    """Present and not false, nor empty text, array or struct; zero counts as true."""

    def test(df: DataFrame) -> Column:
        kind, value = kind_of(df, path), field(df, path)
        if kind is None:
            return F.lit(False)
        if isinstance(kind, T.BooleanType):
            return _true_only(value)
        if isinstance(kind, T.StringType):
            return _true_only(value != "")
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return _true_only(F.size(value) > 0)
        return value.isNotNull()

    return test


def eq(path: str, wanted: str | int | float | bool) -> Condition:
    def test(df: DataFrame) -> Column:
        kind, value = kind_of(df, path), field(df, path)
        if isinstance(wanted, bool):
            fits = isinstance(kind, T.BooleanType)
        elif isinstance(wanted, (int, float)):
            fits = isinstance(kind, _NUMBERS)
        else:
            fits = isinstance(kind, T.StringType)
        if not fits:
            return F.lit(False)
        if isinstance(wanted, float) or isinstance(kind, (T.FloatType, T.DoubleType)) and not isinstance(wanted, bool):
            return _true_only(F.abs(value.cast("double") - F.lit(float(wanted))) < 2.220446049250313e-16)
        return value.eqNullSafe(F.lit(wanted))  # reaches the scan, negated or not

    return test


def ne(path: str, wanted: str | int | float | bool) -> Condition:
    """True for absent fields."""
    return negate(eq(path, wanted))


def compare(path: str, sign: str, bound: int | float) -> Condition:
    """<, <=, > or >= on numbers; false for absent fields and anything else."""
    signs = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}

    def test(df: DataFrame) -> Column:
        if not isinstance(kind_of(df, path), _NUMBERS):
            return F.lit(False)
        value = field(df, path)
        return value.isNotNull() & getattr(value, signs[sign])(F.lit(bound))

    return test


def matches(path: str, pattern: str) -> Condition:
    """The pattern is found in the field's text."""
    return lambda df: _true_only(text_of(df, path).rlike(java(pattern)))


def not_matches(path: str, pattern: str) -> Condition:
    """True for absent fields."""
    return negate(matches(path, pattern))


def contains(value: str, path: str) -> Condition:
    """`"value" in [path]`: the scalar field equals it, or it is an element of the array (tags included)."""

    def test(df: DataFrame) -> Column:
        if segments(path) == [TAGS]:
            return F.array_contains(tags(df), value)
        if isinstance(kind_of(df, path), T.ArrayType):
            return _true_only(F.array_contains(field(df, path), F.lit(value)))
        return eq(path, value)(df)

    return test


def is_in(path: str, wanted: Sequence[str | int | float]) -> Condition:
    return any_of(*(eq(path, w) for w in wanted))


def not_in(path: str, wanted: Sequence[str | int | float]) -> Condition:
    return negate(is_in(path, wanted))


def negate(c: Condition) -> Condition:
    return lambda df: ~c(df)


def all_of(*cs: Condition) -> Condition:
    def test(df: DataFrame) -> Column:
        out = F.lit(True)
        for c in cs:
            out = out & c(df)
        return out

    return test


def any_of(*cs: Condition) -> Condition:
    def test(df: DataFrame) -> Column:
        out = F.lit(False)
        for c in cs:
            out = out | c(df)
        return out

    return test


def where(condition: Condition | str | None, operator: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The operator on rows that meet the condition, the others as they are.

    The condition sees the row as it is before this operator; a chain of operators under one condition
    sees each other's results. Columns that the operator makes are null on the other rows. An operator
    that removes or multiplies rows runs on the rows that meet the condition only.
    """
    if condition is None:
        return operator
    test = sql(condition) if isinstance(condition, str) else condition
    changes = getattr(operator, "changes_rows", False)

    def run(df: DataFrame) -> DataFrame:
        mark, was = unused("__if", df), unused("__old", df)  # conditions may stand in conditions
        if changes:
            marked = df.withColumn(mark, test(df))
            yes = operator(marked.where(F.col(mark)).drop(mark))
            return yes.unionByName(marked.where(~F.col(mark)).drop(mark), allowMissingColumns=True)
        # Catalyst takes the struct apart again, and drops the choice for columns that did not change
        before = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        done = operator(df.withColumns({mark: test(df), was: before}))
        hit, shown = F.col(mark), []
        for f in done.schema.fields:
            if f.name in (mark, was):
                continue
            now, old = F.col(f"`{f.name}`"), F.col(was)[f.name]
            if f.name in df.columns:
                same = f.dataType == df.schema[f.name].dataType
                now = F.when(hit, now).otherwise(old if same else old.try_cast(f.dataType))
            else:
                now = F.when(hit, now)
            shown.append(now.alias(f.name))
        gone = [F.when(~hit, F.col(was)[c]).alias(c) for c in df.columns if c not in done.columns]
        return done.select(*shown, *gone)

    run.changes_rows = changes
    return run


def unused(name: str, df: DataFrame) -> str:
    """The name, with a number behind it if a column bears it."""
    return next(n for n in (name, *(f"{name}{k}" for k in range(1, len(df.columns) + 2))) if n not in df.columns)


def choice(*tests: Condition | None) -> Condition:
    """The number of the first condition of a chain that holds, null if none does; None stands for else."""

    def number(df: DataFrame) -> Column:
        return F.coalesce(*(F.when((always if t is None else t)(df), k) for k, t in enumerate(tests)), F.lit(None).cast("int"))

    return number
