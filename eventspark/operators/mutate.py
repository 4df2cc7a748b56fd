"""Changes of fields: rename, replace, case, strip, remove, copy, substitute, convert, split, join, add, tags."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import add_tags, as_text, field, has, kind_of, remove_tags, template, text_of, with_field, without_field
from ..functions.regex import java, java_replacement

Operator = Callable[[DataFrame], DataFrame]
_TRUE = ["true", "1", "yes", "t", "y"]


def rename(names: Mapping[str, str]) -> Operator:
    """Moves fields that are present; where the source is absent, the target keeps its value."""

    def run(df: DataFrame) -> DataFrame:
        for old, new in names.items():
            if has(df, old) and old != new:
                value = field(df, old)
                if has(df, new) and kind_of(df, new) == kind_of(df, old):
                    value = F.coalesce(value, field(df, new))
                df = without_field(with_field(df, new, value), old)
        return df

    return run


def replace(values: Mapping[str, str]) -> Operator:
    """Sets fields to templates."""
    return lambda df: _set(df, values)


add_field = replace


def _set(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    for name, source in values.items():
        df = with_field(df, template_name(df, name), template(df, source))
    return df


def template_name(df: DataFrame, name: str) -> str:
    if "%{" in name:
        raise ValueError("a column's name cannot depend on the row; put the value into a map column")
    return name


def _on_text(change: Callable) -> Callable[..., Operator]:
    def make(fields: Sequence[str]) -> Operator:
        def run(df: DataFrame) -> DataFrame:
            for name in fields:
                if has(df, name):
                    df = with_field(df, name, change(text_of(df, name)))
            return df

        return run

    return make


uppercase = _on_text(F.upper)
lowercase = _on_text(F.lower)
#: White space of any kind at both ends.
strip = _on_text(lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def remove_field(fields: Sequence[str]) -> Operator:
    def run(df: DataFrame) -> DataFrame:
        for name in fields:
            df = without_field(df, name)
        return df

    return run


def copy(names: Mapping[str, str]) -> Operator:
    def run(df: DataFrame) -> DataFrame:
        for old, new in names.items():
            if has(df, old):
                value = field(df, old)
                if has(df, new) and kind_of(df, new) == kind_of(df, old):
                    value = F.coalesce(value, field(df, new))
                df = with_field(df, new, value)
        return df

    return run


def gsub(changes: Sequence[tuple[str, str, str]]) -> Operator:
    """(field, pattern, replacement) in order; replacements may use $1."""

    def run(df: DataFrame) -> DataFrame:
        for name, pattern, new in changes:
            if has(df, name):
                df = with_field(df, name, F.regexp_replace(text_of(df, name), java(pattern), java_replacement(new)))
        return df

    return run


def convert(kinds: Mapping[str, str], keep_failed: str | None = None, keep_value: bool = False) -> Operator:
    """integer and float take whole numbers as written (nothing around them), boolean is true for
    true, 1, yes, t and y, string is the text form.

    A column has one type: where a number cannot be read the value becomes null, and its text is kept in
    the field `keep_failed`.format(name) if that is given. With keep_value the column becomes a VARIANT that holds
    the number where there is one, and the value as it was where there is none.
    """

    def run(df: DataFrame) -> DataFrame:
        for name, kind in kinds.items():
            if not has(df, name):
                continue
            text = text_of(df, name)
            old = kind_of(df, name)
            if kind == "integer":
                new = field(df, name).cast("long") if isinstance(old, (T.DoubleType, T.FloatType)) else F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))
            elif kind == "float":
                new = F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
            elif kind == "boolean":
                new = F.lower(text).isin(_TRUE)
            elif kind == "string":
                new = text
            else:
                raise ValueError(f"cannot convert to {kind!r}")
            if keep_failed and kind in ("integer", "float"):
                df = with_field(df, keep_failed.format(name), F.when(new.isNull(), text))
            if keep_value and kind in ("integer", "float"):
                new = F.coalesce(F.when(new.isNotNull(), F.call_function("to_variant_object", F.array(new))), F.when(text.isNotNull(), F.call_function("to_variant_object", F.array(text))))
                new = F.try_variant_get(new, "$[0]", "variant")
            df = with_field(df, name, new)
        return df

    return run


def split(separators: Mapping[str, str]) -> Operator:
    """Text to an array, by a literal separator."""

    def run(df: DataFrame) -> DataFrame:
        for name, sep in separators.items():
            if has(df, name):
                df = with_field(df, name, F.split(text_of(df, name), _quoted(sep), -1))
        return df

    return run


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def join(separators: Mapping[str, str]) -> Operator:
    """An array to text."""

    def run(df: DataFrame) -> DataFrame:
        for name, sep in separators.items():
            kind = kind_of(df, name)
            if isinstance(kind, T.ArrayType):
                df = with_field(df, name, F.array_join(F.transform(field(df, name), lambda x: F.coalesce(as_text(x, kind.elementType), F.lit(""))), sep))
        return df

    return run


def merge(fields: Mapping[str, str]) -> Operator:
    """Appends the second field (an array, or one value) to the first, which becomes an array."""

    def as_array(df: DataFrame, name: str):
        value = field(df, name)
        return value if isinstance(kind_of(df, name), T.ArrayType) else F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast(T.ArrayType(kind_of(df, name))))

    def run(df: DataFrame) -> DataFrame:
        for into, other in fields.items():
            if has(df, into) and has(df, other):
                df = with_field(df, into, F.concat(as_array(df, into), F.coalesce(as_array(df, other), F.array())))
        return df

    return run


def coerce(values: Mapping[str, str]) -> Operator:
    """A template for fields that are absent or null."""

    def run(df: DataFrame) -> DataFrame:
        for name, source in values.items():
            df = with_field(df, name, F.coalesce(text_of(df, name), template(df, source)))
        return df

    return run


def add_tag(names: Sequence[str]) -> Operator:
    return lambda df: add_tags(df, *names)


def remove_tag(names: Sequence[str]) -> Operator:
    return lambda df: remove_tags(df, *names)


#: The order in which one mutate applies its parts, whatever order they are given in.
ORDER = ["rename", "replace", "uppercase", "lowercase", "strip", "remove_field", "copy", "gsub", "convert", "split", "join", "merge", "coerce", "add_field", "add_tag", "remove_tag"]


def mutate(**parts) -> Operator:
    """Several of the above as one operator, in the fixed ORDER."""
    unknown = set(parts) - set(ORDER)
    if unknown:
        raise ValueError(f"mutate has no {sorted(unknown)}")
    steps = [globals()[name](parts[name]) for name in ORDER if name in parts]

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run
