"""Scripts: assignments as SQL expressions, and the vector functions that scripts use.

The expression language is Spark SQL, which has the arithmetic, text, date, map and array functions of
the reference's script language; what differs is listed in SQL_FOR.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import add_tags, kind_of, named_parameters, sql_literal, with_field

Operator = Callable[[DataFrame], DataFrame]

#: What to write for script functions whose SQL has another name or a catch. s: text, a: array, m: map, t: timestamp.
SQL_FOR = {
    "a / b (whole numbers)": "try_divide is fractional; write `a div b`, which cuts towards zero",
    "x ? a : b": "if(x, a, b)",
    "length (bytes)": "octet_length(s)",
    "indexOf": "locate(t, s) - 1",
    "charAt(i)": "substring(s, i + 1, 1)",
    "substring(i, j)": "substring(s, i + 1, j - i)",
    "split": "split(s, '\\\\Q,\\\\E')",
    "s ==~ /p/": r"s rlike '\\A(?:p)\\z'",
    "s =~ /p/": "s rlike 'p'",
    "a.indexOf(x)": "array_position(a, x) - 1",
    "a[i], a.get(i)": "get(a, i)",
    "a.add(x)": "array_append(a, x)",
    "a.remove(i)": "concat(slice(a, 1, i), slice(a, i + 2, size(a)))",
    "a.join(t)": "array_join(a, t)",
    "m.get(k)": "try_element_at(m, k)",
    "m.put(k, x)": "map_concat(map_filter(m, (k0, v) -> k0 <> k), map(k, x))",
    "m.remove(k)": "map_filter(m, (k0, v) -> k0 <> k)",
    "m.containsValue(x)": "array_contains(map_values(m), x)",
    "getDayOfWeek": "weekday(t) + 1",
    "toEpochMilli": "unix_millis(t)",
    "plusDays(n)": "t + make_dt_interval(n)",
    "Integer.parseInt": "cast(s as int), or try_cast to get null",
    "Math.log": "ln(x)",
    "Math.round (half up)": "round(x), which takes halves away from zero",
    "for (x : list) sum += x": "aggregate(list, 0L, (s, x) -> s + x)",
    "for (i = 0; i < n; i++)": "aggregate(sequence(0, n - 1), start, (s, i) -> ...)",
    "try { x } catch { y }": "coalesce(try_...(x), y)",
}

#: Compound assignments and the operators they stand for; `/=` on whole numbers cuts towards zero.
COMPOUND = ("+=", "-=", "*=", "/=", "%=")


def script(assignments: Mapping[str, str], params: Mapping[str, object] | None = None, tag: str = "_scripterror") -> Operator:
    """Assigns SQL expressions in order; each sees those before it, and params by :name.

    A name may end in a compound operator: {"n +=": "2"} adds to n; += joins text. Whole numbers that overflow
    and division by zero give null (use the try_ functions for others). A row on which an assignment gives null
    is tagged and left as it was, be it that something failed or that a field it reckons with is absent; where
    that is no error, coalesce() says so.
    """

    def run(df: DataFrame) -> DataFrame:
        out, olds = df, {}
        for target, text in assignments.items():
            name, _, operator = target.partition(" ")
            text = named_parameters(text, {k: sql_literal(v) for k, v in (params or {}).items()})
            if operator:
                text = _compound(out, name, operator, text)
            if name not in olds:
                olds[name] = F.col(f"`{name}`") if name in df.columns else None
                if olds[name] is not None:
                    out = out.withColumn(f"__old_{name}", olds[name])
            out = with_field(out, f"[{name}]", F.expr(text))
        if not assignments:
            return df
        bad = reduce(lambda x, name: x | F.col(f"`{name}`").isNull(), olds, F.lit(False))
        out = out.withColumn("__bad", bad)
        for name, old in olds.items():
            was = F.col(f"`__old_{name}`") if old is not None else F.lit(None)
            kind = kind_of(out, f"[{name}]")
            out = with_field(out, f"[{name}]", F.when(F.col("__bad"), was.try_cast(kind)).otherwise(F.col(f"`{name}`")))
        return add_tags(out, tag, when=F.col("__bad")).drop("__bad", *(f"__old_{n}" for n in olds))

    return run


def _compound(df: DataFrame, name: str, operator: str, text: str) -> str:
    if operator not in COMPOUND:
        raise ValueError(f"not an assignment: {operator!r}")
    kinds = [df.select(F.expr(x)).schema[0].dataType for x in (f"`{name}`", text)]
    whole = all(isinstance(k, T.IntegralType) for k in kinds)
    if operator == "+=" and any(isinstance(k, T.StringType) for k in kinds):
        return f"concat(`{name}`, ({text}))"
    if operator == "/=":
        return f"`{name}` div nullif(({text}), 0)" if whole else f"try_divide(`{name}`, ({text}))"
    if operator == "%=":
        return f"`{name}` % nullif(({text}), 0)"
    return f"{({'+=': 'try_add', '-=': 'try_subtract', '*=': 'try_multiply'})[operator]}(`{name}`, ({text}))"


def code(function: Callable, schema: str) -> Operator:
    """Python on batches, for what no expression can say: pandas frames in and out (mapInPandas)."""
    return lambda df: df.mapInPandas(lambda batches: (function(pdf) for pdf in batches), schema)


# ---------------------------------------------------------------------------------------------------
# vectors: arrays of numbers of one length; null if the lengths differ

def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), total)


def dot_product(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    norms = F.sqrt(dot_product(a, a)) * F.sqrt(dot_product(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot_product(a, b) / F.nullif(norms, F.lit(0.0)))


def l1_norm(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def l2_norm(a: Column, b: Column) -> Column:
    return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def hamming(a: Column, b: Column) -> Column:
    """Number of places at which two arrays differ."""
    return _pairs(a, b, lambda x, y: (x != y).cast("double")).cast("long")
