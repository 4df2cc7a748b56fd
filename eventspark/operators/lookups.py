"""Lookup joins: events against dictionaries, tables and services."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import add_tags, field, has, named_parameters, template, text_of, with_field
from ..functions.regex import java

Operator = Callable[[DataFrame], DataFrame]
#: A dictionary of this many entries or fewer is written into the plan.
LITERALS = 200


def translate(source: str, dictionary: Mapping[str, str] | DataFrame, target: str = "translation", fallback: str | None = None, exact: bool = True, regex: bool = False, override: bool = True) -> Operator:
    """Looks a field's text up in a dictionary (a mapping, or a DataFrame with key and value).

    exact: equal to the key; regex: the first pattern, in order of the keys, that is found in the text;
    otherwise every key found in the text, in order of the keys, is replaced by its value. Rows without
    the field stay as they are; without a hit the fallback (a template) is set, if any.
    """

    def run(df: DataFrame) -> DataFrame:
        if not has(df, source):
            return df
        text = text_of(df, source)
        if isinstance(dictionary, DataFrame) or exact and not regex and len(dictionary) > LITERALS:
            table = dictionary if isinstance(dictionary, DataFrame) else df.sparkSession.createDataFrame(list(dictionary.items()), "key string, value string")
            # Spark broadcasts the dictionary if its size allows, and sorts both sides if not
            table = table.groupBy(F.col("key").alias("__k")).agg(F.max("value").alias("__hit"))
            out = df.withColumn("__t", text).join(table, F.col("__t") == F.col("__k"), "left").drop("__k", "__t")
        else:
            hit: Column = F.lit(None).cast("string")
            if regex:
                for key, value in sorted(dictionary.items(), reverse=True):
                    hit = F.when(text.rlike(java(key)), value).otherwise(hit)
            elif exact:
                hit = F.element_at(F.create_map(*(F.lit(x) for kv in dictionary.items() for x in kv)), text) if dictionary else hit
            else:
                changed = text
                for key, value in sorted(dictionary.items()):
                    changed = F.replace(changed, F.lit(key), F.lit(value))
                hit = F.when(changed != text, changed)
            out = df.withColumn("__hit", hit)
        value = F.col("__hit")
        if fallback is not None:
            value = F.coalesce(value, F.when(text_of(out, source).isNotNull(), template(out, fallback)))
        if has(df, target):
            old = field(df, target).cast("string")
            value = F.coalesce(value, old) if override or target == source else F.coalesce(old, value)
        return with_field(out, target, value).drop("__hit")

    return run


def lookup_table(table: DataFrame, on: Mapping[str, str], target: str, columns: Sequence[str] | None = None, order: Sequence[str] | None = None, tag_missing: str | None = None) -> Operator:
    """All rows of a table whose key columns equal the event's fields, as an array of structs; [] without any.

    on: field of the event -> column of the table. The table is grouped by its key once; Spark broadcasts
    the result if its size allows and joins by shuffle if not, splitting keys that are too frequent.
    """

    def run(df: DataFrame) -> DataFrame:
        keys = list(on.values())
        shown = list(columns or table.columns)
        row = F.struct(*shown)
        rows = F.array_sort(F.collect_list(F.struct(*(order or shown), row.alias("__row"))))
        grouped = table.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.transform(rows, lambda r: r["__row"]).alias("__rows"))
        test = F.lit(True)
        for i, (name, k) in enumerate(on.items()):
            test = test & (field(df, name).cast(table.schema[k].dataType) == F.col(f"__k{i}"))
        out = df.join(grouped, test, "left").drop(*(f"__k{i}" for i in range(len(keys))))
        missing = F.col("__rows").isNull()
        if tag_missing:
            out = add_tags(out, tag_missing, when=missing)
        return with_field(out, target, F.coalesce("__rows", F.array().cast(grouped.schema["__rows"].dataType))).drop("__rows")

    return run


def lookup_join(table: DataFrame, on: Mapping[str, str], how: str = "left", columns: Mapping[str, str] | None = None) -> Operator:
    """A lookup that sets columns (table column -> field) instead of an array; how may also be inner, semi or anti."""

    def run(df: DataFrame) -> DataFrame:
        names = columns or {c: c for c in table.columns if c not in on.values()}
        side = table.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(on.values())), *(F.col(c).alias(n) for c, n in names.items()))
        test = F.lit(True)
        for i, name in enumerate(on):
            test = test & (field(df, name) == F.col(f"__k{i}"))
        return df.join(side, test, how).drop(*(f"__k{i}" for i in range(len(on))))

    return run


def lookup_query(statement: str, parameters: Mapping[str, str], target: str, tag: str | None = "_jdbcstreamingfailure") -> Operator:
    """A parametrised query per event, done as one join: the statement, SQL over registered views with
    named parameters `:name`, is turned into a lateral subquery on the event's fields (parameter -> field).
    Rows without one of these fields get an empty array and the tag, as nothing can be asked for them."""

    def run(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        text = named_parameters(statement, {name: f"__ev.`{source}`" for name, source in parameters.items()})
        fields = spark.sql(statement, args={n: None for n in parameters}).columns
        row = ", ".join(f"'{c}', `{c}`" for c in fields)
        out = spark.sql(f"SELECT __ev.*, __l.__rows FROM {{ev}} AS __ev LEFT JOIN LATERAL (SELECT collect_list(named_struct({row})) AS __rows FROM ({text})) AS __l", ev=df)
        if tag:
            absent = F.lit(False)
            for source in parameters.values():
                absent = absent | F.col(f"`{source}`").isNull()
            out = add_tags(out, tag, when=absent)
        return with_field(out, target, F.coalesce("__rows", F.array().cast(out.schema["__rows"].dataType))).drop("__rows")

    return run


def resolve(df: DataFrame, key: Column, service: Callable[[], Callable[[str], str | None]], target: str) -> DataFrame:
    """Asks a service once for each distinct key and joins the answers back.

    service() opens a session once a task and gives a function from key to answer (None: no answer).
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = service()
        for pdf in batches:
            yield pd.DataFrame({"__k": pdf["__k"], target: [answer(k) for k in pdf["__k"]]})

    keyed = df.withColumn("__key", key)
    answers = keyed.select(F.col("__key").alias("__k")).where("__k IS NOT NULL").distinct().mapInPandas(ask, f"__k string, `{target}` string")
    return keyed.join(answers, F.col("__key") == F.col("__k"), "left").drop("__k", "__key")


def lookup_service(key: str, service: Callable[[], Callable[[str], str | None]], target: str, schema: str | None = None, tag: str = "_httprequestfailure") -> Operator:
    """A REST, search, cache or other service per distinct key (a template); answers are text, or JSON read
    with a schema. No answer tags the row."""

    def run(df: DataFrame) -> DataFrame:
        out = resolve(df, template(df, key), service, "__answer")
        value = F.from_json("__answer", schema) if schema else F.col("__answer")
        out = with_field(out, target, value)
        return add_tags(out, tag, when=F.col("__answer").isNull()).drop("__answer")

    return run


def memcached_get(keys: Mapping[str, str], client: Callable[[], Callable[[str], str | None]]) -> Operator:
    """key template -> field; the client is any cache that answers by key."""

    def run(df: DataFrame) -> DataFrame:
        for key, name in keys.items():
            out = resolve(df, template(df, key), client, "__answer")
            value = F.coalesce("__answer", field(df, name).cast("string")) if has(df, name) else F.col("__answer")
            df = with_field(out, name, value).drop("__answer")
        return df

    return run


def memcached_set(values: Mapping[str, str], client: Callable[[], Callable[[str, str], None]]) -> Callable[[DataFrame], None]:
    """field -> key template: writes the fields' texts to a cache. client() opens a session once a task and gives
    a function of key and value. Of several rows with one key the greatest value is written, so that a task that
    runs again writes the same. An action, so it is called in foreachBatch or at the end of a batch job."""

    def run(df: DataFrame) -> None:
        def put(rows) -> None:
            write = client()
            for row in rows:
                write(row["k"], row["v"])

        for name, key in values.items():
            if has(df, name):
                pairs = df.select(template(df, key).alias("k"), text_of(df, name).alias("v")).where("v IS NOT NULL")
                pairs.groupBy("k").agg(F.max("v").alias("v")).foreachPartition(put)

    return run
