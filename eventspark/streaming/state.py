"""Keyed state: aggregate, throttle, metrics, multiline.

Each operator has a batch form, which works on windows over an explicit order, and, where state has to
outlive a micro-batch, a streaming form on applyInPandasWithState. Order is a column (or several) given
by the caller, as rows of a table have none.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import Condition, sql
from ..functions.fields import add_tags, field, template
from ..functions.regex import java

Operator = Callable[[DataFrame], DataFrame]


def _test(condition: Condition | str | None, df: DataFrame) -> Column:
    return F.lit(False) if condition is None else sql(condition)(df) if isinstance(condition, str) else condition(df)


def aggregate(task: str, order: Sequence[str], fields: Sequence[str], map_action: str = "update", end_of_task: Condition | str | None = None, timeout: float | None = None, time: str = "@timestamp", push_on_timeout: bool = True) -> Operator:
    """Emits a row with a task's collected fields before the row that ends the task, or after a timeout.

    create: the fields of the task's first row; update: of each field the last value that is present. The
    timeout (seconds of event time) runs from the first row in create mode and from the last in update
    mode; maps it ends carry the tag _aggregatetimeout. Maps of tasks that never end are emitted if
    push_on_timeout and a timeout is given. Made rows have `is_map` true and the task's fields only.
    """

    def run(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("__task", template(df, task)).withColumn("__end", _test(end_of_task, df))
        by = Window.partitionBy("__task").orderBy(*order)
        # a new map starts after each end, and after a gap if there is a timeout
        start = F.coalesce(F.lag("__end").over(by), F.lit(True))
        if timeout and map_action == "update":
            gap = F.col(f"`{time}`").cast("double") - F.lag(F.col(f"`{time}`").cast("double")).over(by)
            start = start | F.coalesce(gap >= timeout, F.lit(False))
        marked = keyed.withColumn("__start", start)
        run_no = F.sum(F.col("__start").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
        marked = marked.withColumn("__run", run_no)
        if timeout and map_action == "create":
            first = F.min(F.col(f"`{time}`").cast("double")).over(Window.partitionBy("__task", "__run"))
            marked = marked.withColumn("__run", F.struct("__run", F.floor((F.col(f"`{time}`").cast("double") - first) / timeout).alias("w")))
        position = F.struct(*order)
        values = []
        for name in fields:
            value = F.col(f"`{name}`")
            seen = F.min_by(value, position) if map_action == "create" else F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), position))
            values.append(seen.alias(name))
        ended = F.max("__end").alias("__ended")
        maps = marked.groupBy("__task", "__run").agg(*values, ended, F.max(position).alias("__last"))
        if timeout and push_on_timeout:
            maps = maps.withColumn("tags", F.when(F.col("__ended"), F.array().cast("array<string>")).otherwise(F.array(F.lit("_aggregatetimeout"))))
        else:
            maps = maps.where("__ended").withColumn("tags", F.array().cast("array<string>"))
        shown = [F.col("__last")[o].alias(o) for o in order if o not in fields]
        maps = maps.select(*shown, *fields, "tags", F.lit(True).alias("is_map"), F.col("__task").alias("task_id"))
        rows = keyed.drop("__end").withColumn("is_map", F.lit(False)).withColumnRenamed("__task", "task_id")
        return rows.unionByName(maps, allowMissingColumns=True)

    return run


def throttle(key: str, order: Sequence[str], time: str = "@timestamp", before_count: int = -1, after_count: int = -1, period: float = 3600, tag: str = "_throttle") -> Operator:
    """Tags rows whose count in their key's window is at most before_count or over after_count (-1: no limit).

    A window opens with the key's first row and reopens with the first row at least `period` seconds later,
    so windows depend on each other; each key's rows are read in order, streamed through Arrow batches whose
    columns stay as they are, and only the open window's start and count are held.
    """

    def run(df: DataFrame) -> DataFrame:
        names = df.columns
        keyed = df.withColumns({"__key": template(df, key), "__time": F.col(f"`{time}`").cast("timestamp").cast("double")})
        ordered = keyed.repartition("__key").sortWithinPartitions("__key", *order)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, opened, n = object(), 0.0, 0
            for batch in batches:
                keys = batch.column(batch.schema.get_field_index("__key"))
                times = batch.column(batch.schema.get_field_index("__time")).to_numpy(zero_copy_only=False)
                codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True]))) if len(codes) else [0]
                counts = np.empty(batch.num_rows, np.int64)
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    if keys[int(s)].as_py() != now:
                        now, opened, n = keys[int(s)].as_py(), times[s], 0
                    at, step = int(s), 64
                    while at < e:  # from one reopening of the window to the next
                        late = np.flatnonzero(times[at : min(at + step, e)] - opened >= period)
                        to = at + int(late[0]) if len(late) else min(at + step, int(e))
                        counts[at:to] = np.arange(n + 1, n + 1 + to - at)
                        n += to - at
                        at, step = to, step * 2
                        if len(late):
                            opened, n, step = times[at], 0, 64
                            counts[at], n, at = 1, 1, at + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*batch.schema.names, "__n"])

        schema = T.StructType([*keyed.schema.fields, T.StructField("__n", T.LongType())])
        counted = ordered.mapInArrow(count, schema)
        hit = F.lit(False)
        if before_count >= 0:
            hit = hit | (F.col("__n") <= before_count)
        if after_count >= 0:
            hit = hit | (F.col("__n") > after_count)
        tagged = add_tags(counted, tag, when=hit)
        return tagged.select(*names, *([] if "tags" in names else ["tags"]))

    return run


def _in_order(batches: Iterator[pd.DataFrame], by: str, rows: int = 1000, fan_in: int = 32) -> Iterator[pd.DataFrame]:
    """The rows of all batches ordered by a column, in frames of bounded size: an external merge sort.

    Each batch is a sorted run in a temporary file; of at most fan_in runs at a time a slice is in memory.
    """
    with tempfile.TemporaryFile() as file:

        def store(frames: Iterator[pd.DataFrame]) -> list[int]:
            places = []
            for pdf in frames:
                for k in range(0, len(pdf), rows):
                    places.append(file.seek(0, 2))
                    pickle.dump(pdf.iloc[k : k + rows], file)
            return places

        def load(place: int) -> pd.DataFrame:
            file.seek(place)
            return pickle.load(file)

        def merged(runs: list[list[int]]) -> Iterator[pd.DataFrame]:
            runs = [list(reversed(r)) for r in runs]
            heads = [load(r.pop()) for r in runs]
            while heads:
                # what unread slices hold is not smaller than the last row of their run's head
                bounds = [h[by].iloc[-1] for h, r in zip(heads, runs, strict=True) if r]
                bound = min(bounds) if bounds else None
                cuts = [len(h) if bound is None else int(h[by].searchsorted(bound, side="right")) for h in heads]
                ready = [h.iloc[:c] for h, c in zip(heads, cuts, strict=True) if c]
                yield pd.concat(ready).sort_values(by, kind="stable", ignore_index=True)
                heads = [h.iloc[c:] for h, c in zip(heads, cuts, strict=True)]
                left = [(h if len(h) else load(r.pop()), r) for h, r in zip(heads, runs, strict=True) if len(h) or r]
                heads, runs = [h for h, _ in left], [r for _, r in left]

        runs = []
        for pdf in batches:
            if not len(pdf):
                continue
            runs.append(store([pdf.sort_values(by, kind="stable")]))
            if len(runs) == fan_in * fan_in:
                runs = [store(merged(runs[k : k + fan_in])) for k in range(0, len(runs), fan_in)]
        while len(runs) > fan_in:
            runs = [store(merged(runs[k : k + fan_in])) for k in range(0, len(runs), fan_in)]
        yield from merged(runs)


def _as_text(kind: T.DataType) -> T.DataType:
    """The type with text in place of numbers, which pandas would round where nulls are among them."""
    if isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_as_text(kind.keyType), _as_text(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType), f.nullable) for f in kind.fields])
    return kind


def _cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields), *(c for c in df.columns if c not in schema.names))


def _sortable(df: DataFrame, name: str) -> Column:
    """A column that pandas sorts as Spark does: whole numbers as decimals."""
    return F.col(f"`{name}`").cast("decimal(20,0)") if isinstance(df.schema[name].dataType, T.IntegralType) else F.col(f"`{name}`")


def throttle_stream(df: DataFrame, key: str, before_count: int = -1, after_count: int = -1, period: float = 3600, max_age: float | None = 86400, time: str = "@timestamp", tag: str = "_throttle") -> DataFrame:
    """throttle() for streams: one counter and its start per key, dropped max_age seconds after its last use
    (None: kept; a stream with timeouts never runs out of work, so AvailableNow needs None). A key's rows of one
    micro-batch are counted in the order of time. Other columns come out as they went in."""
    plain = T.StructType([f for f in df.schema.fields if f.name != "tags"])
    text = _as_text(plain)
    schema = T.StructType([*text.fields, T.StructField("tags", T.ArrayType(T.StringType()))])

    def count(_, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, opened = state.get if state.exists else (0, None)
        for pdf in _in_order(batches, "__time"):
            marks = []
            for t in pdf["__time"]:
                t = t.timestamp()
                if opened is None or t - opened >= period:
                    n, opened = 0, t
                n += 1
                hit = 0 <= before_count and n <= before_count or 0 <= after_count < n
                marks.append([tag] if hit else [])
            old = pdf["tags"] if "tags" in pdf else [[]] * len(pdf)
            yield pdf.assign(tags=[[*(o if o is not None else []), *m] for o, m in zip(old, marks, strict=True)])[schema.names]
        state.update((n, opened))
        if max_age is not None:
            state.setTimeoutDuration(int(max_age * 1000))

    keyed = _cast(df.withColumns({"__key": template(df, key), "__time": F.col(f"`{time}`").cast("timestamp")}), text)
    counted = keyed.groupBy("__key").applyInPandasWithState(count, schema, "n long, opened double", "append", "NoTimeout" if max_age is None else "ProcessingTimeTimeout")
    return _cast(counted, plain)


def aggregate_stream(df: DataFrame, task: str, fields: Sequence[str], end: str, order: str | None = None, map_action: str = "update", timeout: float | None = 1800) -> DataFrame:
    """aggregate() for streams: emits each task's map (fields, tags, task_id) when a row has `end` true, or
    after `timeout` seconds without rows (None: never; a stream with timeouts does not run out of work).
    Rows that arrive in one batch are taken in order of `order`; a task's rows are never all in memory."""
    plain = T.StructType([df.schema[f] for f in fields])
    text = _as_text(plain)
    out = T.StructType([*text.fields, T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("task_id", T.StringType())])

    def collect(key, batches, state):
        values = dict(zip(fields, state.get, strict=True)) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{**values, "tags": ["_aggregatetimeout"], "task_id": key[0]}])
            return
        for pdf in _in_order(batches, "__order") if order else batches:
            made = []
            for row in pdf.to_dict("records"):
                new = {f: None if row[f] is pd.NaT or isinstance(row[f], float) else row[f].tolist() if isinstance(row[f], np.ndarray) else row[f] for f in fields}  # numbers are text: a float is an absent value
                if values is None:
                    values = new
                elif map_action == "update":
                    values |= {f: v for f, v in new.items() if v is not None}
                if row["__end"]:
                    made.append({**values, "tags": [], "task_id": key[0]})
                    values = None
            if made:
                yield pd.DataFrame(made)
        if values is None:
            state.remove()
        else:
            state.update(tuple(values[f] for f in fields))
            if timeout is not None:
                state.setTimeoutDuration(int(timeout * 1000))

    made = {"__task": template(df, task), "__end": F.coalesce(F.expr(end).cast("boolean"), F.lit(False))}
    keyed = df.withColumns(made | ({"__order": _sortable(df, order)} if order else {}))
    keyed = _cast(keyed.select(*fields, *made, *(["__order"] if order else [])), text)
    return _cast(keyed.groupBy("__task").applyInPandasWithState(collect, out, text, "append", "NoTimeout" if timeout is None else "ProcessingTimeTimeout"), plain)


def meter(fields: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> Operator:
    """Running count of the rows that have a field, as `<field>_count`."""

    def run(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"{f}_count": F.count(field(df, f)).over(w) for f in fields})

    return run


def timer(name: str, by: Sequence[str] = (), percentiles: Sequence[float] = (1, 5, 25, 50, 75, 95, 99), exact: bool = True) -> Operator:
    """Count, smallest, largest, mean and percentiles (interpolated) of a number, one row per group.

    exact=False uses a sketch of bounded size for groups that are too large to sort.
    """

    def run(df: DataFrame) -> DataFrame:
        value = field(df, name).cast("double")
        pick = F.percentile if exact else F.percentile_approx
        return df.groupBy(*by).agg(
            F.count(value).alias(f"{name}_count"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"), F.avg(value).alias(f"{name}_mean"),
            *(pick(value, F.lit(p / 100)).alias(f"{name}_p{p:g}") for p in percentiles),
        )

    return run


def rates(df: DataFrame, time: str, width: str, by: Sequence[str] = (), watermark: str | None = None) -> DataFrame:
    """Rows per window of time and group; with a watermark also for streams."""
    source = df.withWatermark(time, watermark) if watermark else df
    return source.groupBy(F.window(time, width), *by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), *by, "events")


def multiline(pattern: str, order: Sequence[str], by: Sequence[str] = (), source: str = "message", negate: bool = False, what: str = "previous", max_lines: int = 500, max_bytes: int | None = None, joiner: str = "\n") -> Operator:
    """Joins lines to events: a line that meets the pattern (or with negate one that does not) belongs to
    the previous or the next one. Events are cut after max_lines, and after the line with which their lines
    reach a multiple of max_bytes."""

    def run(df: DataFrame) -> DataFrame:
        hit = F.coalesce(F.col(source).rlike(java(pattern)), F.lit(False))
        hit = ~hit if negate else hit
        w = Window.partitionBy(*by).orderBy(*order)
        first = ~F.col("__hit") if what == "previous" else ~F.coalesce(F.lag("__hit").over(w), F.lit(False))
        out = df.withColumn("__hit", hit).withColumn("__first", first)
        out = out.withColumn("__event", F.sum(F.col("__first").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("__line", F.row_number().over(Window.partitionBy(*by, "__event").orderBy(*order)))
        part = [F.floor((F.col("__line") - 1) / max_lines)]
        if max_bytes:
            before = F.sum(F.octet_length(source) + len(joiner.encode())).over(Window.partitionBy(*by, "__event").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
            part.append(F.floor(F.coalesce(before, F.lit(0)) / max_bytes))
        out = out.withColumn("__part", F.struct(*(p.alias(f"p{k}") for k, p in enumerate(part))))
        position = F.struct(*order)
        lines = F.array_sort(F.collect_list(F.struct(position.alias("o"), F.col(source).alias("m"))))
        return out.groupBy(*by, "__event", "__part").agg(
            F.array_join(F.transform(lines, lambda x: x["m"]), joiner).alias(source), F.count("*").alias("lines"), *(F.min(o).alias(o) for o in order)
        ).drop("__event", "__part")

    return run
