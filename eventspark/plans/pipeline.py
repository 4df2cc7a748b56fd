"""Pipelines given as data: inputs, filters under conditions, outputs, and pipelines that feed each other.

A pipeline is a plain mapping (from JSON, YAML or Python):

    {"filters": [{"use": "grok", "with": {"source": "message", "patterns": "..."}, "if": "level = 'x'"}, ...],
     "outputs": [{"to": <writer or address>, "if": "..."}]}

Conditions are SQL or functions of functions.conditions. Filters are applied in order with
DataFrame.transform, each seeing what the ones before it did, so Catalyst sees one plan.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.conditions import choice, sql, unused, where
from ..operators import lookups, mutate, network, parse, rows, script, shape
from ..streaming import state

Operator = Callable[[DataFrame], DataFrame]

FILTERS: dict[str, Callable[..., Operator]] = {
    "mutate": mutate.mutate, "rename": mutate.rename, "grok": parse.grok, "dissect": parse.dissect, "kv": parse.kv, "json": parse.json,
    "csv": parse.csv, "xml": parse.xml, "date": parse.date, "useragent": parse.useragent, "syslog_pri": parse.syslog_pri,
    "prune": shape.prune, "de_dot": shape.de_dot, "truncate": shape.truncate, "urldecode": shape.urldecode, "bytes": shape.bytes_,
    "uuid": shape.uuid, "json_encode": shape.json_encode, "fingerprint": shape.fingerprint, "anonymize": shape.anonymize,
    "drop": rows.drop, "clone": rows.clone, "split": rows.split, "sleep": rows.sleep, "cidr": network.cidr, "geoip": network.geoip,
    "dns": network.dns, "translate": lookups.translate, "jdbc_static": lookups.lookup_table, "jdbc_streaming": lookups.lookup_query,
    "elasticsearch": lookups.lookup_service, "http": lookups.lookup_service, "memcached": lookups.memcached_get, "script": script.script,
    "code": script.code, "aggregate": state.aggregate, "throttle": state.throttle, "meter": state.meter, "timer": state.timer,
    "multiline": state.multiline,
}


def register_filter(name: str, make: Callable[..., Operator]) -> None:
    """Adds an operator under a name of one's own."""
    FILTERS[name] = make


def expand_env(text: str, env: Mapping[str, str] | None = None) -> str:
    """`${NAME}` and `${NAME:default}`; a name without value and default stays as it is."""
    known = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: known.get(m[1], m[0] if m[2] is None else m[2]), text)


def step(spec: Mapping) -> Operator:
    """One filter, or a chain of branches: {"branches": [{"if": ..., "then": [filters]}, ..., {"then": [...]}]}.

    Which branch a row takes is settled before any of them changes it.
    """
    if "branches" in spec:
        which = choice(*(sql(b["if"]) if isinstance(b.get("if"), str) else b.get("if") for b in spec["branches"]))
        steps = [(k, step(s)) for k, branch in enumerate(spec["branches"]) for s in branch["then"]]

        def run(df: DataFrame) -> DataFrame:
            name = unused("__branch", df)
            out = df.withColumn(name, which(df))
            for k, s in steps:
                out = where(lambda _, k=k: F.coalesce(F.col(name) == k, F.lit(False)), s)(out)
            return out.drop(name)

        run.changes_rows = any(getattr(s, "changes_rows", False) for _, s in steps)
        return run
    if spec["use"] not in FILTERS:
        raise ValueError(f"no filter {spec['use']!r}")
    return where(spec.get("if"), FILTERS[spec["use"]](**spec.get("with", {})))


def chain(steps: Sequence[Operator]) -> Operator:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    run.changes_rows = any(getattr(s, "changes_rows", False) for s in steps)
    return run


def compile_filters(specs: Sequence[Mapping]) -> Operator:
    """All of a pipeline's filters as one operator; faults in the specification show here."""
    return chain([step(s) for s in specs])


def union(*frames: DataFrame) -> DataFrame:
    """All inputs as one, columns by name, absent ones null."""
    out, *rest = frames
    for more in rest:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def run_pipeline(inputs: Sequence[DataFrame], filters: Sequence[Mapping], outputs: Sequence[Mapping]) -> DataFrame:
    """Filters the union of the inputs and writes it; the filtered rows are given back."""
    from ..sinks.writers import routed

    done = union(*inputs).transform(compile_filters(filters))
    routed(done, [(o.get("if"), o["to"]) for o in outputs if callable(o["to"])])
    return done


def connect(pipelines: Mapping[str, Mapping], sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Pipelines that feed each other through addresses, each filtered once, in order of who feeds whom.

    A pipeline's `from` lists sources and addresses; its outputs' `to` names an address. What no pipeline
    reads is in the result under its address, and every pipeline's own rows under its name.
    """
    senders: dict[str, list[str]] = {}
    for name, p in pipelines.items():
        for o in p.get("outputs", []):
            senders.setdefault(o["to"], []).append(name)
    needs = {name: {s for a in p["from"] for s in senders.get(a, [])} for name, p in pipelines.items()}
    frames, sent = dict(sources), {}
    for name in TopologicalSorter(needs).static_order():
        p = pipelines[name]
        parts = [frames[a] if a in frames else union(*sent[a]) for a in p["from"]]
        done = union(*parts).transform(compile_filters(p.get("filters", [])))
        frames[name] = done
        for o in p.get("outputs", []):
            test = o.get("if")
            out = done if test is None else done.where((sql(test) if isinstance(test, str) else test)(done))
            sent.setdefault(o["to"], []).append(out)
    return frames | {a: union(*parts) for a, parts in sent.items() if a not in frames}


def counters(df: DataFrame, name: str | Observation, failures: Sequence[str] = (), message: str | None = None) -> DataFrame:
    """The rows with an observation of how many passed, how many carry failure tags, and the bytes of a text (see df.observe)."""
    parts = [F.count("*").alias("events")]
    if failures and "tags" in df.columns:
        bad = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, failures)))
        parts.append(F.count(F.when(bad, 1)).alias("failed"))
    if message:
        parts.append(F.sum(F.octet_length(message)).cast("long").alias("bytes"))
    return df.observe(name, *parts)
