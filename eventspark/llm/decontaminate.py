"""Benchmark decontamination with a generalised suffix automaton.

Benchmark items are normalised to words and put into one suffix automaton. Training words are streamed
through it; at every word the automaton knows the longest match that ends there. A window of 13 item
words occurs where that length reaches 13; an item of fewer words occurs where its whole length is
matched. The words under occurring windows are hit, and a document is contaminated when its hits reach
a share of its words.

The automaton is broadcast, so its size is checked: items are dealt into shards of at most
`shard_words` words (some 800 bytes each in the automaton), and the documents are streamed past one automaton
after another, of which the driver holds one at a time. What further shards find is written, by the hash of
the text, and added to what the first finds. The number of shards grows with the benchmark, the broadcast
does not.

Edge cases: null and empty texts have no words and no hits; items without words are ignored; repeated
item ids count once; repeated documents are judged alike, one row each; empty tables give empty (or
hit-free) results. Columns other than the named ones are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, alnum_words, column_bytes, sliced, table, written

WINDOW = 13
SHARD_WORDS = 200_000
SPANS = "array<struct<s:int,e:int>>"
NAMES = ("n_words", "spans", "items")


class SuffixAutomaton:
    """Of several word sequences; states know which windows end in them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: item windows that end in a state: (length, item)
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.shortest = window
        walked: list[tuple[list[bytes], int]] = []
        for name, sequence in items:
            if sequence:
                last = 0
                for word in sequence:
                    last = self._extend(last, word)
                walked.append((sequence, place[name]))
                self.shortest = min(self.shortest, len(sequence))
        self.vocabulary = frozenset(w for sequence, _ in walked for w in sequence)
        for sequence, item in walked:
            size = min(window, len(sequence))
            state = matched = 0
            for word in sequence:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.ends[at].add((size, item))
        # what ends in a state also ends wherever a longer match of it ends
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.found[state] = tuple(sorted(self.ends[state] | set(self.found[self.link[state]]), reverse=True))

    def _extend(self, last: int, word: bytes) -> int:
        def copy_of(at: int, length: int) -> int:
            self.next.append(dict(self.next[at]))
            self.link.append(self.link[at])
            self.length.append(length)
            self.ends.append(set())
            return len(self.next) - 1

        def turn(at: int, old: int, new: int) -> None:
            while at != -1 and self.next[at].get(word) == old:
                self.next[at][word] = new
                at = self.link[at]

        known = self.next[last].get(word)
        if known is not None:  # an earlier item already holds this
            if self.length[known] == self.length[last] + 1:
                return known
            twin = copy_of(known, self.length[last] + 1)
            self.link[known] = twin
            turn(last, known, twin)
            return twin
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.ends.append(set())
        new, at = len(self.next) - 1, last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            known = self.next[at][word]
            if self.length[known] == self.length[at] + 1:
                self.link[new] = known
            else:
                twin = copy_of(known, self.length[at] + 1)
                self.link[known] = self.link[new] = twin
                turn(at, known, twin)
        return new

    def step(self, state: int, matched: int, word: bytes) -> tuple[int, int]:
        """The longest match that ends with word, after one of `matched` words in `state`."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, matched + 1)

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (end exclusive, merged) and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        known, shortest, n, i = self.vocabulary, self.shortest, len(sequence), 0
        while i + shortest <= n:
            # a match lies within a run of benchmark words; shorter runs cannot hold one
            probe = i + shortest - 1
            while probe >= i and sequence[probe] in known:
                probe -= 1
            if probe >= i:
                i = probe + 1
                continue
            state = matched = 0
            while i < n and sequence[i] in known:
                state, matched = self.step(state, matched, sequence[i])
                i += 1
                if matched >= shortest:
                    for size, item in self.found[state]:
                        if size <= matched:
                            items.add(item)
                            if spans and spans[-1][1] >= i - size:
                                spans[-1] = (min(spans[-1][0], i - size), i)
                            else:
                                spans.append((i - size, i))
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_shards(benchmark: DataFrame, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with their words, a bounded number of words at a time."""
    shard: list[tuple[str, list[bytes]]] = []
    size = 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    for row in items.toLocalIterator():
        sequence = alnum_words(bytes(row["text"]))
        if not sequence:
            continue
        if shard and size + len(sequence) > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((row["item_id"], sequence))
        size += len(sequence)
    if shard:
        yield shard


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, key: list[str] | None = None, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """key columns, n_words, spans (array of word ranges) and items (array of item ids) of each document, under the given names."""
    spark = docs.sparkSession
    key = ["doc_id"] if key is None else key
    spans_type, items_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.string())

    def scanned(docs: DataFrame, kept: list[str], automaton: SuffixAutomaton) -> DataFrame:
        handle = Carried(spark, automaton)

        def run(batches):
            automaton: SuffixAutomaton = handle.value
            for batch in sliced(batches):
                counts, spans, items = [], [], []
                for text in column_bytes(batch, "text"):
                    sequence = alnum_words(text)
                    found, which = automaton.scan(sequence)
                    counts.append(len(sequence))
                    spans.append([{"s": s, "e": e} for s, e in _merged(found)])
                    items.append(sorted(automaton.names[k] for k in which))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, items_type)], names=[*kept, *names])

        schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{names[0]} long, {names[1]} {SPANS}, {names[2]} array<string>"])
        return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)

    shards = benchmark_shards(benchmark, shard_words)
    first = scanned(docs, key, SuffixAutomaton(next(shards, []), window))
    hashed, more = docs.select(F.xxhash64("text").alias("__th"), "text"), []
    for items in shards:
        hits = scanned(hashed, ["__th"], SuffixAutomaton(items, window)).where(F.size(names[1]) > 0)
        more.append(written(hits.select("__th", names[1], names[2]).dropDuplicates(["__th"]), "hits"))
    if not more:
        return first
    added = reduce(DataFrame.unionByName, more).groupBy("__th").agg(F.flatten(F.collect_list(names[1])).alias("__spans_"), F.flatten(F.collect_list(names[2])).alias("__items_"))
    first = scanned(docs.withColumn("__th", F.xxhash64("text")), [*key, "__th"], SuffixAutomaton(next(benchmark_shards(benchmark, shard_words)), window))
    every = first.join(added, "__th", "left")
    none = F.array().cast(SPANS)
    spans = F.array_sort(F.concat(names[1], F.coalesce("__spans_", none)))
    items = F.array_sort(F.array_distinct(F.concat(names[2], F.coalesce("__items_", F.array().cast("array<string>")))))

    def add(acc, x):
        last = F.element_at(acc, -1)
        meets = F.when(F.size(acc) > 0, last["e"] >= x["s"]).otherwise(False)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x))).cast(SPANS)

    return every.select(*key, names[0], F.aggregate(spans, none, add).alias(names[1]), items.alias(names[2]))


def judged(hits: DataFrame, coverage: int = 20, names: tuple[str, str, str] = NAMES, n_hit: str = "n_hit", contaminated: str = "contaminated") -> DataFrame:
    """Adds n_hit and contaminated: hit words make up at least one in `coverage` of the words."""
    n = F.aggregate(names[1], F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return hits.withColumn(n_hit, n).withColumn(contaminated, (F.col(n_hit) > 0) & (coverage * F.col(n_hit) >= F.col(names[0])))


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the characters from the first to the last word of each span of words."""
    import re

    if not text or not spans:
        return text
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20, remove: str = "documents") -> DataFrame:
    """docs without contamination, with the columns of docs.

    remove="documents" drops documents at or over the coverage limit and leaves all others as they are;
    remove="spans" also cuts the matched spans out of the documents that stay.
    """
    carried = [c for c in docs.columns if c != "text"]
    key = [*carried, "text"]
    names = ("__n", "__spans", "__items")
    found = judged(find_hits(docs, benchmark, window, key=key, names=names), coverage, names, "__hit", "__bad").where("NOT __bad")
    if remove == "spans":
        cutter = F.udf(lambda t, spans: cut(t, [(x["s"], x["e"]) for x in spans]), "string")
        found = found.withColumn("text", F.when(F.col("__hit") > 0, cutter("text", "__spans")).otherwise(F.col("text")))
    return found.select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM bw),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k),
h AS (SELECT r, i, dw.k, item FROM (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM dw) dw JOIN g ON g.k = dw.k AND g.w = dw.w),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
