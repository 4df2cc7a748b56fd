"""Line deduplication with a log-template tree.

Lines are cut into units: whole sentences of a line, closed as soon as they have `min_tokens` tokens together
(what is left at the line's end joins its last unit; a shorter line is one unit). So a passage is found wherever
it stands within lines. Every unit is parsed to a fixed depth: its token count, then its leading tokens, then
the rest, with variable fields generalised to a wildcard. A token is a variable field if it holds a digit.
Units of a leaf that differ in a single further token are generalised as well: a unit offers, next to its
exact form, the forms with one token replaced, and a form that several units offer is a template too. Offering
is needed only where another unit of the leaf has the same first or second half, so few units pay for it.

A template is boilerplate if it is in `min_docs` different texts or more, and in so many that tokens times
texts reach `evidence`: short lines need more texts than long ones, and no line is exempt. Its units are
dropped, except in one of the texts that have it, the one with the smallest hash. Copies of one text count
as one, and a text of which over `copy_share` would be dropped is a copy of others rather than a text
with boilerplate: it is left whole, to near-duplicate detection.

Counting is one pass over the texts. Of each template only the texts with the smallest hashes are carried on, as
many as it needs to be boilerplate: a union of templates is in that many texts if and only if the union of
these few is, and has the same smallest one. So no row count depends on how frequent a line is. Texts meet
what they lose in a join. Before such joins, rows that surely find no partner are sieved out, by bits in a table of
bounded size; that is all that is broadcast.

Edge cases: null texts stay null; blank lines stay; a line of which nothing is left goes; repeated rows are
treated alike; an empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tokens, column_bytes, dropped, mixed, portions, semi_sieved, sieve, sieved, sliced, table, tokenized, written

DEPTH = 3
MIN_TOKENS = 12
MIN_DOCS = 2
EVIDENCE = 24
COPY_SHARE = 0.75
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_DIGITS = bytes(1 if 48 <= b <= 57 else 0 for b in range(256))
WILD = np.uint64(0x5DEECE66D1234567)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _STEP))


def unit_starts(found: Tokens, min_tokens: int = MIN_TOKENS) -> np.ndarray:
    """The first token of each unit. Units follow each other without gaps."""
    if not len(found.start):
        return np.zeros(0, np.int64)
    lines = np.searchsorted(np.flatnonzero(found.data == 10), found.start)
    last = np.concatenate((lines[1:] != lines[:-1], [True]))
    cuts = np.flatnonzero(last | _ENDS[found.data[found.end - 1]])
    out, begin, fresh = [0], 0, True
    for c, closes in zip((cuts + 1).tolist(), last[cuts].tolist(), strict=True):
        if closes:
            if c - begin < min_tokens and not fresh:
                out.pop()  # joins the line's unit before
            out.append(c)
            begin, fresh = c, True
        elif c - begin >= min_tokens:
            out.append(c)
            begin, fresh = c, False
    return np.array(out[:-1], np.int64)


def unit_tokens(found: Tokens) -> np.ndarray:
    """32 bits for each token, variable fields alike."""
    values = mixed(found.hash)
    digits = np.flatnonzero(np.frombuffer(found.data.tobytes().translate(_DIGITS), np.uint8))
    if len(digits):
        at = np.searchsorted(found.end, digits, "right")
        values[at[(at < len(values)) & (found.start[np.minimum(at, len(values) - 1)] <= digits)]] = WILD
    return (values >> np.uint64(32)).astype(np.uint32)


WILD32 = np.uint32(int(WILD) >> 32)


class Units:
    """Templates and halves of units. tokens: of all units, one after the other; starts: where each begins."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> None:
        self.n = np.diff(np.append(starts, len(tokens))).astype(np.int64)
        self.starts, self.depth = starts, depth
        self.place = np.arange(len(tokens)) - np.repeat(starts, self.n)
        top = int(self.n.max()) if len(self.n) else 0
        self.powers = _powers(top + 1)
        self.parts = mixed(tokens.astype(np.uint64) + np.uint64(1)) * self.powers[self.place]
        # sums over leading tokens, the rest's first half and its second half
        sums = np.zeros((3, len(starts)), np.uint64)
        if len(starts):
            running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.parts)))
            ends = starts + self.n
            lead, middle = np.minimum(starts + depth, ends), np.minimum(starts + (self.n + depth + 1) // 2, ends)
            lead_end = np.minimum(lead, middle)
            for row, (s, e) in zip(sums, ((starts, lead_end), (lead_end, middle), (middle, ends)), strict=True):
                row[:] = running[e] - running[s]
        self.leaf = mixed(sums[0] * np.uint64(3) + self.n.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        self.sums = sums

    @property
    def template(self) -> np.ndarray:
        return mixed(self.leaf + self.sums[1] + self.sums[2])

    def half(self, k: int) -> np.ndarray:
        return mixed((self.leaf ^ self.sums[k]) * np.uint64(5) + np.uint64(k))

    def forms(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units and forms with one token replaced: where the first half is shared, in the second, and vice versa."""
        n, middle = np.repeat(self.n, self.n), np.repeat((self.n + self.depth + 1) // 2, self.n)
        on = np.where(self.place >= middle, np.repeat(first, self.n), np.repeat(second, self.n))
        k = np.flatnonzero(on & (self.place >= self.depth))
        unit = np.repeat(np.arange(len(self.n)), self.n)[k]
        gone = mixed(np.full(1, WILD32, np.uint64) + np.uint64(1)) * self.powers[self.place[k]]
        total = self.leaf[unit] + self.sums[1][unit] + self.sums[2][unit] - self.parts[k] + gone
        return unit, mixed(total + mixed(self.place[k].astype(np.uint64) + (n[k].astype(np.uint64) << np.uint64(32))))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _packed(tokens: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Each unit's tokens as bytes."""
    offsets = np.append(starts, len(tokens)).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(tokens))])


def units_of(docs: DataFrame, text: str, min_tokens: int) -> DataFrame:
    """th (a hash of the whole text), tpl, n (tokens), half1, half2 and the tokens of each text's different units."""

    def run(batches):
        for batch in sliced(batches):
            texts, th = column_bytes(batch, text), batch.column("th").to_numpy()
            for a, b in portions(texts):
                found = tokenized(texts[a:b])
                starts, tokens = unit_starts(found, min_tokens), unit_tokens(found)
                units = Units(tokens, starts)
                tpl, row = units.template, np.searchsorted(found.rows, starts, "right") - 1
                one = np.sort(np.unique(mixed(tpl + row.astype(np.uint64) * _STEP), return_index=True)[1])  # each once a text
                cells = [_long(th[a:b][row]), _long(tpl), pa.array(units.n.astype(np.int32)), _long(units.half(1)), _long(units.half(2)), _packed(tokens, starts)]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(one)) for c in cells], names=["th", "tpl", "n", "half1", "half2", "tokens"])

    return docs.select(F.xxhash64(text).alias("th"), text).mapInArrow(run, "th long, tpl long, n int, half1 long, half2 long, tokens binary")


def recurring(units: DataFrame, min_docs: int = MIN_DOCS, evidence: int = EVIDENCE) -> DataFrame:
    """tpl, first: the templates whose units are boilerplate, and the hash of the text that keeps them."""
    need = F.greatest(F.lit(min_docs), F.ceil(F.lit(evidence) / F.col("n")).cast("int"))
    known = [F.first(c).alias(c) for c in ("n", "half1", "half2")]
    # the two smallest texts of a template that needs two are its least and its greatest, as far as counting goes
    two = units.where(need == 2).groupBy("tpl").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), *known)
    two = two.select("tpl", "n", "half1", "half2", F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi")).alias("ths"))
    more = units.where(need != 2).groupBy("tpl", "th").agg(*known)
    few = more.withColumn("r", F.row_number().over(Window.partitionBy("tpl").orderBy("th"))).where(F.col("r") <= need)
    few = few.groupBy("tpl").agg(*known, F.sort_array(F.collect_list("th")).alias("ths"))  # at most max(min_docs, evidence) of them
    exact = written(two.unionByName(few), "templates")

    # units of a leaf that share a half are the only ones that can differ in a single token
    long = exact.where(F.col("n") > DEPTH + 1)
    half = long.select("tpl", F.explode(F.array(F.struct(F.col("half1").alias("half"), F.lit(1).alias("k")), F.struct(F.col("half2").alias("half"), F.lit(2).alias("k")))).alias("x")).select("tpl", "x.*")
    shared = written(half.groupBy("half").agg(F.min("tpl").alias("lo"), F.max("tpl").alias("hi")).where("lo <> hi").select("half"), "halves")
    live = sieve(shared, "half")
    close = semi_sieved(half, "half", live).join(shared, "half").groupBy("tpl").agg(F.max((F.col("k") == 1).cast("int")).alias("s1"), F.max((F.col("k") == 2).cast("int")).alias("s2"))
    # one text's tokens stand for the template
    close = written(close.join(exact.select("tpl", F.element_at("ths", 1).alias("th")), "tpl"), "close")

    def forms(batches):
        for batch in sliced(batches, 4096):
            packed = batch.column("tokens").to_pylist()
            starts = np.cumsum([0, *(len(x) // 4 for x in packed)])[:-1]
            tokens = np.frombuffer(b"".join(packed), np.uint32)
            unit, form = Units(tokens, starts).forms(batch.column("s1").to_numpy() > 0, batch.column("s2").to_numpy() > 0)
            yield pa.RecordBatch.from_arrays([batch.column("tpl").take(pa.array(unit)), _long(form)], names=["tpl", "form"])

    near = sieve(close, "tpl")
    tokens = semi_sieved(units.select("tpl", "th", "tokens"), "tpl", near).join(close, ["tpl", "th"]).dropDuplicates(["tpl"])
    offered = written(tokens.select("tpl", "s1", "s2", "tokens").mapInArrow(forms, "tpl long, form long").distinct(), "forms")
    several = offered.groupBy("form").agg(F.min("tpl").alias("lo"), F.max("tpl").alias("hi")).where("lo <> hi").select("form")
    members = written(offered.join(several, "form").select("form", "tpl"), "members")
    texts = members.join(exact.select("tpl", "n", "ths"), "tpl").select("form", "n", F.explode("ths").alias("th"))
    met = texts.groupBy("form", "th").agg(F.first("n").alias("n")).groupBy("form").agg(F.count("*").alias("texts"), F.min("th").alias("first"), F.first("n").alias("n"))
    wide = members.join(met.where(F.col("texts") >= need).select("form", "first"), "form").select("tpl", "first")
    own = exact.where(F.size("ths") >= need).select("tpl", F.element_at("ths", 1).alias("first"))
    found = written(own.unionByName(wide).groupBy("tpl").agg(F.min("first").alias("first")), "recurring")
    dropped(exact, shared, live, close, near, offered, members)
    return found


def cleaned(texts: list[bytes], gone: list[np.ndarray], min_tokens: int = MIN_TOKENS, copy_share: float = COPY_SHARE) -> list[bytes]:
    """The texts without the units of the templates in gone."""
    found = tokenized(texts)
    starts = unit_starts(found, min_tokens)
    units = Units(unit_tokens(found), starts)
    tpl, row = units.template, np.searchsorted(found.rows, starts, "right") - 1
    out = []
    for i, whole in enumerate(texts):
        own = np.flatnonzero(row == i) if len(texts) > 1 else np.arange(len(starts))
        bad = np.isin(tpl[own], gone[i])
        if not bad.any() or units.n[own[bad]].sum() > copy_share * units.n[own].sum():
            out.append(whole)
            continue
        begin = found.start[starts[own]] - found.text[i]
        lines, kept, u = np.flatnonzero(np.frombuffer(whole + b"\n", np.uint8) == 10).tolist(), [], 0
        at = 0
        for stop in lines:
            pieces, had = [], False
            first = True
            while u < len(own) and begin[u] < stop:
                to = begin[u + 1] if u + 1 < len(own) and begin[u + 1] < stop else stop
                had |= bool(bad[u])
                if not bad[u]:
                    pieces.append(whole[at if first else begin[u] : to])
                first = False
                u += 1
            if first or not had:
                kept.append(whole[at:stop])
            elif pieces:
                kept.append(b"".join(pieces))
            at = stop + 1
        out.append(b"\n".join(kept))
    return out


def deduplicated(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, evidence: int = EVIDENCE, copy_share: float = COPY_SHARE) -> DataFrame:
    """docs without boilerplate; the columns of docs."""
    units = written(units_of(docs, text, min_tokens), "units")
    found = recurring(units, min_docs, evidence)
    bad = sieve(found, "tpl")
    gone = semi_sieved(units.select("tpl", "th"), "tpl", bad).join(found, "tpl").where("th <> first").groupBy("th").agg(F.collect_set("tpl").alias("gone"))
    gone = written(gone.select(F.col("th").alias("__gone_th"), F.col("gone").alias("__gone")), "gone")
    hit = sieve(gone, "__gone_th")
    dropped(units, found, bad)
    # other columns travel as one, so that their names do not meet the operator's
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("__row") if others else F.lit(0).alias("__row"), F.col(text).alias("__text"), F.xxhash64(text).alias("__th"))
    # only texts that lose something travel to what they lose
    rows = sieved(rows, "__th", hit)
    kept = rows.where("__maybe").join(gone, F.col("__th") == F.col("__gone_th"), "left")

    def run(batches):
        for batch in sliced(batches):
            texts, lists = column_bytes(batch, "__text"), batch.column("__gone").to_pylist()
            for k in [k for k, x in enumerate(lists) if x]:
                texts[k] = cleaned([texts[k]], [np.array(lists[k], np.int64).view(np.uint64)], min_tokens, copy_share)[0]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.binary()).cast(pa.string())], names=["__row", "__text"])

    new = kept.select("__row", "__text", "__gone").mapInArrow(run, T.StructType([rows.schema["__row"], rows.schema["__text"]]))
    every = rows.where("NOT __maybe").select("__row", "__text").unionByName(new)
    return every.select(*((F.col("__text") if c == text else F.col("__row")[c]).alias(c) for c in docs.columns))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and what line dedup leaves of the text: lines before and after, and the digest of the new text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = deduplicated(docs.withColumn("old_lines", F.size(F.split("text", "\n"))))
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n")))
    old = F.when(F.col("text").isNull(), 0).otherwise(F.col("old_lines"))
    return new.select("doc_id", old.cast("long").alias("n_lines"), lines.cast("long").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
