"""Language-model scoring: a bigram Katz model over words.

Counts are discounted by Good-Turing (up to K occurrences), words that training has not seen share the
freed mass of the unigrams, and each context's backoff weight is what its discounted bigrams leave over,
divided by the unigram mass of all other words, so that the probabilities after every context add up to
one exactly. Bigrams seen less than `least` times are counted, as Good-Turing needs, but leave their mass
to the backoff; op8 takes all of them (least = 1).

    P(w | v) = d(c(v w)) * c(v w) / (c(v) + 1/2)      if c(v w) >= least
             = alpha(v) * P(w)                        otherwise
    P(w)     = d(c(w)) * c(w) / N, or the unseen mass if c(w) = 0

How it runs: words are 64-bit hashes. One pass counts words. A second packs the bigrams of some million
tokens at a time into columnar blocks, one for each bucket of contexts, with equal bigrams of a document
pre-aggregated; a bucket holds all of the bigrams of its contexts and a bounded number of tokens, as the
number of buckets grows with the corpus. Contexts too frequent for one bucket are spread over all of them by
the next word. Blocks are made, sent and read once: a bucket knows c(v w) and c(v) of all its events, which is
all that words' base scores and listed bigrams ask for but the discounts; how many bigrams of each discounted
count a document has is kept beside its sums until the discounts are known. Left open are events without a
listed bigram. They stay in the bucket, packed with the bigrams of their contexts; the words of both are joined
with the unigram table to learn P(w), frequent contexts' bigrams leave their bucket for the contexts' weights,
and then the open events are settled. So the log probability of a document is

    sum over listed events of log(c(v w) / (c(v) + 1/2)) + sum over r <= K of (events of count r) * log d(r)
    + sum over open events of (log alpha(v) + log P(w))

and no token has to travel to two tables. What a bucket adds to the documents of a chunk goes back to the chunk
as packed arrays, in one row a block, and is added up there.

Edge cases: null and empty texts hold the end token only; without training documents every probability
is the unseen mass, one; rows that repeat an id and a text get the same result each; a null id is never
held out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, column_bytes, held_out, portions, sliced, table, tokenized, written

K = 5  # counts up to here are discounted
CHUNK_TOKENS = 1_200_000
BUCKET_TOKENS = 2_500_000
#: No word holds a line feed, so these stand for the start and the end of a text.
START, END = b"\n", b"\n\n"


START_HASH, END_HASH = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (START, END))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def discounts(seen: list[int]) -> list[float]:
    """Katz's factors for counts 0 to K, from the numbers of types seen 1, 2, ... K + 1 times."""
    n = [0, *seen]
    if all(n[1 : K + 2]):
        cut = (K + 1) * n[K + 1] / n[1]
        if cut < 1:
            found = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, K + 1)]
            if all(0 < d < 1 for d in found):
                return [0.0, *found]
    # too few or too odd counts for Good-Turing: a constant is taken off each instead
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [0.0, *((r - off) / r for r in range(1, K + 1))]


class Unigrams:
    """P(w) from counts."""

    def __init__(self, seen: list[int], total: int) -> None:
        self.total, self.factors = total, np.array([*discounts(seen), 1.0])
        freed = sum(n * r * (1 - self.factors[r]) for r, n in enumerate(seen[:K], 1))
        # with nothing freed, one imagined token is unseen
        self.scale = 1.0 if freed > 0 else total / (total + 1)
        self.unseen = freed / total if freed > 0 else 1 / (total + 1)

    def prob(self, counts: np.ndarray) -> np.ndarray:
        known = self.factors[np.minimum(counts, K + 1)] * counts * (self.scale / max(self.total, 1))
        return np.where(counts > 0, known, self.unseen)


# ---------------------------------------------------------------------------------------------------
# blocks

def _pack(a: np.ndarray, ascending: bool = False) -> bytes:
    if ascending and len(a):
        a = np.concatenate((a[:1], np.diff(a)))
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(out, dtype=kind) if ascending else out


#: A block: places of its documents in the chunk, whether they are for training, contexts and how many
#: bigrams each has, next words, each bigram's word and how many documents have it, and these documents and
#: their counts. One more row a chunk has only the keys of its documents and their numbers of events.
BLOCK = {"ds": np.uint32, "train": np.uint8, "vs": np.uint64, "vn": np.uint32, "ws": np.uint64, "wi": np.uint32, "pn": np.uint32, "di": np.uint32, "cn": np.uint32}
ASCENDING = {"ds", "vs", "ws"}


def _distinct(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, of integers below size."""
    if size > 16 * len(x):
        return np.unique(x, return_inverse=True)
    place = np.zeros(size, np.int64)
    place[x] = 1
    found = np.flatnonzero(place)
    place[found] = np.arange(len(found))
    return found, place[x]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end of the last."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))


class _Chunk:
    """Bigrams of some documents, to be dealt into blocks."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.docs: list[int] = []
        self.train: list[bool] = []
        self.size = 0

    def add(self, key: int, train: bool, codes: np.ndarray) -> None:
        """codes: hashes of the start, words and the end of a text, or an overlapping stretch of these."""
        self.codes.append(codes)
        self.docs.append(key)
        self.train.append(train)
        self.size += len(codes) - 1

    def sizes(self) -> np.ndarray:
        return np.fromiter(map(len, self.codes), np.int64, len(self.codes)) - 1

    def blocks(self, buckets: int, hot: np.ndarray):
        """(bucket, packed columns of BLOCK)"""
        sizes = self.sizes()
        found = pa.array(np.concatenate(self.codes)).dictionary_encode()
        self.codes = []  # no longer asked for
        ids, hashes = found.indices.to_numpy(), found.dictionary.to_numpy()
        inside = np.ones(len(ids) - 1, bool)
        inside[np.cumsum(sizes + 1)[:-1] - 1] = False
        # next words are ranked by hash, contexts by bucket first; the frequent ones, which have many, come last
        is_hot = np.isin(hashes, hot)
        bucket = np.where(is_hot, np.int64(buckets), (hashes % np.uint64(buckets)).astype(np.int64))
        by_hash, by_bucket = np.argsort(hashes), np.lexsort((hashes, bucket))
        rank, context_rank = np.empty((2, len(hashes)), np.uint64)
        rank[by_hash] = context_rank[by_bucket] = np.arange(len(hashes), dtype=np.uint64)
        wide, deep = np.uint64(len(hashes).bit_length()), np.uint64(len(self.docs).bit_length())
        key = context_rank[ids[:-1][inside]]
        key <<= wide
        key |= rank[ids[1:][inside]]
        key <<= deep
        key |= np.repeat(np.arange(len(self.docs), dtype=np.uint64), sizes)
        del found, ids, inside
        key.sort()
        at = _runs(key)
        cn = np.diff(at).astype(np.uint32)
        key = key[at[:-1]]
        d = (key & ((np.uint64(1) << deep) - np.uint64(1))).astype(np.int32)
        key >>= deep
        at = _runs(key)
        pn = np.diff(at)
        key = key[at[:-1]]
        w = (key & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int32)
        v = (key >> wide).astype(np.int32)
        del key
        vh, wh = hashes[by_bucket], hashes[by_hash]
        home = bucket[by_bucket][v]
        spread = int(np.searchsorted(home, buckets))
        home[spread:] = (pair_hash(vh[v[spread:]], wh[w[spread:]]) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        home, first, events = home[by], at[:-1][by], pn[by]
        edges, ends = _runs(home), np.cumsum(events)
        train = np.array(self.train, np.uint8)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part, many = by[s:e], events[s:e]
            begin = ends[s:e] - many - (ends[s] - many[0])
            event = np.repeat(first[s:e] - begin, many) + np.arange(int(many.sum()))
            vat = _runs(v[part])
            ws, wi = _distinct(w[part], len(hashes))
            ds, di = _distinct(d[event], len(self.docs))
            made = {"ds": ds, "train": train[ds], "vs": vh[v[part][vat[:-1]]], "vn": np.diff(vat), "ws": wh[ws], "wi": wi, "pn": many, "di": di, "cn": cn[event]}
            yield int(home[s]), [_pack(made[c].astype(t), c in ASCENDING) for c, t in BLOCK.items()]


def _texts(batches):
    """key, train, and the hashes of the start, words and the end of each text."""
    for batch in sliced(batches):
        keys, train, texts = batch.column("key").to_pylist(), batch.column("train").to_pylist(), column_bytes(batch, "text")
        for a, b in portions(texts):
            found = tokenized(texts[a:b], lower=True)
            starts = found.rows + 2 * np.arange(b - a + 1)
            codes = np.empty(int(starts[-1]), np.uint64)
            codes[np.arange(len(found.hash)) + np.repeat(2 * np.arange(b - a) + 1, np.diff(found.rows))] = found.hash
            codes[starts[:-1]], codes[starts[1:] - 1] = START_HASH, END_HASH
            starts = starts.tolist()
            for k in range(a, b):
                yield keys[k], train[k], codes[starts[k - a] : starts[k - a + 1]]


def _chunks(batches, limit: int):
    """Full chunks of the documents in batches of key, train, text."""
    chunk = _Chunk()
    for key, train, codes in _texts(batches):
        for k in range(0, len(codes) - 1, limit):
            chunk.add(key, train, codes[k : k + limit + 1])
            if chunk.size >= limit:
                yield chunk
                chunk = _Chunk()
    if chunk.size:
        yield chunk


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(key, text).alias("key"), (~held_out(F.col(key), 5)).alias("train"), F.col(text).alias("text"))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, np.uint64).view(np.int64))


def unigram_counts(keyed: DataFrame) -> DataFrame:
    """h, n: each training token's hash and count, the end included."""

    def counts(codes):
        found = pa.array(np.concatenate(codes)).value_counts()
        hashes, n = (found.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        word = hashes != START_HASH
        return pa.RecordBatch.from_arrays([_signed(hashes[word]), pa.array(n[word])], names=["h", "n"])

    def run(batches):
        codes, size = [], 0
        for _, _, text in _texts(batches):
            codes.append(text)
            size += len(text)
            if size >= CHUNK_TOKENS:
                yield counts(codes)
                codes, size = [], 0
        if codes:
            yield counts(codes)

    return keyed.where("train").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _blocks(keyed: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    def run(batches):
        for chunk in _chunks(batches, CHUNK_TOKENS):
            keys = np.array(chunk.docs, np.int64)
            name = xxhash.xxh64_intdigest(keys.tobytes()) - (1 << 63)  # the same if the task runs again
            rows = [(name % buckets, _pack(np.concatenate((keys, chunk.sizes()))), [None] * len(BLOCK))]
            for bucket, packed_keys, packed in chain(rows, ((b, None, packed) for b, packed in chunk.blocks(buckets, hot))):
                cells = [pa.array([bucket], pa.int32()), pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in (packed_keys, *packed))]
                yield pa.RecordBatch.from_arrays(cells, names=["bucket", "chunk", "keys", *BLOCK])

    return keyed.mapInArrow(run, "bucket int, chunk long, keys binary, " + ", ".join(f"{c} binary" for c in BLOCK))


#: What a bucket leaves open: words; contexts of open events, with their counts, places among the frequent ones
#: (or -1) and numbers of listed bigrams; these bigrams' words and counts; open events' contexts, words, documents
#: and counts; the documents' chunks and places there. Frequent contexts' bigrams come last.
OPEN = {"words": np.uint64, "c": np.int64, "hot": np.int32, "pm": np.uint32, "pw": np.uint32, "pn": np.uint32, "ev": np.uint32, "ew": np.uint32, "ed": np.uint32, "en": np.uint32, "chunk": np.int64, "ds": np.uint32, "hv": np.uint64, "hw": np.uint64, "hn": np.int64}
LEARNED = "bucket int, seen array<long>, open array<binary>, chunk long, keys binary, sums array<binary>"
SUMS = [np.uint32, np.uint32, np.float64, np.float64, np.uint32]  # document, unknown words, base, score, events of each discounted count


def _opened(row: list[bytes], *names: str) -> list[np.ndarray]:
    return [_unpack(x, t, c == "words") for x, (c, t) in zip(row, OPEN.items(), strict=True) if c in names]


def _learn(blocks: pa.Table, hot: np.ndarray, hot_counts: np.ndarray, bottom: float, least: int) -> pa.Table:
    """All that a bucket knows about its documents: sums for their chunks, and what is open. hot: the frequent contexts;
    bottom: the base scores' denominator."""
    out, chunks, events = [], [], []
    cols: dict[str, list[np.ndarray]] = {k: [] for k in ("vs", "vn", "w", "key", "taught")}
    for k in range(blocks.num_rows):
        chunk, keys = (blocks.column(c)[k].as_py() for c in ("chunk", "keys"))
        if keys is not None:
            out.append((None, None, None, chunk, keys, None))
            continue
        row = {c: blocks.column(c)[k].as_buffer() for c in BLOCK}
        _, train, vs, vn, ws, wi, pn, di, cn = (_unpack(x, BLOCK[c], c in ASCENDING) for c, x in row.items())
        w = ws[wi]
        taught = np.add.reduceat(cn * train[di], np.cumsum(pn, dtype=np.int64) - pn, dtype=np.uint32)
        for c, x in zip(cols, (vs, vn, w, pair_hash(np.repeat(vs, vn), w), taught), strict=True):
            cols[c].append(x)
        chunks.append(chunk)
        events.append({c: row[c] for c in ("ds", "pn", "di", "cn")})
    if chunks:
        seen, opened, sums = _learn_events(*(np.concatenate(cols.pop(k)) for k in list(cols)), chunks, events, hot, hot_counts, bottom, least)
        out += [(blocks.column("bucket")[0].as_py(), seen, opened, None, None, None), *((None, None, None, chunk, None, x) for chunk, x in zip(chunks, sums, strict=True))]
    types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.list_(pa.binary()))
    return pa.table({c: pa.array(list(x), t) for c, x, t in zip(("bucket", "seen", "open", "chunk", "keys", "sums"), zip(*out, strict=True), types, strict=True)})


def _learn_events(vs: np.ndarray, vn: np.ndarray, w: np.ndarray, key: np.ndarray, taught: np.ndarray, chunks: list[int], events: list[dict], hot: np.ndarray, hot_counts: np.ndarray, bottom: float, least: int):
    """How many bigrams were seen 1, 2, ... K + 1 times; the columns of OPEN; and for each block those of SUMS."""
    # bigrams of blocks to bigrams of the bucket
    order = np.argsort(key)
    at = _runs(key[order])
    n = np.add.reduceat(taught[order], at[:-1], dtype=np.int64)
    here = np.empty(len(order), np.int64)
    here[order] = np.repeat(n, np.diff(at))
    first = order[at[:-1]]
    del key, order, at
    names, context = np.unique(vs, return_inverse=True)
    context = np.repeat(context.astype(np.int32), vn)
    c = np.bincount(context, taught, len(names)).astype(np.int64)
    del vs, vn, taught
    hot_at, is_hot = _find(hot, names)
    c[is_hot] = hot_counts[hot_at[is_hot]]
    said = names != START_HASH
    base, new = np.where(said, np.log10((c + 0.5) / bottom), 0.0), said & (c == 0)

    # block by block, and unpacked a second time, as there are more events than anything else
    sums, left, places, done, before = [], [], [], 0, 0
    for row in events:
        ds, pn, di, cn = (_unpack(x, BLOCK[c], c in ASCENDING) for c, x in row.items())
        many, size = len(pn), len(ds)
        places.append(ds)
        own, r = context[done : done + many], here[done : done + many]
        listed = r >= least
        part = np.where(listed, np.log10(np.maximum(r, 1) / (c[own] + 0.5)), 0.0)
        few = np.bincount(di * np.int64(K + 1) + np.repeat(np.where(listed & (r <= K), r, 0), pn), cn, size * (K + 1)).reshape(size, K + 1)[:, 1:]
        strange = np.flatnonzero(np.repeat(new[own], pn))
        found = (np.bincount(di[strange], cn[strange], size).astype(np.uint32), np.bincount(di, cn * np.repeat(base[own], pn), size), np.bincount(di, cn * np.repeat(part, pn), size), few.astype(np.uint32).ravel())
        sums.append([_pack(ds, True), *map(_pack, found)])
        rest = np.flatnonzero(np.repeat(~listed, pn))
        left.append((np.repeat(np.arange(done, done + many), pn)[rest], di[rest].astype(np.int64) + before, cn[rest]))
        done, before = done + many, before + size

    del here
    run, place, en = (np.concatenate(x) for x in zip(*left, strict=True))
    asked, ev = np.unique(context[run], return_inverse=True)
    number = np.full(len(names), -1)
    number[asked] = np.arange(len(asked))
    owner, lists = context[first], n >= least
    own = np.flatnonzero(lists & (number[owner] >= 0) & ~is_hot[owner])
    own = own[np.argsort(owner[own], kind="stable")]
    words, index = np.unique(np.concatenate((w[run], w[first[own]])), return_inverse=True)
    docs, ed = np.unique(place, return_inverse=True)
    far = np.flatnonzero(lists & is_hot[owner])
    made = {
        "words": words, "c": c[asked], "hot": np.where(is_hot, hot_at, -1)[asked], "pm": np.bincount(number[owner[own]], minlength=len(asked)),
        "pw": index[len(run) :], "pn": n[own], "ev": ev, "ew": index[: len(run)], "ed": ed, "en": en,
        "chunk": np.repeat(chunks, [len(x) for x in places])[docs], "ds": np.concatenate(places)[docs],
        "hv": names[owner[far]], "hw": w[first[far]], "hn": n[far],
    }
    return np.bincount(np.minimum(n, K + 2), minlength=K + 3)[1 : K + 2].tolist(), [_pack(made[k].astype(t), k == "words") for k, t in OPEN.items()], sums


def _asked(opened: DataFrame) -> DataFrame:
    """The words whose probability a bucket asks for, without v; v, w, n of the bigrams of frequent contexts."""

    def run(batches):
        for batch in batches:
            for bucket, row in zip(batch.column("bucket").to_pylist(), batch.column("open").to_pylist(), strict=True):
                words, hv, hw, hn = _opened(row, "words", "hv", "hw", "hn")
                v = pa.concat_arrays([pa.nulls(len(words), pa.int64()), _signed(hv)])
                n = pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(hn)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), bucket, np.int32)), v, _signed(np.concatenate((words, hw))), n], names=["bucket", "v", "w", "n"])

    return opened.mapInArrow(run, "bucket int, v long, w long, n long")


# ---------------------------------------------------------------------------------------------------
# model

class Katz:
    """What every task needs to know: both discounts, and the frequent contexts' counts and weights."""

    def __init__(self, unigrams: Unigrams, pair_factors: list[float], types: int, least: int) -> None:
        self.unigrams, self.pair_factors, self.types, self.least = unigrams, np.array([*pair_factors, 1.0]), types, least
        self.hot = np.zeros(0, np.uint64)
        self.hot_counts = np.zeros(0, np.int64)
        self.hot_alpha = np.ones(0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.unigrams.total + 0.5 * (self.types + 1)))

    def pair_prob(self, n: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self.pair_factors[np.minimum(n, K + 1)] * n / (context + 0.5)

    @staticmethod
    def alpha(taken: np.ndarray, covered: np.ndarray) -> np.ndarray:
        """From the sums of P(w | v) and of P(w) over a context's bigrams."""
        return (1 - taken) / np.maximum(1 - covered, 1e-12)


def _find(table_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether they are right."""
    if not len(table_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table_keys, keys), len(table_keys) - 1)
    return at, table_keys[at] == keys


def _settle(model: Katz, opened: pa.Table, side: pa.Table) -> pa.Table:
    """What open events add to the documents of each chunk, packed. side: the words that the bucket asks for and their counts."""
    keys = side.column("w").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, counts = keys[order], side.column("wn").to_numpy()[order]
    out = []
    for row in opened.column("open").to_pylist():
        words, c, hot, pm, pw, pn, ev, ew, ed, en, chunk, ds = _opened(row, *list(OPEN)[:12])
        if not len(ev):
            continue
        back = model.unigrams.prob(counts[_find(keys, words)[0]])
        context = np.repeat(np.arange(len(c)), pm)
        alphas = Katz.alpha(np.bincount(context, model.pair_prob(pn, c[context]), len(c)), np.bincount(context, back[pw], len(c)))
        alphas = np.where(hot >= 0, model.hot_alpha[hot], alphas)
        added = np.bincount(ed, en * (np.log10(alphas)[ev] + np.log10(back)[ew]), len(ds))
        # a block's documents lie together
        at = _runs(chunk)
        out += [(int(chunk[s]), [_pack(ds[s:e]), _pack(added[s:e])]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    names, sums = zip(*out, strict=True) if out else ((), ())
    return pa.table({"chunk": pa.array(names, pa.int64()), "keys": pa.nulls(len(out), pa.binary()), "sums": pa.array(sums, pa.list_(pa.binary()))})


def _add_chunk(log_factors: np.ndarray, parts: pa.Table) -> pa.Table:
    """key, tokens, unknown, base, score of the documents of a chunk."""
    # chunks of the very same documents share a name: all sums fall to one list of keys, as for any repeated rows
    lists = [_unpack(k, np.int64).reshape(2, -1) for k in parts.column("keys").to_pylist() if k is not None]
    keys, tokens = lists[0][0], sum(x[1] for x in lists)
    unknown, base, score = np.zeros((3, len(keys)))
    for row in parts.column("sums").to_pylist():
        if row is None:
            continue
        if len(row) == 2:
            np.add.at(score, _unpack(row[0], np.uint32), _unpack(row[1], np.float64))
            continue
        ds, *more = (_unpack(x, t, k == 0) for k, (x, t) in enumerate(zip(row, SUMS, strict=True)))
        unknown[ds] += more[0]
        base[ds] += more[1]
        score[ds] += more[2] + more[3].reshape(-1, K) @ log_factors
    return pa.table({"key": pa.array(keys), "tokens": pa.array(tokens), "unknown": pa.array(unknown.astype(np.int64)), "base": pa.array(base), "score": pa.array(score)})


def train_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    spark = docs.sparkSession
    keyed = _keyed(docs, key, text)
    words = written(unigram_counts(keyed), "unigrams")
    seen_rows = words.groupBy(F.least("n", F.lit(K + 2)).alias("r")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).collect()
    total, types = sum(r["tokens"] for r in seen_rows), sum(r["types"] for r in seen_rows)
    by_count = {r["r"]: r["types"] for r in seen_rows}
    unigrams = Unigrams([by_count.get(r, 0) for r in range(1, K + 2)], total)
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(1.25 * total / BUCKET_TOKENS))
    # at most 4 * buckets words are as frequent as this
    frequent = {r["h"]: r["n"] for r in words.where(F.col("n") > total / (4 * buckets)).collect()} if total else {}
    ends_signed = int(END_HASH.view(np.int64))
    n_train = words.where(F.col("h") == ends_signed).select("n").first()
    n_train = n_train["n"] if n_train else 0
    frequent[int(START_HASH.view(np.int64))] = n_train
    hot = np.sort(np.array(list(frequent), np.int64).view(np.uint64))

    hot_counts = np.array([frequent[int(h)] for h in hot.view(np.int64)], np.int64)
    bottom = total + 0.5 * (types + 1)
    learned = written(_blocks(keyed, buckets, hot).groupBy("bucket").applyInArrow(lambda b: _learn(b, hot, hot_counts, bottom, least), LEARNED), "learned", "uncompressed")
    pair_seen = learned.agg(*(F.coalesce(F.sum(F.col("seen")[r]), F.lit(0)).alias(f"s{r}") for r in range(K + 1))).first()
    opened = learned.where("bucket IS NOT NULL").select("bucket", "open")
    asked = written(_asked(opened).join(words.select(F.col("h").alias("w"), F.col("n").alias("wn")), "w", "left").withColumn("wn", F.coalesce("wn", F.lit(0))), "bigrams")
    model = Katz(unigrams, discounts(list(pair_seen)), types, least)
    model.hot, model.hot_counts = hot, hot_counts
    model.hot_alpha = _frequent_alpha(asked.where("v IS NOT NULL"), model)

    handle = Carried(spark, model)
    side = asked.where("v IS NULL").select("bucket", "w", "wn")
    settled = opened.groupBy("bucket").cogroup(side.groupBy("bucket")).applyInArrow(lambda o, s: _settle(handle.value, o, s), "chunk long, keys binary, sums array<binary>")
    log_factors = np.log10(model.pair_factors[1 : K + 1])
    parts = learned.where("chunk IS NOT NULL").select("chunk", "keys", "sums").unionByName(settled)
    added = parts.groupBy("chunk").applyInArrow(lambda p: _add_chunk(log_factors, p), "key long, tokens long, unknown long, base double, score double")
    sums = added.groupBy("key").agg(*(F.sum(c).alias(a) for c, a in (("tokens", "tokens"), ("unknown", "unknown"), ("base", "base"), ("score", "s"))))
    # rows that repeat an id and a text share a key, and its sums
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("key"), held_out(F.col(key), 5).alias("held_out"))
    rows = rows.groupBy("id", "key", "held_out").agg(F.count("*").alias("copies"))
    end = np.array([n_train])
    every = rows.join(sums, "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("n_tokens", F.expr("tokens div copies"))
    score = F.col("s") / F.col("copies")
    return every.select(
        F.col("id").alias(key), "held_out", "n_tokens",
        (F.expr("n_tokens - 1 - unknown div copies") + int(n_train > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + F.lit(float(model.base(end)[0]))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def _frequent_alpha(pairs: DataFrame, model: Katz) -> np.ndarray:
    """The backoff weights of the frequent contexts, whose bigrams lie in several buckets."""
    factors, words = model.pair_factors.tolist(), model.unigrams
    taken = F.element_at(F.array(*map(F.lit, factors)), F.least("n", F.lit(K + 1)).cast("int") + 1) * F.col("n")
    q = F.element_at(F.array(*map(F.lit, words.factors.tolist())), F.least("wn", F.lit(K + 1)).cast("int") + 1) * F.col("wn") * F.lit(words.scale / max(words.total, 1))
    found = {r["v"]: (r["p"], r["q"]) for r in pairs.groupBy("v").agg(F.sum(taken).alias("p"), F.sum(q).alias("q")).collect()}
    sums = np.array([found.get(int(h), (0.0, 0.0)) for h in model.hot.view(np.int64)]).reshape(-1, 2)
    return Katz.alpha(sums[:, 0] / (model.hot_counts + 0.5), sums[:, 1])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
