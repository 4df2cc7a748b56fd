"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the operators' contracts: space, \t, \n, \v, \f, \r.
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: bytes.lower() and bytes.split() touch ASCII only, which is what the contracts ask for.
_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO_ALNUM = bytes(b if b >= 128 or b in _ALNUM else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where Spark runs on it alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="eventspark-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The shuffle files of the job that fills the table are given back as it ends, where Spark can.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        if before is not None:
            spark.conf.set(key, "true")
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


SIEVE_WORDS = 1 << 19


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """A bit for each hash that a key (a long) can have, in at most SIEVE_WORDS rows of 64 bits: small enough to broadcast
    whatever the number of keys. The more keys, the more other values pass; a join behind it decides."""
    place = F.pmod(F.shiftright(column, 20), F.lit(64)).cast("int")
    bits = keys.select(F.pmod(column, F.lit(SIEVE_WORDS)).alias("__w"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("__b"))
    return written(bits.groupBy("__w").agg(F.bit_or("__b").alias("__b")), "sieve")


def sieved(df: DataFrame, column: str, by: DataFrame) -> DataFrame:
    """df with __maybe: false for rows whose key is surely none of those in the sieve."""
    out = df.join(F.broadcast(by), F.pmod(column, F.lit(SIEVE_WORDS)) == by["__w"], "left")
    place = F.pmod(F.shiftright(column, 20), F.lit(64)).cast("int")
    return out.select(*df.columns, (F.coalesce(F.call_function("shiftrightunsigned", "__b", place).bitwiseAND(F.lit(1)), F.lit(0)) == 1).alias("__maybe"))


def semi_sieved(df: DataFrame, column: str, by: DataFrame) -> DataFrame:
    """The rows of df that pass the sieve."""
    return sieved(df, column, by).where("__maybe").drop("__maybe")


class Carried:
    """A broadcast object of this package that workers can read where the package is not installed.

    Spark pickles what it broadcasts by reference to its class; here it travels as bytes that hold the class
    as well, and becomes an object once per worker process.
    """

    def __init__(self, spark: SparkSession, made: Any) -> None:
        self.handle = spark.sparkContext.broadcast(cloudpickle.dumps(made))

    @property
    def value(self) -> Any:
        if not hasattr(self.handle, "made"):
            self.handle.made = pickle.loads(self.handle.value)
        return self.handle.made


class Tokens(NamedTuple):
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, one after the other."""

    data: np.ndarray  #: the texts' bytes, each behind a line feed
    rows: np.ndarray  #: where each text's words begin, and the end of the last
    start: np.ndarray  #: places in data
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray  #: where each text begins in data


_SOLID = bytes(0 if b in WORD_BREAKS.encode() else 1 for b in range(256))
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed one-to-one function of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokenized(texts: list[bytes | None], lower: bool = False) -> Tokens:
    """Words and their hashes, all texts at a time; A-Z lower-cased first if asked for."""
    whole = b"\n" + b"\n".join([t or b"" for t in texts]) + b"\n" + b"\0" * 8
    if lower:
        whole = whole.translate(_LOW)
    begin = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    solid = np.frombuffer(whole.translate(_SOLID), np.uint8)[:-8]
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    eights = np.ndarray((len(whole) - 7,), np.uint64, whole, strides=(1,))
    size = end - start
    h = mixed((eights[start] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    rest = np.flatnonzero(size > 8)
    for k in range(8, 64, 8):
        if not len(rest):
            break
        h[rest] = mixed(h[rest] * np.uint64(3) + (eights[start[rest] + k] & _MASKS[np.minimum(size[rest] - k, 8)]))
        rest = rest[size[rest] > k + 8]
    for i in rest.tolist():
        h[i] = xxhash.xxh64_intdigest(whole[start[i] : end[i]])
    return Tokens(np.frombuffer(whole, np.uint8), np.searchsorted(start, begin), start, end, h, begin[:-1])


def words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 text; null has none."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """The same after lower-casing A-Z."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and any non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TO_ALNUM).lower().split() if text else []


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` as a built-in expression; 0 for null."""
    spaced = text
    for c in WORD_BREAKS[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    spaced = F.trim(F.replace(F.replace(spaced, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" ")))
    # most texts have single spaces by now, which can be counted without cutting the text up
    single = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1
    n = F.when(F.coalesce(spaced, F.lit("")) == "", 0).when(spaced.contains("  "), F.size(F.split(spaced, " +"))).otherwise(single)
    return n.cast("long")


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 1, F.lit(False))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts at a time are Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def portions(texts: list[bytes | None], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some million bytes together; a longer text has a range of its own."""
    first = size = 0
    for k, t in enumerate(texts):
        more = len(t or b"")
        if k > first and size + more > limit:
            yield first, k
            first, size = k, 0
        size += more
    if len(texts) > first:
        yield first, len(texts)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def per_row(df: DataFrame, columns: list[str], text: str, fn: Callable[[bytes | None], tuple], fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """columns of df and what fn makes of each whole text, batch by batch through Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [fn(x) for x in column_bytes(batch, text)]
            cells = list(zip(*made, strict=True)) if made else [[] for _ in fields]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(list(v), t) for v, (_, t) in zip(cells, fields, strict=True)], names=columns + [n for n, _ in fields])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns] + [ddl])
    return df.select(*columns, *([] if text in columns else [text])).mapInArrow(run, schema)
