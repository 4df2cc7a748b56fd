"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n from 1 to 3, blended) that both hold,
over the geometric mean of what each holds. A Nystroem map through a set of landmark texts makes the
kernel finite, and one-versus-rest kernel ridge regression on it gives each language a linear score.
N-grams are kept as presence in a space of 2 ** BITS hashed n-grams, many times what a text can fill.

The classifier is fitted on a bounded sample: at most `per_language` labelled texts of each language (the
ones with the smallest hashes of id and text) and `landmarks` of them as landmarks; only their n-grams reach
the driver. Scoring is one pass over all whole texts; the batches' kernel rows are matrix products with the
landmarks, multiplied through with the regression weights.

The score says how much the best language leads. Whether a text fits its language at all is another matter:
the regression aims at one for texts of a language and minus one for others, and gives about zero to what is
like no landmark. A text whose best value is under `least` does not fit, unless it has too few n-grams to tell.

Edge cases: `und` with score 0 for null texts and texts without a letter; without any labelled text
every result is `und`; ties go to the language that sorts first; repeated rows are judged alike, one row
each. Only the text takes part in a prediction.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Carried, held_out, sliced, table

BITS = 18
LEAST, SHORT = 0.05, 40  # the regression's value, and n-grams, under which a text does not fit, or is too short to tell
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, its lower-case letter, or a space; made once per process."""
    global _LETTERS
    if _LETTERS is None:
        to = np.full(sys.maxunicode + 1, 32, np.uint32)
        for start, end in ((0, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x20000)):
            for c in range(start, end):
                x = chr(c)
                if x.isalpha():
                    low = x.lower()
                    to[c] = ord(low) if len(low) == 1 else c
        for start, end in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0)):  # ideographs and syllables have no case
            to[start:end] = np.arange(start, end)
        _LETTERS = to
    return _LETTERS


def presence(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """The hashed n-grams (1 to 3 characters) of a whole text; None if it has no letter."""
    if not text:
        return None
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not (codes != 32).any():
        return None
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)  # one space for any run of others
    c = np.concatenate((np.array([32], np.uint32), codes[keep], np.array([32], np.uint32))).astype(np.uint64)
    seen = np.zeros(1 << bits, bool)
    shift = np.uint64(64 - bits)
    rolled = np.zeros(len(c), np.uint64)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        rolled = rolled[: len(c) - n + 1] * np.uint64(0x100000001B3) + (c[n - 1 :] + np.uint64(n * 0x110000))
        seen[((rolled * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def _matrix(rows: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Normalised presence rows; places: each n-gram's column, -1 for those left out."""
    out = np.zeros((len(rows), int(places.max(initial=-1)) + 1), np.float32)
    for k, on in enumerate(rows):
        at = places[on]
        out[k, at[at >= 0]] = 1 / np.sqrt(len(on))
    return out


class Model:
    """Languages and, for each, its weight of every n-gram."""

    def __init__(self, languages: list[str], weights: np.ndarray, bits: int) -> None:
        self.languages, self.weights, self.bits = languages, weights, bits

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Regression scores of a batch: its sparse presence matrix times the weights, into which the product
        with the landmarks is folded."""
        sizes = np.array([len(on) for on in rows])
        sums = np.add.reduceat(self.weights[np.concatenate(rows)], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        return sums / np.sqrt(sizes)[:, None]

    def predict(self, texts: list[str | None], least: float = LEAST) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether the texts fit their languages."""
        names, sure, fits = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        made = [(k, on) for k, x in enumerate(texts) if (on := presence(x, self.bits)) is not None]
        if made and self.languages:
            found = self.scores([on for _, on in made])
            best = found.argmax(1)
            odds = np.exp(6 * (found - found.max(1, keepdims=True)))
            share = odds[np.arange(len(best)), best] / odds.sum(1)
            for (k, on), b, s, top in zip(made, best, share, found.max(1), strict=True):
                names[k], sure[k], fits[k] = self.languages[b], round(float(s), 6), bool(top >= least or len(on) < SHORT)
        return names, sure, fits


def fit(rows: list[np.ndarray], labels: list[str], landmarks: int = 512, ridge: float = 1e-3, bits: int = BITS) -> Model:
    """Kernel ridge regression on the Nystroem features of presence rows."""
    languages = sorted(set(labels))
    if not rows:
        return Model([], np.zeros((1 << bits, 0)), bits)
    by = [[k for k, y in enumerate(labels) if y == name] for name in languages]
    turn = [k for group in zip(*([*g, *[-1] * (max(map(len, by)) - len(g))] for g in by), strict=True) for k in group if k >= 0]
    chosen = [rows[k] for k in turn[:landmarks]]
    known = np.unique(np.concatenate(chosen))  # other n-grams are in no landmark
    places = np.full(1 << bits, -1, np.int64)
    places[known] = np.arange(len(known))
    marks = _matrix(chosen, places)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([(_matrix(rows[k : k + 256], places) @ marks.T).astype(np.float64) @ root for k in range(0, len(rows), 256)])
    targets = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    weight = np.array([1 / len(by[languages.index(y)]) for y in labels])[:, None]  # languages count alike
    gram = features.T @ (features * weight) + ridge * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (targets * weight))
    weights = np.zeros((1 << bits, len(languages)))
    weights[known] = marks.T.astype(np.float64) @ (root @ beta)
    return Model(languages, weights, bits)


def sample(docs: DataFrame, learn: Column, per_language: int, text: str = "text", label: str = "lang", key: str = "doc_id", bits: int = BITS) -> tuple[list[np.ndarray], list[str]]:
    """Presence rows and labels of at most per_language different labelled rows of each language."""
    named = docs.where(learn & F.col(label).isNotNull()).select(F.xxhash64(key, text, label).alias("__h"), F.col(label).alias("__l"), F.col(text).alias("__t"))
    # step by step, so that no task sees all rows of a frequent language
    chosen = named.select("__h", "__l").distinct()
    for parts in ([F.pmod("__h", F.lit(256))], [F.pmod("__h", F.lit(16))], []):
        chosen = chosen.withColumn("__r", F.row_number().over(Window.partitionBy("__l", *parts).orderBy("__h"))).where(F.col("__r") <= per_language)
    picked = named.join(F.broadcast(chosen.select("__h")), "__h").select("__h", "__l", "__t").dropDuplicates(["__h"])

    def run(batches):
        for batch in sliced(batches):
            made = [presence(x, bits) for x in batch.column("__t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__h"), batch.column("__l"), pa.array([None if m is None else m.tobytes() for m in made], pa.binary())], names=["h", "l", "on"])

    rows = picked.mapInArrow(run, "h long, l string, on binary").where("on IS NOT NULL").collect()
    rows.sort(key=lambda r: r["h"])
    return [np.frombuffer(bytes(r["on"]), np.int32) for r in rows], [r["l"] for r in rows]


def train(docs: DataFrame, learn: Column, per_language: int = 500, landmarks: int = 512, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    return fit(*sample(docs, learn, per_language, text, label, key), landmarks)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "fits")) -> DataFrame:
    """The kept columns with the predicted language, its score (0 to 1), and whether the text fits it, for every row."""
    handle = Carried(docs.sparkSession, model)

    def run(batches):
        for batch in sliced(batches):
            cells = handle.value.predict(batch.column(text).to_pylist())
            made = [pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *names])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{names[0]} string, {names[1]} double, {names[2]} boolean"])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def identified(docs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """docs without those that the model rejects: no letter, nothing like the language that comes closest, or a
    language not asked for."""
    model = train(docs, ~held_out(F.col("doc_id"), 3))
    found = predict(docs, model, docs.columns, names=("__lang", "__score", "__fits"))
    good = (F.col("__lang") != UNKNOWN) & F.col("__fits")
    return found.where(good & F.col("__lang").isin(languages) if languages else good).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~held_out(F.col("doc_id"), 3))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "lang_pred", "score")
