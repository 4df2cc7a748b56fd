"""Quality rules by weak supervision.

Rules vote good (+1), bad (-1) or abstain (0) on every document. Expectation-maximisation over the counts of all
vote patterns estimates the share of good documents and, for both classes, how often each rule that votes
objects (abstentions say nothing); a document is kept if its posterior probability of being good reaches a
threshold. No rule has a veto: an objection weighs what it is worth by the rule's estimated accuracy, and several
rules look at each kind of junk, so that they can bear each other out. The priors are worth a few documents.
There are at most 3 ** len(RULES) vote patterns whatever the input's size, so only these counts reach the driver.

Edge cases: null and empty texts have no words and fail the base rule; a text whose rules all abstain
gets the prior; repeated rows are judged alike, one result each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, sliced, table, words, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_ended", "n_plain", "n_bare", "n_marks", "n_any_letters"]
#: Words of letters with one mark behind them at most, words without letter and digit, and runs of marks.
_PLAIN = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff]+[.,;:!?]?(?!\S)")
_BARE = re.compile(rb"(?<!\S)[^A-Za-z0-9\s\x80-\xff]+(?!\S)")
_MARKS = re.compile(rb"[!?]{2,}|[#*$%&|<>]{2,}")


def repeated_words(items: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that the text holds twice or more, the first occurrence included."""
    n = len(items)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in items), np.uint64, n)
    if len(ids) == n:
        return 0
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n - window + 1 + k]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    whole = [codes[i : i + window].tobytes() for i in at]  # equal hashes are held against the words themselves
    seen = Counter(whole)
    hit = np.zeros(n + 1, np.int64)
    for i, key in zip(at, whole, strict=True):
        if seen[key] > 1:
            hit[i] += 1
            hit[i + window] -= 1
    return int(np.count_nonzero(np.cumsum(hit[:-1])))


def measures(text: bytes | None) -> tuple[int, ...]:
    """The values named in FIELDS for one whole text."""
    text = text or b""
    items = words(text)
    solid = text.translate(None, b" \t\n\x0b\x0c\r")
    plain = np.frombuffer(solid, np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = int(np.count_nonzero((plain >= 65) & (plain <= 90)))
    lower = int(np.count_nonzero((plain >= 97) & (plain <= 122)))
    return (
        len(items),
        len(solid) - int(np.count_nonzero((plain & 0xC0) == 0x80)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(items),
        len(lines),
        len(set(items)),
        upper,
        upper + lower,
        sum(x.rstrip()[-1:] in b".!?" for x in lines),
        len(_PLAIN.findall(text)),
        len(_BARE.findall(text)),
        len(_MARKS.findall(text)),
        upper + lower + int(np.count_nonzero(plain >= 0xC0)),
    )


def with_measures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    keep = ["doc_id"] if keep is None else keep

    def run(batches):
        for batch in sliced(batches):
            made = np.array([measures(x) for x in column_bytes(batch, text)], np.int64).reshape(-1, len(FIELDS))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(made[:, k]) for k in range(len(FIELDS))], names=keep + FIELDS)

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in FIELDS])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _vote(good: str, bad: str) -> Column:
    return F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")


#: name -> (good if, bad if), over FIELDS; whole-number arithmetic, so that every engine agrees.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 50", "n_words < 20"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "duplicate_lines": ("n_dup_lines = 0 AND n_lines >= 3", "10 * n_dup_lines > 3 * n_lines"),
    "repetition": ("n_repeat_words = 0 AND n_words >= 20", "100 * n_repeat_words > 20 * n_words"),
    "word_length": ("word_chars >= 4 * n_words AND word_chars <= 8 * n_words AND n_words > 0", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    "variety": ("10 * n_distinct >= 4 * n_words AND n_words >= 20", "10 * n_distinct < 2 * n_words"),
    "capitals": ("10 * n_upper <= n_letters AND n_letters > 0", "10 * n_upper > 4 * n_letters"),
    "sentence_ends": ("10 * n_ended >= 6 * n_lines AND n_lines > 0", "10 * n_ended < 2 * n_lines"),
    "plain_words": ("10 * n_plain >= 8 * n_words AND n_words > 0", "10 * n_plain < 7 * n_words"),
    "separators": ("100 * n_bare <= n_words AND n_words > 0", "20 * n_bare > n_words"),
    "mark_runs": ("n_marks = 0", "20 * n_marks > n_words"),
    "letters": ("100 * n_any_letters >= 85 * word_chars AND word_chars > 0", "100 * n_any_letters < 75 * word_chars"),
}
#: Beta priors of an objection, (objects, does not), to a good and to a bad document.
PRIORS = ((0.1, 5.0), (2.0, 2.0))


def fit(patterns: list[tuple[list[int], int]], rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes (0: good, 1: bad) and objects[class, rule], the probability that a rule which votes
    votes bad, from vote patterns and their counts. It starts from the guess that objections are right."""
    k = len(patterns[0][0]) if patterns else len(RULES)
    votes = np.array([v for v, _ in patterns]).reshape(-1, k)
    counts = np.array([c for _, c in patterns], float)
    bad, good = (votes < 0).astype(float), (votes > 0).astype(float)
    first = np.where(bad.sum(1) > 0, 0.05, 0.95)
    part = np.stack((first, 1 - first), 1)
    yes, every = np.array([[p] for p, _ in PRIORS]), np.array([[p + q] for p, q in PRIORS])
    for _ in range(rounds):
        weight = (part * counts[:, None]).T
        share = (weight.sum(1) + 1) / (counts.sum() + 2)
        objects = (weight @ bad + yes) / (weight @ (bad + good) + every)
        logs = np.log(share) + bad @ np.log(objects).T + good @ np.log1p(-objects).T
        before, part = part, np.exp(logs - logs.max(1, keepdims=True))
        part /= part.sum(1, keepdims=True)
        if np.abs(part - before).max(initial=0) < 1e-9:
            break
    return share, objects


def score(df: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Measures, votes' posterior `quality_prob`, `base_failed` and `kept` for every row of df.

    base_failed: under 20 words, or over 30 % of the words in repeated windows of eight.
    """
    measured = written(with_measures(df, text, keep), "quality")
    votes = {name: _vote(*rule) for name, rule in RULES.items()}
    code = sum((v + 1) * 3**k for k, v in enumerate(votes.values()))
    counted = measured.groupBy(code.alias("code")).count().collect()  # at most 3 ** len(RULES) rows
    patterns = [([r["code"] // 3**k % 3 - 1 for k in range(len(RULES))], r["count"]) for r in counted]
    share, objects = fit(patterns)
    like = []
    for of_class, p in zip(share.tolist(), objects.tolist(), strict=True):
        term = F.lit(of_class)
        for vote, x in zip(votes.values(), p, strict=True):
            term = term * F.when(vote < 0, x).when(vote > 0, 1 - x).otherwise(1.0)
        like.append(term)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    prob = F.round(like[0] / sum(like[1:], like[0]), 9)
    return measured.withColumns({"base_failed": failed, "quality_prob": prob}).withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= threshold))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_prob")
