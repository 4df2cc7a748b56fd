"""URL filters by a sort-merge range join.

A rule (host, path) covers its host, all subdomains and all paths that start with its own. With the
labels of the host reversed, `net.example/en/` is a key whose extensions form one interval of the sorted
keys. A url has one key for each suffix of its host, each followed by the path, so a rule fits a url if
and only if one of the url's keys lies in the rule's interval. Intervals of prefixes nest or are apart:
a sweep over the sorted keys keeps the rules around the present key on a stack, the longest on top.

The keys are dealt to slices by cut points, which are quantiles of a bounded sample and decide nothing
but the balance. A rule whose interval reaches into several slices is sent to each of them; at one cut
these are the prefixes of the cut, so copies stay few. Equal urls are swept once and joined back, so a
frequent url or host does not fill one slice.

Edge cases: null urls and urls without :// have an empty host and path and no rule; the longest rule wins
by the length of host and path together, then by the text; repeated rules count
once; repeated pages are judged alike, one row each; an empty table of pages or rules is no fault.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The rules of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    tail = F.expr("substring(__u, locate('://', __u) + 3)")
    host = F.regexp_extract(tail, r"\A([^/?#]*)", 1)
    return _of(url, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; empty without ://."""
    return _of(url, F.regexp_extract(F.expr("substring(__u, locate('://', __u) + 3)"), r"\A[^/?#]*([^?#]*)", 1))


def _of(url: Column, part: Column) -> Column:
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, part).otherwise("")


def with_address(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("__u", F.col(url)).withColumns({"host": host_of(F.col("__u")), "path": path_of(F.col("__u"))}).drop("__u")


def _key(host: Column, path: Column) -> Column:
    # hosts hold no slash, so one slash ends them
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/"), path)


def _keys(addresses: DataFrame) -> DataFrame:
    """A row for each suffix of the host."""
    keys = F.expr("transform(sequence(1, size(labels)), i -> concat(array_join(slice(labels, 1, i), '.'), '/', path))")
    return addresses.withColumn("labels", F.reverse(F.split("host", r"\."))).select("host", "path", F.explode(keys).alias("key"))


def _slices(keys: DataFrame, n: int) -> list[str]:
    """Cut points between n slices, from a bounded sample of the keys (smallest hashes first)."""
    sample = keys.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    found = sorted(r["key"] for r in sample.collect())
    return sorted({found[len(found) * k // n] for k in range(1, n)}, key=lambda k: k.encode()) if found else []


def match_rules(addresses: DataFrame, rules: DataFrame, slices: int | None = None) -> DataFrame:
    """host, path, rule, verdict for the distinct (host, path) that a rule fits; rules: host, path, verdict."""
    spark = addresses.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(addresses.select("host", "path").where("host <> ''").distinct())
    cuts = [c.encode() for c in _slices(keys, slices)]
    n_rules = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    every = keys.select(F.encode("key", "utf-8").alias("key"), "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        n_rules.select(F.encode(_key(F.col("host"), F.col("path")), "utf-8").alias("key"), "host", "path", "verdict")
    )

    def deal(batches):
        for batch in batches:
            at, to = [], []
            for i, (key, verdict) in enumerate(zip(batch.column("key").to_pylist(), batch.column("verdict").to_pylist(), strict=True)):
                first = bisect_right(cuts, key)
                last = first
                if verdict is not None:  # a cut is inside the interval if it starts with the key
                    while last < len(cuts) and cuts[last].startswith(key):
                        last += 1
                at += [i] * (last - first + 1)
                to += range(first, last + 1)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *taken.columns], names=["slice", *batch.schema.names])

    def sweep(batches):
        stack: list[tuple[bytes, str, str]] = []
        here = None
        for batch in batches:
            out = []
            for piece, key, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("slice", "key", "host", "path", "verdict")), strict=True):
                if piece != here:
                    stack, here = [], piece
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    stack.append((key, host + path, verdict))
                elif stack:
                    out.append((host, path, len(stack[-1][0]), stack[-1][1], stack[-1][2]))
            cells = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()], strict=True)], names=["host", "path", "size", "rule", "verdict"])

    dealt = every.mapInArrow(deal, "slice int, key binary, host string, path string, verdict string")
    swept = dealt.repartition(slices, "slice").sortWithinPartitions("slice", "key", F.col("verdict").isNull()).mapInArrow(sweep, "host string, path string, size int, rule string, verdict string")
    best = F.max_by(F.struct("rule", "verdict"), F.struct("size", "rule"))
    return swept.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to pages (in place of columns of these names); default is the verdict where no rule fits."""
    addressed = with_address(pages.drop("host", "path", "rule", "verdict"), url)
    found = match_rules(addressed, rules)
    return addressed.join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
p AS (SELECT page_id, translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM p, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
