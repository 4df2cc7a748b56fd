"""Mixing sources to target weights by temperature.

Sources are weighted by their token shares to the power of an exponent between 0 (all alike) and 1 (as
they are). The exponent is bisected to the largest weight entropy asked for that still respects a limit
on how often a source may be repeated. The weights then become budgets of tokens, and each budget is
realised as block permutations: in every epoch the source's blocks come in another order, and so do the documents
of a block. Whole epochs come first, then the first blocks of one more permutation, the last of them cut
within the block. A document has a row for each time that it is used.

Everything per source is an aggregate in Spark: bisection tries 65 exponents in one aggregation,
six halvings a job, so the list of sources is never collected. Where the last epoch ends is found in
steps: which of a source's RANGES ranges of block hashes, which block in the range, which document in the block.
So no task sorts more than a part of a source. What is known then is a few numbers a source, by which each
document tells on its own how often it is used and where; texts are not shuffled.

Edge cases: null texts have no tokens and stay out of the mix, like any document without words; a null
source is a source of its own; repeated rows are documents of their own, and equal ones are used alike; an
empty table gives an empty result; a single source takes the whole budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, word_count, written

BLOCK_TOKENS = 200_000
RANGES = 4096  # the upper 12 bits of a hash
BUDGET_RATIO = 2.0  # tokens of the mix for each token of the input
SEED = 17
#: What mix() adds to a document.
USES = ["n_tokens", "weight", "epoch", "order_block", "order_key"]


def exponent(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget_ratio: float = 1.0, rounds: int = 5) -> float:
    """The exponent for shares (column share, adding up to 1).

    entropy: share of the largest possible entropy, log(number of sources), to reach at least (0 to 1).
    max_repeats: no source may be seen more often than this at a budget of budget_ratio times all tokens;
    it goes before the entropy. Both measures fall monotonously as the exponent grows.
    """

    def sums(low: float, high: float) -> list[tuple[float, bool, bool]]:
        """For 65 exponents from low to high: whether they satisfy the repetition limit and the entropy."""
        grid = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.lit(low) + i * F.lit((high - low) / 64))
        z = shares.select("share", F.explode(grid).alias("a"))
        # with Z = sum(share ** a): entropy = log Z - a * sum(share ** a * log share) / Z
        found = z.groupBy("a").agg(
            F.sum(F.pow("share", "a")).alias("z"),
            F.sum(F.pow("share", "a") * F.log("share")).alias("l"),
            F.max(F.pow("share", F.col("a") - 1)).alias("r"),
            F.count("*").alias("n"),
        )
        repeats = F.lit(budget_ratio) * F.col("r") / F.col("z")
        spread = F.log("z") - F.col("a") * F.col("l") / F.col("z")
        few = repeats <= max_repeats if max_repeats is not None else F.lit(True)
        wide = spread >= entropy * F.log("n") - 1e-12 if entropy is not None else F.lit(True)
        return sorted(tuple(r) for r in found.select("a", few, wide).collect())  # 65 rows

    low, high = 0.0, 1.0
    for _ in range(rounds):  # the smallest exponent within the repetition limit
        at = sums(low, high)
        low, high = next(((at[max(k - 1, 0)][0], a) for k, (a, few, _) in enumerate(at) if few), (high, high))
    floor = high if max_repeats is not None else 0.0
    if entropy is None:
        return floor
    low, high = 0.0, 1.0
    for _ in range(rounds):  # the largest one with the entropy
        at = sums(low, high)
        low, high = next(((a, at[min(k + 1, len(at) - 1)][0]) for k, (a, _, wide) in reversed(list(enumerate(at))) if wide), (low, low))
    return max(floor, low)


def weights(tokens: DataFrame, alpha: float) -> DataFrame:
    """source, tokens, weight: share ** alpha, normalised. tokens: source, tokens (over 0)."""
    powered = tokens.crossJoin(F.broadcast(tokens.agg(F.sum("tokens").alias("all")))).withColumn("w", F.pow(F.col("tokens") / F.col("all"), F.lit(alpha)))
    total = powered.agg(F.sum("w").alias("z"))  # one row
    return powered.crossJoin(F.broadcast(total)).select("source", "tokens", (F.col("w") / F.col("z")).alias("weight"))


def _source(source: str) -> Column:
    """The source as text that tells null from all others."""
    return F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def _block_order(block: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), "__s", block, epoch)


def _key_order(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 2), "__h", epoch)


def plan(counted: DataFrame, budget_ratio: float, entropy: float | None, max_repeats: float | None, block_tokens: int, seed: int) -> DataFrame | None:
    """__s, weight, blocks, epochs, and where one more epoch ends: before or in the block of order cut, up to the
    key there. counted: __s, __h and n of each document. None if there are no tokens."""
    tokens = written(counted.groupBy("__s").agg(F.sum("n").alias("tokens")), "sources")
    everything = tokens.agg(F.sum("tokens")).first()[0]
    if not everything:
        return None
    alpha = exponent(tokens.select((F.col("tokens") / F.lit(everything)).alias("share")), entropy, max_repeats, budget_ratio)
    budgets = weights(tokens.withColumnRenamed("__s", "source"), alpha).withColumnRenamed("source", "__s").withColumns(
        {"budget": F.round(F.col("weight") * F.lit(everything * budget_ratio)).cast("long"), "blocks": F.ceil(F.col("tokens") / block_tokens).cast("long")}
    )
    budgets = budgets.withColumns({"epochs": F.expr("budget div tokens"), "rest": F.expr("budget % tokens")})
    budgets = written(budgets.select("__s", "weight", "blocks", "epochs", "rest"), "budgets")
    dealt = counted.join(budgets.select("__s", "blocks", "epochs", "rest"), "__s").withColumn("block", F.pmod("__h", "blocks"))
    sizes = dealt.groupBy("__s", "block", "epochs", "rest").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumn("order", _block_order(F.col("block"), F.col("epochs"), seed)).withColumn("range", F.shiftright("order", 52))
    sizes = written(sizes, "blocks")
    # a range of orders, then a block in the range, in which the rest runs out
    ranges = sizes.groupBy("__s", "range").agg(F.sum("size").alias("range_size"))
    ahead = F.coalesce(F.sum("range_size").over(Window.partitionBy("__s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("ahead", ahead)
    inside = sizes.join(ranges, ["__s", "range"]).where("ahead <= rest AND rest < ahead + range_size")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("__s").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("left", F.col("rest") - F.col("ahead") - before).where("left >= 0 AND left < size")
    cut = written(cut.select("__s", "block", F.col("order").alias("cut"), "left"), "cuts")  # one block a source
    # equal documents share a key, and are within the rest together or not at all
    members = dealt.join(cut, ["__s", "block"]).withColumn("key", _key_order(F.col("epochs"), seed))
    upto = F.sum("n").over(Window.partitionBy("__s").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    keys = members.withColumn("upto", upto).where(F.col("upto") <= F.col("left")).groupBy("__s").agg(F.max("key").alias("key"))
    made = budgets.join(cut.select("__s", "cut"), "__s", "left").join(keys, "__s", "left").select("__s", "weight", "blocks", "epochs", "cut", "key")
    made = written(made, "plan")
    dropped(tokens, budgets, sizes, cut)
    return made


def mix(docs: DataFrame, budget_ratio: float = BUDGET_RATIO, entropy: float | None = 0.95, max_repeats: float | None = 4.0, block_tokens: int = BLOCK_TOKENS, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """docs with a row for each use, and n_tokens, weight (of the source), epoch, order_block and order_key: reading
    by epoch, source, order_block and order_key is reading in the order of the permutations. Columns of docs that
    bear these names give way to them.
    """
    named = docs.drop(*USES).withColumns({"__s": _source(source), "__h": F.xxhash64(F.lit(seed), key, text)})
    n = word_count(F.col(text))
    counted = written(named.select("__s", "__h", n.alias("n")), "tokens")
    made = plan(counted.where("n > 0"), budget_ratio, entropy, max_repeats, block_tokens, seed)
    dropped(counted)
    if made is None:
        none = {"n_tokens": "long", "weight": "double", "epoch": "long", "order_block": "long", "order_key": "long"}
        return docs.drop(*USES).limit(0).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    # made by a generator, the count is not made again for the filter
    used = named.select("*", F.explode(F.array(n)).alias("n_tokens")).where("n_tokens > 0").join(made.withColumnsRenamed({c: f"__{c}" for c in ("blocks", "epochs", "cut", "key")}), "__s")
    block, epochs = F.pmod("__h", "__blocks"), F.col("__epochs")
    order = _block_order(block, epochs, seed)
    partly = (order < F.col("__cut")) | (order == F.col("__cut")) & (_key_order(epochs, seed) <= F.col("__key"))
    used = used.withColumn("__uses", epochs + F.coalesce(partly, F.lit(False)).cast("long")).where("__uses > 0")
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__uses") - 1)))
    used = used.withColumns({"order_block": _block_order(block, F.col("epoch"), seed), "order_key": _key_order(F.col("epoch"), seed)})
    return used.select(*docs.drop(*USES).columns, *USES)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def mixed(docs: DataFrame) -> DataFrame:
    """The last stage of the pipeline: the mixed training set, a row for each use of a document."""
    return mix(docs)
