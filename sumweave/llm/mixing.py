"""Mixing sources to target weights by temperature; DataFrame functions only.

Source weights are token shares to the power ``alpha``, normalised. ``alpha`` is found by repeated
section of [0, 1]: the largest that reaches the target entropy (a share of the logarithm of the
number of sources), raised where needed until no source is repeated more often than the limit.
The weights are then realised as budgeted block permutations: a source's documents are dealt into
blocks of bounded size by hash; each epoch passes through all blocks in an order of its own, and
the last, partial epoch stops where the source's token quota is used up.

Prefix sums have three levels (lanes of an epoch, which are ranges of its order and fixed in number;
blocks of a lane; documents of the one block where a quota ends), so no task sees a whole source's
documents or blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumweave.llm import common as C

#: Documents to a block, about.
BLOCK_DOCS = 500
#: An epoch's order is cut into 2 ** LANE_BITS lanes.
LANE_BITS = 12
#: Candidates for the exponent tried by one job, and rounds of them: 16 ** 8 > 2 ** 31 steps.
CANDIDATES, ROUNDS = 16, 8
WORDS = r"[\x20\x09-\x0D]+"


def n_words(text):
    """Words of a text, none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORDS)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def find_alpha(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float = 1.0) -> float:
    """The exponent for sources with a column ``p`` (shares above 0, sum 1). Every round is one
    aggregate over the sources; nothing but sums comes to the driver."""
    n, least = sources.agg(F.count(F.lit(1)), F.min("p")).collect()[0]
    if not n or n == 1:
        return 1.0

    def section(good) -> float:
        """The largest alpha in [0, 1] for which ``good`` (true up to some point) holds, or the
        smallest for which it holds from there on, by narrowing one bracket."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            step = (high - low) / (CANDIDATES + 1)
            tries = [low + step * (k + 1) for k in range(CANDIDATES)]
            aggs = [F.sum(F.pow("p", F.lit(a))) for a in tries] + [F.sum(F.pow("p", F.lit(a)) * F.log("p")) for a in tries]
            got = sources.agg(*aggs).collect()[0]
            flags = [good(a, got[k], got[k + CANDIDATES]) for k, a in enumerate(tries)]
            first = next((k for k, f in enumerate(flags) if not f), CANDIDATES)
            low, high = (tries[first - 1] if first else low), (tries[first] if first < CANDIDATES else high)
        return (low + high) / 2

    alpha = 1.0 if max_repeats is None else 0.0  # with a limit alone, as even as it allows
    if target_entropy is not None:
        want = target_entropy * math.log(n)
        alpha = section(lambda a, z, t: math.log(z) - a * t / z >= want)
    if max_repeats is not None:
        over = lambda a, z: budget_share * least ** (a - 1) / z > max_repeats
        alpha = max(alpha, section(lambda a, z, t: over(a, z)))
    return alpha


def mix(docs: DataFrame, target_entropy: float | None = 0.9, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 17) -> DataFrame:
    """The mixture: a row for each time a document is used.

    Columns: doc_id, source, row_hash (of id and text), n_tokens, epoch, block, schedule (where in
    [0, 1] of its source's quota its block stands: sort by it to interleave the sources).
    Tokens are words; ``budget`` is in tokens, all that there are by default. A source gets its weight's
    share of the budget, rounded down to whole documents, so the total stays within the budget.

    Texts are counted whole, of any length; where rows tie in the dealing's hashes, their doc_id
    decides. A null source is a source of its own; documents without words cost nothing and come along in
    whole epochs; sources without any words come once. Rows that repeat a doc_id are dealt each.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    src = F.col("source").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), src.alias("source"), F.when(src.isNull(), "n").otherwise(F.concat(F.lit("s"), src)).alias("key"), n_words(F.col("text").cast("string")).alias("n_tokens"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("row_hash")
    )
    rows = C.written(rows, "weighed")
    stats = rows.groupBy("key").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("n_docs"))
    stats = C.written(stats, "sources")
    whole = stats.agg(F.sum("total")).collect()[0][0] or 0
    budget = whole if budget is None else budget
    share = stats.where("total > 0").select("key", "total", "n_docs", (F.col("total") / F.lit(float(max(whole, 1)))).alias("p"))
    alpha = find_alpha(share, target_entropy, max_repeats, budget / max(whole, 1))
    z = share.agg(F.sum(F.pow("p", F.lit(alpha)))).collect()[0][0] or 1.0
    quota = F.floor(F.pow("p", F.lit(alpha)) / F.lit(z) * F.lit(float(budget))).cast("long")
    plan = share.withColumn("quota", quota).select("key", "n_docs", "quota", "total", F.floor(F.col("quota") / F.col("total")).cast("long").alias("full"))
    plan = plan.withColumn("rest", F.col("quota") - F.col("full") * F.col("total"))
    plan = plan.unionByName(stats.where("total = 0").select("key", "n_docs", F.lit(0).cast("long").alias("quota"), "total", F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest")))
    dealt = rows.join(plan, "key").withColumn("block", F.pmod(F.xxhash64("row_hash", F.lit(seed)), F.ceil(F.col("n_docs") / F.lit(BLOCK_DOCS))))
    dealt = C.written(dealt.drop("n_docs"), "dealt")

    blocks = dealt.groupBy("key", "block").agg(F.sum("n_tokens").alias("size"), F.first("full").alias("full"), F.first("rest").alias("rest"), F.first("quota").alias("quota"), F.first("total").alias("total"))
    blocks = C.written(blocks, "blocks")
    turn = F.xxhash64("key", "block", "epoch", F.lit(seed))
    epochs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).withColumn("turn", turn).withColumn("lane", F.shiftright("turn", 64 - LANE_BITS))
    lane = Window.partitionBy("key", "epoch").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = epochs.groupBy("key", "epoch", "lane").agg(F.sum("size").alias("n")).select("key", "epoch", "lane", F.coalesce(F.sum("n").over(lane), F.lit(0)).alias("lane_before"))
    within = F.sum("size").over(Window.partitionBy("key", "epoch", "lane").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1))
    epochs = epochs.withColumn("within", F.coalesce(within, F.lit(0))).join(lanes, ["key", "epoch", "lane"]).withColumn("before", F.col("lane_before") + F.col("within"))
    state = F.when(F.col("epoch") < F.col("full"), "whole").when(F.col("before") + F.col("size") <= F.col("rest"), "whole").when(F.col("before") < F.col("rest"), "cut")
    at = (F.col("epoch") * F.col("total") + F.col("before")) / F.greatest(F.col("quota"), F.lit(1))
    epochs = epochs.withColumn("state", state).where((F.col("state").isNotNull()) & ((F.col("epoch") < F.col("full")) | (F.col("rest") > 0)))
    epochs = C.written(epochs.select("key", "block", "epoch", "state", "before", at.alias("schedule")), "epochs")

    base = dealt.select("key", "block", "doc_id", "source", "row_hash", "n_tokens", "rest")
    out = ["doc_id", "source", "row_hash", "n_tokens", "epoch", "block", "schedule"]
    full = base.join(epochs.where("state = 'whole'"), ["key", "block"]).select(*out)
    inside = F.sum("n_tokens").over(Window.partitionBy("key", "block").orderBy(F.xxhash64("row_hash", "epoch"), "row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = base.join(epochs.where("state = 'cut'"), ["key", "block"]).withColumn("inside", inside).where(F.col("before") + F.col("inside") <= F.col("rest")).select(*out)
    return full.unionByName(cut)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture as rows of ``docs``, in all its columns: a document stands as often as it is used.

    Equal rows (of one doc_id, text and source) together stand as often as the mixture uses them all,
    so the budget holds for them as well; those that differ in other columns come out in the
    columns of one of them.
    """
    key = [F.col("doc_id").cast("bigint").alias("_id"), F.col("source").cast("string").alias("_source"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("_hash")]
    use = mix(docs, **how).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("row_hash").alias("_hash")).groupBy("_id", "_source", "_hash").agg(F.count(F.lit(1)).alias("_uses"))
    copies = docs.select(*key).groupBy("_id", "_source", "_hash").agg(F.count(F.lit(1)).alias("_copies"))
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & a["_source"].eqNullSafe(b["_source"]) & (a["_hash"] == b["_hash"])
    use = use.join(copies, same(use, copies)).select(*(use[c] for c in use.columns), "_copies")
    use = C.written(use, "uses")
    own = docs.select(*docs.columns, *key)
    once = own.join(use.where("_copies = 1"), same(own, use)).select(*(own[c] for c in docs.columns), "_uses")
    many = own.join(use.where("_copies > 1"), same(own, use)).select(F.struct(*(own[c] for c in docs.columns)).alias("_row"), own["_id"], own["_source"], own["_hash"], "_uses")
    many = many.groupBy("_id", "_source", "_hash").agg(F.first("_row").alias("_row"), F.first("_uses").alias("_uses")).select("_row.*", "_uses")
    return once.union(many).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_uses")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op6_source_mix."""
    return mix(C.table(spark, sf_dir, "documents"))
