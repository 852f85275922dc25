"""Mixing sources to target weights (problem 7).

Each document has a fixed place on a line of hashes.  Tokens are summed by source and hash
bucket (partial sums leave the map side); running sums over the buckets of a source find the
bucket in which a source's budget ends; only the documents of that bucket are summed again
by the next bits, until the threshold is exact to one hash value.  The selection is then a
filter ``place < threshold``: nothing is sorted, and selections of one source for different
budgets are nested.  A source that must be repeated is taken whole as often as needed, the
rest by threshold.

Defined results.  The size of a document is its number of ids; null and empty texts have
size 0.  Documents without source count in the total and are never drawn.  A source of a mix
that no document has holds 0 tokens.  Null weight, ratio or repeats count as 0.  Documents with one
hash place (also repeated doc_ids) are taken or left together.  Empty documents: every
budget is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.llm.tokens import TOKENIZERS, token_count
from benchloom.session import cut, join_dimension

#: Levels of histograms and bits of each; together the bits of a place.
LEVELS, BITS = 3, 12


def sized(documents: DataFrame, folder: str = TOKENIZERS, seed: int = 7) -> DataFrame:
    """doc_id, source, tokens, place: materialised, as tokens are counted in Python."""
    place = F.expr(f"shiftrightunsigned(xxhash64(doc_id, {seed}), {64 - LEVELS * BITS})")
    return cut(documents.select("doc_id", "source", token_count(F.col("text"), folder).alias("tokens"), place.alias("place")))


def budgets(sizes: DataFrame, mixes: DataFrame) -> DataFrame:
    """One row a (mix, source): target, held, whole copies, tokens left for the threshold, shortfall."""
    held = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("held"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = mixes.select("mix_id", "source", zero("weight").alias("weight"), zero("max_repeats").cast("bigint").alias("max_repeats"), zero("size_ratio").alias("size_ratio"))
    rows = join_dimension(rows.join(F.broadcast(total)), held, ["source"]).withColumn("held", F.coalesce("held", F.lit(0)))
    target = F.round(F.col("weight") * F.col("size_ratio") * F.col("total"), 6)
    rows = rows.withColumn("target", target)
    short = F.col("held") * F.col("max_repeats") < F.col("target")
    whole = F.when(short, F.col("max_repeats")).when(F.col("held") > 0, F.floor(F.col("target") / F.when(F.col("held") > 0, F.col("held")))).otherwise(F.lit(0))
    rows = rows.withColumn("short", short).withColumn("copies", whole.cast("bigint"))
    return rows.withColumn("rest", F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("target") - F.col("copies") * F.col("held")))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``threshold`` (places below it are taken once more) and ``below``, the tokens there."""
    state = wanted.withColumn("threshold", F.lit(0).cast("bigint")).withColumn("below", F.lit(0).cast("bigint"))
    for level in range(LEVELS):
        width = 1 << BITS * (LEVELS - 1 - level)
        bucket = F.floor(F.col("place") / width).cast("bigint")
        rows = sizes.where(F.col("source").isNotNull()).withColumn("bucket", bucket)
        if level:
            edges = state.select("source", F.floor(F.col("threshold") / width / (1 << BITS)).cast("bigint").alias("parent")).distinct()
            rows = rows.withColumn("parent", F.floor(F.col("bucket") / (1 << BITS)).cast("bigint"))
            rows = join_dimension(rows, edges, ["source", "parent"], "left_semi")
        sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
        upto = Window.partitionBy("mix_id", "source").orderBy("bucket")
        inside = (F.col("bucket") * width >= F.col("threshold")) & (F.col("bucket") * width < F.col("threshold") + width * (1 << BITS))
        steps = state.join(sums, "source").where(inside).withColumn("running", F.col("below") + F.sum("in_bucket").over(upto)).where(F.col("running") <= F.col("rest"))
        reached = steps.groupBy("mix_id", "source").agg(F.max("running").alias("r"), F.max("bucket").alias("b"))
        state = state.join(reached, ["mix_id", "source"], "left")
        full = F.coalesce((F.col("b") + 1) * width, F.col("threshold"))
        # The bucket in which the budget ends is the first non-empty one after the last that fits.
        # At the last level it is taken too if that comes closer to the budget.
        nxt = state.withColumn("full", full).join(sums, "source").where((F.col("bucket") * width >= F.col("full")) & (F.col("bucket") * width < F.col("threshold") + width * (1 << BITS))).groupBy("mix_id", "source").agg(F.min(F.col("bucket") * width).alias("edge"), F.min_by("in_bucket", "bucket").alias("next"))
        state = state.withColumn("below", F.coalesce("r", "below")).withColumn("full", full).join(nxt, ["mix_id", "source"], "left")
        if level < LEVELS - 1:
            state = state.withColumn("threshold", F.coalesce("edge", "full"))
        else:
            closer = F.coalesce(F.abs(F.col("below") + F.col("next") - F.col("rest")) < F.abs(F.col("below") - F.col("rest")), F.lit(False))
            state = state.withColumn("threshold", F.when(closer, F.col("edge") + width).otherwise(F.col("full"))).withColumn("below", F.col("below") + F.when(closer, F.col("next")).otherwise(F.lit(0)))
        state = state.drop("r", "b", "full", "edge", "next")
        state = cut(state)
    return state


def report(documents: DataFrame, mixes: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """What each source of each mix was to give, gives, and its share of the mix reached."""
    sizes = sized(documents, folder)
    got = thresholds(sizes, cut(budgets(sizes, mixes)))
    got = got.withColumn("reached", F.col("copies") * F.col("held") + F.col("below"))
    return got.withColumn("share_reached", F.expr("try_divide(cast(reached as double), sum(reached) over (partition by mix_id))")).select(
        "mix_id", "source", "weight", "target", "held", "max_repeats", "copies", "threshold", "reached", "share_reached", "short"
    )


def selection(documents: DataFrame, mixes: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """mix_id, doc_id, source, tokens, copies: the mixes themselves, by filtering."""
    sizes = sized(documents, folder)
    got = thresholds(sizes, cut(budgets(sizes, mixes))).select("mix_id", "source", "copies", "threshold")
    rows = join_dimension(sizes, got, ["source"], "inner")
    copies = F.col("copies") + (F.col("place") < F.col("threshold")).cast("bigint")
    return rows.select("mix_id", "doc_id", "source", "tokens", copies.alias("copies")).where(F.col("copies") > 0)


def found(documents: DataFrame, mixes: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """mix_id, source: sources that cannot give their weight, out of the report on what they give.

    A source that is short is taken whole as often as allowed and still misses its target.
    """
    return report(documents, mixes, folder).where(F.col("short") & (F.col("reached") < F.col("target"))).select("mix_id", "source")
