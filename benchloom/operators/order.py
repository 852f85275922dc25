"""Order statistics that are exact and never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.session import cut, join_dimension

#: Values of a group that one task may sort, and buckets of a round.
SORTED, BUCKETS = 50_000, 4_096


def medians(rows: DataFrame, keys: list[str], value: str, most: int = SORTED, written: bool = False) -> DataFrame:
    """(keys, median): the mean of the two middle values of each group; nulls do not count.

    The two middle ranks are narrowed down: values between the ends of a rank's range are counted in
    ``BUCKETS`` even buckets, the bucket that holds the rank becomes its range, and so on until it
    has one value or at most ``most``, which are then sorted.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    stats = rows.groupBy(*keys).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array(F.struct(F.lit(1).alias("which"), F.expr("(inside + 1) div 2").alias("rank")), F.struct(F.lit(2).alias("which"), F.expr("inside div 2 + 1").alias("rank"))))
    state = cut(stats.withColumn("r", ranks).select(*keys, F.col("r.which").alias("which"), F.col("r.rank").alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("before"), "inside"))
    by = [*keys, "which"]
    while state.where((F.col("inside") > most) & (F.col("lo") < F.col("hi"))).limit(1).count():
        wide = join_dimension(rows, state, keys, "inner").where(F.col("v").between(F.col("lo"), F.col("hi")))
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)))
        counts = wide.withColumn("bucket", bucket).groupBy(*by, "rank", "before", "bucket").agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy(*by).orderBy("bucket"))
        counts = counts.withColumn("upto", F.col("before") + upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("inside") < F.col("rank")))
        state = cut(counts.select(*by, "rank", "lo", "hi", (F.col("upto") - F.col("inside")).alias("before"), "inside"))
    found = state.where("lo = hi").select(*by, F.col("lo").alias("v"))
    last = join_dimension(rows, state.where("lo < hi"), keys, "inner").where(F.col("v").between(F.col("lo"), F.col("hi")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("v"))
    found = found.unionByName(last.withColumn("place", place).where(F.col("place") + F.col("before") == F.col("rank")).select(*by, "v"))
    return found.groupBy(*keys).agg(F.avg("v").alias("median"))
