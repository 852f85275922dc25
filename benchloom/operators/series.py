"""Operators over ordered frames of a video: (video, frame, value) and (video, frame, vector).

Order comes from windows partitioned by video; a video's frames are bounded by its length, so
no window holds more than one clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions import axes as A


def _by(order: str = "frame") -> Window:
    return Window.partitionBy("video").orderBy(order)


def _whole() -> Window:
    return Window.partitionBy("video")


def number_frames(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``frame`` from 0 and ``frames``, the clip's length."""
    w = Window.partitionBy("video").orderBy(*order)
    return rows.withColumn("frame", F.row_number().over(w) - 1).withColumn("frames", F.count("*").over(_whole()))


def adjacent(rows: DataFrame, column: str = "value") -> DataFrame:
    """Each frame beside the one before it."""
    return rows.withColumn("previous", F.lag(column).over(_by())).where(F.col("previous").isNotNull())


def anchors(rows: DataFrame, column: str = "value") -> DataFrame:
    """First, last and second-last value of each clip, by aggregation alone."""
    value = F.col(column)
    return rows.groupBy("video").agg(
        F.min_by(value, F.col("frame")).alias("first"),
        F.max_by(value, F.col("frame")).alias("last"),
        F.max_by(value, F.when(F.col("frame") < F.col("frames") - 1, F.col("frame"))).alias("second_last"),
    )


def kinematic_score(rows: DataFrame) -> DataFrame:
    """Mean flow against five times its 80th percentile; a still clip scores 1."""
    flow = F.abs(F.col("value"))
    stats = rows.groupBy("video").agg(F.avg(flow).alias("mean_flow"), F.percentile(flow, F.lit(0.8)).alias("p80"))
    score = F.when(F.col("p80") <= 0, 1.0).otherwise(F.greatest(F.lit(0.10), 1.0 - F.least(F.try_divide(F.col("mean_flow"), F.col("p80") * 5.0), F.lit(1.0))))
    return stats.withColumn("score", F.coalesce(score, F.lit(1.0))).withColumn("static", A.is_static(F.col("mean_flow"), F.col("mean_flow") < 20.0))


def count_invariant(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """How well a count per frame (``n``) stays at its nominal value."""
    nominal = F.lit(float(expected)) if expected else F.greatest(F.lit(1.0), F.bround(F.median("n").over(_whole()), 0))
    rows = rows.withColumn("nominal", nominal)
    frame = F.greatest(F.lit(0.1), 1.0 - 2.0 * F.abs(F.col("n") - F.col("nominal")) / F.col("nominal"))
    out = rows.withColumn("frame_score", frame).groupBy("video").agg(F.first("nominal").alias("nominal"), F.max("n").alias("most"), F.min("n").alias("least"), F.avg("frame_score").alias("mean"))
    score = F.when(F.col("most") == 0, F.lit(0.10)).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("mean"))))
    return out.select("video", "nominal", score.alias("score"), ((F.col("most") == F.col("least")) & (F.col("most") > 0)).alias("stable"))


def weighted_count_score(rows: DataFrame) -> DataFrame:
    """Difficulty-weighted mean of scores, at least 0.10."""
    return rows.agg(F.greatest(F.lit(0.10), F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), F.lit(0.10))).alias("score"))


def merge_fraction(rows: DataFrame, expected: int) -> DataFrame:
    """Share of frames with fewer than 0.7 of the expected components."""
    merged = (F.col("n") < int(expected * 0.7)).cast("int").cast("double")
    return rows.groupBy("video").agg(F.avg(merged).alias("merge_fraction")).withColumn("score", 1.0 - F.col("merge_fraction"))


def variation_score(rows: DataFrame) -> DataFrame:
    """Coefficient of variation and the score it gives to a rigid link."""
    stats = rows.groupBy("video").agg((F.stddev_pop("value") / (F.avg("value") + 1e-8)).alias("cv"))
    return stats.withColumn("score", F.greatest(F.lit(0.1), 1.0 - F.col("cv") * 5.0))


def direction(rows: DataFrame) -> DataFrame:
    """Sign changes of the differences, and whether the direction holds (at most 15 %)."""
    step = rows.withColumn("d", F.col("value") - F.lag("value").over(_by()))
    step = step.withColumn("turn", (F.signum("d") != F.signum(F.lag("d").over(_by()))).cast("int"))
    out = step.groupBy("video").agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("turns"), F.count("d").alias("steps"), F.bool_and(F.col("d") >= 0).alias("up"), F.bool_and(F.col("d") <= 0).alias("down"))
    return out.select("video", "turns", "steps", (F.col("turns") <= 0.15 * F.col("steps")).alias("consistent"), F.coalesce(F.col("up") | F.col("down"), F.lit(True)).alias("monotonic"))


def moving_average(rows: DataFrame, width: int = 13) -> DataFrame:
    """Centred mean with zeros beyond the ends."""
    half = width // 2
    return rows.withColumn("smooth", F.sum("value").over(_by().rowsBetween(-half, half)) / width)


def merge_gaps(rows: DataFrame, column: str, gap: float) -> DataFrame:
    """Positions that open a group: those beyond ``gap`` from the last kept one.

    What is kept depends on what was kept before, so it is a fold over the clip's sorted positions.
    """
    start = F.array().cast("array<double>")
    fold = lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > gap), F.concat(kept, F.array(x))).otherwise(kept)
    sorted_ = rows.groupBy("video").agg(F.array_sort(F.collect_list(F.col(column).cast("double"))).alias("at"))
    kept = F.aggregate("at", start, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(fold(acc, x)))
    return sorted_.select("video", kept.alias("kept")).withColumn("groups", F.size("kept"))


def stride_sample(rows: DataFrame, parts: int = 8) -> DataFrame:
    """Every (frames / parts)-th frame, and the last."""
    step = F.greatest(F.lit(1), F.expr(f"frames div {parts}"))
    return rows.where((F.col("frame") % step == 0) | (F.col("frame") == F.col("frames") - 1))


def even_sample(rows: DataFrame, k: int = 8) -> DataFrame:
    """k frames spread evenly, ends included; all of a shorter clip. Halves round to even."""
    spot = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i.cast("double") * (F.col("frames") - 1) / F.lit(float(k - 1)), 0).cast("int"))
    return rows.where((F.col("frames") <= k) | F.array_contains(spot, F.col("frame").cast("int")))


def thirds_sample(rows: DataFrame) -> DataFrame:
    """First, one third, two thirds, last."""
    n = F.col("frames")
    return rows.where(F.col("frame").isin(0) | (F.col("frame") == F.expr("frames div 3")) | (F.col("frame") == F.expr("2 * frames div 3")) | (F.col("frame") == n - 1))


def first_middle_last(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("frame") == 0) | (F.col("frame") == F.expr("frames div 2")) | (F.col("frame") == F.col("frames") - 1))


# -- vectors ---------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-8) | (nb < 1e-8), 0.0).otherwise(F.try_divide(dot(a, b), na * nb))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def pad(vector: Column, length: Column) -> Column:
    """Zeros appended up to a length."""
    return F.concat(vector, F.array_repeat(F.lit(0.0), length - F.size(vector)))


def truncate(vector: Column, length: Column) -> Column:
    return F.slice(vector, F.lit(1), length)


def adjacent_cosine(rows: DataFrame) -> DataFrame:
    """Mean similarity of neighbouring frames' vectors."""
    pairs = adjacent(rows, "vector")
    return pairs.groupBy("video").agg(F.avg(cosine(F.col("previous"), F.col("vector"))).alias("similarity"), F.count("*").alias("pairs"))


def points(vector: Column) -> Column:
    """A vector as points of two coordinates; a frame's points are few and stay in its row."""
    count = F.expr("size(vector) div 2")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.get(vector, i * 2).cast("double").alias("x"), F.get(vector, i * 2 + 1).cast("double").alias("y")))


def _nearest(a: Column, b: Column) -> Column:
    gap = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    near = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: gap(p, q))))
    return F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def chamfer(rows: DataFrame) -> DataFrame:
    """Symmetric chamfer distance of neighbouring frames' points, and its score."""
    pairs = adjacent(rows.withColumn("points", points(F.col("vector"))), "points")
    d = (_nearest(F.col("previous"), F.col("points")) + _nearest(F.col("points"), F.col("previous"))) / 2.0
    return pairs.select("video", "frame", d.alias("chamfer")).withColumn("score", F.greatest(F.lit(0.1), 1.0 - F.col("chamfer")))


def ratio_matches(rows: DataFrame, parts: int = 8, ratio: float = 0.75) -> DataFrame:
    """Descriptors of a frame whose nearest one of the next frame is clearly nearer than the second.

    A frame's vector is cut into ``parts`` descriptors, compared within the row.
    """
    piece = lambda v: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(v, i * (64 // parts) + 1, F.lit(64 // parts)))
    pairs = adjacent(rows.withColumn("pieces", piece(F.col("vector"))), "pieces")
    two = F.transform("previous", lambda p: F.array_sort(F.transform("pieces", lambda q: distance(p, q))))
    good = F.filter(two, lambda d: F.get(d, F.lit(0)) < ratio * F.get(d, F.lit(1)))
    return pairs.select("video", "frame", F.size(good).alias("matches")).withColumn("score", F.when(F.col("matches") < 5, 0.10).when(F.col("matches") < 20, 0.25).otherwise(F.col("matches") / float(parts)))


def link_lengths(rows: DataFrame, k: int = 4) -> DataFrame:
    """Distances between the first k points of each frame, upper triangle, within the row."""
    pts = F.slice(points(F.col("vector")), 1, k)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sqrt(F.pow(pts[i]["x"] - pts[j]["x"], 2) + F.pow(pts[i]["y"] - pts[j]["y"], 2)).alias("length")) for i in range(k) for j in range(i + 1, k)]
    return rows.select("video", "frame", F.inline(F.array(*pairs)))
