"""Checks of clips out of what kernels measured in each frame or pair of frames.

A series has (video, frame, value), value a number or an array of numbers; every check is an
aggregation by video, after at most one window over the clip's own frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions import axes as A
from benchloom.kernels import pixels as P
from benchloom.kernels import registry as K
from benchloom.operators import measures as M
from benchloom.operators import scoring as S
from benchloom.operators import series as X

#: What counts an element's occurrences in a frame; fixed values: how hard each element is to keep.
ELEMENTS = {"fuselage_protrusions": ("edge_components", 0.6), "turbine_blades": ("polar_peaks", 0.9), "track_links": ("track_links", 0.95), "via_holes": ("via_holes", 0.7)}
#: Names of the regions of ``P.BANDS``.
BAND_NAMES = ("default", "top_30", "bottom_30", "left_40", "right_40")


def within(score: Column, low: float = 0.0, digits: int | None = 4) -> Column:
    """A score between ``low`` and 1, rounded."""
    score = F.greatest(F.lit(low), F.least(F.lit(1.0), score))
    return score if digits is None else F.round(score, digits)


def _by() -> Window:
    return Window.partitionBy("video").orderBy("frame")


def deviation(mean: Column, spread: Column) -> Column:
    """Spread in per cent of the mean."""
    return spread / (mean + 1e-8) * 100.0


def static_camera(flows: DataFrame) -> DataFrame:
    """(video, mean_flow, dark, static, kinematic): out of the flows of a clip; the kinematic score compares them with their 80th percentile."""
    stats = flows.groupBy("video").agg(F.avg("value").alias("mean_flow"), F.percentile("value", F.lit(0.8)).alias("p80"), F.bool_or("dark").alias("dark"))
    score = F.when(F.col("p80") <= 0, 1.0).otherwise(F.greatest(F.lit(0.10), 1.0 - F.least(F.try_divide(F.col("mean_flow"), F.col("p80") * 5.0), F.lit(1.0))))
    return stats.select("video", "mean_flow", "dark", (F.col("mean_flow") < F.when(F.col("dark"), 0.5).otherwise(0.8)).alias("static"), score.alias("kinematic"))


def count_check(counts: DataFrame, weight: float, expected: int | None = None) -> DataFrame:
    """(video, score, stable, weight, counts): whether a count per frame holds."""
    rows = counts.select("video", "frame", F.col("value").alias("n"))
    listed = counts.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame", F.col("value").cast("int").alias("n")))).alias("c"))
    got = X.count_invariant(rows, expected).join(listed, "video")
    return got.select("video", within(F.col("score"), 0.1).alias("score"), "stable", F.lit(weight).alias("weight"), F.transform("c", lambda x: x["n"]).alias("counts"))


def merge_check(counts: DataFrame, expected: int) -> DataFrame:
    """(video, score, merge_fraction): share of frames in which components have merged."""
    got = X.merge_fraction(counts.select("video", F.col("value").alias("n")), expected)
    return got.select("video", within(F.col("score")).alias("score"), F.round("merge_fraction", 4).alias("merge_fraction"))


def trace_check(periods: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """(video, score): whether the dominant period of a clip's frames holds; 0 is no period."""
    some = F.when(F.col("value") > 0, F.col("value"))
    stats = periods.groupBy("video").agg(F.count(some).alias("n"), F.avg(some).alias("mean"), F.stddev_pop(some).alias("spread"))
    off = deviation(F.col("mean"), F.col("spread"))
    return stats.select("video", F.when(F.col("n") == 0, 0.0).when(F.col("n") < 2, 0.5).when(off <= tolerance, 1.0).when(off <= 2 * tolerance, 0.5).otherwise(0.0).alias("score"))


def jacket_check(frequencies: DataFrame) -> DataFrame:
    """(video, score): likeness of neighbouring frames' strongest frequencies, shorter lists filled with zeros; 0 for a single frame."""
    before = F.lag("value").over(_by())
    length = F.greatest(F.size("value"), F.size("before"))
    fill = lambda c: X.pad(F.col(c), length)
    pairs = frequencies.withColumn("before", before)
    like = F.when(F.col("before").isNotNull(), F.greatest(F.lit(0.0), X.cosine(fill("before"), fill("value"))))
    return pairs.select("video", like.alias("like")).groupBy("video").agg(within(F.coalesce(F.avg("like"), F.lit(0.0))).alias("score"))


def turbine_check(symmetry: DataFrame) -> DataFrame:
    """(video, score): mean of the frames' symmetry."""
    return symmetry.groupBy("video").agg(within(F.avg(F.coalesce("value", F.lit(0.0)))).alias("score"))


def _coupled(rows: DataFrame, score: Column, off: Column, rigid: Column, enough: Column) -> DataFrame:
    """(video, score, deviation, rigid), the least of scores and all of deviation where too little was found."""
    return rows.select(
        "video",
        F.when(enough, within(score, 0.1)).otherwise(0.10).alias("score"),
        F.when(enough, F.round(off, 2)).otherwise(100.0).alias("deviation"),
        (enough & rigid).alias("rigid"),
    )


def scissor_check(angles: DataFrame) -> DataFrame:
    """(video, score, deviation, rigid): a scissor's angle goes one way in even steps; frames without an angle are left out."""
    rows = angles.where(F.col("value").isNotNull()).withColumn("step", F.col("value") - F.lag("value").over(_by()))
    stats = rows.groupBy("video").agg(F.count("value").alias("n"), F.bool_and(F.col("step") >= 0).alias("up"), F.bool_and(F.col("step") <= 0).alias("down"), F.avg(F.abs("step")).alias("mean"), F.stddev_pop(F.abs("step")).alias("spread"))
    stats = angles.select("video").distinct().join(stats, "video", "left")
    off = F.when(F.col("mean") > 1e-3, deviation(F.col("mean"), F.col("spread"))).otherwise(0.0)
    one_way = F.col("up") | F.col("down")
    score = F.when(one_way & (off < 10), 1.0).when(one_way & (off < 25), 0.50 + 0.40 * (1.0 - (off - 10.0) / 15.0)).otherwise(0.10 + 0.40 * F.greatest(F.lit(0.0), 1.0 - off / 100.0))
    return _coupled(stats, score, off, one_way & (off < 25), F.coalesce(F.col("n") >= 2, F.lit(False)))


def arm_check(lengths: DataFrame) -> DataFrame:
    """(video, score, deviation, rigid): links keep their lengths; as many are compared as every frame with three points or more has."""
    rows = lengths.where(F.size("value") >= 3)
    least = rows.groupBy("video").agg(F.min(F.size("value")).alias("least"), F.count("*").alias("n"))
    links = rows.join(least, "video").select("video", F.posexplode(X.truncate(F.col("value"), F.col("least"))).alias("link", "length"))
    links = links.groupBy("video", "link").agg((F.stddev_pop("length") / (F.avg("length") + 1e-8)).alias("off"))
    off = links.groupBy("video").agg(F.avg("off").alias("off"))
    stats = lengths.select("video").distinct().join(least, "video", "left").join(off, "video", "left")
    return _coupled(stats, 1.0 - F.col("off") * 5.0, F.col("off") * 100.0, F.col("off") * 100.0 < 5.0, F.coalesce(F.col("n") >= 2, F.lit(False)))


def conveyor_check(flows: DataFrame) -> DataFrame:
    """(video, score, deviation, rigid): a belt's flow keeps its direction and its speed."""
    turn = F.signum("value") != F.signum(F.lag("value").over(_by()))
    rows = flows.withColumn("turn", turn.cast("int"))
    stats = rows.groupBy("video").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"), F.bool_and(F.col("value") >= 0).alias("on"), F.bool_and(F.col("value") <= 0).alias("back"), F.avg(F.abs("value")).alias("mean"), F.stddev_pop(F.abs("value")).alias("spread"))
    off = deviation(F.col("mean"), F.col("spread"))
    steady = F.col("on") | F.col("back") | (F.coalesce("turns", F.lit(0)) <= F.col("n") * 0.15)
    score = F.when(steady & (off < 20), 1.0).when(steady & (off < 50), 0.50 + 0.40 * (1.0 - (off - 20.0) / 30.0)).otherwise(0.10 + 0.30 * F.greatest(F.lit(0.0), 1.0 - off / 100.0))
    return _coupled(stats, score, off, steady & (off < 50), F.col("n") > 0)


def chain_check(bands: DataFrame) -> DataFrame:
    """(video, score, band): how well a track chain repeats from frame to frame, in the best region if the default one shows little."""
    means = bands.groupBy("video").agg(*(F.avg(F.get("value", F.lit(i))).alias(f"b{i}") for i in range(len(P.BANDS))))
    best = F.greatest(*(F.col(f"b{i}") for i in range(len(P.BANDS))))
    first = F.coalesce(*(F.when(F.col(f"b{i}") == best, F.lit(n)) for i, n in enumerate(BAND_NAMES)))
    plain = F.col("b0") >= 0.3
    return means.select("video", within(F.when(plain, F.col("b0")).otherwise(best), digits=None).alias("score"), F.when(plain, BAND_NAMES[0]).otherwise(first).alias("band"))


# -- scores of whole clips --------------------------------------------------------------------


def temporal(frames: DataFrame, size: K.Size = P.FRAME) -> DataFrame:
    """(video, temporal): likeness of neighbouring frames of a sample of each clip, 0..100; null for a single frame."""
    count = Window.partitionBy("video")
    rows = X.stride_sample(frames.withColumn("frames", F.count("*").over(count)))
    likeness = K.apply_kernel(rows, "ssim", size).groupBy("video").agg(F.avg("value").alias("ssim"))
    lengths = frames.groupBy("video").agg(F.count("*").alias("frames"))
    return lengths.join(likeness, "video", "left").select("video", M.temporal_consistency(F.col("ssim"), F.col("frames"), F.lit(None).cast("double")).alias("temporal"))


def fidelity(frames: DataFrame, references: DataFrame, size: K.Size = P.FRAME) -> DataFrame:
    """(video, fidelity): likeness of a clip's first, middle and last frame to its reference image (video, height, width, channels, pixels), 0..100."""
    count = Window.partitionBy("video")
    rows = X.first_middle_last(frames.withColumn("frames", F.count("*").over(count)))
    rows = rows.join(references.select("video", *(F.col(c).alias(f"last_{c}") for c in K.WHOLE)), "video")
    mean = lambda name: K.measured(rows, name, size).groupBy("video").agg(F.avg("value").alias(name))
    got = rows.groupBy("video").agg(F.first("frames").alias("frames")).join(mean("ssim"), "video").join(mean("histogram_correlation"), "video")
    return got.select("video", M.visual_fidelity(F.col("ssim"), F.col("histogram_correlation"), F.col("frames"), F.lit(None).cast("double")).alias("fidelity"))


def geometry(frames: DataFrame, clips: DataFrame, size: K.Size = P.FRAME) -> DataFrame:
    """(video, method, geometry) of clips (video, sub, topology): the score that a clip's topology calls for, 0..1.

    Each measure reads only the clips that call for it.
    """
    method, _ = M.geometry_route(F.col("sub"), F.col("topology"), {})
    wanted = clips.select("video", "sub", "topology", method.alias("method"))
    only = lambda *names: frames.join(wanted.where(F.col("method").isin(*names)).select("video"), "video", "left_semi")

    def ends(*names: str) -> DataFrame:
        rows = only(*names)
        whole = F.struct("frame", *K.WHOLE)
        both = rows.groupBy("video").agg(F.min_by(whole, "frame").alias("first"), F.max_by(whole, "frame").alias("last"))
        return both.select("video", "last.frame", *(F.col(f"last.{c}").alias(c) for c in K.WHOLE), *(F.col(f"first.{c}").alias(f"last_{c}") for c in K.WHOLE))

    def firsts(*names: str) -> DataFrame:
        return only(*names).groupBy("video").agg(F.min_by(F.struct("frame", *K.WHOLE), "frame").alias("f")).select("video", "f.*")

    number = lambda i: F.get("value", F.lit(i))
    still = static_camera(K.static_flows(only("kinematic", "articulated"), size)).select("video", F.col("kinematic").alias("kinematic"))
    even = K.apply_kernel(only("articulated"), "bilateral_symmetry", size).groupBy("video").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("even"))
    parts = [
        K.apply_kernel(firsts("spectral"), "spectral_peaks", size).select("video", F.col("value").alias("spectral")),
        K.apply_kernel(firsts("rotary"), "circle_rim", size).select("video", F.col("value").alias("rotary")),
        K.measured(ends("lattice"), "lattice_match", size).select("video", M.lattice_score(number(0), number(1), number(2)).alias("lattice")),
        K.measured(ends("surface"), "contour_chamfer", size).select("video", M.surface_score(F.col("value")).alias("surface")),
        still, even,
    ]
    rows = wanted
    for part in parts:
        rows = rows.join(part, "video", "left")
    # A clip of one frame has no flow and counts as still.
    rows = rows.withColumn("kinematic", F.coalesce("kinematic", F.lit(1.0)))
    measures = {c: F.col(c) for c in ("spectral", "lattice", "surface", "rotary", "kinematic")} | {"articulated": A.kinematic_blend(F.col("kinematic"), F.coalesce("even", F.lit(0.0)))}
    return rows.select("video", "method", M.geometry_route(F.col("sub"), F.col("topology"), measures)[1].alias("geometry"))


# -- all checks a clip calls for ------------------------------------------------------------


def check(frames: DataFrame, checker: str, argument: str, size: K.Size) -> DataFrame:
    """(video, score, violation): one checker over clips; ``violation`` is null where it has nothing to say."""
    k = lambda name: K.apply_kernel(frames, name, size)
    told = lambda bad, *text: F.when(bad, F.concat(F.lit(f"{checker}: "), *text)).alias("violation")
    if checker == "check_count_invariant":
        got = count_check(k(ELEMENTS[argument][0]), ELEMENTS[argument][1])
        listed = F.concat(F.lit("["), F.array_join(F.transform("counts", lambda n: n.cast("string")), ", "), F.lit("]"))
        return got.select("video", "score", told(~F.col("stable"), F.lit(f"element '{argument}' count varied across frames: "), listed))
    if checker == "check_topology_merge":
        got = merge_check(k("merged_components"), int(argument))
        return got.select("video", "score", told(F.col("merge_fraction") > 0.3, F.lit("topology merge detected in "), F.format_string("%.0f", F.col("merge_fraction") * 100.0), F.lit("% of frames")))
    if checker == "check_periodic_structure":
        kernel, judge = {"pcb_trace": ("trace_period", trace_check), "lattice_jacket": ("top_frequencies", jacket_check), "turbine_array": ("blade_periodicity", turbine_check)}[argument]
        return judge(k(kernel)).select("video", "score", F.lit(None).cast("string").alias("violation"))
    got = {"scissor_lift": lambda: scissor_check(k("scissor_angle")), "robotic_arm": lambda: arm_check(K.tracked_lengths(frames, size)), "conveyor": lambda: conveyor_check(k("belt_flow"))}[argument]()
    return got.select("video", "score", told(~F.col("rigid"), F.lit(f"{argument} coupling deviation "), F.format_string("%.1f", "deviation"), F.lit("%")))


def constraints(frames: DataFrame, clips: DataFrame, size: K.Size = P.FRAME) -> DataFrame:
    """(video, constraint, violations, invariants) of clips (video, domain, topology, task_category).

    Which checkers a clip calls for is looked up by domain and topology, else by category; a checker that
    gives nothing scores 0; clips without any have a null constraint.  Each checker reads only the clips that call for it.
    """
    from benchloom import registry as R

    wanted = S.dispatch(clips).select("video", F.posexplode_outer("checkers").alias("at", "c")).select("video", "at", "c.checker", "c.argument")
    kinds = sorted({c for cs in (*R.CHECKERS.values(), *R.FALLBACK_CHECKERS.values()) for c in cs})
    results = None
    for checker, argument in kinds:
        who = wanted.where((F.col("checker") == checker) & (F.col("argument") == argument)).select("video")
        got = check(frames.join(who, "video", "left_semi"), checker, argument, size).select("video", F.lit(checker).alias("checker"), F.lit(argument).alias("argument"), "score", "violation")
        results = got if results is None else results.unionByName(got)
    rows = wanted.join(results, ["video", "checker", "argument"], "left")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("x"))))), lambda s: s["x"])
    score = F.when(F.count("checker") > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.when(F.col("checker").isNotNull(), F.coalesce("score", F.lit(0.0)))))), 4))
    return rows.groupBy("video").agg(score.alias("constraint"), listed("violation").alias("violations"), listed("checker").alias("invariants"))
