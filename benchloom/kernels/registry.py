"""Kernels by name, and their application to frame relations.

A frame relation has (video, frame, height, width, channels, pixels); frames are brought to one
size before anything is measured.  Single-frame kernels run batch by batch, pair kernels take the frame before it
from a window, scans hold one frame of a sorted partition at a time: pixels never gather
in one task.  Kernels that need a feature or codec library are registered as unavailable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.kernels import features, motion as M
from benchloom.kernels import pixels as P


@dataclass(frozen=True)
class Kernel:
    """A function of a frame, or of a frame and the one before it, that gives a number or a few."""

    run: Callable
    pair: bool = False
    colour: bool = False
    many: bool = False


KERNELS: dict[str, Kernel] = {}
#: Kernels that need an optional library; asking for one says so.
NEEDS_LIBRARY = ("video_decode", "jpeg_encode")
Size = tuple[int, int] | None


def register(name: str, run: Callable, pair: bool = False, colour: bool = False, many: bool = False) -> None:
    """Adds a kernel frame -> number, or (frame before, frame) -> number; ``many`` kernels give arrays."""
    KERNELS[name] = Kernel(run, pair, colour, many)


for _f in (P.dark_background, P.bilateral_symmetry, P.via_holes, P.merged_components, P.edge_components, P.spectral_peaks, P.polar_peaks, P.track_links, P.trace_period, P.blade_periodicity, M.scissor_angle, features.circle_rim):
    register(_f.__name__, _f)
for _f in (P.ssim, P.roi_correlation, M.mean_flow, M.belt_flow):
    register(_f.__name__, _f, pair=True)
register("histogram_correlation", P.histogram_correlation, pair=True, colour=True)
register("contour_chamfer", lambda a, b: P.chamfer_distance(P.contour_points(a), P.contour_points(b)), pair=True)
register("top_frequencies", P.top_frequencies, many=True)
register("lattice_match", features.lattice_match, pair=True, many=True)
register("phase_shift", P.phase_shift, pair=True, many=True)
register("band_correlations", P.band_correlations, pair=True, many=True)


def kernels() -> tuple[str, ...]:
    return tuple(KERNELS)


WHOLE = ("height", "width", "channels", "pixels")


def decode(height: int, width: int, channels: int, data: bytes, size: Size, colour: bool = False) -> np.ndarray:
    """A frame as numbers, of the given size; grey unless ``colour``."""
    frame = np.frombuffer(data, np.uint8).reshape((int(height), int(width), int(channels)))
    frame = P.colour(frame).astype(float) if colour else frame
    if size is None:
        return frame if colour else P.grey(frame)
    return P.normalise_frame(frame, size) if colour else P.grey(np.rint(P.normalise_frame(frame.astype(float), size)))


def beside_last(frames: DataFrame) -> DataFrame:
    """Each frame but a clip's first, with the one before it under the names ``last_...``."""
    last = F.lag(F.struct(*WHOLE)).over(Window.partitionBy("video").orderBy("frame"))
    rows = frames.withColumn("last", last).where(F.col("last").isNotNull())
    return rows.select("*", *(F.col(f"last.{c}").alias(f"last_{c}") for c in WHOLE)).drop("last")


def images(pdf: pd.DataFrame, size: Size, colour: bool = False, prefix: str = "") -> Iterator[np.ndarray]:
    """The frames of a batch, one at a time."""
    for whole in zip(*(pdf[prefix + c] for c in WHOLE)):
        yield decode(*whole, size, colour)


def apply_kernel(frames: DataFrame, name: str, size: Size = P.FRAME) -> DataFrame:
    """video, frame, value: what a kernel gives for every frame, or for every frame after the first.

    Frames are brought to ``size`` (height, width), or kept as they are where it is None.  A number that a kernel cannot give is null.
    """
    if name in NEEDS_LIBRARY:
        raise NotImplementedError(f"{name} needs a library that is not installed; register a kernel of your own under this name")
    return measured(beside_last(frames) if KERNELS[name].pair else frames, name, size)


def measured(rows: DataFrame, name: str, size: Size = P.FRAME) -> DataFrame:
    """What a kernel gives for every row; a pair kernel compares it with the frame in its ``last_...`` columns."""
    kernel = KERNELS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            now = images(pdf, size, kernel.colour)
            got = map(kernel.run, images(pdf, size, kernel.colour, "last_"), now) if kernel.pair else map(kernel.run, now)
            out = [[float(x) for x in g] if kernel.many else None if g is None else float(g) for g in got]
            yield pd.DataFrame({"video": pdf["video"], "frame": pdf["frame"], "value": pd.Series(out, index=pdf.index, dtype=object)})

    kind = "array<double>" if kernel.many else "double"
    columns = ["video", "frame", *WHOLE, *(f"last_{c}" for c in WHOLE if kernel.pair)]
    return rows.select(*columns).mapInPandas(run, f"video bigint, frame bigint, value {kind}")


def tracked_lengths(frames: DataFrame, size: Size = P.FRAME, most: int = 20) -> DataFrame:
    """video, frame, value: distances between the corners of a clip's first frame as far as they can be followed.

    Frames arrive sorted; a worker holds the last frame and its points, whatever a clip's length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, last, points = None, None, None
        for pdf in batches:
            out = []
            for v, now in zip(pdf["video"], images(pdf, size)):
                if v != video:
                    video, points = v, M.harris_corners(now, most)
                elif len(points):
                    there, found = M.track(last, now, points)
                    points = there[found]
                last = now
                out.append(M.link_lengths(points).tolist())
            yield pd.DataFrame({"video": pdf["video"], "frame": pdf["frame"], "value": pd.Series(out, index=pdf.index, dtype=object)})

    rows = frames.select("video", "frame", *WHOLE).repartition("video").sortWithinPartitions("video", "frame")
    return rows.mapInPandas(run, "video bigint, frame bigint, value array<double>")


def anchor_frames(frames: DataFrame) -> DataFrame:
    """One row a clip: its length and its first, second, second-last and last frame, by aggregation alone."""
    whole = F.struct(*WHOLE)
    ends = frames.groupBy("video").agg(F.min("frame").alias("least"), F.max("frame").alias("most"), F.count("*").alias("frames"))
    rows = frames.join(ends, "video")
    at = lambda c: F.max_by(whole, F.when(c, F.col("frame")))
    return rows.groupBy("video").agg(
        F.first("frames").alias("frames"),
        F.min_by(whole, "frame").alias("first"),
        F.min_by(whole, F.when(F.col("frame") > F.col("least"), F.col("frame"))).alias("second"),
        at(F.col("frame") < F.col("most")).alias("second_last"),
        F.max_by(whole, "frame").alias("last"),
    )


def camera_motion(frames: DataFrame, motions: DataFrame, size: Size = P.FRAME) -> DataFrame:
    """video, degrees, method, for the clips of ``motions`` (video, motion); degrees are null where they cannot be calculated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, motion, *ends in zip(pdf["frames"], pdf["motion"], *(pdf[c] for c in ("first", "second", "second_last", "last"))):
                grey = [None if e is None or e["pixels"] is None else decode(*(e[c] for c in WHOLE), size) for e in ends]
                out.append((0.0, "static_detected") if n < 2 else M.camera_motion(*grey, n, motion == "crane"))
            yield pd.DataFrame({"video": pdf["video"], "degrees": pd.Series([d for d, _ in out], index=pdf.index, dtype=object), "method": [m for _, m in out]})

    rows = anchor_frames(frames).join(motions.select("video", "motion"), "video")
    return rows.mapInPandas(run, "video bigint, degrees double, method string")


def static_flows(frames: DataFrame, size: Size = P.FRAME) -> DataFrame:
    """video, frame, value, dark: mean flow of each pair of frames, of the centre where the clip's first frame has a dark background."""
    firsts = frames.groupBy("video").agg(F.min_by(F.struct("frame", *WHOLE), "frame").alias("f")).select("video", "f.*")
    dark = apply_kernel(firsts, "dark_background", size).select("video", (F.col("value") > 0).alias("dark"))
    pairs = beside_last(frames).join(dark, "video")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flows = map(M.static_flow, images(pdf, size, prefix="last_"), images(pdf, size), pdf["dark"])
            yield pd.DataFrame({"video": pdf["video"], "frame": pdf["frame"], "value": list(flows), "dark": pdf["dark"]})

    return pairs.select("video", "frame", *WHOLE, *(f"last_{c}" for c in WHOLE), "dark").mapInPandas(run, "video bigint, frame bigint, value double, dark boolean")


#: Sub-topology -> kernel of its geometry score, then by topology; anything else scores 0.
ROUTES = {"2d_planar": "spectral_peaks", "3d_spatial": "lattice_match", "aerodynamic": "contour_chamfer", "rigid_housing": "lattice_match", "articulated": "bilateral_symmetry", "rotational": "circle_rim", "cable_hose": "static_flows"}
TOPOLOGY_ROUTES = {"kinematic": "static_flows", "flexible": "static_flows", "lattice": "lattice_match", "surface": "lattice_match"}
