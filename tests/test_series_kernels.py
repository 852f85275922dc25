"""Frame series and pixel kernels on cases with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.kernels import apply_kernel, features as X2, motion as M, pixels as P, registry as KR
from benchloom.operators import clips as C, series as X


def clip(spark, values, n=None):
    rows = [(1, i, float(v), int(n[i]) if n else 0) for i, v in enumerate(values)]
    return X.number_frames(spark.createDataFrame(rows, "video bigint, ts bigint, value double, n bigint"), "ts")


def test_still_clip_scores_one(spark):
    assert X.kinematic_score(clip(spark, [0, 0, 0])).first()["score"] == 1.0


def test_counts(spark):
    assert X.count_invariant(clip(spark, [0] * 4, [2, 2, 2, 2])).first()["score"] == 1.0
    r = X.count_invariant(clip(spark, [0] * 4, [2, 4, 2, 4])).first()
    assert r["score"] < 0.8 and not r["stable"]
    assert X.count_invariant(clip(spark, [0] * 2, [0, 0])).first()["score"] == pytest.approx(0.10)


def test_direction(spark):
    assert X.direction(clip(spark, [1, 2, 3, 4])).first().asDict() == {"video": 1, "turns": 0, "steps": 3, "consistent": True, "monotonic": True}
    assert X.direction(clip(spark, [1, 2, 1, 2])).first()["consistent"] is False


def test_samples(spark):
    c = clip(spark, range(20))
    pick = lambda f: [r["frame"] for r in f(c).orderBy("frame").collect()]
    assert pick(X.stride_sample) == [*range(0, 20, 2), 19]
    assert pick(X.even_sample) == [round(i * 19 / 7) for i in range(8)]
    assert pick(X.thirds_sample) == [0, 6, 13, 19] and pick(X.first_middle_last) == [0, 10, 19]


def test_gap_merge_compares_with_the_last_kept(spark):
    got = X.merge_gaps(clip(spark, range(12)), "frame", 5.0).first()
    assert got["kept"] == [0.0, 6.0]


def test_single_frame_and_empty(spark):
    assert X.adjacent(clip(spark, [1])).count() == 0 and X.anchors(clip(spark, [1])).first()["second_last"] is None
    assert X.adjacent(clip(spark, [1]).limit(0)).count() == 0


def test_cosine_of_nothing_is_zero(spark):
    a, b = F.array(F.lit(0.0)), F.array(F.lit(1.0))
    assert spark.range(1).select(X.cosine(a, b)).first()[0] == 0.0 and spark.range(1).select(X.cosine(b, b)).first()[0] == 1.0


def square(n=64, at=20, size=16, value=200):
    g = np.zeros((n, n))
    g[at : at + size, at : at + size] = value
    return g


def test_ssim_and_correlation_of_equal_frames():
    g = square()
    assert P.ssim(g, g) == pytest.approx(1.0) and P.histogram_correlation(g, g) == pytest.approx(1.0) and P.roi_correlation(g, g) == pytest.approx(1.0)


def test_phase_shift_finds_the_translation():
    rng = np.random.default_rng(1)
    g = P.blur(rng.uniform(0, 255, (80, 100)), 9, 2.0) * 3 - 256
    dx, dy, strength = P.phase_shift(np.clip(g, 0, 255), np.clip(np.roll(g, (3, -4), (0, 1)), 0, 255))
    assert (dx, dy) == pytest.approx((-4.0, 3.0), abs=0.3) and strength > 0
    assert P.phase_shift(np.zeros((20, 20)), square(20, 4)) == (0.0, 0.0, 0.0)


def test_symmetry():
    assert P.bilateral_symmetry(square(at=24)) == 1.0


def test_components():
    m = np.zeros((20, 20), bool)
    m[2:5, 2:5] = m[5, 5] = m[10:12, 10:18] = True
    assert P.components(m) == 2 and P.components(m, 0.03) == 1


def test_components_join_late():
    m = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert P.components(m) == 1


def test_via_holes():
    g = np.full((64, 64), 220.0)
    g[8:15, 8:15] = g[30:40, 30:40] = 10
    g[:3] = 10  # outside the part that is looked at
    assert P.via_holes(g) == 2


def test_trace_period():
    g = np.tile(128 + 100 * np.sin(2 * np.pi * np.arange(64) / 8), (64, 1))
    assert P.trace_period(g) == 8.0 and P.trace_period(square() * 0) == 0.0


def test_chamfer():
    a = np.array([[0.0, 0.0], [1.0, 0.0]])
    assert P.chamfer_distance(a, a) == 0.0 and P.chamfer_distance(a, a + [0, 0.5]) == 0.5 and P.chamfer_distance(a, a[:0]) == np.inf


def test_resize_keeps_the_mean():
    g = np.random.default_rng(0).uniform(0, 255, (40, 60))
    assert P.resize(g, 20, 30).mean() == pytest.approx(g.mean()) and P.resize(g, 80, 120).shape == (80, 120) and P.resize(g, 40, 60) is g


SIZE = (64, 64)


def frames_of(spark, clips, channels=1):
    """{video: list of grey arrays} as a frame relation."""
    data = [(v, i, *g.shape, channels, bytearray(np.repeat(np.rint(g).astype(np.uint8)[..., None], channels, 2).tobytes())) for v, fs in clips.items() for i, g in enumerate(fs)]
    return spark.createDataFrame(data, "video bigint, frame bigint, height int, width int, channels int, pixels binary")


def test_kernels_over_frames(spark):
    f = frames_of(spark, {1: [square(at=20 + i) for i in range(3)]})
    assert apply_kernel(f, "via_holes", SIZE).count() == 3
    assert all(len(r["value"]) == 3 for r in apply_kernel(f, "phase_shift", SIZE).collect())
    with pytest.raises(NotImplementedError):
        apply_kernel(f, "video_decode")


def test_frames_are_brought_to_one_size(spark):
    small, large = square(32, 10, 8), square(64, 20, 16)
    one = [r["value"] for r in apply_kernel(frames_of(spark, {1: [small, large]}, 3), "ssim", SIZE).collect()]
    assert one[0] > 0.8
    assert {P.normalise_frame(np.zeros((9, 16))).shape, P.normalise_frame(np.zeros((1080, 1920, 3))).shape[:2]} == {P.FRAME}


def test_colour_histograms_differ_where_grey_ones_do_not(spark):
    a, b = np.zeros((4, 6, 3), np.uint8), np.zeros((4, 6, 3), np.uint8)
    a[:2, :, 0], b[:2, :, 2] = 250, 95  # blue and red of much the same luma
    rows = [(1, i, 4, 6, 3, bytearray(x.tobytes())) for i, x in enumerate((a, b, b))]
    f = spark.createDataFrame(rows, "video bigint, frame bigint, height int, width int, channels int, pixels binary")
    assert [round(r["value"], 3) for r in apply_kernel(f, "histogram_correlation", None).orderBy("frame").collect()] == [0.5, 1.0]


def scene(h=180, w=240, seed=0):
    rng = np.random.default_rng(seed)
    g = np.full((h, w), 120.0)
    for _ in range(60):
        y, x, a, b = (int(v) for v in (rng.integers(h - 20), rng.integers(w - 20), rng.integers(6, 20), rng.integers(6, 20)))
        g[y : y + a, x : x + b] = rng.integers(0, 255)
    return P.blur(g, 5, 1.0)


def moved(g, degrees=0.0, dx=0.0, dy=0.0):
    h, w = g.shape
    y, x = np.mgrid[:h, :w]
    t, px, py = np.deg2rad(degrees), x - w / 2 - dx, y - h / 2 - dy
    return M.sample(g, np.cos(t) * px + np.sin(t) * py + w / 2, -np.sin(t) * px + np.cos(t) * py + h / 2)


@pytest.mark.parametrize(("degrees", "dx", "dy"), [(5.0, 0.0, 0.0), (-12.0, 3.0, -2.0), (0.0, 4.5, -7.0)])
def test_transforms_are_found(degrees, dx, dy):
    g = scene()
    cos, sin, tx, ty = M.anchor_transform(g, moved(g, degrees, dx, dy))
    assert np.degrees(np.arctan2(sin, cos)) == pytest.approx(degrees, abs=0.2)
    if not degrees:
        assert (tx, ty) == pytest.approx((dx, dy), abs=0.1)


def test_a_few_strays_do_not_turn_the_transform():
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 100, (40, 2))
    b = a + [5.0, -3.0]
    b[:12] = rng.uniform(0, 100, (12, 2))
    got, agree = M.similarity(a, b)
    assert got == pytest.approx([1, 0, 5, -3], abs=1e-6) and agree >= 28
    assert M.similarity(a[:1], b[:1]) == (None, 0) and M.anchor_transform(np.zeros((40, 40)), np.zeros((40, 40))) is None


def test_dense_flow_of_texture():
    g = P.blur(np.random.default_rng(2).uniform(0, 255, (120, 160)), 9, 2.0)
    g = (g - g.mean()) * 6 + 128
    for dx, dy in ((2.0, -1.0), (5.0, 3.0)):
        flow = M.dense_flow(g, moved(g, 0, dx, dy))[:, 20:-20, 20:-20]
        assert np.median(flow[0]) == pytest.approx(dx, abs=0.3) and np.median(flow[1]) == pytest.approx(dy, abs=0.3)
    assert M.mean_flow(g, g) == pytest.approx(0.0, abs=1e-6) and M.median_flow(g, g) == (0.0, 0.0, 0.0)


def test_camera_motion_of_clips(spark):
    g = scene()
    clips = {1: [moved(g, 2.0 * i) for i in range(9)], 2: [moved(g, 0, 0, -5.0 * i) for i in range(9)], 3: [g] * 4, 4: [g]}
    motions = spark.createDataFrame([(1, "orbit"), (2, "crane"), (3, "pan"), (4, "orbit")], "video bigint, motion string")
    got = {r["video"]: (r["degrees"], r["method"]) for r in KR.camera_motion(frames_of(spark, clips, 3), motions, (180, 240)).collect()}
    assert got[1] == (pytest.approx(16.0, abs=0.3), "anchor_to_final_ransac")
    assert got[2] == (pytest.approx(M.crane_angle(40.0, 180), abs=0.3), "anchor_to_final_crane_translation")
    assert got[3] == got[4] == (0.0, "static_detected")


def test_flat_frames_cannot_be_calculated():
    flat, grid = np.full((80, 80), 200.0), np.add.outer(np.arange(80) * 2.0, np.zeros(80))
    assert M.camera_motion(flat, grid, flat, flat, 5, False)[1] in ("anchor_to_final_ransac", "static_detected")
    assert M.camera_motion(flat, flat, None, flat, 5, True) == (0.0, "static_detected")


def test_static_camera(spark):
    g = P.blur(np.random.default_rng(2).uniform(0, 255, (64, 64)), 9, 2.0)
    g = (g - g.mean()) * 6 + 128
    clips = {1: [g] * 3, 2: [moved(g, 0, 3.0 * i) for i in range(3)], 3: [np.zeros((64, 64))] * 3}
    got = {r["video"]: r for r in C.static_camera(KR.static_flows(frames_of(spark, clips), SIZE)).collect()}
    assert got[1]["static"] and got[1]["kinematic"] == 1.0 and not got[1]["dark"]
    assert not got[2]["static"] and got[2]["kinematic"] < 0.9 and got[3]["dark"] and got[3]["static"]


def test_corners_are_followed_frame_by_frame(spark):
    g = scene(120, 120)
    clips = {1: [moved(g, 0, 2.0 * i, i) for i in range(4)], 2: [g, np.full((120, 120), 90.0), g]}
    got = KR.tracked_lengths(frames_of(spark, clips), (120, 120))
    sizes = {(r["video"], r["frame"]): len(r["value"]) for r in got.collect()}
    assert sizes[1, 0] == 190 and sizes[1, 3] >= 45 and sizes[2, 0] == 190
    arm = {r["video"]: r for r in C.arm_check(got).collect()}
    assert arm[1]["rigid"] is not None


def test_key_points_match_across_a_turn():
    g = scene()
    a, b, matches = X2.lattice_match(g, moved(g, 10.0))
    assert a > 50 and b > 50 and matches > 0.5 * min(a, b)
    assert X2.lattice_match(g, np.random.default_rng(1).uniform(0, 255, g.shape))[2] < 0.05 * a
    assert X2.lattice_match(g * 0, g).tolist()[0::2] == [0.0, 0.0]


def test_circles():
    y, x = np.mgrid[:160, :200]
    g = np.full((160, 200), 60.0)
    g[np.hypot(y - 80, x - 110) < 45] = 200
    (cx, cy, r), *more = X2.hough_circles(g)
    assert (cx, cy, r) == pytest.approx((110, 80, 45), abs=3) and not more
    assert 0.3 < X2.circle_rim(g) <= 1.0 and X2.circle_rim(np.zeros((80, 80))) is None
    assert P.rim_symmetry(np.full((50, 50), 9.0), 25, 25, 10) == pytest.approx(1.0) and P.rim_symmetry(g, -900, -900, 5) is None


def test_counts_of_blades_and_links():
    y, x = np.mgrid[:200, :200]
    blades = np.where(np.cos(4 * np.arctan2(y - 100, x - 100)) > 0, 220.0, 20.0)
    assert P.polar_peaks(blades) == 8 and P.polar_peaks(blades * 0) == 0
    links = np.tile(np.where(np.arange(200) % 20 < 10, 220.0, 20.0), (200, 1))
    assert P.track_links(links) >= 5 and P.track_links(links * 0) == 0
    assert P.blade_periodicity(blades) > 0.9 > 0.5 > P.blade_periodicity(np.random.default_rng(0).uniform(0, 255, (200, 200)))
    assert P.gap_groups(np.array([0, 3, 6, 9, 30]), 5) == 3


def test_frequencies_of_a_lattice():
    y, x = np.mgrid[:96, :128]
    f = P.top_frequencies(128 + 100 * np.sin(2 * np.pi * x / 8))
    assert sorted(abs(v) for v in f[:4]) == pytest.approx([0, 0, 0.25, 0.25]) and len(P.top_frequencies(np.zeros((32, 32)))) == 0


def test_checks_of_a_clip(spark):
    """Two clips with known faults: merged parts in half the frames, a count that varies."""
    dots = lambda n: sum((np.pad(np.full((6, 6), 200.0), ((26, 32), (14 + 12 * k, 44 - 12 * k))) for k in range(n)), np.zeros((64, 64)))
    clips = {1: [dots(3), dots(3), dots(1), dots(1)], 2: [dots(3)] * 4, 3: [dots(2)] * 2}
    kinds = spark.createDataFrame([(1, "oil_gas", "surface", None), (2, "nowhere", "surface", "industrial_logic_and_compliance"), (3, "nowhere", "surface", None)], "video bigint, domain string, topology string, task_category string")
    got = {r["video"]: r for r in C.constraints(frames_of(spark, clips), kinds, SIZE).collect()}
    assert got[1]["invariants"] == ["check_topology_merge"] and got[1]["constraint"] == 0.5 and got[1]["violations"] == ["check_topology_merge: topology merge detected in 50% of frames"]
    assert got[2]["constraint"] == 1.0 and got[2]["violations"] == []
    assert got[3]["constraint"] is None and got[3]["invariants"] == []
    counted = C.check(frames_of(spark, {1: [255 - dots(1), 255 - dots(3)]}), "check_count_invariant", "via_holes", SIZE).first()
    assert counted["violation"] == "check_count_invariant: element 'via_holes' count varied across frames: [1, 3]"
    still = C.check(frames_of(spark, {1: [square()] * 3}), "check_kinematic_coupling", "conveyor", SIZE).first()
    assert still["violation"] is None and still["score"] == 1.0


def test_checks_without_enough_frames(spark):
    one = spark.createDataFrame([(1, 0, None), (2, 0, 1.0)], "video bigint, frame bigint, value double")
    assert {(r["score"], r["deviation"], r["rigid"]) for r in C.scissor_check(one).collect()} == {(0.1, 100.0, False)}
    assert C.scissor_check(one.limit(0)).count() == C.conveyor_check(one.limit(0)).count() == 0
    some = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0])], "video bigint, frame bigint, value array<double>")
    assert C.arm_check(some).first()["score"] == 0.1 and C.jacket_check(some).first()["score"] == 0.0


def test_scores_of_whole_clips(spark):
    g = scene(90, 120)
    clips = {1: [g] * 5, 2: [g, 255 - g, g], 3: [g]}
    f = frames_of(spark, clips, 3)
    got = {r["video"]: r["temporal"] for r in C.temporal(f, (90, 120)).collect()}
    assert got[1] == 100.0 and got[2] < 60 and got[3] is None
    images = frames_of(spark, {1: [g], 2: [g], 3: [255 - g]}, 3).drop("frame")
    got = {r["video"]: r["fidelity"] for r in C.fidelity(f, images, (90, 120)).collect()}
    assert got[1] == 100.0 and got[3] < got[2] < 100


def test_geometry_by_topology(spark):
    g = scene(90, 120)
    kinds = [(1, "2d_planar", None), (2, "3d_spatial", "surface"), (3, "aerodynamic", None), (4, "articulated", None), (5, "rotational", None), (6, None, "kinematic"), (7, "odd", "odd")]
    f = frames_of(spark, {k[0]: [g] * 3 for k in kinds})
    got = {r["video"]: (r["method"], r["geometry"]) for r in C.geometry(f, spark.createDataFrame(kinds, "video bigint, sub string, topology string"), (90, 120)).collect()}
    assert got[2] == ("lattice", pytest.approx(1.0, abs=0.1)) and got[3] == ("surface", 1.0) and got[6] == ("kinematic", 1.0) and got[7] == (None, 0.0)
    assert got[4][1] == pytest.approx(0.6 + 0.4 * P.bilateral_symmetry(np.rint(g)), abs=0.01) and 0 < got[1][1] <= 1 and got[5] == ("rotary", 0.0)
