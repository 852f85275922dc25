"""Problem 1: spellings, numbers, precedence of units, and a plain reading of every row."""

import math

import pytest

from benchloom.operators import units as U
from benchloom.session import table

SCHEMA = "row_id bigint, motion_type string, viewpoint_motion_target string, prompt string, source_id int, constraint_annotations string, unit string, kind string"
SOURCES = [(1, "deg", "x"), (2, "rad", "percent"), (3, None, None), (4, " Turns", "%"), (None, "gon", "x")]


def run(spark, *cases):
    data = [(i, m, t, p, s, a, "clash", "clash") for i, (m, t, p, s, a) in enumerate(cases)]
    src = spark.createDataFrame(SOURCES, "source_id int, angle_unit string, dolly_unit string")
    return {r["row_id"]: (r["target_unit"], r["milli"]) for r in U.found(spark.createDataFrame(data, SCHEMA), src).collect()}


def test_forms(spark):
    written = [
        ("orbit", "90°", 90000), ("orbit", "1.5708 rad", 90000), ("pan", "0,25 turns", 90000), ("tilt", "1/4 turn", 90000), ("crane", "100 gon", 90000), ("orbit", "5400'", 90000), ("orbit", "5 400 arcmin", 90000), ("orbit", "π/2", 90000),
        ("orbit", "3π/4 rad", 135000), ("orbit", "12°30′", 12500), ("orbit", "half turn", 180000), ("pan", "Three-quarter turn", 270000), ("pan", "forty-five degrees", 45000), ("orbit", "a third of a revolution", 120000), ("orbit", "full circle", 360000),
        ("orbit", "orbit_ccw_90DEG", 90000), ("orbit", "~ 30 deg.", 30000), ("orbit", "９０．５ deg", 90500), ("pan", "1570.8 milliradians", 90000), ("dolly", "150%", 1500), ("dolly", "1.5x", 1500), ("dolly", "x1.5", 1500), ("dolly", "3:2", 1500),
        ("dolly", "one and a half times", 1500), ("dolly", "twice the size", 2000), ("dolly", "triple", 3000), ("dolly", "dolly_in_3x", 3000), ("dolly-in", "1.25-fold", 1250), ("dolly", "2 ×", 2000), ("orbit", "45 degress", 45000), ("orbit", "45 dgrees", 45000),
    ]
    got = run(spark, *((m, t, None, 3, None) for m, t, _ in written))
    for i, (m, t, milli) in enumerate(written):
        assert got.get(i) and abs(got[i][1] - milli) <= 1, (m, t, got.get(i))
        assert got[i][0] == ("x" if m.startswith("dolly") else "deg")


def test_words_after_the_unit(spark):
    written = [
        ("orbit", "0.5 rad, slowly, around the boom with the joints in view", 28648), ("pan", "30 minutes of arc to the left and back until the whole of the deck is in view", 500),
        ("orbit", "quarter turn clockwise", 90000), ("dolly", "150 percent (towards the operator's cabin, then hold the shot until the end)", 1500), ("tilt", "3 wobbles of the boom", 1080000),
    ]
    got = run(spark, *((m, t, None, 4 if m == "tilt" else 1, None) for m, t, _ in written))
    assert {i: r[1] for i, r in got.items()} == {i: milli for i, (_, _, milli) in enumerate(written)}


def test_units_among_other_words(spark):
    written = [
        ("orbit", "1.5 radians cw", 85.943669, "target"), ("orbit", "1.5 radians clockwise", 85.943669, "target"), ("orbit", "1.5 rad left", 85.943669, "target"), ("pan", "1.5 clockwise radians", 85.943669, "target"),
        ("orbit", "1.5 radians measured about the vertical centre axis", 85.943669, "target"), ("tilt", "5400 arcmin total", 90.0, "target"), ("pan", "2 " + "slow and steady " * 400 + "turns", 720.0, "target"),
        ("dolly", "1.5 turns of the wheel, 3x", 1.5, "unresolved"), ("orbit", "30 paces", 30.0, "unresolved"), ("orbit", "30", 30.0, "default"),
    ]
    data = [(i, m, t, None, 3, None, "clash", "clash") for i, (m, t, _, _) in enumerate(written)]
    src = spark.createDataFrame(SOURCES, "source_id int, angle_unit string, dolly_unit string")
    got = {r["row_id"]: (round(r["value"], 6), r["via"]) for r in U.harmonise(spark.createDataFrame(data, SCHEMA), src).collect()}
    assert got == {i: (value, via) for i, (_, _, value, via) in enumerate(written)}


def test_precedence(spark):
    clause = "Camera: circle the subject; target motion value 2.0{}. Then the crane 9 stops."
    got = run(
        spark,
        ("orbit", "2.0", clause.format(" rad"), 4, None),  # the source's unit before the prompt's
        ("orbit", "2.0", clause.format(" rad"), 3, None),
        ("orbit", "2.0", clause.format(" (gradians)"), 3, None),
        ("orbit", "2.0", clause.format(", expressed in radians"), 3, None),
        ("orbit", "2.0 deg", clause.format(" rad"), 4, None),  # the target's own unit first
        ("orbit", "2.0", clause.format(""), 3, None),  # a bare number in the common unit
        ("orbit", "2.0", None, 1, None),
        ("dolly", "200", None, 2, None),
        ("orbit", "2.0", None, 99, None),  # unknown source
        (None, "0.5", None, 4, '{"motion_type": "tilt"}'),
    )
    assert got == {0: ("deg", 720000), 1: ("deg", round(2000 * 180 / math.pi)), 2: ("deg", 1800), 3: ("deg", round(2000 * 180 / math.pi)), 4: ("deg", 2000), 7: ("x", 2000), 9: ("deg", 180000)}


def test_nothing_to_read(spark):
    none = [("orbit", None, None, 3, None), ("orbit", "", None, 3, None), ("orbit", "TBD", None, 3, None), ("pan", "horizontal_pan_lr", None, 3, None), ("static", "45 deg", None, 1, None), (None, "45 deg", None, 1, None), (None, "45 deg", None, 1, "no json"), ("orbit", "x" * 5000, None, 1, None), ("orbit", "1/0 turn", None, 1, None)]
    assert run(spark, *none) == {}
    empty = spark.createDataFrame([], SCHEMA)
    assert U.found(empty, spark.createDataFrame(SOURCES, "source_id int, angle_unit string, dolly_unit string")).count() == 0


def test_repeated_rows_and_sources(spark):
    src = spark.createDataFrame(SOURCES * 2, "source_id int, angle_unit string, dolly_unit string")
    row = (1, "orbit", "1 turn", None, 2, None, "", "")
    assert U.found(spark.createDataFrame([row, row], SCHEMA), src).count() == 2


@pytest.mark.parametrize(("a", "b", "far"), [("degree", "degree", 0), ("degrees", "degree", 0.3), ("degreee", "degree", 0.3), ("dergee", "degree", 0.5), ("dagree", "degree", 0.5), ("rad", "grad", 1)])
def test_distance(a, b, far):
    assert U.weighted_distance(a, b) == pytest.approx(far)


def test_every_source_unit_is_known(spark):
    src = table(spark, "/root/testdata/sf0.001", "annotation_sources").collect()
    names = {n for r in src for n in (r["angle_unit"], r["dolly_unit"]) if n}
    got = U.alias_dictionary(spark.createDataFrame([(n.strip().lower(),) for n in names], "spelling string"))
    assert {r["spelling"] for r in got.collect()} == {n.strip().lower() for n in names}
