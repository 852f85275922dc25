"""Literal cases of scores, gates and tiers."""

import math

import pytest
from pyspark.sql import functions as F

from benchloom import registry as R
from benchloom.functions import axes as A
from benchloom.operators import aggregate as G
from benchloom.operators import scoring as S

SCHEMA = "result_id bigint, model_id bigint, task_id string, skipped boolean, domain string, task_category string, motion_type string, logic double, geometry double, physics double, temporal double, reference double, motion double, angle double, has_score boolean, constraint double, violations array<string>, invariants array<string>"


def rows(spark, *cases, **common):
    base = {"skipped": False, "model_id": 1, "task_id": "t", "domain": "d", "task_category": "spatial_exploration_and_viewpoint", "motion_type": "orbit", "violations": [], "invariants": []}
    data = [r | {"angle": r.get("angle", r.get("motion")), "has_score": True} for r in (base | {"result_id": i} | common | c for i, c in enumerate(cases))]
    return spark.createDataFrame([[r.get(f.split()[0]) for f in SCHEMA.split(", ")] for r in data], SCHEMA)


FULL = {"logic": 80.0, "temporal": 70.0, "physics": 75.0, "reference": 85.0, "geometry": 90.0}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("axis", "score", "want"), [(R.LOGIC, 1.0, 5.0), (R.GEOMETRY, 5.0, 8.0), (R.MOTION, -1.0, 0.0), (R.LOGIC, math.nan, 5.0), (R.LOGIC, None, None), (R.GEOMETRY, 90.0, 90.0)])
def test_floor(spark, axis, score, want):
    assert one(spark, A.floored(axis, F.lit(score).cast("double"))) == want


def test_floor_is_idempotent(spark):
    again = A.floored(R.GEOMETRY, A.floored(R.GEOMETRY, F.lit(3.0)))
    assert one(spark, again) == 8.0


def test_motion_folds_into_reference(spark):
    r = S.score_samples(rows(spark, FULL, FULL | {"motion": 0.0}, {**FULL, "reference": None, "motion": 40.0}, FULL | {"motion": 100.0})).orderBy("result_id").collect()
    assert r[0]["reference"] == 85.0 and r[0]["rif"] is not None and 0 < r[0]["weighted_score"] <= 100
    assert r[1]["reference"] == pytest.approx(59.5) and r[1]["weighted_score"] < r[0]["weighted_score"] and r[1]["rif_gated"] is None
    assert r[2]["reference"] == 40.0 and r[2]["num_axes"] == 5
    assert r[3]["reference"] >= r[0]["reference"]


def test_constraint_folds_into_geometry(spark):
    r = S.score_samples(rows(spark, FULL | {"constraint": 0.20}, {"constraint": 0.5})).orderBy("result_id").collect()
    assert r[0]["geometry"] == pytest.approx(69.0)
    assert r[1]["geometry"] is None and r[1]["weighted_score"] == 0.0 and r[1]["strict"] is False and r[1]["rif"] is None


def test_unknown_motion_does_not_gate(spark):
    r = S.score_samples(rows(spark, FULL)).first()
    assert r["gate"] == 1.0 and r["rif_gated"] == r["rif"]


def test_relaxed_strict_and_gated(spark):
    axes = dict.fromkeys(S.SHORT, 80.0)
    scored = spark.createDataFrame([(1, False, True, 80.0, True, 1.0, 100.0, *axes.values()), (1, False, True, 70.0, True, 0.0, 0.0, *axes.values()), (1, False, False, 0.0, False, 1.0, None, *axes.values())], "model_id bigint, skipped boolean, has_score boolean, weighted_score double, strict boolean, gate double, angle double, " + ", ".join(f"{s} double" for s in S.SHORT))
    models = spark.createDataFrame([(1, "a"), (2, "b")], "model_id bigint, model_name string")
    got = {r["model_id"]: r for r in G.model_metrics(scored, models).collect()}
    assert (got[1]["relax_score"], got[1]["strict_pass_rate"], got[1]["gated_score"], got[1]["overall"]) == (75.0, 1.0, 40.0, 40.0)
    assert (got[1]["num_samples_total"], got[1]["num_samples_completed"], got[1]["num_samples_skipped"]) == (3, 2, 1)
    assert got[2]["note"] == "no_completed_samples" and got[2]["overall"] == 0.0 and got[2]["num_samples_total"] == 0


@pytest.mark.parametrize(("motion", "tier"), [(0.0, "none"), (5.0, "weak"), (15.0, "weak"), (20.0, "moderate"), (60.0, "full"), (None, None)])
def test_tier(spark, motion, tier):
    assert one(spark, A.motion_tier(F.lit(motion).cast("double"))) == tier


@pytest.mark.parametrize(("target", "want"), [("45.0", 45.0), ("orbit_cw_90deg", 90.0), ("orbit_ccw_30deg", 30.0), ("crane_up_30deg", 30.0), ("horizontal_pan_lr", None), ("orbit_cw_xdeg", None), (None, None)])
def test_target(spark, target, want):
    assert one(spark, A.parse_target(F.lit(target).cast("string"))) == want


def test_motion_fidelity(spark):
    assert one(spark, A.motion_fidelity(F.lit(0.0), F.lit(30.0))) == pytest.approx(33.3333)
    assert one(spark, A.motion_fidelity(F.lit(0.0), F.lit(90.0))) == 0.0
    assert one(spark, A.motion_fidelity(F.lit(None).cast("double"), F.lit(90.0))) is None


def test_image_size(spark):
    w, h = A.image_target_size(F.lit(3200), F.lit(1600))
    assert (one(spark, w), one(spark, h)) == (1600, 800)


def test_sanitize(spark):
    assert one(spark, A.sanitize(F.lit(math.nan))) is None and one(spark, A.sanitize(F.lit(math.inf))) is None and one(spark, A.measured(F.lit(-1.0))) is None


def test_weakest_axis_takes_the_first_of_ties(spark):
    r = G.weakest_axis(rows(spark, {"physics": 10.0, "temporal": 10.0})).first()
    assert r["weakest_axis"] == R.PHYSICS


def test_breakdowns_and_reports_of_nothing(spark):
    empty = S.score_samples(rows(spark, FULL).limit(0))
    assert G.breakdowns(empty).count() == 0 and G.axis_statistics(empty).count() == 0 and G.worst_samples(empty).count() == 0


def test_metrics_do_not_depend_on_order(spark):
    a = S.score_samples(rows(spark, FULL, FULL | {"motion": 20.0}, {"physics": 30.0}))
    b = a.orderBy(F.desc("result_id"))
    models = spark.createDataFrame([(1, "a")], "model_id bigint, model_name string")
    x, y = (G.model_metrics(d, models).first() for d in (a, b))
    assert x["relax_score"] == pytest.approx(y["relax_score"]) and x["relax_score"] >= x["gated_score"]


def test_dispatch_and_its_fallback(spark):
    data = spark.createDataFrame([("mining", "kinematic", None), ("visual_security", "surface", "industrial_logic_and_compliance"), ("x", "y", "z")], "domain string, topology string, task_category string")
    got = [r["checkers"] for r in S.dispatch(data).collect()]
    assert sorted(None if g is None else tuple(c["checker"] for c in g) for g in got if g) == [("check_kinematic_coupling", "check_count_invariant"), ("check_topology_merge",)] and got.count(None) == 1
