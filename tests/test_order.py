"""Exact medians by narrowing ranks."""

import numpy as np
import pytest

from benchloom.operators.order import medians


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_medians(spark, most):
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.normal(size=400).tolist(), "odd": rng.uniform(-1e9, 1e9, 301).tolist(), "equal": [3.25] * 50, "two": [1.0, 2.0], "one": [-4.0], "nulls": [None, 5.0, None],
        "hot": [0.0] * 300 + [1.0] * 299, "wide": [-1.7e308, -1.0, 2.0, 1.7e308], "empty": [None], None: [7.0, 8.0, 9.0],
    }
    rows = [(k, v, "clash") for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double, lo string")
    got = {r["g"]: r["median"] for r in medians(df.where("g is not null"), ["g"], "x", most).collect()}
    want = {k: float(np.median([v for v in vs if v is not None])) for k, vs in groups.items() if k and any(v is not None for v in vs)}
    assert got == pytest.approx(want)
    assert medians(df.limit(0), ["g"], "x", most).count() == 0
