"""Nearest points of clouds against plain loops: far clouds, copies, numbers that aren't finite, and all levels of cells."""

import math

import numpy as np
import pytest

from plateworks.operators import clouds
from plateworks.plans import shapes


def least(a, b):
    """Squared distances of the points a to the nearest of b, nulls passed over and NaN the greatest."""
    out = []
    for p in a:
        each = [[(u - v) * (u - v) for u, v in zip(p, q, strict=True)] for q in b if None not in q] if None not in p else []
        ds = [x + y + z for x, y, z in each]
        real = [d for d in ds if not math.isnan(d)]
        out.append(min(real) if real else (math.nan if ds else None))
    return out


@pytest.mark.parametrize("in_cell", [16, 1])
def test_nearest_is_exact(spark, monkeypatch, in_cell):
    monkeypatch.setattr(clouds, "IN_CELL", in_cell)
    rng = np.random.default_rng(4)
    near, far = rng.normal(size=(400, 3)), rng.normal(size=(300, 3)) * [1, 5, 0.1] + 40
    made = {1: near.tolist() + [[math.inf, 0.0, 0.0], [None, 0.0, 0.0], [math.nan, 1.0, 1.0]], 2: far.tolist() + [[0.5, 0.5, 0.5]] * 50, 3: [[math.inf, 0.0, 1.0], [math.nan, 0.0, 1.0]], 4: rng.integers(0, 3, (200, 3)).astype(float).tolist()}
    points = spark.createDataFrame([(k, *p) for k, ps in made.items() for p in ps], "to long, x double, y double, z double").repartition(3)
    ask = rng.normal(size=(120, 3)).tolist() + [[90.0, -90.0, 0.0], [math.inf, 0.0, 0.0], [None, 1.0, 1.0], [math.nan, 0.0, 0.0]]
    asked = [(i, k, *p) for k in (*made, 9) for i, p in enumerate(ask)]
    got = {(r.to, r.i): r.sq for r in clouds.nearest_sq(spark.createDataFrame(asked, "i long, to long, x double, y double, z double"), points, "to").collect()}
    assert set(got) == {(k, i) for k in made for i in range(len(ask))}
    for k, ps in made.items():
        for i, d in enumerate(least(ask, ps)):
            assert (got[k, i] is None) == (d is None) and (d is None or got[k, i] == d or (math.isnan(d) and math.isnan(got[k, i])))


def test_points_meet_few_others(spark):
    """Of 3,000 points in a cloud, a point meets those of the cells around it."""
    rng = np.random.default_rng(5)
    rows = [(1, *p) for p in rng.random((3000, 3)).tolist()]
    points = spark.createDataFrame(rows, "to long, x double, y double, z double")
    assert clouds.grid(points, "to").first()["_top"] == 2
    plan = clouds.nearest_sq(points, points, "to")
    assert plan.count() == 3000 and plan.agg({"sq": "max"}).first()[0] == 0


def test_chamfer_of_any_labels(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3).astype(np.float32)], int(rng.integers(3, 6))) for i in range(300)] + [(900, [0.0, 0.0, 0.0], 13), (901, [1.0, 0.0, 0.0], None), (5, [2.0, 2.0, 2.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.label: r for r in shapes.chamfer(spark, str(tmp_path)).collect()}
    assert set(got) == {3, 4, 13}
    cloud = lambda k: [(i, p) for i, p, j in rows if j == k]

    def mean(a, b):
        best = {}
        for (i, _), d in zip(a, least([p for _, p in a], [p for _, p in b]), strict=True):
            best[i] = min(d, best.get(i, d))
        return sum(best.values()) / len(best), len(best)

    for k, r in got.items():
        there, back = mean(cloud(k), cloud((k + 1) % 10)), mean(cloud((k + 1) % 10), cloud(k))
        assert r.n == there[1] and r.mean_sq == pytest.approx(there[0], abs=2e-5) and r.mean_sq_back == pytest.approx(back[0], abs=2e-5)
