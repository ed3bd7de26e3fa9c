"""Hard negatives and nearest vectors against all pairs; ties, hot vectors, odd rows, several lengths, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateworks.llm import negatives, neighbours

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, low=50, high=95):
    ok = [(i, tuple(math.floor(256 * x) for x in v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok, out = sorted(set(ok)), []
    for a in ok:
        if a[0] % 50:
            continue
        scored = [(sum(x * y for x, y in zip(a[1], b[1], strict=True)), b[0], b) for b in ok if len(b[1]) == len(a[1]) and b != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2][2] == a[2]][:5]:
            hard = [s for s in scored if s[2][2] != a[2] and low * ps <= 100 * s[0] <= high * ps][:3]
            out += [(a[0], p, k, n, ps, ns) for k, (ns, n, _) in enumerate(hard, 1)]
    return sorted(out)


def told(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 30])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CELL", 8)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12)) / 3
    rows = [(i, (centres[i % 6] + rng.standard_normal(12) / 8).tolist(), int(rng.integers(4))) for i in range(500)]
    rows += [(500 + i, rows[0][1], int(i % 2)) for i in range(150)]  # one vector a quarter of all rows has
    rows += [(700 + i, [0.5] * 12, 3) for i in range(10)] + [rows[50], rows[50], (50, rows[51][1], 2), (650, [0.0] * 12, 1)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 12, 1), (1050, [None] + [0.1] * 11, 1), (None, [0.1] * 12, 1), (1100, [0.1] * 12, None), (1150, [float("inf")] + [0.0] * 11, 0)]
    rows += [(2000 + i, rng.standard_normal(5).tolist(), int(i % 2)) for i in range(60)] + [(3000 + i, [], i % 2) for i in range(4)] + [(3050, [], 0), (3100, [0.3], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("_id", "_v", "_h1", "windows", "anchor_id")}).repartition(5)
    want = plain(rows)
    assert told(negatives.mine(df, F.col("vec_id") % 50 == 0)) == want and len(want) > 150


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], SCHEMA)
    assert negatives.mine(df, F.col("vec_id") % 50 == 0).collect() == []
    assert negatives.mine(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**22, 1.0], 0), (1, [2.0**22, 3.0], 0), (2, [2.0**21, 5.0], 1), (3, [2.0**21 + 1, -4.0], 1), (4, [2.0**20, 0.0], 1), (5, [2.0**21 + 1, -4.5], 1)]
    want = plain(rows)
    assert told(negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)) == want and len(want) == 3


def test_cells_come_by_falling_sum():
    rng = random.Random(4)
    one, two = np.array([rng.random() for _ in range(13)]), np.array([rng.random() for _ in range(7)])
    got = list(negatives.by_falling_sum(one, two))
    assert [s for s, _, _ in got] == sorted((a + b for a in one for b in two), reverse=True) and len({g[1:] for g in got}) == 91


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.integers(-200, 200, (400, 9)).astype(float)
    codes = negatives.Codes(9, v[:100], 6)
    a, ra, b, rb = codes.assign(v)
    radii = tuple(np.array([far[code == c].max(initial=0) for c in range(len(book))]) for code, far, book in zip((a, b), (ra, rb), codes.books, strict=True))
    for q in rng.integers(-200, 200, (20, 9)).astype(float):
        one, two = codes.bounds(q, radii)
        assert (v @ q <= one[a] + two[b]).all()


@pytest.mark.parametrize("size", [1e-200, 1e200, 1.0])
def test_nearest_of_vectors_of_any_size(spark, size):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 8))
    rows = [(i, (v * size * (10.0 ** (i % 3))).tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 10 = 0")).collect()
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    for r in got:
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12
    want = {(q, int(np.argsort([-9 if i == q else -(unit[q] @ unit[i]) for i in range(60)])[1])) for q in range(0, 60, 10)}
    assert len(got) == 30 and len({(r.query_id, r.vec_id) for r in got if r["rank"] == 1} & want) >= 5
