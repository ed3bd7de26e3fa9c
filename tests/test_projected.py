"""Grid matching, projected curves, heat maps and records against plain loops; nulls, degenerate geometry, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateworks.operators import heat, matching, projection, records
from plateworks.plans import graphs, measures, serial


def on(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    sq = dx * dx + dy * dy
    if sq < 1e-6:
        return math.hypot(p[0] - a[0], p[1] - a[1]) < 1e-3
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / sq
    return -1e-3 <= t <= 1 + 1e-3 and math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy) < 1e-3


def test_matches_through_cells_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    pred, drawn = [], []
    for g in range(5):
        lines = []
        for o in range(40):
            kind = rng.choice(["line", "line", "circle", "arc", "ellipse"])
            a, b = ((rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in "ab")
            if o % 7 == 0:
                b = (a[0], b[1])
            if o % 11 == 0:
                b = a
            r = rng.choice([1.0, 2.0, 3.0])
            ends = (*a, *b) if kind == "line" else (None,) * 4
            conic = (a[0], a[1], r, r + 1, r) if kind != "line" else (None,) * 5
            pred.append((g, o, [f"t{rng.randrange(30)}"], kind, *ends, *conic))
            lines.append(pred[-1])
        for k in range(60):
            s = rng.choice(lines)
            kind = rng.choice(["line", "polyline"]) if s[3] == "line" else rng.choice(["circle", "arc"]) if s[3] in ("circle", "arc") else "ellipse"
            if s[3] == "line":
                at = lambda t: [s[4] + t * (s[6] - s[4]) + rng.choice([0, 0, 5e-4, 0.2]), s[5] + t * (s[7] - s[5])]  # noqa: B023, E731
                pts = [at(rng.uniform(-0.0005, 1.0005)) for _ in range(2 + (kind == "polyline"))]
                drawn.append((g, k, kind, pts, None, None, None, None, None))
            else:
                off = rng.choice([0, 5e-4, 2e-3])
                drawn.append((g, k, kind, None, s[8] + off, s[9], s[10] + rng.choice([0, 5e-4, 0.5]), s[11] + rng.choice([0, 5e-3, 0.5]), s[12]))
    drawn.append((0, 999, "line", None, None, None, None, None, None))
    drawn.append((0, 998, "spline", None, 1.0, 1.0, 1.0, 1.0, 1.0))
    p = spark.createDataFrame(pred, "g long, ord long, ids array<string>, type string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, r double, rmaj double, rmin double").repartition(3)
    d = spark.createDataFrame(drawn, "g long, k long, type string, pts array<array<double>>, cx double, cy double, r double, rmaj double, rmin double")
    got = {(r.g, r.k): r.origins for r in matching.origins(d, p, ["g"], "k").collect()}
    want = {}
    for g, k, kind, pts, cx, cy, r, ra, ri in drawn:
        ids = []
        for q in sorted((q for q in pred if q[0] == g), key=lambda q: q[1]):
            if kind in ("line", "polyline") and q[3] == "line" and pts:
                hit = all(on(z, q[4:6], q[6:8]) for z in pts)
            elif kind in ("circle", "arc") and q[3] in ("circle", "arc"):
                hit = math.hypot(cx - q[8], cy - q[9]) < 1e-3 and abs(r - q[10]) < 1e-3
            else:
                hit = kind == q[3] == "ellipse" and math.hypot(cx - q[8], cy - q[9]) < 1e-3 and abs(ra - q[11]) < 1e-2 and abs(ri - q[12]) < 1e-2
            if hit:
                ids += [i for i in q[2] if i not in ids]
        if ids:
            want[g, k] = ids
    assert got == want and len(want) > 60
    assert matching.origins(d.where("false"), p, ["g"], "k").collect() == []


VIEWS = {"front": ((0, -1, 0), lambda p: (-p[2], p[0])), "top": ((0, 0, 1), lambda p: (p[0], p[1])), "right": ((1, 0, 0), lambda p: (p[2], -p[1]))}


def test_projected_curves(spark):
    rng = np.random.default_rng(9)
    vec = lambda v: None if v is None else tuple(map(float, v))
    rows = []
    for i in range(30):
        axis = rng.integers(-2, 3, 3)
        u = rng.integers(-2, 3, 3)
        major = np.cross(axis, u)
        rows.append((i, ["line", "circle", "ellipse"][i % 3], vec(rng.integers(-9, 9, 3)), vec(rng.integers(-9, 9, 3)), vec(rng.integers(-9, 9, 3)), vec(axis), vec(major), 2.5, 4.0, 1.5))
    rows += [(50, "spline", *[(1.0, 0.0, 0.0)] * 5, 1.0, 1.0, 1.0), (51, None, *[(1.0, 0.0, 0.0)] * 5, 1.0, 1.0, 1.0), (52, "line", None, *[(1.0, 0.0, 0.0)] * 4, 1.0, 1.0, 1.0), (53, "circle", *[(1.0, 0.0, 0.0)] * 5, None, 1.0, 1.0)]
    rows += [(54, "line", (1.0, 2.0, 3.0), (1.0, 2.0, 8.0), *[(1.0, 0.0, 0.0)] * 3, 1.0, 1.0, 1.0), (55, "circle", *[(0.0, 0.0, 0.0)] * 5, 1.0, 1.0, 1.0)]
    v = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"id int, curve string, p1 {v}, p2 {v}, centre {v}, axis {v}, major {v}, r double, rmaj double, rmin double")
    got = {(r.id, r.view): (r.shape, r.skipped) for r in projection.project(df).collect()}
    assert len(got) == 3 * len(rows)
    for i, kind, p1, p2, centre, axis, major, r, ra, ri in rows[:30]:
        for view, (way, flat) in VIEWS.items():
            s, skipped = got[i, view]
            if kind == "line":
                a, b = (np.round(flat(p), 3) for p in (p1, p2))
                if (a == b).all():
                    assert skipped == "point" and s is None
                else:
                    assert s.type == "line" and np.allclose([s.u1, s.v1, s.u2, s.v2], [*a, *b])
                continue
            axis, c = np.array(axis), np.array(centre)
            if not axis.any() or (kind == "ellipse" and not np.any(major)):
                assert skipped == "unreadable" and s is None
                continue
            n = axis / np.linalg.norm(axis)
            if kind == "circle":
                one = np.cross(n, [1.0, 0, 0]) if abs(n[0]) < 0.9 else np.cross(n, [0, 1.0, 0])
                one, sizes = one / np.linalg.norm(one), (r, r)
            else:
                one, sizes = np.array(major) / np.linalg.norm(major), (ra, ri)
            two = np.cross(n, one)
            t = np.linspace(0, 2 * math.pi, 20001)
            pts = np.array(flat((c[:, None] + np.outer(one, np.cos(t)) * sizes[0] + np.outer(two, np.sin(t)) * sizes[1]))) - np.array(flat(c))[:, None]
            far = np.hypot(*pts)
            if s.type == "line":
                assert kind == "circle" and abs(n @ way) < 1e-6 and abs(math.hypot(s.u1 - s.u2, s.v1 - s.v2) - 2 * far.max()) < 3e-3
            elif s.type == "circle":
                assert abs(abs(n @ way) - 1) < 1e-6 and s.r == r and np.allclose([s.u1, s.v1], np.round(flat(c), 3))
            else:
                assert abs(s.rmaj - far.max()) < 2e-3 and abs(s.rmin - far.min()) < 2e-3
                if far.max() - far.min() > 0.2:
                    k = far.argmax()
                    turn = (math.degrees(math.atan2(pts[1][k], pts[0][k])) - s.rot) % 180
                    assert min(turn, 180 - turn) < 0.3
    assert [got[i, "top"][1] for i in range(50, 56)] == ["unsupported", "unsupported", "unreadable", "unreadable", "point", "unreadable"]
    assert projection.project(df.where("false")).collect() == []


def test_heat_of_whole_maps(spark):
    rng = random.Random(10)
    circles = [(m, rng.uniform(-5, 170), rng.uniform(-5, 70), rng.choice([2.0, 10.0, 40.0])) for m in range(4) for _ in range(5)] + [(9, 10.0, 10.0, None), (9, None, 10.0, 4.0), (8, 500.0, 10.0, 4.0)]
    df = spark.createDataFrame(circles, "map long, x double, y double, r double").withColumn("note", F.lit(1))
    got = {}
    for r in heat.targets(df, ["map"], width=40, height=16, stride=4).collect():
        assert (r["map"], r.iy, r.ix) not in got
        got[r["map"], r.iy, r.ix] = (r.heat, r.radius, r.centre)
    assert {k[0] for k in got} <= set(range(4))
    for m in range(4):
        h, rad, mid = np.zeros((16, 40)), np.zeros((16, 40)), np.zeros((16, 40), bool)
        iy, ix = np.arange(16)[:, None], np.arange(40)[None, :]
        for _, x, y, r in (c for c in circles if c[0] == m):
            gx, gy = x / 4, y / 4
            if not (0 <= gx < 40 and 0 <= gy < 16):
                continue
            s = max(1.0, r / 4 * 0.3)
            h = np.maximum(h, np.exp(-((iy - gy) ** 2 + (ix - gx) ** 2) / (2 * s * s)))
            cy, cx = min(round(gy), 15), min(round(gx), 39)
            mid[cy, cx] = True
            for yy in range(max(0, cy - 1), min(16, cy + 2)):
                for xx in range(max(0, cx - 1), min(40, cx + 2)):
                    rad[yy, xx] = max(rad[yy, xx], math.log(max(r, 1.0)))
        h[mid] = 1.0
        for y in range(16):
            for x in range(40):
                value, radius, centre = got.get((m, y, x), (0.0, None, False))
                assert abs(value - h[y, x]) <= (1e-12 if h[y, x] > math.exp(-4.5) else math.exp(-4.5)) and centre == mid[y, x] and abs((radius or 0) - rad[y, x]) < 1e-12


def test_records_of_odd_texts(spark):
    texts = {
        "a": "PART unit=mm bbox=1,2.5,-3 grid=100 ext=3\nFEAT C1 cylinder axis=Z r=2.5 dir=+Z\nFEAT C2 slot axis=X r=-\nBLEND fillet |Z v1.5\nBLEND chamfer >X v-\nVIEW front axes=X,Y\nL vis 0,0 1,-1 C1,C2\nCI hid c1,2 r3 C1 DIA6 DIA6.5\nVIEW top axes=X,Z\nVIEW right axes=Y,Z\nA vh c0,0 r1 a10..20\nEL hid c1,1 rj3 rn2 rot45 e0..90\nPT vis 1,1\nPL vis 0,0 1,1 2,0\nDIM D1 linear w 10 front X0..10\nDIM D2 angle - 45 top -",
        "b": "L vis 0,0 1,1\n\nnoise here\r\nVIEW v axes=X,Y\nQQ vis 1,1\nL vis\nL vis <|coord_0012|>,-<|coord_3|>   1,1 C7",
        "c": "",
        "d": None,
    }
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    read = records.parse(df, "id", "text")
    back = {r.id: r.text for r in records.emit(read, "id").collect()}
    assert back["a"] == texts["a"]
    assert back["b"] == "VIEW v axes=X,Y\nL vis 12,-3 1,1 C7" and set(back) == {"a", "b"}
    rows = {(r.id, r.n): r for r in read.collect()}
    assert [rows["a", n].view for n in (6, 7, 10, 13)] == ["front", "front", "right", "right"] and rows["a", 8].record == "VIEW"
    assert (rows["a", 0].bbox, rows["a", 0].grid, rows["a", 0].ext) == ([1.0, 2.5, -3.0], 100, 3.0)
    assert (rows["a", 7].c, rows["a", 7].r, rows["a", 7].tags, rows["a", 7].dias) == ([1.0, 2.0], 3.0, ["C1"], [6.0, 6.5])
    assert (rows["a", 14].axis, rows["a", 14].low, rows["a", 14].high, rows["a", 15].axis) == ("X", 0.0, 10.0, None)
    tokens = {r.id: r.text for r in records.emit(read.where("id = 'b'"), "id", tokens=True).collect()}
    assert tokens["b"] == "VIEW v axes=X,Y\nL vis <|coord_12|>,-<|coord_3|> <|coord_1|>,<|coord_1|> C7"
    assert records.emit(read.where("false"), "id").collect() == []


def test_lines_are_made_once(spark):
    """A filter before the aggregate would make each line a second time."""
    read = spark.createDataFrame([(1, 0, "VIEW", "N")], "id long, n long, record string, view string")
    plan = records.emit(records.complete(read, "id"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Aggregate")[-1]
    odd = [0.125, 2.675, 1.005, -0.001, -0.0, 12.5, 100.0, 1e15, -1e20, 1e37, float("nan"), float("inf"), None, 1234567.891]
    d = spark.createDataFrame(list(enumerate(odd)), "k long, v double").select("k", records.number(F.col("v")).alias("t"), F.regexp_replace(F.format_string("%.2f", "v"), r"\.?0+$", "").alias("w"))
    for row in d.collect():
        assert row.t == (None if odd[row.k] is None else "0" if row.w == "-0" else row.w)


@pytest.mark.parametrize("block", [64, 5])
def test_heat_of_blocks(spark, monkeypatch, block):
    """Cells of a map in several blocks are those of one; circles, not cells, are shuffled, once."""
    monkeypatch.setattr(heat, "BLOCK", block)
    circles = [(1, 0.0, 0.0, 4.0), (1, 79.0, 47.0, 90.0), (1, 33.0, 20.0, 12.0), (1, 33.0, 20.0, 30.0), (2, 80.0, 1.0, 2.0)]
    made = heat.targets(spark.createDataFrame(circles, "g long, x double, y double, r double"), ["g"], width=20, height=12, stride=4)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for _, x, y, r in circles[:4]:
        s, gx, gy = max(1.0, r / 4 * 0.3), x / 4, y / 4
        cy, cx = min(round(gy), 11), min(round(gx), 19)
        for iy in range(12):
            for ix in range(20):
                if abs(iy - gy) <= 3 * s and abs(ix - gx) <= 3 * s:
                    own, beside = (iy, ix) == (cy, cx), abs(iy - cy) <= 1 and abs(ix - cx) <= 1
                    h, q, o = want.get((iy, ix), (0.0, -1.0, False))
                    want[iy, ix] = (max(h, 1.0 if own else math.exp(-((iy - gy) ** 2 + (ix - gx) ** 2) / (2 * s * s))), max(q, math.log(max(r, 1)) if beside else -1.0), o or own)
    got = {(c.iy, c.ix): (c.heat, -1.0 if c.radius is None else c.radius, c.centre) for c in made.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_all_peaks(spark):
    """More than 200 peaks of a map come out, and their cells are dealt out once."""
    sf = "/root/testdata/sf0.01"
    peaks = measures.heat_peaks(spark, sf)
    assert peaks.groupBy("map").count().agg(F.max("count")).first()[0] > 200
    assert peaks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_samples_stay_in_place(spark):
    """Lines are shuffled, not their samples."""
    plan = graphs.line_coverage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "pi#" not in "".join(x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_drawings_are_shuffled_once_for_their_texts(spark):
    """Nothing is written, joined by merging or moved again behind the shuffle by drawing: the other one is of the supplier's faces."""
    plan = serial.serialised(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "Exchange hashpartitioning(face" in plan and "SortMergeJoin" not in plan and "plateworks-" not in plan
