"""Recovered circles, merged tiles, solved constraints and dropout against plain loops; ties, nulls, empty tables and extra columns."""

import math
import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from plateworks.operators import drawing, kernels, recovery, solve, tiles
from plateworks.plans import recover


def plain_recovery(dets, anchors):
    out = {}
    for g in {a[0] for a in anchors}:
        seen = [d[1:] for d in dets if d[0] == g]
        mine = sorted((a for a in anchors if a[0] == g), key=lambda a: a[1])
        votes = []
        for _, _, x, y, v in mine:
            near = [r for dx, dy, r in seen if math.hypot(dx - x, dy - y) < 15]
            if v is not None and v > 0 and near:
                votes.append(min(near) / (v / 2))
        if not votes:
            continue
        s = median(votes)
        for _, no, x, y, v in mine:
            if v is None or not 3 <= v / 2 * s <= 600:
                continue
            r = v / 2 * s
            if not any(math.hypot(dx - x, dy - y) < max(10, 0.4 * max(r, dr)) for dx, dy, dr in seen):
                seen.append((x, y, r))
                out[g, no] = (x, y, round(r, 9))
    return out


def test_recovery_with_anchors_that_suppress_each_other(spark):
    rng = random.Random(4)
    dets = [(g, rng.randrange(200) * 1.0, rng.randrange(200) * 1.0, rng.randrange(4, 40) * 1.0) for g in range(6) for _ in range(12)]
    anchors = [(g, n, rng.randrange(220) * 1.0, rng.randrange(220) * 1.0, rng.choice([None, 0.0, -3.0] + [2.0 * rng.randrange(2, 30)] * 9)) for g in range(8) for n in range(40)]
    d = spark.createDataFrame(dets, "g long, x double, y double, r double").withColumn("note", F.lit("d"))
    a = spark.createDataFrame(anchors, "g long, no long, x double, y double, value double").repartition(3)
    got = {(r.g, r.no): (r.x, r.y, round(r.r, 9)) for r in recovery.recovered(d, a, "g").collect()}
    want = plain_recovery(dets, anchors)
    assert got == want and len(want) > 20
    lone = {k for k, (x, y, r) in want.items() if any(j != k and j[0] == k[0] and math.hypot(x - q[0], y - q[1]) < max(10, 0.4 * max(r, q[2])) for j, q in want.items())}
    assert not lone
    assert recovery.recovered(d.where("false"), a, "g").collect() == [] and recovery.recovered(d, a.where("false"), "g").collect() == []


def same(a, b):
    if a["type"] == "line" and b["type"] == "line":
        d = lambda i, j: math.hypot(a[f"x{i}"] - b[f"x{j}"], a[f"y{i}"] - b[f"y{j}"]) < 20
        return (d(1, 1) and d(2, 2)) or (d(1, 2) and d(2, 1))
    curves = ("circle", "arc")
    if a["type"] in curves and b["type"] in curves:
        return math.hypot(a["x1"] - b["x1"], a["y1"] - b["y1"]) < 20 and abs((a["r"] or 0) - (b["r"] or 0)) < max(8, 0.2 * (a["r"] or 0))
    return False


def test_tiles_of_lines_and_curves_with_reference_sets(spark):
    rng = random.Random(5)
    prims, dims = [], []
    for sheet in range(4):
        for tile in range(4):
            for n in range(25):
                kind = rng.choice(["line", "line", "circle", "arc", "point"])
                x1, y1 = rng.randrange(150) * 1.0, rng.randrange(80) * 1.0
                end = (rng.randrange(150) * 1.0, rng.randrange(80) * 1.0) if kind == "line" else (None, None)
                r = rng.choice([None, 5.0, 12.0, 20.0, 31.0]) if kind != "line" else None
                prims.append((sheet, tile, n, f"p{n}", kind, tile * 10.0, 5.0, x1, y1, *end, r, "extra"))
            for n in range(12):
                refs = rng.choice([None, [], [f"p{rng.randrange(30)}"], [f"p{rng.randrange(30)}", f"p{rng.randrange(25)}"]])
                dims.append((sheet, tile, n, rng.choice(["linear", "diameter", None]), rng.choice([None, 1.0, 1.04, 2.5]), refs))
    df = spark.createDataFrame(prims, "sheet long, tile long, ord long, id string, type string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, r double, note string").repartition(3)
    dd = spark.createDataFrame(dims, "sheet long, tile long, ord long, kind string, value double, refs array<string>").repartition(2)
    merged = tiles.merged(tiles.shifted(df), "sheet")
    assert merged.columns == [*df.columns, "kept"]
    names = df.columns
    stands = {}
    for sheet in range(4):
        kept = []
        for row in sorted((dict(zip(names, p, strict=True)) for p in prims if p[0] == sheet), key=lambda p: (p["tile"], p["ord"])):
            for c in ("x1", "x2"):
                row[c] = None if row[c] is None else row[c] + row["x0"]
            for c in ("y1", "y2"):
                row[c] = None if row[c] is None else row[c] + row["y0"]
            first = next((k for k in kept if same(k, row)), None)
            stands[sheet, row["tile"], row["id"]] = (row["tile"], row["id"]) if first is None else (first["tile"], first["id"])
            if first is None:
                kept.append(row)
    assert {(r.sheet, r.tile, r.id): tuple(r.kept) for r in merged.collect()} == stands and len(set(stands.values())) < len(stands)
    want = []
    for sheet in range(4):
        seen = set()
        for _, tile, n, kind, value, refs in sorted((d for d in dims if d[0] == sheet), key=lambda d: (d[1], d[2])):
            to = [stands.get((sheet, tile, r)) for r in refs or []]
            to = [t for t in to if t]
            key = (kind or "", round(value or 0.0, 1), frozenset(to))
            if key not in seen:
                seen.add(key)
                want.append((sheet, len(seen), tile, n, kind, value or 0.0, to))
    got = sorted((r.sheet, r.no, r.tile, r.ord, r.kind, r.value, [tuple(x) for x in r.refs]) for r in tiles.remapped(dd, merged, "sheet").collect())
    assert got == sorted(want)
    assert tiles.merged(df.where("false"), "sheet").collect() == []


def plain_solve(seed, constraints):
    def e(v):
        out = []
        for k, a, b, c, d, x in constraints:
            out.append({"fix": lambda: v[a] - x, "gap": lambda: v[b] - v[a] - x, "middle": lambda: v[c] - (v[a] + v[b]) / 2 - x, "distance": lambda: math.hypot(v[c] - v[a], v[d] - v[b]) - x}[k]())
        return np.array(out)

    v = np.array(seed, float)
    for _ in range(50):
        base = e(v)
        j = np.array([(e(v + 1e-6 * np.eye(len(v))[i]) - base) / 1e-6 for i in range(len(v))]).T
        step = np.linalg.lstsq(j, -base, rcond=1e-9)[0]
        v = v + step
        if np.linalg.norm(step) < 1e-9:
            break
    return v


def test_systems_are_solved_as_by_a_plain_solver(spark):
    rng, rows = random.Random(6), []
    for i in range(40):
        w, h = rng.uniform(20, 60), rng.uniform(20, 60)
        seed = [v + rng.uniform(-5, 5) for v in (0, 0, w, 0, w, h)]
        cs = [("fix", 0, None, None, None, 0.0), ("fix", 1, None, None, None, 0.0), ("gap", 1, 3, None, None, 0.0), ("gap", 2, 4, None, None, 0.0), ("gap", 0, 2, None, None, w)]
        cs.append(("distance", 0, 1, 4, 5, math.hypot(w, h)) if i % 2 else ("gap", 3, 5, None, None, h))
        rows.append((i, seed, cs[: 5 if i % 5 == 0 else 6], "extra"))
    df = spark.createDataFrame(rows, f"id int, seed array<double>, constraints array<{solve.CONSTRAINT}>, note string")
    for r in solve.solve(df).collect():
        want = plain_solve(r.seed, [tuple(c) for c in r.constraints])
        assert np.abs(np.array(r.solution["values"]) - want).max() < 1e-6 and r.solution.residual < 1e-9
        assert (r.solution.status, r.solution.rank) == (("free", 5) if r.id % 5 == 0 else ("solved", 6))


def test_singular_contradictory_and_broken_systems_have_a_stated_result(spark):
    fix = lambda a, v: ("fix", a, None, None, None, v)
    rows = [
        (0, [1.0, 7.0], [fix(0, 3.0)]),
        (1, [0.0], [fix(0, 1.0), fix(0, 3.0)]),
        (2, None, [fix(0, 1.0)]),
        (3, [1.0], [("spin", 0, None, None, None, 1.0)]),
        (4, [1.0], [fix(4, 1.0)]),
        (5, [1.0, 2.0], []),
        (6, [0.0, 0.0, 0.0, 0.0], [("distance", 0, 1, 2, 3, 5.0)]),
        (7, [float("nan")], [fix(0, 1.0)]),
    ]
    df = spark.createDataFrame(rows, f"id int, seed array<double>, constraints array<{solve.CONSTRAINT}>")
    got = {r.id: r.solution for r in solve.solve(df).collect()}
    assert (got[0].status, got[0]["values"], got[0].rank) == ("free", [3.0, 7.0], 1)
    assert got[1].status == "unmet" and abs(got[1]["values"][0] - 2.0) < 1e-9 and abs(got[1].residual - math.sqrt(2)) < 1e-9
    assert all(got[i].status == "invalid" and got[i]["values"] is None for i in (2, 3, 4, 7))
    assert (got[5].status, got[5]["values"]) == ("free", [1.0, 2.0])
    assert got[6].status == "unmet"  # both points in one place: no direction to move them
    assert solve.solve(df.where("false")).collect() == []


def test_rows_all_of_whose_tags_show_elsewhere(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice("ABC"), g * 100 + i, rng.choice(["vis", "hid", "hid"]), rng.choice([None, [], ["a"], ["a", "b"], ["b", "b"], ["c", "a"], ["d"]])) for g in range(12) for i in range(9)]
    df = spark.createDataFrame(rows, "graph int, view string, pi int, role string, tags array<string>").repartition(3)
    got = {r.pi for r in drawing.shown_elsewhere(df, "graph", "view", "pi", "tags", F.col("role") == "hid", F.col("role") == "vis").collect()}
    want = set()
    for g, view, pi, role, tags in rows:
        shows = lambda t: {v for h, v, _, r, ts in rows if h == g and r == "vis" and t in (ts or [])}  # noqa: B023, E731
        if role == "hid" and tags and all(shows(t) and view not in shows(t) for t in tags):
            want.add(pi)
    assert got == want and want


def test_rows_shown_elsewhere_are_moved_once(spark):
    """Nulls show nowhere; a row known twice passes only as a whole; primitives that lie together by drawing are shuffled once."""
    rows = [(1, "A", 1, "vis", ["a"]), (1, "B", 2, "hid", ["a"]), (1, None, 3, "hid", ["a"]), (None, "B", 4, "hid", ["a"]), (1, "B", 5, "hid", ["a", None]), (1, "B", 6, "hid", ["a"]), (1, "A", 6, "hid", ["a"]), (1, "B", 7, None, ["a"]), (2, None, 8, "vis", ["b"]), (2, "B", 9, "hid", ["b"])]
    df = spark.createDataFrame(rows, "graph int, view string, pi int, role string, tags array<string>")
    got = drawing.shown_elsewhere(df, "graph", "view", "pi", "tags", F.col("role") == "hid", F.col("role") == "vis")
    assert got.columns == df.columns and sorted(r.pi for r in got.collect()) == [2, 9]
    plan = recover.hidden_dropout(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "Exchange hashpartitioning(face" in plan and "SortMergeJoin" not in plan


def test_first_kept_over_chunks_and_batches(spark, monkeypatch):
    """Groups longer than a chunk and than a batch, against a plain loop; near is asked for chunks, not for each point."""
    rng = random.Random(5)
    rows = [(g, i, rng.uniform(0, 60), rng.uniform(0, 9)) for g, n in ((1, 150), (2, 3), (3, 90)) for i in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    calls = spark.sparkContext.accumulator(0)

    def near(kept, p):
        calls.add(1)
        return (abs(kept[:, 0] - p[0]) < 1) & (abs(kept[:, 1] - p[1]) < 2)

    try:
        got = {(r.g, r.i): r.kept for r in kernels.first_kept(spark.createDataFrame(rows, "g long, i long, x double, y double"), ["g"], ["i"], near, ["x", "y"], "i").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stay = []
    for g, i, x, y in rows:
        k = next((j for h, j, u, v in stay if h == g and abs(u - x) < 1 and abs(v - y) < 2), None)
        if k is None:
            stay.append((g, i, x, y))
        assert got[g, i] == (i if k is None else k)
    assert calls.value < len(rows) / 5


def test_parts_are_dealt_out(spark):
    assert recover.constraint_solve(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
