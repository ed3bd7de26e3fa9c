"""Entities, labels, fragments and bundles against plain loops; nulls, unknown types, empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plateworks.operators import bundles, emit
from plateworks.plans import exports

SHAPE = "g long, id long, type string, role string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, r double, a1 double, a2 double"


def shapes():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        kind = rng.choice(["line", "circle", "arc", "arc", "spline", None])
        ends = [float(rng.randrange(40)) for _ in range(4)] if kind == "line" else [None] * 4
        conic = [float(rng.randrange(1, 40)) for _ in range(3)] if kind != "line" else [None] * 3
        angles = [rng.choice([None, 0.0, 45.0, 270.0]), rng.choice([None, 90.0, 300.0])] if kind == "arc" else [None, None]
        rows.append((i % 3, i, kind, rng.choice(["hidden", "center", "visible", "phantom", None]), *ends, *conic, *angles))
    return rows


def test_entities(spark):
    rows = shapes()
    got = {r.id: r for r in emit.dxf(spark.createDataFrame(rows, SHAPE), F.lit(100.0)).withColumn("path", emit.svg_path()).collect()}
    for _, i, kind, role, x1, y1, x2, y2, cx, cy, r, a1, a2 in rows:
        layer = {"hidden": "HIDDEN", "center": "CENTER"}.get(role, "VISIBLE")
        open_ = kind == "arc" and (a1 is None or a2 is None)
        want = None
        if kind == "line":
            want = ("LINE", x1, 100 - y1, x2, 100 - y2, None, None, None)
        elif kind == "circle" or open_:
            want = ("CIRCLE", cx, 100 - cy, None, None, r, None, None)
        elif kind == "arc":
            want = ("ARC", cx, 100 - cy, None, None, r, -a2, -a1)
        assert (None if got[i].entity is None else tuple(got[i].entity)) == want
        assert got[i].layer == ("ARC" if open_ else layer)
        if kind == "arc" and not open_:
            at = lambda a: (cx + r * math.cos(math.radians(a)), cy + r * math.sin(math.radians(a)))  # noqa: B023, E731
            path = got[i].path.split()
            assert [float(x) for x in path[1:3] + path[-2:]] == pytest.approx([*at(a1), *at(a2)], abs=1e-4) and path[7] == str(int((a2 - a1) % 360 > 180))
        elif kind in ("circle", "arc"):
            assert got[i].path.count("A") == 2 and got[i].path.endswith("Z")
        else:
            assert (got[i].path is None) == (kind != "line")
    assert emit.dxf(spark.createDataFrame([], SHAPE), F.lit(1.0)).collect() == []


def test_labels(spark):
    rows = [r for r in shapes() if r[2] in ("line", "circle", "arc")]
    rng = random.Random(12)
    notes = [(g, n, rng.choice(["diameter", "radius", "linear", None]), rng.choice([2.0, 2.5, 0.125]), *rng.choice([(None, None), (None, None), (7.0, 8.0), (7.0, None)]), rng.choice([None, [], [900], [900, rng.choice(rows)[1], rng.choice(rows)[1]]])) for g in range(3) for n in range(20)]
    df = spark.createDataFrame(notes, "g long, ord long, kind string, value double, text_x double, text_y double, refs array<long>")
    got = {(r.g, r.ord): (r.label, r.x, r.y) for r in emit.labels(df, spark.createDataFrame(rows, SHAPE), "g", F.lit(100.0)).collect()}
    for g, n, kind, value, tx, ty, refs in notes:
        x, y = 20.0, 20.0 + n * 30
        if tx is not None and ty is not None:
            x, y = tx, ty
        else:
            first = next((s for k in refs or [] for s in rows if s[:2] == (g, k)), None)
            if first:
                x, y = (first[4], first[5]) if first[2] == "line" else (first[8] + first[10] + 10, first[9])
        assert got[g, n] == ({"diameter": "Ø", "radius": "R"}.get(kind, "") + f"{value:g}", x, 100 - y)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_variants_and_splits(spark, tmp_path, share):
    rows = [(i * 37 % 101, f"p{i}", i % 3, "x" * i) for i in range(40)] + [(500, "q", None, "yy")]
    df = spark.createDataFrame(rows, "at long, id string, k int, text string").repartition(6)
    made = bundles.variants(df, "id", {"clean": F.lit(True), "scan": F.col("k") > 0}, order=["at"], share=share)
    want, flat = {}, [(r, v) for r in sorted(rows) for v in ("clean", "scan") if v == "clean" or (r[2] or 0) > 0]
    for n, (r, v) in enumerate(flat):
        split = "both" if not share else "val" if n < max(1, int(len(flat) * share)) else "train"
        want[f"{r[1]}__{v}"] = (v, split)
    assert {r.file_name: (r.variant, r.split) for r in made.collect()} == want
    told = {(r.split, r.variant): (r.n, r.min, r.max, r["mean"]) for r in bundles.write_bundle(made, f"{tmp_path}/b", F.char_length("text")).collect()}
    size = {r[1]: len(r[3]) for r in rows}
    for key in set((s, v) for v, s in want.values()):
        sizes = [size[f.split("__")[0]] for f, (v, s) in want.items() if (s, v) == key]
        assert told[key] == (len(sizes), min(sizes), max(sizes), sum(sizes) // len(sizes))
    assert bundles.variants(df.where("false"), "id", {"clean": F.lit(True)}, order=["at"], share=share).collect() == []


def test_score_parts_broadcasts_no_side(spark):
    """Only the report itself, of a few rows a view, may be sent whole."""
    plan = exports.score_parts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1 and plan.count("SortMergeJoin") > 2
