"""Ranks and histograms of one group that holds everything, with ties, infinities, NaN and nulls."""

import random

from pyspark.sql import functions as F

from plateworks.operators import selection, stats


def test_histogram_of_one_group(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), rng.lognormvariate(3, 4), float(rng.randrange(9)), -1e9 * rng.random()]) for _ in range(3000)]
    values += [float("inf"), float("-inf"), float("nan"), float("nan"), None]
    df = spark.createDataFrame([(None if i % 2 else "a", v) for v in values for i in range(2)], "g string, v double").repartition(5)
    rows = stats.histogram(df, ["g"], "v").collect()
    plain = stats.histogram(df, ["g"], "v", spread=False).collect()
    text = lambda rs: sorted(str((r["g"], r["v"], r["_n"], r["_upto"], r["_total"])) for r in rs)
    assert text(rows) == text(plain)
    assert max(r["_upto"] for r in rows) == len(values) - 1 == rows[0]["_total"]


def test_slices_never_fall(spark):
    rng = random.Random(6)
    values = sorted([rng.lognormvariate(0, 9) * rng.choice([-1, 1]) for _ in range(5000)] + [0.0, -0.0, float("inf"), float("-inf")])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.slice_of(F.col("v")).alias("s"))
    slices = [r["s"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert slices == sorted(slices)


def test_numbers_of_one_group(spark):
    rows = [(("x", None)[i % 3 == 0], (i * 7919) % 50, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = {r["id"]: r["n"] for r in selection.numbered_spread(df, ["g"], ["v", "id"], selection.slice_of(F.col("v"))).collect()}
    want = {}
    for g in ("x", None):
        want |= {i: n for n, (_, i) in enumerate(sorted((v, i) for k, v, i in rows if k == g), 1)}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert stats.histogram(df, ["g"], "v").collect() == []
    assert selection.numbered_spread(df, ["g"], ["v"], selection.slice_of(F.col("v"))).collect() == []
