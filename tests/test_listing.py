"""Sources that begin with a listing, over a tree with missing and broken files; counters of the pass that writes."""

import json

import pytest
from pyspark.sql import functions as F

from plateworks.sources import listing
from plateworks.sources.sinks import write_counted


@pytest.fixture()
def tree(tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("run/f1/result.json", json.dumps({"status": "ok", "cad_score": 0.5, "gt_metrics": {"shape_similarity_score": "0.25"}, "topology_metrics": {"score": 1}, "validation": {"is_valid": True}, "extra": [1]}))
    put("run/f2/result.json", '{"status": "ok", "cad_score": "none", "gt_metrics": null, "validation": {"is_valid": false}}')
    put("run/f3/result.json", '{"status": "o')
    put("run/f4/result.json", "[1, 2]")
    put("run/f5/log.txt", "no result")
    put("run/f6/deep/result.json", '{"status": "ok"}')
    put("run/f7/result.json", "{}")
    put("run/notes.txt", "not a fixture")
    put("fix/g2/input.png", "x")
    put("fix/g1/input.png", "x")
    put("fix/g3/other.png", "x")
    put("fix/g4/deep/input.png", "x")
    for n in ("b", "a", "c10", "c9"):
        put(f"pred/{n}.py", "pass")
    put("pred/sub/z.py", "pass")
    put("pred/readme.md", "")
    put("ids.txt", "x2\n\n  x1  \r\nx2\nx9")
    return tmp_path


def test_results_of_a_run(spark, tree):
    results, skipped = listing.run_results(spark, str(tree / "run"))
    got = {r.fixture: tuple(r)[1:] for r in results.collect()}
    assert got == {"f1": ("ok", 0.5, 0.25, 1.0, True), "f2": ("ok", 0.0, None, None, False), "f7": ("missing", 0.0, None, None, False)}
    assert {tuple(r) for r in skipped.collect()} == {("f3", "broken"), ("f4", "broken"), ("f5", "missing"), ("f6", "missing")}


def test_listing_reads_no_contents(spark, tree):
    plan = listing.paths(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_fixtures(spark, tree):
    assert {r.fixture for r in listing.fixtures(spark, str(tree / "fix")).collect()} == {"g1", "g2"}
    with pytest.raises(FileNotFoundError):
        listing.fixtures(spark, str(tree / "pred"))


def test_evaluation_ids(spark, tree):
    ids = lambda **k: [r.id for r in sorted(listing.evaluation_ids(spark, **k).collect(), key=lambda r: r.place)]
    assert ids(folder=str(tree / "pred")) == ["a", "b", "c10", "c9"]
    assert ids(folder=str(tree / "pred"), limit=3) == ["a", "b", "c10"]
    assert ids(file=str(tree / "ids.txt")) == ["x2", "x1", "x2", "x9"]
    assert ids(file=str(tree / "ids.txt"), folder=str(tree / "pred"), limit=2) == ["x2", "x1"]
    with pytest.raises(ValueError):
        listing.evaluation_ids(spark)


def test_counters_of_the_pass_that_writes(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id")).alias("v")).mapInArrow(seen, "id long, v long")
    told = write_counted(df, str(tmp_path / "out"), {"null": F.col("v").isNull(), "large": F.col("v") >= 50, "never": F.col("v") < 0}, keep=F.col("v") < 50)
    assert told == {"null": 10, "large": 45}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 45 and scans.value == 100
    assert write_counted(df.where("false"), str(tmp_path / "none"), {"null": F.col("v").isNull()}) == {}
