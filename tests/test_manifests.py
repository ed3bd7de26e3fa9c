"""Manifests, statistics and selection parameters on small files."""

import json

import pytest

from plateworks.sources import manifests


def test_manifest_of_what_went_well(spark, tmp_path):
    parts = spark.createDataFrame([("a", 1, "OK"), ("b", 2, "timeout"), ("c", 3, "OK"), ("d", 4, None)], "id string, n int, status string")
    lost = {r.status: r.n for r in manifests.write_manifest(parts, f"file://{tmp_path}/m").collect()}
    assert lost == {"timeout": 1, None: 1}
    assert {(r.id, r.n) for r in manifests.manifest(spark, f"file://{tmp_path}/m", "id string, n int").collect()} == {("a", 1), ("c", 3)}
    with pytest.raises(FileNotFoundError, match="no manifest at"):
        manifests.manifest(spark, f"file://{tmp_path}/none", "id string")


def test_stats_and_selection(spark, tmp_path):
    manifests.write_stats(spark.sql("select 3 as n, named_struct('p50', 1.5) as dist"), f"file://{tmp_path}/s")
    assert manifests.selection_params(spark, f"file://{tmp_path}/s", "n int, dist struct<p50:double>") == {"n": 3, "dist": {"p50": 1.5}}
    assert manifests.selection_params(spark, f"file://{tmp_path}/none", "n int") is None
    (tmp_path / "bad.json").write_text("{broken")
    assert manifests.selection_params(spark, f"file://{tmp_path}/bad.json", "n int") is None
    (tmp_path / "two.json").write_text(json.dumps({"n": 1}) + "\n" + json.dumps({"n": 2}))
    assert manifests.selection_params(spark, f"file://{tmp_path}/two.json", "n int") is None
