"""Readers, sinks and the incremental form on small files."""

import json

from plateworks.sources import documents
from plateworks.streaming import ingest_new


def test_graphs_and_primitives(spark, tmp_path):
    doc = {"views": [{"name": "front", "primitives": [{"id": "a", "type": "line", "line_role": "hidden"}, {"id": "b", "type": "circle", "visibility": "visible"}, {"id": "c", "type": "arc"}]}, {"name": "top", "primitives": []}]}
    (tmp_path / "p1.graph.json").write_text(json.dumps(doc))
    (tmp_path / "p2.graph.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    g = documents.graphs(spark, f"file://{tmp_path}")
    assert {(r.graph_id, r.doc is None) for r in g.collect()} == {("p1", False), ("p2", True)}
    p = documents.primitives(g.where("doc is not null")).collect()
    assert [(r.view, r.pi, r.prim.id, r.role) for r in p] == [("front", 0, "a", "hidden"), ("front", 1, "b", "visible"), ("front", 2, "c", "visible")]


def test_records_and_bundle(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": \n{"id": "a", "n": null}\n')
    r = documents.records(spark, f"file://{tmp_path}/in.jsonl", "id string, n int")
    assert sorted(x.status for x in r.collect()) == ["malformed", "ok", "ok"]
    ok = r.where("status = 'ok'").select("record.*")
    documents.write_bundle(ok, ok.limit(0), f"file://{tmp_path}/out")
    assert [x.id for x in spark.read.json(f"file://{tmp_path}/out/all").collect()] == ["a", "x"]
    new = spark.createDataFrame([("a", 9)], "id string, n int")
    assert {(x.id, x.n) for x in documents.resumed(ok, new).collect()} == {("a", 9), ("x", 1)}


def test_contracts_parse(spark):
    for ddl in documents.CONTRACTS.values():
        assert spark.createDataFrame([], ddl).count() == 0


def test_ingest_is_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": "a"}\n')
    args = (f"file://{src}", "id string", f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert ingest_new(spark, *args) == 1
    (src / "2.json").write_text('{"id": "b"}\n{"id": "c"}\n')
    assert ingest_new(spark, *args) == 2
    assert sorted(r.id for r in spark.read.parquet(args[2]).collect()) == ["a", "b", "c"]
