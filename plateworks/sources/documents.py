"""Drawing documents: their schema, readers of JSON folders and record files, and the bundle's sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators.selection import stem

#: The part of a drawing document that the relational tables are made of; every field may be absent.
GRAPH = (
    "amvdg_version string, part_id string, profile string, units string, "
    "world struct<handedness:string,up_axis:string,bbox_3d:array<double>>, "
    "views array<struct<name:string,frame:struct<origin_px:array<double>,px_per_mm:double>,primitives:array<struct<id:string,type:string,line_role:string,visibility:string,"
    "feature_id:string,p1:array<double>,p2:array<double>,center:array<double>,r_px:double,r:double,prov:struct<topo_origins:array<struct<dim:int,id:string,role:string>>>>>>>, "
    "annotations array<struct<id:string,kind:string,value:double,view:string,refs:array<string>>>, "
    "features array<struct<feature_id:string,kind:string,axis:string,r_mm:double,parent:string,prov:struct<occ_face_ids:array<string>>>>"
)
#: Row contracts of stages that stay outside (CAD kernel, model, renderer): what they hand back.
CONTRACTS = {
    "rendered": "id string, status string, graph string, error string",
    "generated": "id string, code string, status string",
    "evaluated": "id string, exec_ok boolean, has_result boolean, valid boolean, iou double, cd_mm double, bbox_err_mm array<double>, error_type string",
    "faces": "id string, n_faces int",
    "detected": "graph_id string, kind string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, r double, score double",
}


def graphs(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, raw, doc) of the *.graph.json files of a folder, one a row; doc is null for a broken one."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.graph.json").text(folder)
    return files.select(stem(F.col("_metadata.file_path")).alias("graph_id"), F.col("value").alias("raw"), F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", GRAPH)).alias("doc"))


def primitives(docs: DataFrame) -> DataFrame:
    """(graph_id, view, pi, prim, role): all views' primitives in emission order; an older name of the role is read too."""
    views = docs.select("graph_id", F.posexplode("doc.views").alias("vi", "v"))
    p = views.select("graph_id", F.col("v.name").alias("view"), "vi", F.posexplode("v.primitives").alias("pi", "prim"))
    return p.withColumn("role", F.coalesce("prim.line_role", "prim.visibility", F.lit("visible")))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line, status, record) of a file of JSON lines: ok or malformed; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    ok = F.try_parse_json("value").isNotNull()
    return lines.select(F.col("value").alias("line"), F.when(ok, "ok").otherwise("malformed").alias("status"), F.when(ok, F.from_json("value", schema)).alias("record"))


def write_bundle(records: DataFrame, quarantined: DataFrame, folder: str, key: str = "id") -> None:
    """Records and quarantined rows, each range-sorted by key, as JSON lines; Spark's committer makes each folder appear whole."""
    for name, rows in (("all", records), ("invalid_extent", quarantined)):
        rows.repartitionByRange(key).sortWithinPartitions(key).write.json(f"{folder}/{name}")


def resumed(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a new run over those of an earlier one."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))
