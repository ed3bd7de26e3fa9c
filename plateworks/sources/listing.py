"""Sources that begin with what files there are: id lists, fixtures, run results. Files are listed without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateworks.operators import selection


def paths(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, folder, name, size) of the files under a folder, at any depth, whose names match. Only metadata are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    f = files.select("path", F.col("length").alias("size"))
    return f.select("path", F.element_at(F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/"), -1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "size")


def fixtures(spark: SparkSession, root: str, marker: str = "input.png") -> DataFrame:
    """(fixture, path) of the folders right under root that hold the marker. It is an error if there are none."""
    depth = _below(root)
    found = paths(spark, root, marker).where(F.size(depth) == 2).select(F.col("folder").alias("fixture"), "path")
    if found.isEmpty():
        raise FileNotFoundError(f"no folder with {marker} under {root}")
    return found


def _below(root: str) -> Column:
    """The parts of a path after root's own name."""
    name = root.rstrip("/").split("/")[-1]
    return F.split(F.substring_index("path", f"/{name}/", -1), "/")


def evaluation_ids(spark: SparkSession, *, folder: str | None = None, file: str | None = None, limit: int | None = None) -> DataFrame:
    """(place, id): the lines of a list file in order, without blank ones, or else the sorted stems of the programs (*.py) right in a folder; the first ``limit`` of them, if one is given (0: all).

    Ids that stand in the list twice stay twice.
    """
    if file:
        text = spark.read.option("wholetext", True).text(file)
        lines = text.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "id")).select("at", F.trim("id").alias("id")).where("id <> ''")
        # A list of ids is one file: its lines are ordered where it is read.
        ids = lines.select((F.row_number().over(Window.orderBy("at")) - 1).alias("place"), "id")
    elif folder:
        programs = paths(spark, folder, "*.py").where(F.size(_below(folder)) == 1).select(F.regexp_replace("name", r"\.py$", "").alias("id"))
        ids = selection.numbered_spread(programs, [], ["id"], F.conv(F.hex(F.substring("id", 1, 2)), 16, 10).cast("long"), "place").select((F.col("place") - 1).cast("int").alias("place"), "id")
    else:
        raise ValueError("a folder of programs or a list of ids is needed")
    return ids.where(F.col("place") < limit) if limit else ids


#: The parts of a result document that count; any may be absent.
RESULT = "status string, cad_score string, gt_metrics struct<shape_similarity_score:string>, topology_metrics struct<score:string>, validation struct<is_valid:string>"


def run_results(spark: SparkSession, run: str) -> tuple[DataFrame, DataFrame]:
    """(results, skipped) of a run's folder: fixture, status, cad_score, shape, topology, is_valid; and fixture, reason.

    A fixture is a folder right under it with any file. One without result.json is ``missing``, one whose document can't be read ``broken``.
    Scores that are no numbers are null, but for cad_score, which is 0 then; a missing status is ``missing``; is_valid is whether it says so.
    """
    seen = paths(spark, run).where(F.size(_below(run)) >= 2).select(_below(run)[0].alias("fixture")).distinct()
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "result.json").option("recursiveFileLookup", "true").text(run)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value").where(F.size(_below(run)) == 2).select(_below(run)[0].alias("fixture"), "value")
    doc = F.when(F.try_parse_json("value").isNotNull() & F.startswith(F.trim(F.translate("value", "\r\n\t", "   ")), F.lit("{")), F.from_json("value", RESULT))
    parsed = files.select("fixture", doc.alias("d"))
    real = lambda c: F.col(c).try_cast("double")
    results = parsed.where("d is not null").select(
        "fixture",
        F.coalesce("d.status", F.lit("missing")).alias("status"),
        F.coalesce(real("d.cad_score"), F.lit(0.0)).alias("cad_score"),
        real("d.gt_metrics.shape_similarity_score").alias("shape"),
        real("d.topology_metrics.score").alias("topology"),
        F.coalesce(F.lower("d.validation.is_valid") == "true", F.lit(False)).alias("is_valid"),
    )
    known = parsed.select("fixture", F.col("d").isNotNull().alias("ok"))
    skipped = seen.join(known, "fixture", "left").where("ok is null or not ok").select("fixture", F.when(F.col("ok").isNull(), "missing").otherwise("broken").alias("reason"))
    return results, skipped
