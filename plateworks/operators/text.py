"""Text records, headers and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part_header(text: Column) -> tuple[Column, Column]:
    """(bbox, extent) of a PART line: ``PART bbox=a,b,c ext=e``; null where it is missing or not quantised."""
    line = F.regexp_extract(text, r"(?m)^PART (.*)$", 1)
    box = F.regexp_extract(line, r"bbox=([-0-9.,]+)", 1)
    sides = F.transform(F.split(box, ","), lambda x: x.try_cast("double"))
    return F.when(box != "", sides), F.regexp_extract(line, r"ext=([-0-9.]+)", 1).try_cast("double")


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, view, line): each line with the VIEW it stands under."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    own = F.when(F.col("line").startswith("VIEW "), F.substring_index("line", " ", -1))
    under = F.last(own, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos"))
    return lines.withColumn("view", under)


def coordinate(value: Column, width: int) -> Column:
    """Sign token, if negative, and magnitude token of a whole coordinate."""
    return F.concat(F.when(value < 0, "<neg>").otherwise(""), F.lit("<c"), F.lpad(F.abs(value).cast("string"), width, "0"), F.lit(">"))


def slug(name: Column) -> Column:
    return F.translate(name, "/: ", "___")


def masked_labels(prompt: Column, whole: Column) -> Column:
    """The whole list with -100 over the longest prefix it shares with the prompt."""
    shared = F.aggregate(
        F.arrays_zip(prompt.alias("p"), whole.alias("w")),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, x: F.struct((a["n"] + F.when(a["on"] & x["p"].eqNullSafe(x["w"]), 1).otherwise(0)).alias("n"), (a["on"] & x["p"].eqNullSafe(x["w"])).alias("on")),
        lambda a: a["n"],
    )
    # An array of one binds the length, which the inner function would else work out for each element.
    return F.get(F.transform(F.array(shared), lambda n: F.transform(whole, lambda x, i: F.when(i < n, -100).otherwise(x))), F.lit(0))


def left_padded(ids: Column, to: Column, pad: int = 0) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), (to - F.size(ids)).cast("int")), ids)
