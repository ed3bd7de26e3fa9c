"""Mixing sources to target weights with a time-varying curriculum (DataFrame functions only).

Each source has a weight and a schedule ``w(t) = 1 + slope * (2t - 1)`` over training time ``t`` in [0, 1]. Integrated,
``W(t) = (1 - slope) t + slope t^2`` is the share of the source's words that training has taken by ``t``. The stream of a
source is its documents in hash order, repeated; the word at place ``p`` of ``demand`` words stands at the training position
``W^-1(p / demand)``, and documents are range-sorted by that position.

No source's rows meet in one task: running sums are taken inside (source, slice of the hash) and offset by the running sums
of the slices, a table of at most sources x slices rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateworks.llm.names import fresh, packed, unpacked
from plateworks.llm.store import written

#: A word is a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)
SLICES = 1024


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """Words wanted from each source: (_none, _src, source_size, target, demand, slope index _ord).

    sizes: one row (_none, _src, source_size) for each source. Sources by code point, null last, get the weights in turn and
    share ``share[0] / share[1]`` of all words; none gets over ``most`` times its size. A source is full if its limit for its
    weight is at most what is left for the weights left, when sources come by that ratio; the first that isn't full fixes
    the level of all later ones.
    """
    num, den = share
    everyone = Window.partitionBy()
    by_name = Window.orderBy("_none", "_src")
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("_ord") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_ord", F.row_number().over(by_name) - 1).withColumn("_w", w)
    # Whole numbers in units of 1 / den words keep every comparison exact.
    s = s.withColumn("_cap", F.col("source_size") * most * den).withColumn("_all", F.sum("source_size").over(everyone) * num)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_ord").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    s = s.withColumn("_wleft", F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    s = s.withColumn("_full", F.col("_cap") * F.col("_wleft") <= F.col("_w") * F.col("_left"))
    s = s.withColumn("_rest", F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(everyone))
    s = s.withColumn("_wrest", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(everyone))
    level = (F.col("_w") * F.col("_rest")).cast("double") / (F.col("_wrest") * den).cast("double")
    target = F.when(F.col("_full"), (F.col("source_size") * most).cast("double")).otherwise(level)
    s = s.withColumn("target", target).withColumn("demand", F.floor(F.col("target") + 0.5).cast("long"))
    return s.select("_none", "_src", "source_size", "target", "demand", "_ord")


def position(u: Column, slope: Column) -> Column:
    """The time t with (1 - slope) t + slope t^2 = u; never a negative zero."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)
    return F.round(F.when(slope == 0, u).otherwise((root - (1 - slope)) / (2 * slope)), 9) + 0.0


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    slices: int = SLICES,
    border: str = "split",
    out: str = "mix",
) -> DataFrame:
    """docs with a struct column ``out``: size, source_size, target, taken, copies, position, and what the order of training needs.

    ``taken`` is how many words of the document the mix takes, repeats counted, at most ``most`` times its size. With
    border="split" the document at which a source's demand ends gives only the words still wanted, so that the source gives
    exactly its rounded target; with "whole" documents are taken whole, the last one if at least half of it is wanted.
    ``copies`` is the number of times it is begun, ``position`` the training time of its first word (null if not taken).

    Null texts and texts without words have size 0, take part and are never taken. Null sources are one source, the last.
    Repeated rows are separate documents. The order is by md5 of the key (of the text where the key is null), then key and size (null first), so that
    reruns agree; rows that tie in all of them are alike. A column that is named as ``out`` is replaced; other columns stay, whatever their names.
    No rows give no rows.
    """
    d = packed(
        docs,
        _key=F.col(key),
        _size=word_count(F.col(text)),
        _none=F.col(source).isNull(),
        _src=F.coalesce(F.col(source), F.lit("")),
        # Rows without a key are spread by their texts.
        _hash=F.md5(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")).cast("binary")),
    )
    d = d.withColumn("_slice", F.shiftright(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * slices, 32))
    names = ["_none", "_src"]
    slim = written(d.groupBy(*names, "_slice").agg(F.sum("_size").alias("_n")), "slices")
    want = targets(slim.groupBy(*names).agg(F.sum("_n").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = slim.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    plan = start.join(want, names)
    inside = Window.partitionBy(*names, "_slice").orderBy("_hash", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(plan, [*names, "_slice"]).withColumn("_at", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))

    size, total = F.col("_size"), F.col("source_size")
    rounds = F.when(total > 0, F.floor(F.col("demand") / total)).otherwise(0).cast("long")
    last = F.col("demand") - rounds * total - F.col("_at")
    if border == "split":
        extra = F.greatest(F.lit(0).cast("long"), F.least(size, last))
    else:
        extra = F.when((last * 2 >= size) & (last > 0), size).otherwise(F.lit(0).cast("long"))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("_ord") % len(slopes) + 1).cast("int"))
    taken = rounds * size + extra
    d = d.withColumns({"_rounds": rounds, "_extra": extra, "_slope": slope, "_taken": taken})
    when = F.when(F.col("_taken") > 0, position(F.col("_at") / F.col("demand"), F.col("_slope")))
    copies = F.when(size > 0, F.col("_rounds") + (F.col("_extra") > 0).cast("long")).otherwise(0)
    made = F.struct(
        size.alias("size"),
        total.alias("source_size"),
        F.col("target"),
        F.col("_taken").alias("taken"),
        copies.alias("copies"),
        when.alias("position"),
        F.col("_at").alias("at"),
        F.col("demand"),
        F.col("_slope").alias("slope"),
        F.col("_hash").alias("order"),
    )
    return unpacked(d, docs.columns, out, made)


def by_position(mixed: DataFrame, out: str = "mix") -> DataFrame:
    """What mix() returns, range-sorted by training position; documents not taken come first, in hash order."""
    at = [F.col(f"{out}.position"), F.col(f"{out}.order")]
    return mixed.repartitionByRange(*at).sortWithinPartitions(*at)


def curriculum(mixed: DataFrame, out: str = "mix") -> DataFrame:
    """A row for each copy that training reads, range-sorted by its own position (in ``out``.position)."""
    m, copy, time = F.col(out), fresh("_copy", mixed.columns), fresh("_time", mixed.columns)
    rows = mixed.where(m.copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), m.copies - 1)))
    own = position((m.at + F.col(copy) * m.source_size) / m.demand, m.slope)
    rows = rows.withColumn(time, own)
    at = [F.col(time), m.order, F.col(copy)]
    rows = rows.repartitionByRange(*at).sortWithinPartitions(*at)
    return rows.withColumn(out, m.withField("position", F.col(time))).drop(time, copy)
