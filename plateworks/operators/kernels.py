"""Order-dependent kernels by group: greedy matches, suppression, batches, draws, number text, program rewriting.

Each is a small function over one group's rows (a drawing's view, an image, a record); Spark deals out the groups.
"""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_order(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Whole groups in one partition each, sorted, for a kernel that reads them row by row and keeps one group's state."""
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def _rows(batches: Iterator[pa.RecordBatch], by: list[str], cols: list[str]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[bool, tuple]]]]:
    """Batches with their rows as (whether a group begins, values of cols)."""
    last: list = [None]

    def each(batch: pa.RecordBatch) -> Iterator[tuple[bool, tuple]]:
        keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
        values = zip(*(batch.column(c).to_pylist() for c in cols), strict=True)
        for key, row in zip(keys, values, strict=True):
            begins, last[0] = key != last[0], key
            yield begins, row

    for batch in batches:
        yield batch, each(batch)


def greedy(df: DataFrame, by: list[str], left: str, right: str, order: list[str], more: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs of candidates (by, left, right and others), taken group by group in the given order.

    A pair is taken if neither side is yet. Where each left row takes the best that is left, in the order of the left rows,
    ``order`` begins with their ordinal. Pairs keep the columns ``more``, so that what is counted of them needs no join.
    """
    names = [*by, left, right, *more]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: tuple[set, set] = set(), set()
        for batch, rows in _rows(batches, by, [left, right]):
            taken = []
            for begins, (a, b) in rows:
                if begins:
                    used = set(), set()
                free = a not in used[0] and b not in used[1]
                if free:
                    used[0].add(a)
                    used[1].add(b)
                taken.append(free)
            yield batch.filter(pa.array(taken, pa.bool_()))

    return in_order(df, by, order).select(names).mapInArrow(take, T.StructType([df.schema[c] for c in names]))


#: Points that first_kept compares at once.
CHUNK = 64


class _Kept:
    """Points of a group that stay, in an array that doubles as it fills."""

    def __init__(self, width: int):
        self.rows, self.n = np.empty((16, width)), 0

    def add(self, p: tuple) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.n] = p
        self.n += 1

    def first(self, p: tuple, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> int:
        """The place of the first that p is near to, or -1."""
        hits = near(self.rows[: self.n], np.array(p, float)) if self.n else np.empty(0, bool)
        return int(hits.argmax()) if hits.any() else -1


def first_kept(df: DataFrame, by: list[str], order: list[str], near: Callable[[np.ndarray, np.ndarray], np.ndarray], at: list[str], ids: str, out: str = "kept") -> DataFrame:
    """df with ``out``: the id of the row that stands for each. In order, a row stays and stands for itself if it is near none that stays before it; else the first of those stands for it.

    near gets points (columns ``at``) that stay, as (points, columns, 1), and points that come, as (columns, points), and tells for all pairs of them.
    A group is read in chunks of CHUNK rows; what is held is the points of one group that stay.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, df.schema[ids].dataType)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, names = _Kept(len(at)), []
        for batch, rows in _rows(batches, by, [ids]):
            mine, begins = [], []
            for i, (begin, (name,)) in enumerate(rows):
                mine.append(name)
                if begin:
                    begins.append(i)
            points = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in at]).astype(float)
            stands, fresh = [], set(begins)
            for low, high in pairwise(sorted({0, *begins, len(mine)})):
                if low in fresh:
                    kept, names = _Kept(len(at)), []
                for a in range(low, high, CHUNK):
                    p = points[a : min(a + CHUNK, high)]
                    m = len(p)
                    # A point is met by those that stay from before, the first of them first, then by those of its chunk.
                    old = near(kept.rows[: kept.n, :, None], p.T) if kept.n else np.zeros((1, m), bool)
                    first, there, own = old.argmax(axis=0).tolist(), old.any(axis=0).tolist(), near(p[:, :, None], p.T).T.tolist()
                    new: list[int] = []
                    for j in range(m):
                        at_ = names[first[j]] if there[j] else None
                        if not there[j]:
                            i = next((i for i in new if own[j][i]), j)
                            at_ = mine[a + i]
                            if i == j:
                                new.append(j)
                        stands.append(at_)
                    for j in new:
                        kept.add(p[j])
                        names.append(mine[a + j])
            yield batch.append_column(out, pa.array(stands, batch.column(ids).type))

    return in_order(df, by, order).mapInArrow(keep, schema)


def suppressed(df: DataFrame, by: list[str], order: list[str], near: Callable[[np.ndarray, np.ndarray], np.ndarray], at: list[str]) -> DataFrame:
    """Rows kept by non-maximum suppression: in order, one stays if it is near none kept before. near gets kept points and a point."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(len(at))
        for batch, rows in _rows(batches, by, at):
            stays = []
            for begins, p in rows:
                if begins:
                    kept = _Kept(len(at))
                free = kept.first(p, near) < 0
                if free:
                    kept.add(p)
                stays.append(free)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return in_order(df, by, order).mapInArrow(keep, df.schema)


def token_batches(df: DataFrame, by: list[str], length: str, tie: str, most: int, budget: int) -> DataFrame:
    """df with batch: rows by rising length; a new batch begins when the count or longest * count would be over. A lone long row is one."""
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = number = 0
        for batch, rows in _rows(batches, by, [length]):
            out = []
            for begins, (longest,) in rows:
                if begins:
                    n = number = 0
                elif n + 1 > most or longest * (n + 1) > budget:
                    number, n = number + 1, 0
                n += 1
                out.append(number)
            yield batch.append_column("batch", pa.array(out, pa.int64()))

    return in_order(df, by, [length, tie]).mapInArrow(deal, schema)


def number_text(value: float | None) -> str | None:
    """Two decimals of the exact binary value, without trailing zeros; no negative zero."""
    if value is None or math.isnan(value):
        return None
    s = f"{value:.2f}".rstrip("0").rstrip(".")
    return "0" if s == "-0" else s


@F.pandas_udf(T.StringType())
def canonical_number(v: pd.Series) -> pd.Series:
    return v.map(number_text)


@F.pandas_udf(T.DoubleType())
def exact_round(v: pd.Series) -> pd.Series:
    """Rounding to two decimals as the exact binary value has it."""
    return v.map(lambda x: round(x, 2), na_action="ignore")


def dropped_out(key: Column, seed: int, share: float) -> Column:
    """Whether a seeded hash of the key draws below a share: the same on every run, and in SQL (the first eight digits of an md5)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") < round(share * 2**32)


def repaired(text: str) -> tuple[str, str]:
    """(status, JSON text): ok, repaired (the longest beginning of the object that closes a bracket, closed) or fail.

    What stands before the first brace is passed over. One scan finds the last closing bracket behind which the object can be closed;
    earlier ones are tried only where that is no JSON, each by halving the number of those left, so that a long broken text is parsed a few times.
    """
    begin = text.find("{")
    if begin < 0:
        return "fail", ""
    body = text[begin:]
    try:
        json.loads(body)
        return "ok", body
    except ValueError:
        pass
    opened: list[str] = []
    inside = escaped = False
    cuts: list[tuple[int, str]] = []
    for i, c in enumerate(body):
        if inside:
            inside = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{[":
            opened.append("}" if c == "{" else "]")
        elif c in "}]":
            if not opened or opened[-1] != c:
                break  # no beginning that goes on from here is JSON
            opened.pop()
            cuts.append((i + 1, "".join(reversed(opened))))
            if not opened:
                break
    # A beginning that can be closed to JSON stays so when it is cut at an earlier closing bracket: the last good one is found by halving.
    low, high = 0, len(cuts)
    while low < high:
        mid = (low + high) // 2
        try:
            json.loads(body[: cuts[mid][0]] + cuts[mid][1])
            low = mid + 1
        except ValueError:
            high = mid
    if not low:
        return "fail", ""
    at, rest = cuts[low - 1]
    return "repaired", body[:at] + rest


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("body", T.StringType())]))
def repair_json(v: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repaired(t or "") for t in v], columns=["status", "body"])


#: The calls that blend edges, and those that select what is blended.
BLENDS = frozenset({"fillet", "chamfer"})
SELECTORS = frozenset({"edges", "faces", "vertices", "wires", "solids", "shells", "first", "last", "item", "end", "all"})


def _cut_of(call: ast.Call) -> ast.expr | None:
    """For a blend, the expression that stays: what the selectors right before it were called on."""
    if not isinstance(call.func, ast.Attribute) or call.func.attr not in BLENDS:
        return None
    stays = call.func.value
    while isinstance(stays, ast.Call) and isinstance(stays.func, ast.Attribute) and stays.func.attr in SELECTORS:
        stays = stays.func.value
    return stays


def strip_blends(source: str | None) -> tuple[str | None, int, str | None]:
    """(program without blends, blends removed, error). A null program gives nulls and 0. It is parsed, never run.

    Blends are cut out of the text itself, from the end of what stays to the end of the call, so that everything else stays
    as it is written; cuts inside a selector that goes as well count, but are not made twice.
    """
    if source is None:
        return None, 0, None
    try:
        tree = ast.parse(source)
        raw = source.encode()
        # ast counts bytes in the lines of the text, with all line ends as line feeds.
        begins = [0]
        for line in raw.splitlines(keepends=True) if b"\x0c" not in raw else raw.split(b"\n"):
            begins.append(begins[-1] + len(line) + (b"\x0c" in raw))
        at = lambda line, col: begins[line - 1] + col
        cuts = []
        for node in ast.walk(tree):
            stays = _cut_of(node) if isinstance(node, ast.Call) else None
            if stays is not None:
                inner = raw[at(stays.end_lineno, stays.end_col_offset) : at(node.end_lineno, node.end_col_offset)]
                # A bracket that closes around what stays belongs to it.
                skip = len(inner) - len(inner.lstrip(b") \t\r\n")) if inner.lstrip(b" \t\r\n").startswith(b")") else 0
                cuts.append((at(stays.end_lineno, stays.end_col_offset) + skip, at(node.end_lineno, node.end_col_offset)))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, 0, type(e).__name__
    out, done = [], 0
    for begin, end in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if begin >= done:
            out.append(raw[done:begin])
        done = max(done, end)
    out.append(raw[done:])
    return b"".join(out).decode(), len(cuts), None


@F.pandas_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("error", T.StringType())]))
def stripped(v: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strip_blends(s) for s in v], columns=["code", "n", "error"])


def picks(df: DataFrame, by: list[str], size: str, tie: str, k: int, budget: int) -> DataFrame:
    """by, place, tie: k examples, the shortest first (also over the budget), then at even ranks, each walked down to the next unused one that fits.

    The walk is the highest unused rank at or below the wanted one that fits: one aggregate for each place, over all ranks.
    """
    order = Window.partitionBy(*by).orderBy(size, tie)
    ranked = df.select(*by, (F.row_number().over(order) - 1).alias("_r"), F.col(size).alias("_s"), F.col(tie).alias("_t"))
    pick = lambda i: F.struct(F.lit(i).cast("long").alias("place"), "_r", "_s", "_t")
    state = ranked.groupBy(*by).agg(F.count("*").alias("_n"), F.array(F.min_by(pick(0), "_r")).alias("_p"))
    for i in range(1, k):
        wanted = F.rint(F.lit(i / k) * (F.col("_n") - 1)).cast("int")
        left = F.lit(budget) - F.aggregate("_p", F.lit(0).cast("double"), lambda a, x: a + x["_s"])
        now = state.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_n", "_p", wanted.alias("_w"), left.alias("_left"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])
        fits = (F.col("_r") <= F.col("_w")) & (F.col("_s") <= F.col("_left")) & ~F.array_contains(F.transform("_p", lambda x: x["_r"]), F.col("_r"))
        found = F.max_by(pick(i), F.when(fits, F.col("_r")))
        state = ranked.join(now, same).groupBy(*by).agg(F.any_value("_n").alias("_n"), F.any_value("_p").alias("_p"), found.alias("_f"))
        state = state.select(*by, "_n", F.when(F.col("_f").isNull(), F.col("_p")).otherwise(F.array_append("_p", F.col("_f"))).alias("_p"))
    return state.select(*by, F.explode("_p").alias("_p")).select(*by, "_p.place", F.col("_p._t").alias(tie))
