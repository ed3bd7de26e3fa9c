"""Hard negatives by an inverted multi-index.

Rows of one label and vector are one entry. The halves of its vector are each given to the nearest centroid of a codebook of their own, and a pair of
codes is a cell. Of a query, q1 * c1 + |q1| * r1 bounds the score of every first half with code c1, r1 being the largest distance of one from its
centroid, and likewise for the second; the sum bounds a cell. A heap over both sorted lists of half bounds visits cells by falling sum, and the
search ends when the next sum can't reach any window that is still open: what was found is then certain, not probable.

Cells lie in blocks of bounded size, and a large cell in several. A query first goes to the few blocks of its best cells. What it finds there
is the least that the result can hold, so then it goes to those other blocks that have a cell whose bound reaches that. Positives are
searched first; their scores give the windows of the negatives.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateworks.llm.store import written

#: Entries from which the codebooks are fitted, rounds of that, and codes of a codebook at most.
SAMPLE, ROUNDS, CODES = 20_000, 8, 512
#: Entries of a cell for which the number of codes is chosen, of a block at most, of the first blocks of a query, and scored at once.
CELL, BLOCK, HOME, AT_ONCE = 64, 4_096, 512, 512
SCALE = 256


def finite(v: Column) -> Column:
    """Not null, and no component null or non-finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; those beyond 64 bits are the largest or least number there is."""
    size = rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0))
    if size < 2**53:
        return (rows @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, q.tolist(), strict=True)) for r in rows.tolist()]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], np.int64)


def codebook(points: np.ndarray, codes: int) -> np.ndarray:
    """Centroids of the points by Lloyd's rounds; they begin at points spread evenly over the first component's order."""
    order = np.argsort(points[:, 0], kind="stable") if points.shape[1] else np.arange(len(points))
    at = points[order[np.linspace(0, len(points) - 1, codes).round().astype(int)]]
    for _ in range(ROUNDS):
        near = nearest(points, at)
        counts = np.bincount(near, minlength=codes)
        sums = np.zeros_like(at)
        np.add.at(sums, near, points)
        at = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], at)
    return at


def nearest(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((at * at).sum(axis=1)[None, :] - 2 * points @ at.T).argmin(axis=1)


def by_falling_sum(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs by falling sum, with a heap over both sorted lists."""
    if not len(one) or not len(two):
        return
    a, b = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
    one, two = one.tolist(), two.tolist()
    heap = [(-one[a[0]] - two[b[0]], 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, a[i], b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-one[a[i]] - two[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-one[a[i + 1]] - two[b[0]], i + 1, 0))


class Codes:
    """Codebooks of the halves of vectors of one length. Lengths that the sample lacks have one code, at 0."""

    def __init__(self, dim: int, sample: np.ndarray | None, codes: int):
        self.half = dim // 2
        if sample is None or not len(sample):
            self.books = np.zeros((1, self.half)), np.zeros((1, dim - self.half))
        else:
            codes = min(codes, len(sample))
            self.books = codebook(sample[:, : self.half], codes), codebook(sample[:, self.half :], codes)

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[..., : self.half], v[..., self.half :]

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """The code of each half and its distance from the centroid."""
        out = []
        for part, book in zip(self.halves(v), self.books, strict=True):
            code = nearest(part, book)
            out += [code, np.sqrt(((part - book[code]) ** 2).sum(axis=1))]
        return tuple(out)

    def bounds(self, q: np.ndarray, radii: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """What a half of each code can score at most; a little more, for rounding."""
        out = []
        for part, book, far in zip(self.halves(q), self.books, radii, strict=True):
            norm = math.sqrt(float(part @ part))
            top = book @ part + norm * far
            out.append(top + 1e-9 * (np.abs(book) @ np.abs(part) + norm * far) + 1e-6)
        return out


class Layout:
    """Which blocks each cell lies in, by length of vector: cells in order, filled into blocks one after another."""

    def __init__(self, first: int, cells: list[tuple[int, int, int]], radii: tuple[np.ndarray, np.ndarray]):
        """cells: (code, code, entries). Blocks are numbered from ``first``."""
        self.radii = radii
        self.cells = {}
        at, room = first, BLOCK
        for a, b, n in sorted(cells):
            if n > room and room < BLOCK:
                at, room = at + 1, BLOCK
            wide = max(1, -(-n // BLOCK))
            self.cells[a, b] = at, wide, n
            if wide > 1:
                at, room = at + wide, BLOCK
            else:
                room -= n
        self.blocks = at + 1
        self.a, self.b = np.array([*self.cells], np.int64).reshape(-1, 2).T
        self.at, self.wide = np.array([x[:2] for x in self.cells.values()], np.int64).reshape(-1, 2).T

    def home(self, bounds: list[np.ndarray]) -> list[int]:
        """Blocks of the best cells that hold HOME entries; of a large cell all its blocks."""
        out, n = set(), 0
        for _, a, b in by_falling_sum(*bounds):
            if (a, b) in self.cells:
                at, wide, k = self.cells[a, b]
                out.update(range(at, at + wide))
                n += k
                if n >= HOME:
                    break
        return sorted(out)

    def reaching(self, bounds: list[np.ndarray], floor: float) -> list[int]:
        """Blocks with a cell whose bound reaches floor."""
        good = bounds[0][self.a] + bounds[1][self.b] >= floor
        return sorted({x for at, wide in zip(self.at[good].tolist(), self.wide[good].tolist(), strict=True) for x in range(at, at + wide)})


class Index:
    """Codebooks and layouts: what every task knows. It holds at most CODES ** 2 cells and 2 * CODES centroids for a length."""

    def __init__(self) -> None:
        self.codes: dict[int, Codes] = {}
        self.layouts: dict[int, Layout] = {}

    def of(self, dim: int) -> Codes:
        if dim not in self.codes:
            self.codes[dim] = Codes(dim, None, 1)
        return self.codes[dim]


_ENTRY = "_dim int, _label string, _h1 long, _h2 long, _ids array<long>, _v array<double>"
_PLACED = f"{_ENTRY}, _a int, _b int, _ra double, _rb double"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of equal keys."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    yield from ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)


def entries(rows: DataFrame, ids: int) -> DataFrame:
    """One row for each label and vector (_dim, _v) with its least ids, so many at most. Large groups are cut down before they are shuffled."""
    group = ["_dim", "_label", "_h1", "_h2", "_v"]
    # Repeated rows have one rank; the limit by rank works in each task first.
    ranked = rows.select(*group, "_id", F.dense_rank().over(Window.partitionBy(*group).orderBy("_id")).alias("_r")).where(F.col("_r") <= ids)
    return ranked.groupBy(*group).agg(F.sort_array(F.collect_set("_id")).alias("_ids")).select("_dim", "_label", "_h1", "_h2", "_ids", "_v")


def fit(found: DataFrame, sample: int = SAMPLE) -> tuple[Index, DataFrame]:
    """The index of the entries, and the entries with their cell and block, written."""
    index, n = Index(), found.count()
    share = min(1_000_000, 1_000_000 * sample // max(n, 1))
    drawn = found.where(F.pmod(F.col("_h1"), F.lit(1_000_000)) <= share).select("_dim", "_v", "_h1").orderBy("_h1").limit(2 * sample).collect()
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(r["_dim"], []).append(r["_v"])
    for dim, vs in by_dim.items():
        mine = n * len(vs) / max(len(drawn), 1)
        index.codes[dim] = Codes(dim, np.array(vs, float).reshape(len(vs), dim), max(1, min(CODES, round(math.sqrt(mine / CELL)))))
    shared = found.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(batch.column("_dim").to_pylist()):
                part = batch.slice(a, b - a)
                dim = part.column("_dim")[0].as_py()
                one, far1, two, far2 = shared.value.of(dim).assign(_matrix(part.column("_v"), dim))
                made = [pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(far1), pa.array(far2)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "_a", "_b", "_ra", "_rb"])

    placed = written(found.mapInArrow(place, _PLACED), "placed")
    cells = placed.groupBy("_dim", "_a", "_b").agg(F.count("*").alias("n"), F.max("_ra").alias("ra"), F.max("_rb").alias("rb")).collect()
    first = 0
    for dim in sorted({c["_dim"] for c in cells}):
        mine, codes = [c for c in cells if c["_dim"] == dim], index.of(dim)
        radii = tuple(np.zeros(len(b)) for b in codes.books)
        for c in mine:
            radii[0][c["_a"]], radii[1][c["_b"]] = max(radii[0][c["_a"]], c["ra"]), max(radii[1][c["_b"]], c["rb"])
        index.layouts[dim] = Layout(first, [(c["_a"], c["_b"], c["n"]) for c in mine], radii)
        first = index.layouts[dim].blocks
    final = found.sparkSession.sparkContext.broadcast(index)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for dim, a, b, h in zip(*(batch.column(c).to_pylist() for c in ("_dim", "_a", "_b", "_h2")), strict=True):
                at, wide, _ = final.value.layouts[dim].cells[a, b]
                blocks.append(at + h % wide)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(blocks, pa.int32())], names=[*names, "_block"])

    names = [*(c.split()[0] for c in _ENTRY.split(", ")), "_a", "_b"]
    return index, written(placed.select(*names).mapInArrow(dealt, f"{_ENTRY}, _a int, _b int, _block int"), "blocks")


_WINDOWS = "array<struct<low:long,high:long,floor:long>>"
_LEAST, _MOST = -(2**63), 2**63 - 1


def routed(asked: DataFrame, index: Index, home: bool) -> DataFrame:
    """asked (_dim, _label, _h1, _h2, _v, windows) once for each block that it goes to: those of its best cells, or the others that reach a floor."""
    shared = asked.sparkSession.sparkContext.broadcast(index)
    names = ["_dim", "_label", "_h1", "_h2", "_v", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, block = [], []
            for i, (dim, v, windows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_dim", "_v", "windows")), strict=True)):
                layout = shared.value.layouts.get(dim)
                if layout is None or not windows:
                    continue
                bounds = shared.value.of(dim).bounds(np.array(v, float), layout.radii)
                first = layout.home(bounds)
                to = first if home else sorted(set(layout.reaching(bounds, min(w["floor"] for w in windows))).difference(first))
                row += [i] * len(to)
                block += to
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.select(names).columns), pa.array(block, pa.int32())], names=[*names, "_block"])

    return asked.select(*names).mapInArrow(run, f"_dim int, _label string, _h1 long, _h2 long, _v array<double>, windows {_WINDOWS}, _block int")


class Block:
    """The entries of a block, cell by cell."""

    def __init__(self, parts: list[pa.RecordBatch], index: Index):
        t = pa.Table.from_batches(parts).combine_chunks()
        col = lambda c: t.column(c).chunk(0)
        self.dim = t.column("_dim")[0].as_py()
        a, b = (col(c).to_numpy() for c in ("_a", "_b"))
        order = np.lexsort((b, a))
        self.rows = _matrix(col("_v"), self.dim)[order]
        labels = col("_label").to_pylist()
        self.names = {x: i for i, x in enumerate(sorted(set(labels)))}
        self.labels = np.array([self.names[x] for x in labels], np.int64)[order]
        self.top = float(np.abs(self.rows).max(initial=0))
        self.h1, self.h2 = (col(c).to_numpy()[order] for c in ("_h1", "_h2"))
        ids = col("_ids").to_pylist()
        self.ids = [ids[i] for i in order.tolist()]
        pairs = list(zip(a[order].tolist(), b[order].tolist(), strict=True))
        self.cells = {pairs[x]: (x, y) for x, y in _runs(pairs)}
        self.a, self.b = np.unique(a), np.unique(b)
        self.codes, self.radii = index.of(self.dim), index.layouts[self.dim].radii

    def batches(self, q: np.ndarray) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """(bound of the first cell, where their entries stand) of cells by falling bound, AT_ONCE entries or one cell together; no later cell has a greater bound."""
        one, two = self.codes.bounds(q, self.radii)
        top, held, n = math.inf, [], 0
        for bound, i, j in by_falling_sum(one[self.a], two[self.b]):
            cell = self.cells.get((int(self.a[i]), int(self.b[j])))
            if cell is None:
                continue
            if not held:
                top = bound
            held.append(cell)
            n += cell[1] - cell[0]
            if n >= AT_ONCE:
                yield top, held
                held, n = [], 0
        if held:
            yield top, held

    def search(self, q: np.ndarray, label: str, h: tuple[int, int], windows: list[dict], k: int, same: bool) -> Iterator[tuple[int, int, int, bool]]:
        """(window, score, id, whether of the query's own entry): the k best of each window, ties to the lesser id."""
        found: list[list] = [[] for _ in windows]
        need = [w["floor"] for w in windows]
        code = self.names.get(label, -1)
        # Sums of products that a double holds exactly; cells are scored where they stand.
        plain = self.dim * self.top * float(np.abs(q).max(initial=0)) < 2**53
        for bound, cells in self.batches(q):
            if bound < min(need):
                break
            rows = np.concatenate([np.arange(a, b) for a, b in cells])
            scores = np.concatenate([self.rows[a:b] @ q for a, b in cells]).astype(np.int64) if plain else products(self.rows[rows], q)
            fit = (self.labels[rows] == code) == same
            rows, scores = rows[fit], scores[fit]
            for i, w in enumerate(windows):
                good = np.flatnonzero((scores >= max(need[i], w["low"])) & (scores <= w["high"]))
                if len(good):
                    more = [(-s, x, (self.h1[r], self.h2[r]) == h) for s, r in zip(scores[good].tolist(), rows[good].tolist(), strict=True) for x in self.ids[r]]
                    found[i] = heapq.nsmallest(k, found[i] + more)
                    if len(found[i]) == k:
                        need[i] = max(need[i], -found[i][-1][0])
        for i, best in enumerate(found):
            yield from ((i, -s, x, own) for s, x, own in best)


def searched(blocks: DataFrame, asked: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(_h1, _h2, w, score, id, own): what the routed queries find in each block."""
    shared = blocks.sparkSession.sparkContext.broadcast(index)
    both = blocks.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("_block").sortWithinPartitions("_block", "_side")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("_block").to_pylist(), batch.column("_side").to_pylist(), strict=True))
            for x, y in _runs(keys):
                part, (at, side) = batch.slice(x, y - x), keys[x]
                if at != now:
                    now, parts, block = at, [], None
                if not side:
                    parts.append(part)
                    continue
                block = block or Block(parts, shared.value)
                out = []
                for label, h1, h2, v, windows in zip(*(part.column(c).to_pylist() for c in ("_label", "_h1", "_h2", "_v", "windows")), strict=True):
                    out += [(h1, h2, *r) for r in block.search(np.array(v, float), label, (h1, h2), windows, k, same)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_h1", "_h2", "w", "score", "id", "own"])

    return dealt.mapInArrow(run, "_h1 long, _h2 long, w int, score long, id long, own boolean")


def best(blocks: DataFrame, asked: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(_h1, _h2, w, best): the k best (score, id, own) of each window of asked, in order. First the blocks of the best cells, then what can still matter."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "own"))), 1, k).alias("_best")
    first = written(searched(blocks, routed(asked, index, True), index, k, same), "first")
    # At most k rows of each block that a query went to.
    told = first.groupBy("_h1", "_h2", "w").agg(top).where(F.size("_best") == k)
    told = told.groupBy("_h1", "_h2").agg(F.map_from_entries(F.collect_list(F.struct("w", (-F.col("_best")[k - 1]["s"]).alias("f")))).alias("_told"))
    raised = F.transform("windows", lambda w, i: F.struct(w["low"], w["high"], F.greatest(w["floor"], F.element_at("_told", i)).alias("floor")))
    then = asked.join(told, ["_h1", "_h2"], "left").withColumn("windows", F.when(F.col("_told").isNull(), F.col("windows")).otherwise(raised).cast(_WINDOWS))
    second = searched(blocks, routed(then, index, False), index, k, same)
    return first.unionByName(second).groupBy("_h1", "_h2", "w").agg(top).select("_h1", "_h2", "w", F.transform("_best", lambda x: F.struct((-x["s"]).alias("score"), x["id"].alias("id"), x["own"].alias("own"))).alias("best"))


def mine(vectors: DataFrame, anchors: Column, *, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    A score is the inner product of the vectors' components as floor(256 * x). Positives are the best other rows with the anchor's label;
    negatives the best rows of another label whose score is from ``low`` to ``high`` per cent of the positive's; ties go to the smaller id.
    Rows with a null id or label, or a vector that is null or has null or non-finite components, take no part; vectors of another length
    than the anchor's are not its candidates; empty ones score 0. Repeated rows count once; rows that repeat an id with another label or
    vector are rows of their own, each an anchor if it is one. An anchor without positives or negatives has no rows. Other columns are not read. No rows give no rows.

    Tables of the index and of what the first blocks give are written to the shared folder; store.release() deletes them.
    """
    label = F.col(label) if isinstance(label, str) else label
    wide = F.col(vector).cast("array<double>")
    whole = F.transform(wide, _floored)
    ok = F.col(key).isNotNull() & label.isNotNull() & finite(wide)
    rows = vectors.where(ok).select(F.col(key).cast("long").alias("_id"), anchors.alias("_asks"), label.cast("string").alias("_label"), F.size(vector).alias("_dim"), whole.alias("_v"))
    rows = written(rows.withColumns({"_h1": F.xxhash64("_label", "_v"), "_h2": F.xxhash64("_v", "_label", F.lit(2))}), "vectors")
    index, blocks = fit(written(entries(rows, positives + 1), "entries"))
    asking = rows.where("_asks")
    open_ = F.array(F.struct(F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"), F.lit(_LEAST).alias("floor"))).cast(_WINDOWS)
    asked = written(asking.dropDuplicates(["_h1", "_h2", "_dim"]).select("_dim", "_label", "_h1", "_h2", "_v", open_.alias("windows")), "asked")
    near = written(best(blocks, asked, index, positives + 1, True).select("_h1", "_h2", F.col("best").alias("near")), "positives")
    # A window for each score of a positive: scores below 0 have none.
    scores = F.array_sort(F.array_distinct(F.transform("near", lambda x: x["score"])))
    least = lambda s: F.ceil(s.cast("decimal(38,0)") * low / 100).cast("long")
    window = lambda s: F.struct(least(s).alias("low"), F.floor(s.cast("decimal(38,0)") * high / 100).cast("long").alias("high"), least(s).alias("floor"))
    open_scores = near.select("_h1", "_h2", F.filter(scores, lambda s: s >= 0).alias("scores"))
    then = asked.drop("windows").join(open_scores, ["_h1", "_h2"]).withColumn("windows", F.transform("scores", window).cast(_WINDOWS))
    then = written(then, "windows")
    hard = best(blocks, then, index, negatives, False).join(then.select("_h1", "_h2", "scores"), ["_h1", "_h2"])
    hard = hard.select("_h1", "_h2", F.element_at("scores", F.col("w") + 1).alias("positive_score"), "best")
    each = asking.select(F.col("_id").alias("anchor_id"), "_h1", "_h2").distinct().join(near, ["_h1", "_h2"])
    others = F.slice(F.filter("near", lambda x: ~(x["own"] & (x["id"] == F.col("anchor_id")))), 1, positives)
    each = each.select("anchor_id", "_h1", "_h2", F.explode(others).alias("p")).select("anchor_id", "_h1", "_h2", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = each.join(hard, ["_h1", "_h2", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("r", "x"))
    return out.select("anchor_id", "positive_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


def _floored(x: Column) -> Column:
    """floor(256 * x) as a double, also where it is too large for a long; no negative zero."""
    big = x * SCALE
    return F.when(F.abs(big) < 2.0**52, F.floor(big).cast("double")).otherwise(big) + F.lit(0.0)
