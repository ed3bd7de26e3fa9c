"""Approximate nearest neighbours by collision-counting hashing.

Vectors of one length are dealt into blocks by a hash. A block projects its unit vectors on orthogonal directions and keeps each
projection as a sorted array. Around a query's own projections windows open; virtual rehashing widens them
from radius to radius, and only what the wider rings add is counted. A vector in enough windows is a candidate and is
verified by its exact cosine. The search of a block ends at the radius within which it has verified k vectors: a vector within that
radius has been a candidate with probability RECALL at least. The last radius spans the sphere, so all vectors are verified there.

A task reads one block, indexes it once and streams all queries past it, a batch at a time; queries are what Spark sends to every block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECTIONS = 96
#: Windows at radius r are r * WIDTH wide: at three standard deviations of a neighbour's distance one collision tells most.
WIDTH = 3.0
RADII = (0.15, 0.3, 0.55, 0.8, 0.92, 1.0, 1.04, 1.08, 1.12, 1.16, 1.2, 1.25, 1.3, 1.4142135, 2.0)
RECALL = 0.85
#: Spread of the number of collisions for orthogonal directions, against independent ones (measured in 64 dimensions).
SPREAD = 0.75
#: Vectors in a block: LEAST_BLOCK, or what makes BLOCKS blocks, up to MOST_BLOCK (some 200 MB of a task).
LEAST_BLOCK, BLOCKS, MOST_BLOCK = 16_000, 256, 100_000


def threshold(m: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """Collisions that a vector at distance r has at radius r, in m projections, with that probability at least."""
    p = 2 * NormalDist().cdf(width / 2) - 1
    least = math.floor(m * p - SPREAD * NormalDist().inv_cdf(recall) * math.sqrt(m * p * (1 - p)))
    return max(1, least)


@functools.lru_cache(maxsize=8)
def directions(dim: int, m: int, seed: int) -> np.ndarray:
    """m columns in sets of at most dim orthogonal ones, each as long as a random direction is on average."""
    rng = np.random.default_rng([seed, dim, m])
    sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-m // dim))]
    return np.hstack(sets)[:, :m] * math.sqrt(dim)


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    wide = F.transform(v, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def mild(vectors: np.ndarray) -> np.ndarray:
    """The vectors, each divided by the power of 2 that brings its largest component to 0.5 or more but under 1: squares neither over- nor underflow, and cosines stay."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Block:
    """Vectors with their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int):
        vectors = mild(vectors)
        self.ids, self.vectors, self.seed = ids, vectors, seed
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        places = ((vectors / self.norm[:, None]) @ directions(vectors.shape[1], PROJECTIONS, seed)).T
        self.order = np.argsort(places, axis=1).astype(np.int32)
        self.values = np.take_along_axis(places, self.order, axis=1)
        self.verified = 0  # exact cosines so far

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end in the sorted arrays of the windows of all queries: (queries, radii, projections)."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        at = (queries / norms[:, None]) @ directions(queries.shape[1], PROJECTIONS, self.seed)
        half = np.array(RADII[:-1]) * WIDTH / 2
        low, high = (np.empty((len(queries), len(half), PROJECTIONS), np.int32) for _ in "lh")
        for j, v in enumerate(self.values):
            low[:, :, j] = v.searchsorted(at[:, j, None] - half, "left")
            high[:, :, j] = v.searchsorted(at[:, j, None] + half, "right")
        return low, high

    def nearest(self, qids: list[int], queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and cosines of the k nearest that are found for each query, nearest first; rows with its own id are passed over."""
        queries = mild(queries)
        lows, highs = (w.tolist() for w in self.windows(queries))
        for qid, query, low, high in zip(qids, queries, lows, highs, strict=True):
            yield self._nearest(qid, query, low, high, k)

    def _nearest(self, qid: int, query: np.ndarray, low: list[list[int]], high: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        n, need, qnorm = len(self.ids), threshold(), math.sqrt((query * query).sum())
        counts, seen = np.zeros(n, np.int64), self.ids == qid
        near_ids, near_cos = np.empty(0, np.int64), np.empty(0)
        for r, radius in enumerate(RADII):
            if radius >= 2:
                fresh = np.flatnonzero(~seen)
            else:
                if r:  # what the wider windows add on both sides
                    rings = [o[a:b] for o, a, b in zip(self.order, low[r], low[r - 1], strict=True)]
                    rings += [o[a:b] for o, a, b in zip(self.order, high[r - 1], high[r], strict=True)]
                else:
                    rings = [o[a:b] for o, a, b in zip(self.order, low[0], high[0], strict=True)]
                counts += np.bincount(np.concatenate(rings), minlength=n)
                fresh = np.flatnonzero((counts >= need) & ~seen)
            if len(fresh):
                seen[fresh] = True
                self.verified += len(fresh)
                # Row by row, so that equal vectors have equal cosines whatever stands beside them.
                dots = (self.vectors[fresh] * query).sum(axis=1)
                near_ids, near_cos = np.append(near_ids, self.ids[fresh]), np.append(near_cos, dots / (self.norm[fresh] * qnorm))
                best = np.lexsort((near_ids, -near_cos))[:k]
                near_ids, near_cos = near_ids[best], near_cos[best]
            if len(near_cos) >= k and 2 - 2 * near_cos[k - 1] <= radius * radius:
                break
        return near_ids, near_cos


#: Queries whose windows are looked up in one go.
BATCH = 128


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int | None = None, seed: int = 7) -> DataFrame:
    """(query_id, rank, key, score): for each query the k vectors of largest cosine that are found, all if there are fewer.

    Vectors and queries that are null, empty or zero, or hold null or non-finite components, take no part; nor do null ids.
    Only vectors of a query's length are its candidates, and not the rows with its own id. Ties go to the smaller id. Rows
    that repeat an id are candidates each; queries that repeat id and vector are one query, those that repeat an id with another vector
    are searched each for itself and give k rows each. Other columns are not read. No rows give no rows.
    """
    ok = F.col(key).isNotNull() & usable(F.col(vector))
    slim = lambda df: df.where(ok).select(F.col(key).cast("long").alias("_id"), F.size(vector).alias("_dim"), F.col(vector).cast("array<double>").alias("_v"))
    base = slim(vectors)
    asked = slim(queries).withColumn("_q", F.xxhash64("_v")).dropDuplicates(["_id", "_dim", "_q"])
    n = vectors.count()
    size = block or min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS)))
    blocks = -(-n // size) or 1
    # By id and vector, so that rows that repeat an id, or a vector, are dealt out too; a row number tells apart those that repeat both.
    deal = F.pmod(F.xxhash64(F.lit("block"), "_id", "_v", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    left = base.select(deal.alias("_block"), F.lit(0).alias("_side"), "_dim", "_id", F.lit(0).cast("long").alias("_q"), "_v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_side"), "_dim", "_id", "_q", "_v")
    # Of each block and length, first the vectors and then the queries.
    rows = left.unionByName(right).repartitionById(blocks, "_block").sortWithinPartitions("_block", "_dim", "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("_block", "_dim", "_side")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, (*group, side) = batch.slice(a, b - a), keys[a]
                if group != now:
                    now, held, index = group, [], None
                if not side:
                    held.append((part.column("_id").to_numpy(), _vectors(part.column("_v"))))
                    continue
                if not held and index is None:
                    continue  # no vectors of this length in the block
                if index is None:
                    index, held = Block(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), seed), []
                ids, qs, vs = part.column("_id").to_pylist(), part.column("_q").to_pylist(), _vectors(part.column("_v"))
                got = [x for i in range(0, len(ids), BATCH) for x in index.nearest(ids[i : i + BATCH], vs[i : i + BATCH], k)]
                out = [(i, q, *x) for i, q, x in zip(ids, qs, got, strict=True)]
                m = [len(x[2]) for x in out]
                arrays = [np.repeat([x[i] for x in out], m) for i in (0, 1)] + [np.concatenate([x[i] for x in out]) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "_q", "_id", "score"])

    found = rows.mapInArrow(run, "query_id long, _q long, _id long, score double")
    # At most k rows of each block come to a query.
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("_id").alias("i"))))
    best = found.groupBy("query_id", "_q").agg(F.slice(order, 1, k).alias("b")).select("query_id", F.posexplode("b").alias("r", "x"))
    return best.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.i").alias(key), (-F.col("x.s")).alias("score"))
