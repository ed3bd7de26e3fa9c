"""N-gram Jaccard join by chosen paths.

A document is the set of its word n-grams; documents with the same set are one class member. Every set is embedded by
minhashes. A run splits all sets recursively: at a node, each coordinate is chosen with probability 1 / (LEAST * coordinates),
by a hash of the path so far, and a set goes on under its own value there, so that sets which share sampled tokens stay
together and a pair at similarity LEAST shares one child in expectation. After DEPTH levels the nodes are buckets. Runs are
repeated until a pair at LEAST has met in one with probability RECALL. Since a path depends on nothing but the set, all runs are
one pass over the texts and one shuffle of (path, set).

Buckets with one set go. In the others, cut into blocks where they are large, all minhashes are compared, and a spanning forest of what
looks similar is kept: a row for a set and bucket, never a row for a pair. Its components are candidate groups, within which,
again in blocks, all n-grams are compared exactly. Likenesses can chain, so a group of over LARGE sets (templated pages that each look like the next)
is not compared whole but bucket by bucket; a pair counts in the least bucket that both are in. A task holds two blocks. Results are a set's
links, counted, and a spanning forest of the links, whose components are the classes.

Sets have names of 128 bits. What is sent for the exact comparison is one text for each set, which is smaller than its n-gram hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateworks.llm import bpe
from plateworks.llm.components import components
from plateworks.llm.names import packed, restored
from plateworks.llm.store import checkpointed, written

N, LEAST, RECALL = 5, 0.8, 0.999
COORDINATES, DEPTH = 64, 3
#: Sets in a block of a large bucket or candidate group, on average.
BLOCK = 400
#: Sets in a candidate group up to which it is compared whole, each text being sent once for each of its at most 16 blocks.
LARGE = 16 * BLOCK

_U = np.uint64
_RNG = np.random.default_rng(20_011)
_FLIP = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def runs(least: float = LEAST, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs after which a pair at the least similarity has met in one: the chance to share a node is that of a branching process with one child in expectation."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of all words if there are fewer; none if there are none.

    Words stand between characters 9 to 13 and 32, as they are.
    """
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def minhashes(grams: np.ndarray) -> np.ndarray:
    """COORDINATES minhashes (uint32) of a set."""
    low = (grams >> _U(32)).astype(np.uint32)
    out = np.full(COORDINATES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 2048):
        part = (low[at : at + 2048, None] ^ _FLIP) * _TIMES
        np.minimum(out, part.min(axis=0), out=out)
    return out


def paths(signatures: np.ndarray, repeats: int, depth: int = DEPTH, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, path) of all leaves of all runs."""
    share = _U(int((1 << 64) / (least * COORDINATES)) - 1)
    owner = np.repeat(np.arange(len(signatures)), repeats)
    node = np.tile(_mix(np.arange(1, repeats + 1, dtype=np.uint64)), len(signatures))
    wide = signatures.astype(np.uint64)
    for _ in range(depth):
        parts = []
        for at in range(0, len(owner), 1 << 15):
            o, v = owner[at : at + (1 << 15)], node[at : at + (1 << 15)]
            i, c = np.nonzero(_mix(v[:, None] ^ _SALT) <= share)
            parts.append((o[i], _mix(v[i] + _SALT[c] + _mix(wide[o[i], c]))))
        owner, node = (np.concatenate([p[k] for p in parts]) if parts else x for k, x in enumerate((owner, node)))
    return owner, node


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order].view(np.int64)))


def embedded(docs: DataFrame, *, n: int, least: float) -> DataFrame:
    """docs (_key, _text, _hash) as (_key, _hash, _set, _n, _sig, _paths). _set is null where there are no words."""
    repeats = runs(least)
    key = docs.schema["_key"]
    schema = T.StructType([key, T.StructField("_hash", T.LongType()), T.StructField("_set", T.BinaryType()), T.StructField("_n", T.LongType()), T.StructField("_sig", T.BinaryType()), T.StructField("_paths", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in bpe.small_batches(batches, "_text"):
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                sets = [ngrams(t, n) for t in batch.column("_text").to_pylist()]
                names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = np.array([minhashes(s) for s in sets], np.uint32).reshape(-1, COORDINATES)
                full = np.flatnonzero([len(s) > 0 for s in sets])
                owner, node = paths(sigs[full], repeats, least=least)
                short = (sigs & np.uint32(0xFFFF)).astype(np.uint16)
                arrays = [batch.column("_key"), batch.column("_hash"), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in short], pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, _lists(full[owner] if len(full) else owner, node, len(sets))], names=schema.names)

    return docs.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with the same keys, of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield last, held
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield last, held


def forest(n: int, rows: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """The least index of the component of each of n items; rows gives (i, linked items after i)."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, linked in rows:
        for j in linked.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], dtype=np.int64)


def blocked(rows: DataFrame, key: str, size: str, block: int = BLOCK) -> DataFrame:
    """rows with _a, _b and _side: each pair of blocks of a key with ``size`` rows is one task's group, bounded by two blocks."""
    g = F.greatest(F.ceil(F.col(size) / block), F.lit(1)).cast("int")
    r = rows.withColumn("_g", g).withColumn("_side", F.pmod(F.xxhash64(F.lit("block"), "_set"), F.col("_g")).cast("int"))
    r = r.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    r = r.withColumn("_a", F.least("_side", "_other")).withColumn("_b", F.greatest("_side", "_other")).drop("_g", "_other")
    return r.repartition(key, "_a", "_b").sortWithinPartitions(key, "_a", "_b", "_set")


def _meets(sides: np.ndarray, a: int, b: int, i: int) -> np.ndarray:
    """Which rows after i are compared with i: those of the other block, or all if there is but one."""
    return np.ones(len(sides) - i - 1, bool) if a == b else sides[i + 1 :] != sides[i]


def _looking_alike(rows: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) of a spanning forest in each bucket of what looks similar. rows: (_path, _a, _b, _side, _set, _n, _sig)."""
    need = math.ceil(COORDINATES * (least - 3.5 * math.sqrt(least * (1 - least) / COORDINATES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), parts in groups(batches, ["_path", "_a", "_b"]):
            t = pa.Table.from_batches(parts)
            if t.num_rows < 2:
                continue
            sets, n, sides = (t.column(c).to_numpy() for c in ("_set", "_n", "_side"))
            sig = np.frombuffer(b"".join(t.column("_sig").to_pylist()), np.uint16).reshape(-1, COORDINATES)

            def linked() -> Iterator[tuple[int, np.ndarray]]:
                for i in range(len(sets) - 1):
                    same = (sig[i + 1 :] == sig[i]).sum(axis=1) >= need
                    near = np.minimum(n[i + 1 :], n[i]) >= least * np.maximum(n[i + 1 :], n[i])
                    yield i, i + 1 + np.flatnonzero(same & near & _meets(sides, a, b, i))

            root = forest(len(sets), linked())
            child = np.flatnonzero(root != np.arange(len(root)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(sets[child], pa.binary()), pa.array(sets[root[child]], pa.binary())], names=["u", "v"])

    return rows.mapInArrow(run, "u binary, v binary")


def _exactly(rows: DataFrame, by: str, n: int, least: float) -> DataFrame:
    """(_set, _root, _links) for each block pair of a candidate group, named by ``by``: links (documents) found there and the root of a spanning forest.

    If by is a bucket, a link counts in the least bucket of those (_paths) that both sets are in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (here, a, b), parts in groups(batches, [by, "_a", "_b"]):
            t = pa.Table.from_batches(parts)
            sets, first = np.unique(t.column("_set").to_numpy(), return_index=True)
            buckets = [set(x) for x in t.column("_paths").take(pa.array(first)).to_pylist()] if by == "_path" else None
            sides, copies = (t.column(c).to_numpy()[first] for c in ("_side", "_copies"))
            texts = t.column("_text")
            grams = [ngrams(texts[int(i)].as_py(), n) for i in first]
            sizes = np.array([len(g) for g in grams])
            values, inverse, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            shared = np.cumsum(count > 1) - 1  # n-grams of one set only are in no intersection
            bits = np.zeros((len(sets), -(-int((count > 1).sum()) // 64) or 1), np.uint64)
            for i, own in enumerate(np.split(inverse, np.cumsum(sizes)[:-1])):
                at = shared[own[count[own] > 1]]
                np.bitwise_or.at(bits[i], at // 64, _U(1) << (at % 64).astype(np.uint64))
            links = np.zeros(len(sets), np.int64)

            def linked() -> Iterator[tuple[int, np.ndarray]]:
                for i in range(len(sets) - 1):
                    j = i + 1 + np.flatnonzero(_meets(sides, a, b, i) & (np.minimum(sizes[i + 1 :], sizes[i]) >= least * np.maximum(sizes[i + 1 :], sizes[i])))
                    if not len(j):
                        continue
                    both = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
                    j = j[both >= least * (sizes[j] + sizes[i] - both) - 1e-9]
                    if buckets is not None:
                        j = np.array([x for x in j.tolist() if min(buckets[x] & buckets[i]) == here], np.int64)
                        if not len(j):
                            continue
                    links[i] += copies[j].sum()
                    links[j] += copies[i]
                    yield i, j

            root = forest(len(sets), linked())
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(sets[root], pa.binary()), pa.array(links)], names=["_set", "_root", "_links"])

    return rows.mapInArrow(run, "_set binary, _root binary, _links long")


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = N, least: float = LEAST) -> DataFrame:
    """(key, _hash, class_id, n_links, is_kept) for each row: the class of its document and how many documents link to it.

    Documents link if the Jaccard similarity of their sets of n-word runs is at least ``least``; copies (equal sets) do. Classes are the
    connected components of the links. class_id is the least key of the class (null if all its keys are null), n_links the number of other
    rows linked to the row, is_kept whether it is the one to keep: the least key, then the least hash of the text (_hash, xxhash64). Rows that
    repeat key and text are all marked then. Texts shorter than n words are one run; null, empty and blank texts have no run, link to none and
    are each a class of their own. Null keys are documents without a name. Other columns are not read. No rows give no rows.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("_key"), value.alias("_text"), F.xxhash64(value).alias("_hash"))
    made = written(embedded(slim, n=n, least=least), "sets")
    named = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_hash").alias("hash"))
    sets = written(made.where("_set is not null").groupBy("_set").agg(F.count("*").alias("_copies"), F.min(named).alias("_least")), "copies")

    leaves = made.where("_set is not null").select("_set", F.explode("_paths").alias("_path")).distinct()
    busy = leaves.groupBy("_path").agg(F.count("*").alias("_size")).where("_size > 1")
    known = made.where("_set is not null").select("_set", "_n", "_sig").dropDuplicates(["_set"])
    buckets = leaves.join(busy, "_path").join(known, "_set")
    alike = checkpointed(_looking_alike(blocked(buckets, "_path", "_size"), least).distinct())

    candidates = checkpointed(components(alike).withColumnRenamed("v", "_set").withColumnRenamed("root", "_root"))
    size = candidates.groupBy("_root").agg(F.count("*").alias("_size"))
    asked = candidates.join(size, "_root").join(sets, "_set").select("_set", "_root", "_size", "_copies", F.col("_least.key").alias("_key"), F.col("_least.hash").alias("_hash"))
    same = F.col("d._key").eqNullSafe(F.col("a._key")) & (F.col("d._hash") == F.col("a._hash"))
    # Rows that repeat key and text are one.
    texts = slim.alias("d").join(asked.alias("a"), same).select("_set", "_root", "_size", "_copies", "_text").dropDuplicates(["_set"])
    whole = F.col("_size") <= LARGE
    found = _exactly(blocked(texts.where(whole), "_root", "_size"), "_root", n, least)
    if not size.where(~whole).isEmpty():
        large = written(texts.where(~whole).select("_set", "_copies", "_text"), "large-groups")
        mine = written(leaves.join(busy, "_path").join(large.select("_set"), "_set", "left_semi"), "large-buckets")
        both = mine.join(mine.groupBy("_set").agg(F.collect_set("_path").alias("_paths")), "_set").join(large, "_set")
        found = found.unionByName(_exactly(blocked(both, "_path", "_size"), "_path", n, least))
    found = written(found, "links")

    roots = components(found.select(F.col("_set").alias("u"), F.col("_root").alias("v"))).withColumnRenamed("v", "_set").withColumnRenamed("root", "_class")
    links = found.groupBy("_set").agg(F.sum("_links").alias("_links"))
    by_set = sets.join(roots, "_set", "left").join(links, "_set", "left").withColumn("_class", F.coalesce("_class", "_set"))
    least_of = by_set.groupBy("_class").agg(F.min("_least").alias("_rep"))
    told = by_set.join(least_of, "_class").select("_set", "_rep", (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"))
    rows = made.select("_key", "_hash", "_set").join(told, "_set", "left")
    alone = F.col("_set").isNull()
    kept = alone | (F.col("_key").eqNullSafe(F.col("_rep.key")) & (F.col("_hash") == F.col("_rep.hash")))
    return rows.select(
        F.col("_key").alias(key),
        "_hash",
        F.when(alone, F.col("_key")).otherwise(F.col("_rep.key")).alias("class_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        kept.alias("is_kept"),
    )


def distinct_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = N, least: float = LEAST) -> DataFrame:
    """One document of each class, with all columns of docs, whatever their names; of rows that repeat key and text, one. Blank documents stay."""
    marks = join(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), key="_k", text="_t", n=n, least=least)
    marks = marks.where("is_kept").select(F.col("_k").alias("_k2"), F.col("_hash").alias("_h2")).distinct()
    d = packed(docs, _k=F.col(key), _h=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    # Kept first, so that only what stays is sent to be told apart.
    d = d.join(marks, d["_k"].eqNullSafe(marks["_k2"]) & (d["_h"] == marks["_h2"]), "left_semi").dropDuplicates(["_k", "_h"])
    return d.select(*[c for _, c in restored(docs.columns)])
