"""A Merkle manifest of a dataset as a postorder append log.

Leaves of a tree (rows of a source by key) have numbers from 0. FANOUT consecutive nodes become one of the next level, until one is left.
A node is written as soon as its last leaf is, so the log of a tree is in postorder, and where a node stands there follows from the number
of leaves and the sizes of the subtrees alone. Builders are aligned: each task takes runs of CHUNK leaves, whose nodes are one stretch of
the log. The roots of the chunks are the leaves of the next round, so each round has CHUNK times fewer rows. Last, the roots of the trees
are the leaves of one tree over all of them.

A proof holds the siblings of a leaf at each level. The upper part of it is the same for all leaves of a chunk: it comes down from the round
above, and the lower part is read from the chunk's stretch of the log by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plateworks.llm.store import written

FANOUT = 16
#: Leaves that a builder takes at once: a power of FANOUT. A task keeps one chunk, about a megabyte.
CHUNK = FANOUT**2


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it goes into a leaf: its length in bytes of UTF-8, a colon and the value; - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def levels(n: int) -> int:
    """How many levels of nodes lie over n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def position(level: int, index: int, n: int) -> int:
    """Where node ``index`` of a level stands in the postorder log of n leaves, from 0.

    Before it stand all nodes up to its level that end where it ends or earlier, and those of higher levels that end earlier.
    """
    end = min(n, (index + 1) * FANOUT**level)
    low = sum(-(-end // FANOUT**k) for k in range(level + 1))
    high = sum((end - 1) // FANOUT**k for k in range(level + 1, levels(n) + 1))
    return low + high - 1


def build(leaves: list[str], height: int) -> list[tuple[int, int, str]]:
    """(level, index, digest) of the nodes over the leaves in order of completion, up to ``height`` levels, lone nodes of a level too.

    Each level holds the nodes that wait for their siblings.
    """
    log: list[tuple[int, int, str]] = []
    waiting: list[list[str]] = [[] for _ in range(height + 1)]
    made = [0] * (height + 1)

    def add(level: int, node: str) -> None:
        log.append((level, made[level], node))
        made[level] += 1
        waiting[level].append(node)
        if level < height and len(waiting[level]) == FANOUT:
            close(level)

    def close(level: int) -> None:
        full, waiting[level] = waiting[level], []
        add(level + 1, digest(full))

    for x in leaves:
        add(0, x)
    for level in range(height):
        if waiting[level]:
            close(level)
    return log


def numbered(leaves: DataFrame, by: str, order: list[str]) -> DataFrame:
    """leaves with _n, their number within ``by`` from 0, and _total. Rows are sorted by range; only the counts of (range, group) are summed up."""
    at = leaves.repartitionByRange(F.asc_nulls_first(by), *[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(F.asc_nulls_first(by), *[F.asc_nulls_first(c) for c in order])
    at = written(at.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "ranked")
    runs = at.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    group = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_k").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_by", "_p", "_first", before.alias("_before"), F.sum("_k").over(group).alias("_total"))
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p"))
    return at.join(runs, same).withColumn("_n", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_by", "_p", "_first", "_before")


#: A node of a log: what it is, and where it stands.
_LOG = "tree string, chunk long, total long, level int, index long, pos long, digest string"
#: A proof: at each level, the place among the siblings and the others.
_PROOF = "array<struct<place:int,others:array<string>>>"
_PROVED = "tree string, n long, proof " + _PROOF + ", subroot string"
_SAID = "_tree string, _key {key}, leaf string, subroot string, proof_sha256 string, folded_root string"


def _height(total: int) -> int:
    """Levels over the leaves of a chunk: all of a small tree's, else those of a whole chunk."""
    return levels(min(total, CHUNK))


def _top() -> Column:
    """_height of the column total."""
    return sum(((F.col("total") > FANOUT**k).cast("int") for k in range(levels(CHUNK))), F.lit(0))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _sent(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``most``."""
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def _logged(leaves: DataFrame) -> DataFrame:
    """The log of one round over (tree, n, total, digest): of each tree and chunk the nodes in order of completion."""
    dealt = leaves.withColumn("chunk", F.expr(f"n div {CHUNK}")).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "n")
    schema = _arrow(_LOG)

    def nodes(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (tree, chunk, total), leaves in groupby(rows, lambda r: r[:3]):
            for level, index, node in build([r[3] for r in leaves], _height(total)):
                i = chunk * (CHUNK // FANOUT**level) + index
                yield tree, chunk, total, level, i, position(level, i, total), node

    names = ["tree", "chunk", "total", "digest"]
    return dealt.select(*names).mapInArrow(lambda batches: _sent(nodes(_rows(batches, names)), schema, 8_192), _LOG)


class _Chunk:
    """A chunk's stretch of the log by position, and the part of its leaves' proofs that lies above it."""

    def __init__(self) -> None:
        self.nodes: dict[int, str] = {}
        self.total, self.upper, self.subroot = 0, [], None
        self.runs: dict[tuple[int, int], list[str]] = {}

    def proof(self, n: int) -> list[dict]:
        out, size = [], self.total
        for level in range(_height(self.total)):
            place, run = n % FANOUT, n // FANOUT
            if (level, run) not in self.runs:  # addressed by position, once for all that share it
                first = run * FANOUT
                self.runs[level, run] = [self.nodes[position(level, j, self.total)] for j in range(first, min(first + FANOUT, size))]
            siblings = self.runs[level, run]
            out.append({"place": place, "others": siblings[:place] + siblings[place + 1 :]})
            n, size = run, -(-size // FANOUT)
        return out + self.upper


def _walked(log: DataFrame, asked: DataFrame, above: DataFrame) -> DataFrame:
    """Of each chunk its stretch of the log, what comes from above (tree, n of the chunk, proof, subroot), and then the rows asked for."""
    own = log.select("tree", "chunk", F.lit(0).alias("side"), F.col("pos").alias("at"), "total", "digest")
    upper = above.select("tree", F.col("n").alias("chunk"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("at"), "proof", "subroot")
    rows = asked.withColumns({"chunk": F.expr(f"n div {CHUNK}"), "side": F.lit(2), "at": F.col("n")}).drop("n")
    both = own.unionByName(upper, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    return both.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "side", "at")


def _chunks(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[tuple[_Chunk, tuple]]:
    """(its chunk, (tree, n, *more)) of each row asked for."""
    now, chunk = None, _Chunk()
    for tree, c, side, at, total, node, proof, subroot, *rest in _rows(batches, ["tree", "chunk", "side", "at", "total", "digest", "proof", "subroot", *more]):
        if (tree, c) != now:
            now, chunk = (tree, c), _Chunk()
        if side == 0:
            chunk.nodes[at], chunk.total = node, total
        elif side == 1:
            chunk.upper, chunk.subroot = proof, subroot
        else:
            yield chunk, (tree, at, *rest)


class Manifest:
    """A forest's logs, round by round, all written. The roots are (tree, round, digest)."""

    def __init__(self, leaves: DataFrame, name: str):
        """leaves: (tree, n, total, digest)."""
        self.rounds: list[DataFrame] = []
        now = leaves
        while True:
            log = written(_logged(now), f"{name}-log{len(self.rounds)}")
            self.rounds.append(log)
            heads = log.where((F.col("total") > CHUNK) & (F.col("level") == levels(CHUNK)))
            now = heads.select("tree", F.col("chunk").alias("n"), F.ceil(F.col("total") / CHUNK).cast("long").alias("total"), "digest")
            if now.isEmpty():
                break

    def roots(self) -> DataFrame:
        tops = [log.where((F.col("total") <= CHUNK) & (F.col("level") == _top())).select("tree", F.lit(i).alias("round"), "digest") for i, log in enumerate(self.rounds)]
        return reduce(DataFrame.unionByName, tops)

    def above(self, over: DataFrame) -> DataFrame:
        """(tree, n, proof, subroot) of the chunks of the lowest round. ``over`` has the proofs of the trees' roots: tree, round, proof, subroot."""
        of = lambda i: over.where(F.col("round") == i).select("tree", F.lit(0).cast("long").alias("n"), "proof", "subroot")
        last = len(self.rounds) - 1
        now, schema = of(last), _arrow(_PROVED)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _sent(((tree, n, chunk.proof(n), chunk.subroot) for chunk, (tree, n) in _chunks(batches, [])), schema, 1_024)

        for i in range(last, 0, -1):
            heads = self.rounds[i].where("level = 0").select("tree", F.col("index").alias("n"))
            now = of(i - 1).unionByName(_walked(self.rounds[i], heads, now).mapInArrow(run, _PROVED))
        return now


def fold(start: str, proof: list[dict]) -> str:
    """The root that a leaf and the siblings of its proof give."""
    for step in proof:
        start = digest([*step["others"][: step["place"]], start, *step["others"][step["place"] :]])
    return start


def manifest(df: DataFrame, columns: list[str], *, tree: str, key: str, tampered: dict[str, Column] | None = None, out: str = "merkle") -> DataFrame:
    """(tree, key, ``out``): leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    A leaf is the hash of ``columns``; leaves of a tree ascend by key (null first), equal keys by their hash. ``tampered`` gives columns other
    values before a leaf is folded with the siblings of the untampered dataset; verified says whether that still gives the root.
    Nulls are values like others, also in tree and key; texts of any length are hashed whole; repeated rows are leaves each. Columns that aren't
    named are not read, whatever they are called. No rows give no rows.

    Each round of the logs is a table in the shared folder; store.release() deletes them.
    """
    bent = {c: (tampered or {}).get(c, F.col(f"`{c}`")) for c in columns}
    rows = df.select(F.col(f"`{tree}`").cast("string").alias("_tree"), F.col(f"`{key}`").alias("_key"), leaf(*[F.col(f"`{c}`") for c in columns]).alias("leaf"), leaf(*bent.values()).alias("_bent"))
    # A null tree has a name that no other has.
    named = F.coalesce(F.concat(F.lit("="), "_tree"), F.lit("-"))
    rows = rows.select("_tree", named.alias("tree"), "_key", "leaf", F.when(F.col("_bent") != F.col("leaf"), F.col("_bent")).alias("bent"))
    ranked = written(numbered(written(rows, "leaves"), "_tree", ["_key", "leaf", "bent"]).withColumnsRenamed({"_n": "n", "_total": "total"}), "numbered")
    forest = Manifest(ranked.select("tree", "n", "total", F.col("leaf").alias("digest")), "forest")
    ends = forest.roots().withColumns({"_all": F.lit(""), "_name": F.when(F.col("tree") != "-", F.col("tree"))})
    roots = written(numbered(ends, "_all", ["_name"]).withColumnsRenamed({"_n": "n", "_total": "total"}), "roots")
    top = Manifest(roots.select(F.col("_all").alias("tree"), "n", "total", "digest"), "top")
    found = top.roots().select("tree", "round", "digest").first()
    root = found["digest"] if found else ""
    none = F.lit(None).cast("string").alias("subroot")
    no_more = F.array().cast(_PROOF).alias("proof")
    chunks = top.above(top.roots().select("tree", "round", no_more, none))
    schema = _arrow("source string, round int, subroot string, proof " + _PROOF)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(((*rest, chunk.proof(n)) for chunk, (_, n, *rest) in _chunks(batches, ["source", "round", "root_of"])), schema, 1_024)

    asked = roots.select(F.col("_all").alias("tree"), "n", F.col("tree").alias("source"), "round", F.col("digest").alias("root_of"))
    proved = _walked(top.rounds[0], asked, chunks).mapInArrow(over, "source string, round int, subroot string, proof " + _PROOF)
    proved = written(proved.select(F.col("source").alias("tree"), "round", "proof", "subroot"), "over")

    said = _SAID.format(key=ranked.schema["_key"].dataType.simpleString())
    arrow = _arrow(said)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for chunk, (_, n, name, k, own, changed) in _chunks(batches, ["_tree", "_key", "leaf", "bent"]):
                proof = chunk.proof(n)
                yield name, k, own, chunk.subroot, digest([x for step in proof for x in step["others"]]), fold(changed or own, proof)

        return _sent(each(), arrow, 4_096)

    done = _walked(forest.rounds[0], ranked.select("tree", "n", "_tree", "_key", "leaf", "bent"), forest.above(proved)).mapInArrow(last, said)
    made = F.struct("leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
    return done.select(F.col("_tree").alias(tree), F.col("_key").alias(key), made.alias(out))
