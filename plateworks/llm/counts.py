"""Token counts by overlap resynchronisation.

A huge document is cut into overlapping chunks, which Spark deals out as rows. The library encodes each chunk with offsets. A
pre-token pattern without look-behind goes on alike from any place at which two scans of the same text both begin a
pre-token. So where a pre-token begins in both of two neighbouring chunks, in their overlap and away from its ends, what the
left chunk has before that place and the right chunk from it on are the tokens of the whole text: a proven common boundary. A
document with a pair of chunks without such a place is encoded again with wider chunks and overlaps, until one chunk holds
it. Other documents are encoded as they are; white space is dropped by the tokenizer and begins a pre-token on both sides, so
the words between spaces are counted once a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateworks.llm import bpe, library
from plateworks.llm.store import checkpointed

#: Texts over this many characters are cut.
CHUNK = 16_384
OVERLAP = 512
#: Each further try is this many times as wide.
WIDER = 4
#: Common boundaries keep this many characters from both ends of the overlap: more than any look-ahead or composed character.
MARGIN = 32

_PLACES = "array<struct<at:long,before:long>>"


def boundaries(encoding, start: int, zone: tuple[int, int]) -> list[dict]:
    """Places (characters of the whole text) in zone at which a pre-token begins, with the number of the chunk's tokens before."""
    out, last = [], None
    for i, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last and zone[0] <= start + a < zone[1]:
            out.append({"at": start + a, "before": i})
        last = word
    return out


def _chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """A row for each chunk: key, _size, _hash, k, n chunks, start, part. Characters are code points."""
    step = size - overlap
    n = F.greatest(F.ceil((F.col("_size") - overlap) / step), F.lit(1)).cast("long")
    d = docs.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("k") * step
    return d.select("_key", "_size", "_bytes", "_hash", "k", "n", start.alias("start"), F.substring("_text", start + 1, F.lit(size)).alias("part"))


def _encoded(chunks: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """The chunks with their token counts and the boundaries in the overlaps on both sides."""
    kept = [f for f in chunks.schema.fields if f.name != "part"]
    places = T._parse_datatype_string(_PLACES)
    schema = T.StructType([*kept, T.StructField("total", T.LongType()), T.StructField("head", places), T.StructField("tail", places)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = library.tokenizer(path)
        for batch in bpe.small_batches(batches, "part"):
            made: dict[str, list] = {"total": [], "head": [], "tail": []}
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "start", "k", "n")), strict=True)
            for part, start, k, n in rows:
                e = t.encode(part, add_special_tokens=False)
                made["total"].append(len(e))
                head, tail = (start + MARGIN, start + overlap - MARGIN), (start + size - overlap + MARGIN, start + size - MARGIN)
                made["head"].append(boundaries(e, start, head) if k else [])
                made["tail"].append(boundaries(e, start, tail) if k < n - 1 else [])
            arrays = [*(batch.column(f.name) for f in kept), pa.array(made["total"], pa.int64())]
            kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            arrays += [pa.array(made[c], kind) for c in ("head", "tail")]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return chunks.mapInArrow(run, schema)


def _spliced(parts: DataFrame) -> DataFrame:
    """A row for each document (repeated rows again as often): _key, _size, _bytes, _hash, n_tokens (null if a pair has no common boundary)."""
    one = F.struct("k", "total", "head", "tail")
    groups = parts.groupBy("_key", "_size", "_bytes", "_hash").agg(F.array_sort(F.collect_set(one)).alias("c"), F.count_if(F.col("k") == 0).alias("m"))

    def seam(left, right):
        """What the left chunk has before the last common boundary less what the right one has before it."""
        at = F.array_max(F.array_intersect(F.transform(left.tail, lambda x: x["at"]), F.transform(right.head, lambda x: x["at"])))
        before = lambda places: F.get(F.filter(places, lambda x: x["at"] == at), F.lit(0))["before"]
        return before(left.tail) - left.total - before(right.head)

    c = F.col("c")
    seams = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda right, i: seam(c[i], right))
    whole = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.total)
    n = F.aggregate(seams, whole, lambda a, x: a + x)
    return groups.select("_key", "_size", "_bytes", "_hash", n.alias("n_tokens"), "m").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).drop("_", "m")


def count_tokens(docs: DataFrame, *, path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, splices: bool = True) -> DataFrame:
    """(key, n_bytes, n_tokens) of each whole text, as the tokenizers file at path counts without added special tokens.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows; null keys stay null. There is no limit
    on length: texts over ``chunk`` characters are cut into chunks. Other columns are not read. No rows give no rows.
    The tokenizer must drop white space, as word-end vocabularies do. Few documents fail to splice; only their
    keys and hashes, kept in the shared folder, tell what the next, wider try reads again.
    """
    if overlap <= 2 * MARGIN or chunk <= 2 * overlap:
        raise ValueError("chunks must be over twice as long as overlaps, and overlaps longer than their margins")
    value = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("_key"), value.alias("_text"), F.char_length(value).cast("long").alias("_size"), F.octet_length(value).cast("long").alias("_bytes"))
    schema = T.StructType([d.schema["_key"], T.StructField("_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library.words(path)
        for batch in bpe.small_batches(batches, "_text"):
            n = pa.array(words.count(batch.column("_text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_bytes"), n], names=schema.names)

    short = d.where(F.col("_size") <= chunk).select("_key", "_bytes", "_text").mapInArrow(whole, schema)
    long = d.where(F.col("_size") > chunk).withColumn("_hash", F.xxhash64("_text"))
    done, todo, size, lap = [short], long, chunk, overlap
    while True:
        tried = checkpointed(_spliced(_encoded(_chunks(todo, size, lap), path, size, lap)))
        done.append(tried.where(F.col("n_tokens").isNotNull()).select("_key", "_bytes", "n_tokens"))
        failed = tried.where(F.col("n_tokens").isNull()).select("_key", "_hash").distinct()
        if failed.isEmpty():
            break
        same = F.col("t._key").eqNullSafe(F.col("f._key")) & (F.col("t._hash") == F.col("f._hash"))
        todo = todo.alias("t").join(failed.alias("f"), same, "left_semi")
        size, lap = size * WIDER, lap * WIDER
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("_key").alias(key), F.col("_bytes").alias("n_bytes"), "n_tokens")
