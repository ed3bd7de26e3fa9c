"""Token ids in files of fixed-width bit-packed blocks.

Documents are range-sorted by key; each partition writes its blocks in order. A block is one row of a Parquet folder (so that
any store Spark writes to will do, and a lost task writes its part again): every id takes the fewest bits that the vocabulary
needs, 64 ids fill that many 64-bit little-endian words, and the block tells where each of its documents ends. Reading
unpacks whole columns of words with numpy, or only the words of one document.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateworks.llm import bpe, library
from plateworks.llm.store import shared_dir

#: A block is closed when it holds this many ids; a document is never cut.
BLOCK_IDS = 1 << 18
#: Entries of a worker's memo of pre-tokens; there is one worker a task here, so it may hold more than where others work beside it.
MEMO = 600_000
_GROUP = 64


def width(vocabulary: int) -> int:
    """Bits that an id of a vocabulary of that size needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, each in bits bits; the last group of 64 is filled up with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id over {bits} bits: {ids.max()}")
    groups = np.zeros((-(-len(ids) // _GROUP), _GROUP), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), bits), np.uint64)
    for j in range(_GROUP):
        word, low = divmod(j * bits, 64)
        words[:, word] |= groups[:, j] << np.uint64(low)
        if low + bits > 64:
            words[:, word + 1] |= groups[:, j] >> np.uint64(64 - low)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids begin to end (uint32) of a packed block; only their words are read."""
    first, last = begin // _GROUP, -(-end // _GROUP)
    words = np.frombuffer(data, "<u8", (last - first) * bits, first * bits * 8).reshape(-1, bits)
    groups, mask = np.empty((len(words), _GROUP), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(_GROUP):
        word, low = divmod(j * bits, 64)
        got = words[:, word] >> np.uint64(low)
        if low + bits > 64:
            got = got | (words[:, word + 1] << np.uint64(64 - low))
        groups[:, j] = got & mask
    return groups.reshape(-1)[begin - first * _GROUP : end - first * _GROUP]


def byte_characters() -> dict[int, int]:
    """Code points by which byte-level files write bytes: printable ones of Latin-1 stand for themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as the tokenizers library gives them.

    A byte-level file that cuts texts by the usual pattern and has no normalizer encodes each pre-token apart, so that a
    memo of pre-tokens saves most calls. Texts that hold an added token, and other files, go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = library.tokenizer(path)
        rules = json.loads(self.tokenizer.to_str())
        cut = rules["pre_tokenizer"] or {}
        self.apart = rules["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.added = [x["content"] for x in rules["added_tokens"]]
        self.chars = byte_characters()
        self.memo = bpe.Memo(public_tokenizers.PATTERN, self.pretokens, MEMO)

    def whole(self, text: str) -> bytes:
        return bpe.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pretokens(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens, by the library's model alone: it takes the bytes as the characters of byte-level files."""
        cut, chars = self.tokenizer.model.tokenize, self.chars
        return [bpe.packed([x.id for x in cut((p if p.isascii() else p.encode().decode("latin-1")).translate(chars))]) for p in pieces]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none for null."""
        whole = np.ones(len(texts), bool)
        if self.apart:
            whole[:] = False
            for a in self.added:
                whole |= pc.fill_null(pc.match_substring(texts, a), False).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.frombuffer(self.whole(texts[i].as_py() or ""), np.int32) if w else None for i, w in enumerate(whole)]
        for i, ids in zip(np.flatnonzero(~whole), self.memo.encode(texts.filter(pa.array(~whole))), strict=True):
            out[i] = ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_packed(docs: DataFrame, folder: str, *, path: str, end_id: int | None, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> str:
    """Writes the ids of all texts in ascending order of the key to a new folder, and returns the folder.

    Null and empty texts give no ids but the end id (none if that is None). Null keys come first; rows that share a key are
    ordered by the hash of their text, and repeated rows are written as often as they are there. Other columns are not read.
    No rows give a folder without blocks. Blocks: part, seq (their order), first (ids before it in its part), n_ids, bits,
    keys, ends (of each document in the block), low and high (least and greatest key, for pruning), data.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("_key"), value.alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    # Rows that repeat key and text may go to any partition between their neighbours: a number of the row lets the range split them.
    at = ["_key", "_hash", "_row"]
    d = d.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*at).sortWithinPartitions(*at).select("_key", "_text")
    kind = d.schema["_key"].dataType
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("seq", T.LongType()), ("first", T.LongType()), ("n_ids", T.LongType()), ("bits", T.IntegerType()), ("keys", T.ArrayType(kind)), ("ends", T.ArrayType(T.LongType())), ("low", kind), ("high", kind), ("data", T.BinaryType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        bits = width(max(e.tokenizer.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1))
        last = np.array([] if end_id is None else [end_id], np.int32)
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        ends: list[int] = []
        keys: list[pa.Array] = []

        def block(kind: pa.DataType) -> pa.RecordBatch:
            k = pa.concat_arrays(keys)
            data = pack(np.concatenate(ids).astype(np.uint32), bits)
            rows = [[part], [seq], [before], [held], [bits], None, [ends], None, None, [data]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), None, pa.list_(pa.int64()), None, None, pa.binary()]
            arrays = [None if t is None else pa.array(v, t) for v, t in zip(rows, types, strict=True)]
            arrays[5] = pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k)
            arrays[7], arrays[8] = k.slice(0, 1), k.slice(len(k) - 1, 1)
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in bpe.small_batches(batches, "_text"):
            own, texts = batch.column("_key"), batch.column("_text")
            begin = 0
            for i, got in enumerate(e.encode(texts)):
                ids += (got, last)
                held += len(got) + len(last)
                ends.append(held)
                if held >= block_ids:
                    keys.append(own.slice(begin, i + 1 - begin))
                    yield block(own.type)
                    begin, seq, before, held = i + 1, seq + 1, before + held, 0
                    ids, ends, keys = [], [], []
            if begin < len(texts):
                keys.append(own.slice(begin))
        if ends:
            yield block(keys[0].type)

    target = f"{folder.rstrip('/')}/packed-{uuid.uuid4().hex}"
    d.mapInArrow(run, schema).write.parquet(target)
    return target


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a folder with ``start``: the number of ids in all blocks before."""
    blocks = spark.read.parquet(folder)
    # One row for each written part, so a bounded table whatever the number of documents.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return blocks.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + F.col("first")).drop("_before")


def read_packed(spark: SparkSession, folder: str, *, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """A row for each document of a folder: key, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids."""
    blocks = read_blocks(spark, folder).select("bits", "start", "keys", "ends", "data")
    kind = blocks.schema["keys"].dataType.elementType
    fields = [T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bits, start, data = (batch.column(c)[i].as_py() for c in ("bits", "start", "data"))
                keys, ends = batch.column("keys")[i].values, batch.column("ends")[i].values.to_numpy()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                all_ids = unpack(data, bits, 0, int(ends[-1])).astype("<u4")
                crc = [zlib.crc32(all_ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                arrays = [keys, pa.array(start + begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1]).astype(np.int32)), pa.array(all_ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return blocks.mapInArrow(run, schema)


def fetch(spark: SparkSession, folder: str, wanted: int, *, key: str = "doc_id") -> DataFrame:
    """Random access: (key, ids) of the documents with one key. Parquet skips blocks by low and high; only the words of the document are unpacked."""
    blocks = read_blocks(spark, folder).where((F.col("low").isNull() | (F.col("low") <= wanted)) & (F.col("high") >= wanted)).select("bits", "keys", "ends", "data")
    schema = T.StructType([T.StructField(key, blocks.schema["keys"].dataType.elementType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begins = [0, *row["ends"]]
                for k, a, b in zip(row["keys"], begins, row["ends"], strict=False):
                    if k == wanted:
                        got = unpack(row["data"], row["bits"], a, b).astype(np.int32)
                        yield pa.RecordBatch.from_pylist([{key: k, "ids": got.tolist()}], schema=pa.schema([(key, batch.schema.field("keys").type.value_type), ("ids", pa.list_(pa.int32()))]))

    return blocks.mapInArrow(run, schema)


def folder_for(spark: SparkSession) -> str:
    """The shared folder, for callers that name none."""
    return shared_dir(spark)
