"""Byte-level BPE encoding and decoding by a rank file.

Two tiers resolve a pre-token. A minimal perfect hash answers at once if its bytes are a vocabulary entry. If not, a heap of
neighbouring pairs merges a linked list of its bytes, lowest rank first, leftmost first among equals. The ranks of pairs come
from the same hash. Both run inside Arrow batches that Spark deals out; a worker keeps what it has resolved in a bounded memo.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plateworks.llm.names import fresh

#: Entries at which a worker's memo of pre-tokens and runs of them starts anew, while the last one is kept to ask (about 200 bytes each).
MEMO = 300_000
#: The same for candidates for a merge; few are frequent.
CANDIDATES = 60_000
#: Texts of this many bytes make a batch at most (one text always fits).
BATCH_BYTES = 3 << 20
_MIX = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings to their ranks: displacements by bucket, one slot a key, none free."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(1, len(ranks))
        self.n, self.buckets = n, n // 2 + 1
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.ranks = [-1] * n
        groups: dict[int, list[bytes]] = {}
        for key in ranks:
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        free = iter(range(n))
        for b, keys in sorted(groups.items(), key=lambda kv: (-len(kv[1]), kv[0])):
            if len(keys) == 1:  # a lone key takes the next free slot, written as a negative displacement
                slot = next(s for s in free if self.keys[s] is None)
                self.shift[b] = -slot - 1
                self._put(slot, keys[0], ranks)
                continue
            hashes, d = [xxhash.xxh3_64_intdigest(k) for k in keys], 0
            while True:
                d += 1
                slots = {self._slot(h, d) for h in hashes}
                if len(slots) == len(keys) and all(self.keys[s] is None for s in slots):
                    break
            self.shift[b] = d
            for k, h in zip(keys, hashes, strict=True):
                self._put(self._slot(h, d), k, ranks)

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & _MIX) >> 20) % self.n

    def _put(self, slot: int, key: bytes, ranks: dict[bytes, int]) -> None:
        self.keys[slot], self.ranks[slot] = key, ranks[key]

    def get(self, key: bytes) -> int:
        """The rank of key, or -1 if it is no entry."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.ranks[slot] if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, rank) -> list[int]:
    """Ids of a piece that is no entry itself. rank(bytes) gives a rank or -1."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at i; 0 once it is merged into the one before
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, stop = pop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank(piece[i : end[stop]])) >= 0:
                push(heap, (r, i, end[stop]))
        j = before[i]
        if j >= 0 and (r := rank(piece[j:stop])) >= 0:
            push(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        if (r := rank(piece[i : end[i]])) < 0:
            raise ValueError(f"the vocabulary lacks the byte {piece[i : end[i]]!r}")
        out.append(r)
        i = end[i]
    return out


class Ranks(dict):
    """What the hash said of each candidate so far."""

    def __init__(self, hashed: PerfectHash):
        self.hashed = hashed

    def __missing__(self, key: bytes) -> int:
        if len(self) > CANDIDATES:
            self.clear()
        self[key] = found = self.hashed.get(key)
        return found


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encoder of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.hash = PerfectHash(read_ranks(path))
        self.rank = Ranks(self.hash).__getitem__
        self.memo = Memo(pattern, self.pretokens, MEMO)

    def pretokens(self, pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            raw = piece.encode()
            r = self.hash.get(raw)
            out.append(packed([r] if r >= 0 else merge_bytes(raw, self.rank)))
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return self.memo.encode(texts)


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit integers: what the memo holds, at a fraction of a tuple's memory."""
    return array.array("i", ids).tobytes()


#: A space beside another white space character, at an end, or a zero character: there the text is matched as a whole.
_SPACES = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WIDE = rf"[{_SPACES}] | [{_SPACES}]|\x00|^ | $"


class Memo:
    """Packed ids of pre-tokens and of what stands between spaces, for whole batches of texts.

    resolve gives the packed ids of a list of pre-tokens. In a text without double white space a single space begins a
    pre-token whatever stands around it, so that what lies between two spaces is looked up as one run, once a batch; Arrow
    cuts the texts and finds the distinct runs, numpy lays out their ids. Other texts go match by match.
    """

    def __init__(self, pattern: str, resolve: Callable[[list[str]], list[bytes]], most: int):
        self.find, self.resolve, self.most = regex.compile(pattern).findall, resolve, most
        self.usual = pattern == public_tokenizers.PATTERN
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def lookup(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct runs. For the usual pattern, a space and letters are one match, and a sign behind them another."""
        if len(self.known) > self.most:  # what is not asked for again before the next time goes
            self.known, self.older = {}, self.known
        known, older, find = self.known, self.older, self.find
        new = [r for r in words if r not in known]
        if older:
            known.update((r, older[r]) for r in new if r in older)
            new = [r for r in new if r not in known]
        lacking: list[str] = []
        several: list[tuple[str, list[str]]] = []
        for r in new:
            if self.usual and r[:1] == " ":
                if r[1:].isalpha():
                    lacking.append(r)
                    continue
                if r[-1] in ".,!?;:" and r[1:-1].isalpha():
                    several.append((r, [r[:-1], r[-1]]))
                    continue
            parts = find(r)
            if len(parts) == 1:
                lacking.append(parts[0])
            if len(parts) != 1 or parts[0] != r:
                several.append((r, parts))
        lacking = list({*lacking, *(p for _, parts in several for p in parts if p not in known)})
        known.update(zip(lacking, self.resolve(lacking), strict=True))
        for r, parts in several:
            known[r] = b"".join([known[p] for p in parts])
        return [known[r] for r in words]

    def laid_out(self, lists: pa.ListArray) -> list[np.ndarray]:
        """Ids of each list of runs."""
        coded = lists.flatten().dictionary_encode()
        packed, index = self.lookup(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids, begins = np.frombuffer(b"".join(packed), np.int32), np.cumsum(lengths) - lengths
        n = lengths[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.arange(ends[-1]) + np.repeat(begins[index] - ends[:-1], n)]
        at = lists.offsets.to_numpy()
        return np.split(flat, ends[at[1:-1] - at[0]])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (int32) of each text, each match of the pattern apart; none for null."""
        texts = pc.fill_null(texts, "")
        wide = pc.match_substring_regex(texts, _WIDE)
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        for mask, cut in ((pc.invert(wide), self.between_spaces), (wide, self.matches)):
            own = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            if len(own):
                for i, ids in zip(own, self.laid_out(cut(texts.filter(mask))), strict=True):
                    out[i] = ids
        return out

    def between_spaces(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")

    def matches(self, texts: pa.Array) -> pa.ListArray:
        return pa.array([self.find(t) for t in texts.to_pylist()], pa.list_(pa.string()))


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(path, pattern)


@functools.lru_cache(maxsize=4)
def entries(path: str) -> list[bytes]:
    """The bytes of each id; decoding needs nothing else."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for key, r in ranks.items():
        out[r] = key
    return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_BYTES of the column, or of one row."""
    for batch in batches:
        values = batch.column(column)
        at = 0
        n = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + BATCH_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _with(df: DataFrame, column: str, outs: dict[str, T.DataType], make: Callable[[pa.Array], list[pa.Array]], keep: bool) -> DataFrame:
    """df with the columns outs, made from an Arrow array of the column by make; without the column, unless it is kept."""
    taken = {o.lower() for o in outs}
    names = [c for c in df.columns if c.lower() not in taken and (keep or c != column)]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(n, t) for n, t in outs.items()])
    # The column goes in under a name of its own, so that an existing column named as one of outs does not matter.
    inner = fresh("_in_", [*names, *outs])
    source = df.select(*names, df[column].alias(inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, inner):
            made = make(batch.column(inner))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *outs])

    return source.mapInArrow(run, schema)


def _encoded(path: str, pattern: str, texts: pa.Array) -> pa.ListArray:
    each = encoder(path, pattern).encode(texts)
    ends = np.cumsum([0, *map(len, each)], dtype=np.int64)
    flat = np.concatenate(each) if each else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _decoded(path: str, ids: pa.ListArray) -> pa.Array:
    of = entries(path).__getitem__
    flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    null = ids.is_null().to_pylist()
    each = [b"" if none else b"".join(map(of, flat[a:b].tolist())) for none, a, b in zip(null, ends[:-1], ends[1:], strict=True)]
    return pa.array(each, pa.binary())


_IDS, _BYTES = T.ArrayType(T.IntegerType()), T.BinaryType()


def encode(df: DataFrame, *, path: str, pattern: str, text: str = "text", out: str = "ids", keep: bool = True) -> DataFrame:
    """df with the column out: the ids (array<int>) of each whole text. Without keep the texts go, and stay out of the workers' output.

    Null and empty texts give an empty array, texts without any match too. There is no limit on length; a text is encoded in
    memory in about 10 times its bytes. An existing column named as out is replaced. Repeated rows stay. No rows give no rows.
    """
    return _with(df, text, {out: _IDS}, lambda texts: [_encoded(path, pattern, texts)], keep)


def decode(df: DataFrame, *, path: str, ids: str = "ids", out: str = "decoded", keep: bool = True) -> DataFrame:
    """df with the column out: the bytes of each list of ids. Null ids give no bytes; an id that is no entry is an error."""
    return _with(df, ids, {out: _BYTES}, lambda lists: [_decoded(path, lists)], keep)


def round_trip(df: DataFrame, *, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: bool = False) -> DataFrame:
    """What encode() and then decode() give, in one pass and one worker: the bytes are decoded from the ids, batch by batch."""

    def make(texts: pa.Array) -> list[pa.Array]:
        lists = _encoded(path, pattern, texts)
        return [lists, _decoded(path, lists)]

    return _with(df, text, {ids: _IDS, decoded: _BYTES}, make, keep)
