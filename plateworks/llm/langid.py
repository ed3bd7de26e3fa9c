"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers which strings occur in it. A text is parsed from left to right
into the longest phrases that occur there; with c phrases, c * log2(length of the labelled text) / length of the text is the
cross entropy in bits a character. The language that needs fewest bits wins.

Labelled text is a bounded sample, so the automata are small arrays; they are built once and broadcast. Texts are whole, and so is their
parse: numpy steps through segments of all texts of a batch at once, each as if a phrase began with it. Then a segment is parsed again from
the state in which the one before ends, up to the first place at which both parses begin a phrase, from where on they agree; segments whose
entry changes by that follow, until none does.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateworks.llm import bpe
from plateworks.llm.names import fresh

#: Labelled documents taken for a language (in expectation), and characters in all that its automaton is built of, at most: each gives a piece.
DOCS, CHARS = 400, 60_000
#: Characters of all languages together, and what each has at least: these bound the model, and so do they the number of languages (30,000).
ALL_CHARS, LEAST_CHARS = 1_500_000, 50
SEGMENT = 256
#: Bytes up to which the automata of a worker are laid out as dense tables; others look their transitions up.
DENSE_BYTES = 160 << 20
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> str:
    """Lower case; every run of other characters than letters is one space."""
    points = _points(text.lower())
    keep = _letters()[points]
    first = np.append(True, keep[:-1])
    return np.where(keep, points, 32)[keep | first].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Automaton:
    """The suffix automaton of a text over the characters it has: transitions by state * symbols + code. 0 is the root, and no way leads to it."""

    def __init__(self, text: str):
        points = _points(text)
        self.size, self.points = len(points), np.unique(points)
        #: One code more stands for all characters that the text does not have.
        self.symbols = len(self.points) + 1
        link, length, ways = [-1], [0], [{}]
        last = 0
        for c in np.searchsorted(self.points, points).tolist():
            new = len(ways)
            ways.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in ways[p]:
                ways[p][c] = new
                p = link[p]
            if p != -1:
                q = ways[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(ways)
                    ways.append(dict(ways[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and ways[p].get(c) == q:
                        ways[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.states = len(ways)
        at = np.array([s * self.symbols + c for s, w in enumerate(ways) for c in w], np.int64)
        to = np.array([x for w in ways for x in w.values()], np.int32)
        order = np.argsort(at)
        self.at, self.to = at[order], to[order]

    def code(self, points: np.ndarray) -> np.ndarray:
        """Codes of characters (int32)."""
        known = np.full(int(self.points[-1]) + 2, self.symbols - 1, np.int32)
        known[self.points] = np.arange(len(self.points), dtype=np.int32)
        return known[np.minimum(points, len(known) - 1)]

    def table(self, dense: bool) -> "Steps":
        return Steps(self, dense)


class Steps:
    """Transitions of an automaton, for many states at once."""

    def __init__(self, a: Automaton, dense: bool):
        self.a, self.dense = a, dense
        if dense:
            self.all = np.zeros(a.states * a.symbols, np.int32)
            self.all[a.at] = a.to
        self.root = np.zeros(a.symbols, np.int32)
        first = a.at < a.symbols
        self.root[a.at[first]] = a.to[first]

    def __call__(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with the character): where there is no way on, and after a character that the root has no way for."""
        if self.dense:
            to = self.all.take(state * np.int32(self.a.symbols) + code)
        else:
            at = state.astype(np.int64) * self.a.symbols + code
            i = np.minimum(np.searchsorted(self.a.at, at), len(self.a.at) - 1)
            to = np.where(self.a.at[i] == at, self.a.to[i], np.int32(0))
        lost = to == 0
        np.copyto(to, self.root.take(code), where=lost)
        return to, lost | (state == 0)


def count_phrases(step: Steps, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phrases that begin in each segment of the coded characters flat. Segments come by falling size; before: the segment that goes before, or -1."""
    width = int(size[0]) if len(size) else 0
    codes = flat[np.minimum(begin[None, :] + np.arange(width)[:, None], len(flat) - 1)]
    active = np.searchsorted(-size, -np.arange(width), side="left")
    begins = np.zeros((width, len(size)), bool)
    end = np.zeros(len(size), np.int32)
    for t, m in enumerate(active.tolist()):
        end[:m], begins[t, :m] = step(end[:m], codes[t, :m])
    entry = np.zeros(len(size), np.int32)
    while True:
        now = np.where(before >= 0, end[before], 0)
        todo = np.flatnonzero(now != entry)
        if not len(todo):
            return begins.sum(axis=0)
        entry = now
        state = entry[todo]
        for t in range(width):
            state, new = step(state, codes[t, todo])
            stays = ~(new & begins[t, todo])
            begins[t, todo] = new
            done = stays & (size[todo] == t + 1)
            end[todo[done]] = state[done]
            stays &= ~done
            todo, state = todo[stays], state[stays]
            if not len(todo):
                break


class Model:
    """Automata of all languages."""

    def __init__(self, texts: dict[str, list[str]], chars: int = CHARS):
        """texts: the labelled texts of each language, already bounded."""
        whole = {lang: " ".join(folded(t) for t in many)[:chars] for lang, many in sorted(texts.items())}
        automata = {lang: Automaton(t) for lang, t in whole.items() if t.strip()}
        self.langs, self.automata = list(automata), list(automata.values())

    @functools.cached_property
    def steps(self) -> list[Steps]:
        """Dense as far as the bytes go; not sent along."""
        out, left = [], DENSE_BYTES
        for a in self.automata:
            need = 4 * a.states * a.symbols
            out.append(a.table(need <= left))
            left -= need if need <= left else 0
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "steps"}

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each folded text needs in each language: (texts, languages)."""
        each = [_points(t) for t in texts]
        lengths = np.array([len(c) for c in each], np.int64)
        segments = -(-lengths // SEGMENT)
        first = np.cumsum(segments) - segments
        owner = np.repeat(np.arange(len(texts)), segments)
        nth = np.arange(len(owner)) - np.repeat(first, segments)
        size = np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
        begin = (np.cumsum(lengths) - lengths)[owner] + nth * SEGMENT
        by_size = np.argsort(-size, kind="stable")
        place = np.empty(len(owner), np.int64)
        place[by_size] = np.arange(len(owner))
        before = np.where(nth > 0, place[np.maximum(np.arange(len(owner)) - 1, 0)], -1)[by_size]
        size, begin, owner = size[by_size], begin[by_size], owner[by_size]
        flat = np.concatenate(each) if len(owner) else np.empty(0, np.uint32)
        out = np.zeros((len(texts), len(self.langs)))
        for k, (a, step) in enumerate(zip(self.automata, self.steps, strict=True)):
            np.add.at(out[:, k], owner, count_phrases(step, a.code(flat), begin, size, before))
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score and bits a character of each text."""
        clean = [folded(t or "") for t in texts]
        c = self.phrases(clean) if self.langs else np.zeros((len(texts), 0))
        bits_each = np.log2(np.maximum([a.size for a in self.automata], 2))
        langs, scores, bits = [], [], []
        for text, need in zip(clean, c, strict=True):
            if not text.strip() or not len(need):
                langs.append(UNKNOWN), scores.append(0.0), bits.append(None)
                continue
            each = need * bits_each / len(text)
            order = np.argsort(each, kind="stable")
            second = each[order[1]] if len(order) > 1 else np.inf
            langs.append(self.langs[order[0]])
            scores.append(float(second / (each[order[0]] + second)) if np.isfinite(second) else 1.0)
            bits.append(float(each[order[0]]))
        return langs, scores, bits


def fit(labelled: DataFrame, *, key: str, text: str, lang: str, docs: int = DOCS) -> Model:
    """The model of a bounded sample: about ``docs`` documents a language by the hash of key and text, of each a piece at a place that the hash draws.

    All languages are learned, as long as each can have LEAST_CHARS of ALL_CHARS; of more (a dirty column may have any number) those with most labelled
    documents. Null languages and null texts are not sampled. The sample is the only thing that comes to the driver: at most about ALL_CHARS characters.
    """
    named = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    counts = named.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(ALL_CHARS // LEAST_CHARS).collect()
    chars = min(CHARS, ALL_CHARS // max(1, len(counts)))
    piece = max(LEAST_CHARS, chars // docs)
    # A language that has few characters gets them from few documents.
    share = lambda n: min(1_000_000, 1 + 1_000_000 * min(docs, max(1, 2 * chars // piece)) // n)
    known = labelled.sparkSession.createDataFrame([(r["l"], share(r["n"])) for r in counts], "l string, share long")  # a row a language
    drawn = named.withColumn("h", F.xxhash64(F.lit("sample"), "k", "t"))
    draw = F.pmod("h", F.lit(1_000_000))
    place = F.pmod(F.xxhash64(F.lit("place"), "h"), F.greatest(F.char_length("t") - piece + 1, F.lit(1)).cast("long")).cast("int")
    sampled = drawn.join(F.broadcast(known), "l").where(draw < F.col("share"))
    rows = sampled.select("l", F.substring("t", place + 1, F.lit(piece)).alias("t"), draw.alias("d")).orderBy("d", "t").collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r["l"], []).append(r["t"])
    return Model(texts, chars)


def predict(df: DataFrame, model: Model, *, text: str = "text", out: str = "lang_id") -> DataFrame:
    """df with a struct column ``out``: lang, score, bits.

    Whole texts are parsed, of any length. A text that is null or has no letter gets "und", score 0 and null bits, and so does every text
    if no language was learned. score is the second-best language's share of the bits of the best two (0.5 to 1; 1 if only one was learned); of equals
    the first by code point wins. Other columns, whatever their names, and repeated rows stay; a column named as out is replaced. No rows give no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # some 36 bytes for each of at most ALL_CHARS characters
    names = [c for c in df.columns if c.lower() != out.lower()]
    source = fresh("_in_", [*names, out])
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small_batches(batches, source):
            made = shared.value.classify(batch.column(source).to_pylist())
            column = pa.StructArray.from_arrays([pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), pa.array(made[2], pa.float64())], names=["lang", "score", "bits"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), column], names=[*names, out])

    return df.select(*names, F.col(text).alias(source)).mapInArrow(run, schema)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3))
