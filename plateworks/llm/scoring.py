"""Language-model scores of texts: word counts of the whole corpus as a base, and a causal self-attention model on subword ids.

Words are what stands between ASCII white space, with A-Z in lower case; a text is its words and an end. The subword ids of a word are
those of the word behind a space. All training texts are counted: words for the base, their ids for the model's symbols, its biases and the
shares inside the rare symbol, pairs of symbols for their classes. All training texts are learned from whole: a text is in one turn, the
tasks of a turn go through its texts from the same weights, each symbol is predicted once, and the weights that they end with are
averaged for the next turn. The first turn is small and one task's, for tasks that begin apart would not agree.

Texts are encoded once, in Arrow batches, and written as symbols. What is frequent is known to every task (at most HEAVY words); the other
words of a text stay beside it as a list, which a join with the counts resolves. No frequent word is in that join, so none of its keys is hot.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateworks.llm import bpe
from plateworks.llm.attention import BATCH, CLASSES, RATE, STEPS, SYMBOLS, Attention, alike
from plateworks.llm.names import packed, restored
from plateworks.llm.store import written

#: Words that every task knows the counts of, at most.
HEAVY = 100_000
#: Symbols of the first turn (in expectation), which one task learns from; if there are less than twice as many, all texts are in it.
FIRST = 3_000_000
#: The turns after the first: which part of the texts that are left each takes, and the rates of its steps.
TURNS = ((0.25, 0.004), (1.0, 0.002))
#: Symbols that a task brings in random order at once, windows of a step in turns after the first, and tasks that add up what the tasks of a turn end with.
CHUNK, MANY, ADDERS = 1_000_000, 256, 16
#: Different words that a task counts before it hands them on.
COUNTED = 400_000
#: Characters that are encoded at once of a longer word.
LONG = 1_000
#: The end of a text, among words and among symbols; the symbol of all ids that have none of their own.
END, END_SYMBOL, RARE = "", 0, 1
#: White space that is not ASCII, which could join the space before the next word, and control characters that count as such.
_ODD = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 7."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7))


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for entry, rank in ranks.items():
        sizes[rank] = len(entry)
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def word_ids(words: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of all words in a row, each word behind a space, and how many each has. Words over LONG characters are encoded in pieces of that length.

    Plain words are encoded in one text; as each brings its own space, no id goes over from one to the next.
    """
    library, entry = _tokenizer(path, pattern)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    odd = pc.or_(pc.greater(pc.utf8_length(words), LONG), pc.match_substring_regex(words, _ODD)).to_numpy(zero_copy_only=False)
    plain = words.filter(pa.array(~odd))
    sizes = np.zeros(len(words), np.int64)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
    flat = np.array(library.encode_ordinary(" " + text), np.int64) if len(plain) else np.empty(0, np.int64)
    ends = np.searchsorted(np.cumsum(entry[flat]), np.cumsum(pc.binary_length(plain).to_numpy().astype(np.int64) + 1), side="right")
    sizes[~odd] = np.diff(ends, prepend=0)
    at = np.flatnonzero(odd)
    if len(at):
        begin, more = np.cumsum(sizes) - sizes, []
        for i, word in zip(at.tolist(), words.take(pa.array(at)).to_pylist(), strict=True):
            more.append([x for a in range(0, len(word), LONG) for x in library.encode_ordinary(word[a : a + LONG] if a else " " + word[:LONG])])
            sizes[i] = len(more[-1])
        flat = np.insert(flat, np.repeat(begin[at], [len(x) for x in more]), [x for m in more for x in m])
    return flat, sizes


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 and so on, of each run, in a row."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


class Words:
    """The words of a batch of texts: the different ones, which of them each place holds, and the text that each place is in."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        self.known: pa.Array = coded.dictionary
        index = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        empty = pc.index(self.known, "").as_py()
        if empty >= 0:  # white space at an end of a text leaves an empty string there
            keep = index != empty
            index, owner = index[keep], owner[keep]
        self.index, self.owner, self.texts = index, owner, len(texts)

    def each(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, how often) of those different words of each text that are asked for (a mask), text by text."""
        n, asked = max(1, len(self.known)), words[self.index]
        pair, times = np.unique(self.owner[asked] * np.int64(n) + self.index[asked], return_counts=True)
        return pair // n, pair % n, times


def count_words(df: DataFrame, text: str, learn: str) -> DataFrame:
    """(word, n, n_all): how often the texts to learn from, and all texts, have each word; END stands once in every text. Tasks add up before the shuffle."""

    def total(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum"), ("n_all", "sum")])
        return t.rename_columns({"n_sum": "n", "n_all_sum": "n_all"}).select(["word", "n", "n_all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in bpe.small_batches(batches, text):
            w, wanted = Words(batch.column(text)), batch.column(learn).to_numpy(zero_copy_only=False)
            n_all = np.bincount(w.index, minlength=len(w.known))
            n = np.bincount(w.index[wanted[w.owner].astype(bool)], minlength=len(w.known))
            names = pa.concat_arrays([w.known, pa.array([END])])
            parts.append(pa.table({"word": names, "n": np.append(n, wanted.sum()).astype(np.int64), "n_all": np.append(n_all, batch.num_rows).astype(np.int64)}))
            rows += len(names)
            if rows > 2 * COUNTED:
                parts = [total(parts)]
                rows = len(parts[0])
                if rows > COUNTED:
                    yield from parts[0].to_batches()
                    parts, rows = [], 0
        if parts:
            yield from total(parts).to_batches()

    counted = df.select(text, learn).mapInArrow(run, "word string, n long, n_all long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")).where("n_all > 0")


def count_ids(counts: DataFrame, path: str, pattern: str) -> np.ndarray:
    """How often each subword id occurs in the texts to learn from: one number for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(_tokenizer(path, pattern)[1]))
        for batch in batches:
            ids, sizes = word_ids(batch.column("word"), path, pattern)
            total += np.bincount(ids, weights=np.repeat(batch.column("n").to_numpy(), sizes), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen].astype(np.int64))], names=["id", "n"])

    rows = counts.where((F.col("word") != END) & (F.col("n") > 0)).select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(_tokenizer(path, pattern)[1]), np.int64)
    for row in rows:
        out[row["id"]] = row["n"]
    return out


class Vocabulary:
    """Counts of the frequent words, and the symbol of each id."""

    def __init__(self, *, total: int, distinct: int, heavy: dict[str, int], ids: np.ndarray, ends: int, path: str, pattern: str):
        self.total, self.distinct, self.ends, self.path, self.pattern = total, distinct, ends, path, pattern
        self.heavy, self.counts = pa.array(heavy, pa.string()), np.array([*heavy.values(), -1])  # -1: none of them
        own = np.argsort(-ids, kind="stable")[: SYMBOLS - 2]
        own = own[ids[own] > 0]
        self.symbol = np.full(len(ids), RARE, np.int64)
        self.symbol[own] = np.arange(2, 2 + len(own))
        rare = self.symbol == RARE
        #: log10 of an id's share among those without a symbol of their own, counted with one more each.
        self.within = np.where(rare, np.log10((ids + 1) / max(1, int((ids[rare] + 1).sum()))), 0.0)
        self.symbol_counts = np.zeros(SYMBOLS)
        self.symbol_counts[END_SYMBOL], self.symbol_counts[RARE] = ends + 1, ids[rare].sum() + 1
        self.symbol_counts[2 : 2 + len(own)] = ids[own]
        #: Symbols of all texts to learn from, with their ends.
        self.symbols_to_learn = int(ids.sum()) + ends
        self.heavy_symbols, self.heavy_sizes, self.heavy_inside = self.encoded(self.heavy)

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words in a row, how many each has, and the log10 share of its rare ids within the rare symbol."""
        ids, sizes = word_ids(words, self.path, self.pattern)
        inside = np.bincount(np.repeat(np.arange(len(words)), sizes), weights=self.within[ids], minlength=len(words))
        return self.symbol[ids].astype(np.uint16), sizes, inside

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word stands among the frequent ones; after the last, if it is none of them."""
        return pc.fill_null(pc.index_in(words, self.heavy), len(self.heavy)).to_numpy().astype(np.int64)

    def symbols(self, words: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, where those of each word begin, how many it has, the log10 share of its rare ids)."""
        new = place == len(self.heavy)
        symbols, more, far = self.encoded(words.filter(pa.array(new)))
        sizes, inside, begin = (np.empty(len(words), t) for t in (np.int64, float, np.int64))
        known = place[~new]
        sizes[~new], sizes[new], inside[~new], inside[new] = self.heavy_sizes[known], more, self.heavy_inside[known], far
        begin[~new] = (np.cumsum(self.heavy_sizes) - self.heavy_sizes)[known]
        begin[new] = len(self.heavy_symbols) + np.cumsum(more) - more
        return np.concatenate([self.heavy_symbols, symbols]), begin, sizes, inside

    def texts(self, w: Words, place: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The symbols of each text of a batch, two bytes each, and the log10 share of its rare ids; place: of its words."""
        symbols, begin, sizes, inside = self.symbols(w.known, place)
        of = sizes[w.index]  # symbols at each place of the texts
        ends = np.append(0, np.cumsum(np.bincount(w.owner, weights=of, minlength=w.texts).astype(np.int64)))
        flat = symbols[spread(begin[w.index], of)].astype("<u2")
        made = pa.Array.from_buffers(pa.binary(), w.texts, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(flat)])
        return made, np.bincount(w.owner, weights=inside[w.index], minlength=w.texts)


def stream_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts as Vocabulary.texts() gives them, one text after another with an end before, between and behind them, and where those ends are."""
    texts = texts.cast(pa.binary())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    ends = np.append(0, np.cumsum(np.diff(at) // 2 + 1))
    stream = np.full(ends[-1] + 1, END_SYMBOL, np.int64)
    holes = np.ones(len(stream), bool)
    holes[ends] = False
    stream[holes] = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view("<u2")
    return stream, ends


def added(vectors: DataFrame) -> np.ndarray | None:
    """The sum of the vectors of all rows, which some tasks add up before they come to the driver; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                total = np.frombuffer(v.as_buffer()) + (0 if total is None else total)
        if total is not None:
            yield _vector(total)

    rows = vectors.repartition(ADDERS).mapInArrow(run, "v binary").collect()
    return sum(np.frombuffer(bytes(r["v"])) for r in rows) if rows else None


def _vector(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.astype(float).tobytes()], pa.binary())], names=["v"])


class Model:
    """The attention over codes, and the code of each symbol: those of a class lie side by side."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray):
        """counts of symbols; pairs: of frequent ones (before) and all (after)."""
        self.code = np.empty(SYMBOLS, np.int64)
        self.code[alike(pairs)] = np.arange(SYMBOLS)
        placed = np.empty(SYMBOLS)
        placed[self.code] = counts
        self.attention = Attention(placed)
        #: Symbols, with the ends of texts, that it has learned from.
        self.learned = 0

    @functools.cached_property
    def tables(self):
        return self.attention.tables()

    @functools.cached_property
    def nothing(self) -> float:
        """The log10 probability of a text without symbols; in single precision it would differ a little from batch to batch."""
        return float(self.tables.score(self.code[[END_SYMBOL, END_SYMBOL]], np.array([0, 1]))[0])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("tables", "nothing")}

    def score(self, texts: pa.Array) -> np.ndarray:
        """The log10 probability of the symbols of each text of a batch."""
        stream, ends = stream_of(texts)
        return np.where(np.diff(ends) == 1, self.nothing, self.tables.score(self.code[stream], ends))

    def turn(self, texts: DataFrame, *, rates: tuple[float, float], steps: int = 0, together: bool = False) -> None:
        """Learns from all texts (_uid, _symbols): each task goes on from the weights so far, and what they end with is averaged by the symbols they saw.

        Tasks go through their texts once, CHUNK symbols at a time. If the texts are to be taken together, one task holds all of them and makes at least so many steps.
        """
        attention, code = self.attention, self.code

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, np.ndarray]] = []
            room, seen, chunk = CHUNK, 0, 0
            attention.adam = None

            def learn() -> None:
                attention.train([s for _, s in sorted(held, key=lambda h: h[0])], steps, seed=12 + chunk, rates=rates, batch=BATCH if together else MANY)

            start = attention.vector()
            for batch in bpe.small_batches(batches, "_symbols"):
                stream, ends = stream_of(batch.column("_symbols"))
                stream = code[stream].astype(np.int32)
                for uid, a, b in zip(batch.column("_uid").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    held.append((uid, stream[a : b + 1]))
                    room -= b - a
                    seen += b - a
                    if room <= 0 and not together:
                        learn()
                        held, room, chunk = [], CHUNK, chunk + 1
            if held:
                learn()
            if seen:
                yield _vector(np.append(attention.vector() * seen, seen))
            attention.load(start)

        texts = texts.select("_uid", "_symbols")
        total = added((texts.repartition(1) if together else texts).mapInArrow(run, "v binary"))
        if total is not None:
            self.attention.load(total[:-1] / total[-1])
            self.learned += int(total[-1])


def vocabulary(counts: DataFrame, path: str, pattern: str) -> Vocabulary:
    """Of texts whose words are counted in ``counts`` (see count_words), which should be a written table.

    To the driver come two totals, at most HEAVY words and one number for each id of the vocabulary.
    """
    size = F.floor(F.log2("n_all") * 64).cast("int")
    said = counts.groupBy(size.alias("b")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("d")).collect()
    least, room = math.inf, HEAVY
    for row in sorted(said, key=lambda r: -r["b"]):
        room -= row["k"]
        if room < 0:
            break
        least = row["b"]
    heavy = {r["word"]: r["n"] for r in counts.where(size >= least).select("word", "n").collect()} if said and math.isfinite(least) else {}
    ends = counts.where(F.col("word") == END).select("n").first()
    return Vocabulary(
        total=sum(r["n"] for r in said), distinct=sum(r["d"] for r in said), heavy=heavy, ids=count_ids(counts, path, pattern), ends=ends[0] if ends else 0, path=path, pattern=pattern
    )


def count_pairs(texts: DataFrame, counts: np.ndarray) -> np.ndarray:
    """How often each of the most frequent symbols stands before each symbol, in all texts."""
    most = 4 * CLASSES
    rank = np.empty(SYMBOLS, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most * SYMBOLS)
        for batch in bpe.small_batches(batches, "_symbols"):
            stream = stream_of(batch.column("_symbols"))[0]
            before, after = rank[stream[:-1]], stream[1:]
            told = before < most
            total += np.bincount(before[told] * SYMBOLS + after[told], minlength=len(total))
        yield _vector(total)

    total = added(texts.select("_symbols").mapInArrow(run, "v binary"))
    return (np.zeros(most * SYMBOLS) if total is None else total).reshape(most, SYMBOLS)


def fit(texts: DataFrame, symbols: int, counts: np.ndarray, steps: int | None = None) -> Model:
    """The model of all texts (_uid, _symbols) to learn from, a written table; symbols: of all of them, with their ends; counts of each symbol."""
    model = Model(counts, count_pairs(texts, counts))
    if not symbols:
        return model
    place = F.pmod(F.xxhash64("_uid"), F.lit(1_000_000))
    begin = 1_000_000 if symbols < 2 * FIRST else 1_000_000 * FIRST // symbols
    model.turn(texts.where(place < begin), rates=(RATE, RATE / 10) if begin == 1_000_000 else (RATE, TURNS[0][1]), steps=STEPS if steps is None else steps, together=True)
    for part, rate in TURNS if begin < 1_000_000 else ():
        end = begin + math.ceil((1_000_000 - begin) * part)
        model.turn(texts.where((place >= begin) & (place < end)), rates=(rate, rate))
        begin = end
    return model


def score(df: DataFrame, learn: Column, *, key: str, text: str, path: str, pattern: str, out: str = "lm", steps: int | None = None) -> DataFrame:
    """df without its text, with a struct ``out``: n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` says which rows to learn from (null: not). Texts are whole, of any length; a null one is empty and has only its end. Rows with
    a null key count like others, and repeated rows each count. If there is nothing to learn from, N and V are 0 and the
    model is untrained. Columns of any name stay, one named as out is replaced. No rows give no rows.
    steps: that the first turn makes at least, in more passes if its texts are few. The counts and the rows with their texts' symbols are
    written to the shared folder; store.release() deletes them.
    """
    spark, others = df.sparkSession, [c for c in df.columns if c != text]
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    counts = written(count_words(slim, "_text", "_learn"), "words")
    known = vocabulary(counts, path, pattern)
    # Bounded by HEAVY words and the tokenizer's vocabulary.
    shared = spark.sparkContext.broadcast(known)
    rows = packed(df.select(*others, F.col(text).alias("_text_of_row"), F.coalesce(learn, F.lit(False)).alias("_learn_of_row")), _text=F.col("_text_of_row"), _learn=F.col("_learn_of_row"))
    rows = rows.drop(f"_row{len(others)}", f"_row{len(others) + 1}")
    names = [c for c in rows.columns if c != "_text"]
    kinds = "n_tokens long, known long, base double, inside double, _symbols binary, rest array<struct<word:string,n:long>>"
    schema = T.StructType([*(rows.schema[c] for c in names), *T._parse_datatype_string(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in bpe.small_batches(batches, "_text"):
            w = Words(batch.column("_text"))
            n = len(batch)
            place = m.places(w.known)
            c = m.counts[place]
            told = c >= 0
            add = lambda weights: np.bincount(w.owner, weights=weights[w.index], minlength=n)  # noqa: B023, E731
            base = add(np.where(told, np.log10(np.maximum(c, 0) + 1), 0.0)) + math.log10(m.ends + 1)
            known = add((c > 0).astype(float)).astype(np.int64) + (m.ends > 0)
            n_tokens = np.bincount(w.owner, minlength=n) + 1
            text_of, word, times = w.each(~told)
            left = np.append(0, np.cumsum(np.bincount(text_of, minlength=n)))
            rest = pa.StructArray.from_arrays([w.known.take(pa.array(word)), pa.array(times.astype(np.int64))], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), rest)
            symbols, inside = m.texts(w, place)
            made = [pa.array(n_tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(inside), symbols, lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *made], names=schema.names)

    encoded = written(rows.mapInArrow(run, schema).withColumn("_uid", F.monotonically_increasing_id()), "encoded")
    # Bounded by the size of the attention.
    model = spark.sparkContext.broadcast(fit(encoded.where("_learn").select("_uid", "_symbols"), known.symbols_to_learn, known.symbol_counts, steps))
    kept = [*(f"_row{i}" for i in range(len(others))), "n_tokens", "known", "base", "_uid"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.small_batches(batches, "_symbols"):
            score = model.value.score(batch.column("_symbols")) + batch.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(score)], names=[*kept, "score"])

    scored = encoded.select(*kept, "inside", "_symbols").mapInArrow(told, T.StructType([*(encoded.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))
    asked = encoded.select("_uid", F.explode("rest").alias("r")).select("_uid", "r.word", "r.n")
    seen = asked.join(counts.where("n > 0").select("word", F.col("n").alias("c")), "word")
    more = seen.groupBy("_uid").agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_base"))
    whole = scored.join(more, "_uid", "left")
    lower = math.log10(known.total + known.distinct + 1)
    made = F.struct(
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * lower).alias("base_score"),
        "score",
    )
    done = whole.select(*[f"_row{i}" for i in range(len(others))], made.alias("_made"))
    return done.select(*[c for name, c in restored(others) if name.lower() != out.lower()], F.col("_made").alias(out))
