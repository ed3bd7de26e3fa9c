"""The language model: gradients, windows, subword ids, and scores against plain loops."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plateworks.llm import attention, langid, queries, scoring

RULES = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def test_gradient_is_that_of_small_differences():
    rng = np.random.default_rng(0)
    m = attention.Attention(rng.integers(1, 50, attention.SYMBOLS))
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    codes, target, use = rng.integers(0, attention.SYMBOLS, (3, 7)), rng.integers(0, attention.SYMBOLS, (3, 7)), np.ones((3, 7), bool)
    use[2, 4:] = False
    _, g = m.gradient(codes, target, use)
    for k, v in m.p.items():
        for i in np.argsort(-np.abs(g[k]).ravel())[:2]:
            at = np.unravel_index(i, v.shape)
            kept, out = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = kept + step
                out.append(m.gradient(codes, target, use)[0])
            v[at] = kept
            assert abs((out[0] - out[1]) / 2e-5 - g[k][at]) < 1e-7


def test_gradient_in_parts_is_the_sum_of_the_windows():
    rng = np.random.default_rng(5)
    m = attention.Attention(rng.integers(1, 50, attention.SYMBOLS))
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    n, w = 2 * attention.TOGETHER + 9, attention.WINDOW
    codes, use = rng.integers(0, attention.SYMBOLS, (n, w)), rng.random((n, w)) < 0.8
    target = np.where(rng.random((n, w)) < 0.7, rng.integers(0, attention.MEMBERS, (n, w)), rng.integers(0, attention.SYMBOLS, (n, w)))  # a class larger than a part
    loss, g = m.gradient(codes, target, use)
    each = [(m.gradient(codes[i : i + 1], target[i : i + 1], use[i : i + 1]), use[i].sum()) for i in range(n)]
    assert math.isclose(loss, sum(one[0] * k for one, k in each) / use.sum(), rel_tol=1e-9)
    for name in m.p:
        assert np.allclose(g[name], sum(one[1][name] * k for one, k in each) / use.sum(), atol=1e-12)


def test_gradient_keeps_little_of_many_windows():
    """What doesn't stay in a core's cache costs time: of all places at once there are ten arrays of vectors at most."""
    rng = np.random.default_rng(6)
    m, n, w = attention.Attention(rng.integers(1, 50, attention.SYMBOLS)), 2048, attention.WINDOW
    codes, target = rng.integers(0, attention.SYMBOLS, (2, n, w)).astype(np.int32)
    tracemalloc.start()
    m.gradient(codes, target, np.ones((n, w), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * n * w * attention.HIDDEN * 4


def test_exp_that_is_too_much():
    x = np.array([[-1e4, 0, 79], [80, 90, 1e9]], np.float32)
    attention._exp(x)
    assert np.isfinite(x).all() and x[0, 0] == 0 and x[0, 1] == 1 and x[1, 0] == x[1, 1] == x[1, 2] > x[0, 2]


def plain_score(m, seq):
    """A window after another; each symbol by the window that scores it."""
    p, out, a, n = m.p, 0.0, 0, len(seq) - 1
    while True:
        codes = seq[a : min(a + attention.WINDOW, n)]
        z = m.hidden(m.mixed(codes[None])[0][0])
        for j in range(attention.CONTEXT if a else 0, len(codes)):
            c, i = divmod(int(seq[a + j + 1]), attention.MEMBERS)
            one, two = z[j] @ p["class"] + p["class0"], z[j] @ p["member"][c] + p["member0"][c]
            share = np.exp(one[c]) / np.exp(one).sum() * np.exp(two[i]) / np.exp(two).sum()
            out += np.log((1 - attention.PLAIN) * share + attention.PLAIN * m.share[seq[a + j + 1]])
        if a + attention.WINDOW >= n:
            return out / math.log(10)
        a += attention.WINDOW - attention.CONTEXT


def test_windows_score_each_symbol_once():
    rng = np.random.default_rng(1)
    m = attention.Attention(rng.integers(1, 50, attention.SYMBOLS))
    losses = m.train([np.cumsum(rng.integers(1, 4, 200)) % attention.SYMBOLS for _ in range(60)], steps=60)
    assert losses[-1] < losses[0] - 2
    lengths = [1, 2, 31, 32, 33, 34, 56, 57, 100, 400]
    each = [np.append(7, rng.integers(0, attention.SYMBOLS, n - 1)) for n in lengths]
    stream, begins = np.append(np.concatenate(each), 7), np.append(0, np.cumsum(lengths))
    got = m.tables().score(stream, begins)
    want = [plain_score(m, stream[a : b + 1]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    assert np.allclose(got, want, rtol=1e-5)
    # What comes later changes nothing.
    other = stream.copy()
    other[begins[9] + 60 : begins[10]] = 3
    a, b = (m.tables().hidden(s[None, begins[9] : begins[9] + 32].astype(np.int32), 0) for s in (stream, other))
    assert np.array_equal(a, b)


def test_ids_of_words_are_those_of_the_library():
    words = ["the", "don't", "naïve", "x1,y2", "ß", "a b", " ", "b ", " c", "\x1cq", "語", "end.", "w" * 2500, "ab cd" * 3]
    ids, sizes = scoring.word_ids(pa.array(words), **RULES)
    library = scoring._tokenizer(**RULES)[0]
    want = [[x for a in range(0, len(w), 1000) for x in library.encode_ordinary(w[a : a + 1000] if a else " " + w[:1000])] for w in words]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert [len(x) for x in scoring.word_ids(pa.array([], pa.string()), **RULES)] == [0, 0]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [""]


def documents(spark):
    rng = np.random.default_rng(2)
    pool = ["Le", "la", "eau", "THE", "of", "mot ", "x\tz", "\n\n", "  ", "É", "é", "fin."] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(pool, int(rng.integers(0, 60))))) for i in range(160)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "word " * 3000), (None, "the keyless text"), (5, "again"), (5, "again"), (904, "q" * 4000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("heavy", [100_000, 8, 0])
def test_base_scores_are_exact_and_all_is_scored(spark, monkeypatch, heavy):
    monkeypatch.setattr(scoring, "HEAVY", heavy)
    extra = ["_uid", "rest", "n_tokens", "known", "base", "score", "_text", "_key", "_learn", "word", "lm"]
    df = documents(spark).withColumns({c: F.lit(c) for c in extra})
    learn = F.coalesce(scoring.fold(F.col("doc_id")) != 2, F.lit(True))
    done = scoring.score(df, learn, key="doc_id", text="text", steps=20, **RULES)
    assert done.columns == ["doc_id", *[c for c in extra if c != "lm"], "lm"]
    got = done.collect()
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    counts = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        ws = words_of(t)
        want[i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)] += 1
    assert Counter((r.doc_id, r.lm.n_tokens, r.lm.n_known, r.lm.train_tokens, round(r.lm.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.lm.score) and r.lm.score < 0 for r in got) and all(r[c] == c for r in got for c in extra if c != "lm")
    one = {r.doc_id: r.lm.score for r in got}
    assert one[900] == one[901] == one[902]


def test_model_prefers_the_language_it_learned(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(["ba", "du", "ki", "so"], 3))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(120)] + [(1000, " ".join("".join(rng.permutation(list("badukiso"))) for _ in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.lm for r in scoring.score(df, F.col("doc_id") < 100, key="doc_id", text="text", steps=150, **RULES).collect()}
    mean = np.mean([got[i].score for i in range(100, 120)])
    best = 60 * math.log10(1 / 64)  # three of four syllables at random
    assert got[1000].score < 1.5 * mean and best > mean > 1.06 * best


@pytest.mark.parametrize("first", [20_000, 500, 1])
def test_all_of_each_training_text_is_learned(spark, monkeypatch, first):
    """4,200 short texts and a long one, in one turn and in three: each symbol and each end once, in every turn's weights too."""
    monkeypatch.setattr(scoring, "FIRST", first)
    rows = [(i, f"w{i % 7} x") for i in range(4200)] + [(9000, "begin " + "a b " * 4000 + "end"), (9001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = df.select(F.col("doc_id").alias("_uid"), "text", F.lit(True).alias("_learn"))
    counts = scoring.count_words(texts, "text", "_learn").cache()
    known = scoring.vocabulary(counts, **RULES)
    assert known.symbols_to_learn == sum(len(scoring.word_ids(pa.array(words_of(t)[:-1], pa.string()), **RULES)[0]) + 1 for _, t in rows)

    def run(batches):
        for b in batches:
            w = scoring.Words(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("_uid"), known.texts(w, known.places(w.known))[0]], names=["_uid", "_symbols"])

    coded = texts.select("_uid", "text").mapInArrow(run, "_uid long, _symbols binary").cache()
    assert scoring.count_pairs(coded, known.symbol_counts).sum() == known.symbols_to_learn
    model = scoring.fit(coded, known.symbols_to_learn, known.symbol_counts, steps=1)
    assert model.learned == known.symbols_to_learn
    assert all(np.isfinite(v).all() for v in model.attention.p.values())
    other = scoring.fit(coded.where("_uid <> 4199"), known.symbols_to_learn, known.symbol_counts, steps=1)
    assert other.learned < model.learned and not np.array_equal(other.attention.vector(), model.attention.vector())


def test_turns_learn_as_one_does(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(["ba", "du", "ki", "so"], 3))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sums = []
    for first in (1_000_000, 20_000):
        monkeypatch.setattr(scoring, "FIRST", first)
        done = scoring.score(df, F.col("doc_id") < 380, key="doc_id", text="text", steps=150, **RULES).where("doc_id >= 380")
        sums.append(done.agg(F.avg("lm.score")).first()[0])
    assert sums[1] > 1.03 * sums[0] and sums[0] < 0


def test_empty_and_nothing_to_learn(spark, tmp_path):
    df = documents(spark)
    assert scoring.score(df.where("false"), F.lit(True), key="doc_id", text="text", **RULES).collect() == []
    got = scoring.score(df.where("doc_id < 3"), F.lit(None).cast("boolean"), key="doc_id", text="text", **RULES).collect()
    assert len(got) == 3 and all(r.lm.base_score == 0 and r.lm.n_known == 0 and math.isfinite(r.lm.score) for r in got)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_lm_score(spark, str(tmp_path)).collect()
    assert len(rows) == 168 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)


def test_more_languages_than_anyone_has(spark):
    rows = [(i, f"{chr(0x4E00 + 40 * (i % 90))}{chr(0x4E00 + 40 * (i % 90) + 1)} " * 30, f"l{i % 90}") for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, key="doc_id", text="text", lang="lang")
    assert len(model.langs) == 90
    said = langid.predict(df, model).collect()
    assert all(r.lang_id.lang == r.lang for r in said)
