"""Language identification, quality rules, mixing, chat formatting and the pipeline."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plateworks.llm import chat, langid, mixing, quality, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents conversations embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, duck, name):
    df, r = queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name])
    cols = sorted(df.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(r.columns) == cols
    got = sorted([text(x[c]) for c in cols] for x in df.collect())
    assert got == sorted([text(x[list(r.columns).index(c)]) for c in cols] for x in r.fetchall())


def phrases(text, train):
    """Phrases of the greedy parse of one whole text by substring search."""
    i = n = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in train:
            k += 1
        i, n = i + k, n + 1
    return n


@pytest.mark.parametrize(("segment", "dense"), [(256, 1 << 30), (256, 0), (7, 1 << 30), (7, 0)])
def test_phrases_are_the_longest_matches(monkeypatch, segment, dense):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    monkeypatch.setattr(langid, "DENSE_BYTES", dense)
    rnd = random.Random(1)
    made = ["".join(rnd.choice(letters) for _ in range(400)) for letters in ("abcd e", "abcd е", "中文字符一二三四五六七八九十 ")] + ["a" * 50 + " ab" * 9]
    m = langid.Model({f"l{i}": [s] for i, s in enumerate(made)})
    tests = ["".join(rnd.choice("abcd efеж中文字符一二") for _ in range(n)) for n in (1, 5, 255, 256, 257, 700, 3000)]
    tests += ["a" * 3000, "ab " * 700, made[0] * 3, made[2][50:350], "", "zzz" * 200]
    clean = [langid.folded(t) for t in tests]
    assert m.phrases(clean).tolist() == [[phrases(t, langid.folded(s)) for s in made] for t in clean]


def test_many_letters_keep_languages_apart():
    """Scripts of thousands of letters beside each other: no letter is folded into another."""
    rnd = random.Random(2)
    scripts = {"han": range(0x4E00, 0x5E00), "hangul": range(0xAC00, 0xBC00), "cyrillic": range(0x430, 0x44F), "greek": range(0x3B1, 0x3C9)}
    words = {k: ["".join(chr(rnd.choice(v)) for _ in range(3)) for _ in range(300)] for k, v in scripts.items()}
    text = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    m = langid.Model({k: [text(k, 3000)] for k in scripts})
    assert m.classify([text(k, 30) for k in scripts])[0] == list(scripts)


def test_no_more_languages_than_the_characters_allow(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_CHARS", 3 * langid.LEAST_CHARS)
    df = spark.createDataFrame([(i, f"text of language number {i % 7} abc", f"l{i % 7}") for i in range(70)], "doc_id long, text string, lang string")
    assert langid.fit(df, key="doc_id", text="text", lang="lang").langs == ["l0", "l1", "l2"]


def test_language_identification_held_out(spark):
    sf = "/root/testdata/sf0.01"
    said = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(said) == len(docs)
    held = [d for d in docs if said[d.doc_id].held_out]
    assert all(said[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) for d in docs)
    right = sum(said[d.doc_id].lang_pred == d.lang for d in held) / len(held)
    assert right > 0.97 and all(0 <= r.score <= 1 for r in said.values())


def test_language_identification_edges(spark):
    rows = [(1, "abc abc abd", "x", "a"), (2, "efg egf efg", "y", "b"), (3, None, "x", "c"), (4, "12 !?", "y", "d"), (5, "", None, "e"), (6, "abd " * 5000, None, "f"), (None, "gfe", None, "g"), (6, "abd " * 5000, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_id string").withColumns({c: F.lit(c) for c in ("_in_", "__in_", "score", "k", "t", "l")})
    model = langid.fit(df, key="doc_id", text="text", lang="lang")
    got = [(r.doc_id, r.lang_id.lang, r.lang_id.score) for r in langid.predict(df, model).collect()]
    assert sorted((k or 0, lang) for k, lang, _ in got) == [(0, "y"), (1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und"), (6, "x"), (6, "x")]
    none = langid.fit(df.limit(0), key="doc_id", text="text", lang="lang")
    assert {r.lang_id.lang for r in langid.predict(df, none).collect()} == {"und"} and langid.predict(df.limit(0), model).count() == 0


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = SPACE.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_are_brute_force(spark):
    rnd = random.Random(2)
    made = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    made += ["".join(rnd.choice("ab \n\t#|<é漢  \x0b") for _ in range(rnd.randint(0, 200))) for _ in range(80)]
    made += [None, "", "a b c d e " * 3000, "x", "a\n\na\na", "one two three four five"]
    made += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r.quality for r in quality.measures(df).collect()}
    for i, t in enumerate(made):
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == measured(t), repr(t)[:80]


def test_rules_are_learned_and_ordered(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        a, b = rnd.random(), rnd.random()
        rows.append((i, a > 0.8 or (b < 0.2 and a > 0.4), a, b))
    df = spark.createDataFrame(rows, "doc_id long, bad boolean, a double, b double")
    rules = quality.learn(df, ("a", "b"))
    assert rules and all(1 <= len(r) <= quality.MAX_CONDITIONS for r in rules)
    out = df.withColumn("rule", quality.verdict(rules, {"a": F.col("a"), "b": F.col("b")})).collect()
    said, bad = [r for r in out if r.rule], [r for r in out if r.bad]
    assert sum(r.bad for r in said) / len(said) > 0.9 and sum(r.rule > 0 for r in bad) / len(bad) > 0.7
    assert quality.learn(df.limit(0), ("a", "b")) == [] and quality.learn(df.where("bad"), ("a", "b")) == []


def test_judge_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, None, 1), (None, "", 2), (2, "word " * 9, 3), (3, "a b c d e f g h i j k l", 4), (3, "a b c d e f g h i j k l", 4), (4, "a b c d e " * 2000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = sorted(((r.doc_id or 0), r.quality.base_failed, r.quality.kept) for r in quality.judge(df, labels).collect())
    assert got == [(0, True, False), (1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, True, False)]
    kept = quality.keep(quality.judge(df.drop("quality"), labels))
    assert kept.columns == ["doc_id", "text"] and kept.count() == 2
    assert quality.judge(df.limit(0), labels).count() == 0


def test_quality_query_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1 and not got[k].base_failed]
    bad = [k for k, q in labels.items() if q == 0]
    assert sum(got[k].kept for k in good) / len(good) > 0.98 and sum(got[k].kept for k in bad) / len(bad) < 0.2


@pytest.mark.parametrize("border", ["split", "whole"])
def test_mix_meets_targets(spark, border):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "c", None, "Ω"]), "w " * rnd.randint(0, 30)) for i in range(2000)] + [(5000, "z", None), (None, "a", "x y"), (7, "b", "dup"), (7, "b", "dup")]
    df = spark.createDataFrame([(*r, "?") for r in rows], "doc_id long, source string, text string, mix string")
    got = mixing.mix(df, border=border, slices=16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r.mix)
    total = sum(m.size for ms in by.values() for m in ms)
    assert sum(ms[0].target for ms in by.values()) == pytest.approx(1.5 * total)
    for ms in by.values():
        assert sum(m.size for m in ms) == ms[0].source_size and ms[0].target <= 2 * ms[0].source_size
        off = abs(sum(m.taken for m in ms) - ms[0].target)
        assert off <= (0.5 if border == "split" else 15)
        assert all(0 <= m.taken <= 2 * m.size and (m.position is None) == (m.taken == 0) for m in ms)
        assert all(0 <= m.position <= 1 for m in ms if m.position is not None)
    again = mixing.mix(df.repartition(7), border=border, slices=16).collect()
    key = lambda rs: sorted((r.doc_id or -1, r.source or "", r.text or "", tuple(r.mix)[:5]) for r in rs)
    assert [k[:3] + k[3][:4] for k in key(got)] == [k[:3] + k[3][:4] for k in key(again)]
    copies = mixing.curriculum(mixing.mix(df, border="whole", slices=16))
    times = [r.mix.position for r in copies.collect()]
    assert times == sorted(times) and len(times) == sum(r.mix.copies for r in mixing.mix(df, border="whole", slices=16).collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_position_inverts_the_schedule(spark):
    u = np.linspace(0, 1, 21).tolist()
    for slope in (-0.5, 0.0, 0.5):
        t = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(mixing.position(F.col("u"), F.lit(slope))).collect()]
        assert all(abs((1 - slope) * a + slope * a * a - b) < 1e-8 for a, b in zip(t, u, strict=True))


def test_chat_collapse(spark):
    turns = lambda conv, *ts: [(conv, i, r, t, "x") for i, (r, t) in enumerate(ts)]
    a, b, c = ("user", "hi"), ("assistant", "yes <|im_end|>"), (None, None)
    rows = [*turns(1, a), *turns(2, a, b), *turns(3, a, b, c), *turns(4, a, b, c), *turns(5, b), *turns(6, a, c), *turns(None, b, a), (7, None, "user", "", "x"), *turns(2, a)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.render(df).collect()}
    assert set(got) == {3, 6, 7, None}
    assert got[3] == (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes < |im_end|><|im_end|>\n<|im_start|>unknown\n<|im_end|>\n")
    assert got[7] == (1, 1, "<|im_start|>user\n<|im_end|>\n") and got[None][0] == 2
    assert chat.render(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mix_sources", "byte_level_bpe"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), name)
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert 0 < docs.count() <= before.count()
    assert docs.where("not round_trip").count() == 0 and docs.count() > 0
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}


def test_pipeline_of_odd_documents(spark, tmp_path):
    src = f"file://{tmp_path}"
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{src}/labels.parquet")
    t = "a line of text that is quite long enough here " * 2
    rows = [(1, t, "en", "a", 90), (1, t, "en", "a", 90), (2, None, None, None, None), (None, t + " more", "en", None, 95), (3, "", "en", "b", 0), (4, "w%d " * 3, "en", "b", 9)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (made, made.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, src), name)
        docs.count()
