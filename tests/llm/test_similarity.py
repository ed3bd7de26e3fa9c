"""Line dedup, Jaccard join and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plateworks.llm import components, jaccard, lines, neighbours, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, a, n, letters):
    b = list(a)
    for _ in range(n):
        k = rnd.randrange(len(b)) if b else 0
        kind = rnd.randint(0, 2)
        if kind == 0 or not b:
            b.insert(k, rnd.choice(letters))
        elif kind == 1:
            b.pop(k)
        else:
            b[k] = rnd.choice(letters)
    return "".join(b)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_banded_distance(spark, most):
    rnd = random.Random(most)
    rows = []
    for _ in range(200):
        a = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 14)))
        rows.append((a, edited(rnd, a, rnd.randint(0, 4), "abcé ")))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b"), most).alias("w")).collect()
    assert all(r.w == (distance(r.a, r.b) <= most) for r in got)


def judged(rows, most=2, per=12):
    """By brute force: for each (key, text) the places of its lines that stand earlier elsewhere, exactly or nearly."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, later = {}, {}
    for k, t in order:
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\x0b\x0c\r"):
                first.setdefault(x, (k, i))
    seen = []
    for x in first:  # in the order in which they stand first
        later[x] = any(abs(len(x) - len(y)) <= most and distance(x, y) <= min(most, min(len(x), len(y)) // per) for y in seen)
        seen.append(x)
    out = {}
    for k, t in rows:
        lines = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
        exact = [i for i, x in lines if first[x] != (k, i)]
        near = [i for i, x in lines if first[x] == (k, i) and later[x]]
        gone = sorted(exact + near)
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)
        out[k] = (len(lines), len(exact), len(near), gone, len(kept))
    return out


def in_documents(lines_, rnd, n=9):
    rnd.shuffle(lines_)
    return [(k, "\n".join(lines_[at : at + n])) for k, at in enumerate(range(0, len(lines_), n))]


@pytest.mark.parametrize(("most", "hot", "block"), [(1, 32, 1 << 18), (2, 32, 1 << 18), (2, 3, 1 << 18), (2, 2, 600)])
def test_near_lines_are_those_of_brute_force(spark, most, hot, block):
    rnd = random.Random(most)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(8, 40))) for _ in range(40)]
    made = [*base, *(edited(rnd, a, rnd.randint(1, 3), "abcdef") for a in base for _ in range(4)), "", " \t"]
    made += [f"row {rnd.randint(0, 4000):06d} of the table{'s' * rnd.randint(0, 2)} has been loaded" for _ in range(60)]
    rows = in_documents(made, rnd)
    d = spark.createDataFrame(rows, "_key long, _text string").withColumn("_hash", F.xxhash64("_text"))
    found = lines.marks(d, most=most, hot=hot, block_bytes=block).select("_key", F.posexplode("_firsts").alias("_", "f")).where("f.near").select("_key", "f.pos")
    got = {(r[0], r[1]) for r in found.collect()}
    want = {(k, i) for k, i in near_places(rows, most)}
    assert got == want and got


def near_places(rows, most):
    told = judged(rows, most)
    seen, out = set(), []
    for k, t in rows:
        for i, x in enumerate(t.split("\n")):
            if x not in seen and i in told[k][3]:
                out.append((k, i))
            seen.add(x)
    return out


def test_entries_take_little_room(spark):
    """Behind the table of distinct lines an entry is a key and a number: two hashes in each of the 25 entries of a line took most of the disk."""
    c = lines.coded(spark.createDataFrame([("a line of some length that is long enough",)], "_line string"), 2).withColumn("_u", F.lit(7).cast("long"))
    index, probes = lines.entries(c, 2, lines.ID)
    assert index.columns == ["_k", "_u"] and probes.columns == ["_k", "_u", "_longer"]
    assert {r["_u"] for r in index.union(probes.drop("_longer")).collect()} == {7}


def test_template_lines_make_rows_in_proportion(spark):
    """1,200 numbered lines of one template: all under a few hot keys, a row for each pair of blocks."""
    rows = [(i, f"row {i:06d} of the table has been loaded into the warehouse today") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    c = lines.coded(df.select(F.col("text").alias("_line")).distinct(), 2)
    index, probes = lines.entries(c, 2)
    usual = index.join(index.groupBy("_k").count().where(f"count > {lines.HOT}"), "_k", "left_anti")
    assert lines._joined(usual, probes).count() < 3 * len(rows)
    want = judged(rows)
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, list(r.dropped), r.kept_chars) for r in lines.report(df).collect()}
    assert got == want


def test_op8_is_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 60))) for _ in range(50)]
    made = [*base, *rnd.choices(base, k=40), *(edited(rnd, a, rnd.randint(0, 3), "abcdef ") for a in base for _ in range(2)), *[""] * 6, *["All rights reserved."] * 5]
    rows = [*in_documents(made, rnd), (900, None), (901, ""), (902, " \n\t"), (903, "é" * 30 + "\n" + "é" * 29 + "e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, list(r.dropped), r.kept_chars) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == judged(rows)


def test_line_dedup_of_documents(spark):
    long = "This is a line that is long enough to be compared."
    near = "This is a line that is long enough to be comparedx."
    rows = [(2, f"{long}\nshort\n\nown line of document two, also long"), (1, f"{long}\nshort"), (3, near), (4, None), (5, ""), (None, long), (6, "shirt"), (6, "shirt"), (7, "one line here that is long enough\n" * 3)]
    extra = ["_hash", "_key", "_lines", "_firsts", "_row", "n_lines", "n_exact", "n_near", "dropped", "line_dedup", "_text", "kept_text"]
    df = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string").withColumns({c: F.lit(c) for c in extra})
    done = lines.dedup_lines(df)
    assert set(done.columns) == set(df.columns)
    whole = done.collect()
    assert all(r[c] == c for r in whole for c in extra if c != "line_dedup")
    got = [(r.doc_id, r.line_dedup.kept_text, r.line_dedup.n_exact, r.line_dedup.n_near, list(r.line_dedup.dropped)) for r in whole]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert len(got) == len(rows)
    assert by[1] == [(f"{long}\nshort", 0, 0, [])]
    assert by[2] == [("\nown line of document two, also long", 2, 0, [0, 1])]
    assert by[3] == [("", 0, 1, [0])] and by[None] == [("", 1, 0, [0])]
    assert by[4] == [(None, 0, 0, [])] and by[5] == [("", 0, 0, [])] and by[6] == [("shirt", 0, 0, [])] * 2
    assert by[7] == [("one line here that is long enough\n", 2, 0, [1, 2])]
    told = {r.doc_id: (r.n_lines, r.dropped, r.kept_chars) for r in lines.report(df).collect() if r.doc_id != 6}
    for k, v in told.items():
        assert list(v[1]) == by[k][0][3] and v[2] == len(by[k][0][0] or "")
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_short_lines_are_near_by_the_same_measure(spark, tmp_path):
    short, other = "All rights reserved.", "All rights reserved?"  # 20 characters, one edit apart
    rows = [(1, f"{short}\nx\n\n \nfirst document"), (2, f"{other}\nx\n\n \n{short}"), (3, short), (None, "x\ny"), (4, "é\né")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, list(r.dropped), r.kept_chars) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {
        1: (3, 0, 0, [], 40),
        2: (3, 2, 1, [0, 1, 4], 2),
        3: (1, 1, 0, [0], 0),
        None: (2, 1, 0, [0], 1),  # "y" is one edit from "x", but too short for one
        4: (2, 1, 0, [1], 1),
    }
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("n_chars", F.char_length("text").cast("long"))
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert left == {1: (rows[0][1], 40), None: ("y", 1), 4: ("é", 1)}


def shingles(t, n=5):
    w = (t or "").encode().split()
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def classes(rows, least=0.8):
    sets = {k: shingles(t) for k, t in rows}
    links, root = dict.fromkeys(sets, 0), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (find(k), links[k]) for k in sets}


def near_copies(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(3, 200))]
        for _ in range(rnd.choice([1, 1, 2, 8, 30])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = word()
            rows.append((k, " ".join(t)))
            k += 1
    return rows


@pytest.mark.parametrize("large", [jaccard.LARGE, 6])
def test_jaccard_join_is_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard.blocked, "__defaults__", (7,))  # many blocks
    monkeypatch.setattr(jaccard, "LARGE", large)
    rows = [*near_copies(), (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "one")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_jaccard_repeated_rows_and_null_keys(spark):
    t = "a b c d e f g h"
    rows = [(3, t, 1), (3, t, 2), (None, t, 3), (None, "else where no one else is", 4), (4, None, 5), (4, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id long")
    df = df.withColumns({c: F.lit(c) for c in ("_hash", "_k", "_h", "_row", "_key", "_set", "is_kept", "n_links")})
    got = jaccard.join(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id, r.n_links, r.is_kept) for r in got} == {(3, 3, 2, True), (None, 3, 2, False), (None, None, 0, True), (4, 4, 0, True)}
    kept = jaccard.distinct_documents(df).collect()
    assert all(r._hash == "_hash" and r._row == "_row" and r.is_kept == "is_kept" for r in kept)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "else where no one else is"), (3, t), (4, "")]
    assert jaccard.join(df.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert jaccard.runs() == 15


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 32)).astype(np.float32)
    v[100:120] = v[99]  # a group of copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [1.0, 2.0]), (None, [1.0] * 32), (9004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 50 = 0"), block=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    w = v.astype(np.float64)
    norm = np.linalg.norm(w, axis=1)
    hit = total = 0
    for q in range(0, 1500, 50):
        cos = w @ w[q] / (norm * norm[q])
        cos[q] = -2
        want = {int(i) for i in np.lexsort((np.arange(1500), -cos))[:5]}
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos[i]) < 1e-12 for _, i, s in mine) and [s for *_, s in mine] == sorted((s for *_, s in mine), reverse=True)
        hit, total = hit + len(want & {i for _, i, _ in mine}), total + 5
    assert hit / total >= 0.9
    assert [i for _, i, _ in sorted(got[100])] == [99, 101, 102, 103, 104]  # ties go to the smaller id
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 50, 9003)")
    assert {(r.query_id, r.vec_id) for r in neighbours.search(few, few).collect()} == {(0, 50), (50, 0)}


@pytest.mark.parametrize(("n", "most"), [(2000, 0.15), (20_000, 0.06)])
def test_few_vectors_are_verified(n, most):
    """Neighbours are found by their collisions: of random vectors, the hardest case, few are verified."""
    v = np.random.default_rng(n).standard_normal((n, 64))
    block = neighbours.Block(np.arange(n), v, 7)
    norm = np.linalg.norm(v, axis=1)
    hit, queries_ = 0, range(0, n, n // 20)
    for q in queries_:
        cos = v @ v[q] / (norm * norm[q])
        cos[q] = -2
        hit += len(set(next(block.nearest([q], v[q : q + 1], 5))[0].tolist()) & set(np.argsort(-cos)[:5].tolist()))
    assert hit / (5 * len(queries_)) >= 0.9
    assert block.verified / (n * len(queries_)) < most


def test_repeated_query_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    twice = spark.createDataFrame([*rows, rows[50]], "vec_id long, embedding array<double>")
    one = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = lambda df: sorted(tuple(r) for r in neighbours.search(df, df.where("vec_id % 50 = 0")).collect() if r.query_id == 50)
    assert ask(twice) == ask(one) and len(ask(one)) == 5
    other = spark.createDataFrame([*rows, (50, rows[7][1])], "vec_id long, embedding array<double>")
    got = ask(other)
    assert len(got) == 10 and {r[2] for r in got if r[1] == 1} >= {7} and all(r[2] != 50 for r in got)


def test_a_chain_of_lookalikes_is_no_class(spark, monkeypatch):
    """60 documents, each at 0.73 to the next: they look alike, but none is linked, also where their group counts as large."""
    words = [f"w{i}" for i in range(100 + 59 * 15)]
    rows = [(i, " ".join(words[15 * i : 15 * i + 100])) for i in range(60)]
    for large in (jaccard.LARGE, 10):
        monkeypatch.setattr(jaccard, "LARGE", large)
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {(r.doc_id, r.class_id, r.n_links, r.is_kept) for r in got} == {(i, i, 0, True) for i, _ in rows}
