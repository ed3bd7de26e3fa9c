"""The postorder log and proofs against plain recursion; nulls, repeats, clashing names, empty tables."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plateworks.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h([field(row[c]) for c in COLUMNS[:-1]] + [field(text)])


def plain(rows, bend):
    """doc row -> (leaf, subroot, root, proof, folded root), by levels of whole lists."""

    def tree(leaves):
        now, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
        while len(now) > 1:
            for i, place in enumerate(at):
                run = now[place // 16 * 16 : place // 16 * 16 + 16]
                proofs[i].append((run[: place % 16], run[place % 16 + 1 :]))
                at[i] = place // 16
            now = [h(now[a : a + 16]) for a in range(0, len(now), 16)]
        return now[0], proofs

    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in by[s]])
    root, top = tree([trees[s][0] for s in names])
    out = []
    for s, over in zip(names, top, strict=True):
        for r, low in zip(by[s], trees[s][1], strict=True):
            proof = low + over
            x = leaf(r, bend(r))
            for a, b in proof:
                x = h(a + [x] + b)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][0], root, h([y for a, b in proof for y in a + b]), x, x == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4097])
def test_positions_are_those_of_the_log(n):
    log = merkle.build([str(i) for i in range(n)], merkle.levels(n))
    assert [merkle.position(level, i, n) for level, i, _ in log] == list(range(len(log)))
    now = [str(i) for i in range(n)]
    while len(now) > 1:
        now = [h(now[a : a + 16]) for a in range(0, len(now), 16)]
    assert log[-1][2] == now[0]


def rows_of(spark, sizes):
    rows = [(i * 7 % 1009 if i % 50 else None, s, ["en", None][i % 2], i, ["Some TEXT", "ünï\n", None, "", "x" * 5000][i % 5]) for s, n in sizes for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


def test_manifest_of_trees_of_all_sizes(spark):
    # More sources than a run holds, one of them over a chunk of chunks' worth of leaves, repeated rows and ids, a null source and one named as its mark.
    sizes = [("big", 4500), ("mid", 300), (None, 40), ("-", 3), ("", 1), ("é", 17), *((f"s{i}", 1 + i % 3) for i in range(40))]
    df = rows_of(spark, sizes).withColumns({c: F.lit(c) for c in ("tree", "chunk", "leaf", "bent", "digest", "n", "total", "_key", "_tree", "merkle")})
    picked = F.coalesce(F.col("n_chars") % 5 == 0, F.lit(False))
    bent = F.when(picked, F.lower("text")).otherwise(F.col("text"))
    made = merkle.manifest(df, COLUMNS, tree="source", key="doc_id", tampered={"text": bent})
    got = sorted(str((r.doc_id, *r.merkle)) for r in made.collect())
    rows = [r.asDict() for r in df.select(*COLUMNS).collect()]
    assert got == plain(rows, lambda r: r["text"].lower() if r["n_chars"] % 5 == 0 and r["text"] is not None else r["text"])
    assert 0 < sum(x.endswith("False)") for x in got) < len(got)


def test_query_and_empty(spark, tmp_path):
    df = rows_of(spark, [("a", 30), ("b", 2)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    low = {c: c + 32 for c in range(65, 91)}
    bend = lambda r: r["text"].translate(low) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None else r["text"]
    want = plain([r.asDict() for r in df.collect()], bend)
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in got) == want
    assert merkle.manifest(df.where("false"), COLUMNS, tree="source", key="doc_id").collect() == []
