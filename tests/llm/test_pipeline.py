"""The pipeline on the smallest tables against a plain version, stage by stage and as a whole."""

import hashlib
import re

import public_tokenizers
from pyspark.sql import functions as F
from test_encoding import ranks, tik  # noqa: F401
from test_similarity import classes, judged

import corpus_pipeline
from plateworks.llm import mixing, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lines(docs):
    told = judged([(d["doc_id"], d["text"]) for d in docs])
    out = []
    for d in docs:
        gone = told[d["doc_id"]][3]
        if gone:
            left = "\n".join(x for i, x in enumerate(d["text"].split("\n")) if i not in gone)
            if not WORD.search(left):
                continue
            d = d | {"text": left, "n_chars": len(left)}
        out.append(d)
    return out


def plain_distinct(docs):
    least = classes([(d["doc_id"], d["text"]) for d in docs])
    return [d for d in docs if least[d["doc_id"]][0] == d["doc_id"]]


def plain_mix(docs):
    """(key, copies) by water-filling step by step, and documents taken whole in the order of md5."""
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(d["doc_id"])
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    whole = {s: sum(size[k] for k in by[s]) for s in sources}
    rest, open_, target = 1.5 * sum(whole.values()), set(sources), {}
    while True:
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level >= 2 * whole[s]}
        if not full:
            break
        target |= {s: 2 * whole[s] for s in full}
        rest, open_ = rest - sum(2 * whole[s] for s in full), open_ - full
    target |= {s: weight[s] * level for s in open_}
    out = {}
    for s in sources:
        demand = int(target[s] + 0.5)
        keys = sorted(by[s], key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
        while demand > 0 and any(size[k] for k in keys):
            for k in keys:
                if size[k] and demand * 2 >= size[k] and demand > 0:
                    out[k] = out.get(k, 0) + 1
                demand -= size[k]
    return out


def test_pipeline_is_its_plain_version(spark, tik):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r.asDict() for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()]
    judged_ = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {d["doc_id"] for d in kept} == {r.doc_id for r in judged_ if not r.quality.base_failed and r.quality.rule == 0}
    lined = plain_lines(kept)
    once = plain_distinct(lined)
    copies = plain_mix(once)
    texts = {d["doc_id"]: d["text"] for d in once}
    want = sorted((k, n) for k, n in copies.items())
    got = corpus_pipeline.run(spark, SF).collect()
    count = {}
    for r in got:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.round_trip
    assert sorted(count.items()) == want


def test_stages_keep_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    names = ["_quality", "_lines", "_mix", "target", "_hash", "n_lines", "_words", "_order", "_row", "_key", "size"]
    docs = docs.withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert all(r[c] == c for r in docs.collect() for c in names)
    assert mixing.WORD == WORD.pattern and public_tokenizers.PATTERN
