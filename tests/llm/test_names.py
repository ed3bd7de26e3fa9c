"""Columns of the caller that are named as helper columns, and rows that repeat key and text."""

import public_tokenizers
from pyspark.sql import functions as F

from plateworks.llm import bpe, mixing, names, packing, quality

HELPERS = """_row __row _in_ _made _key _text _hash _size _none _src _slice _start _at _n _words _lines _windows _placed _found _copy _time _order _label
target demand source_size size taken copies position order n_words n_lines bad rule kept base_failed ids decoded quality2 mix2 _ord _rounds _extra _slope _taken""".split()


def docs(spark):
    rows = [(i, f"a few words of text number {i} " * 3, "ab"[i % 2]) for i in range(40)] + [(None, None, None), (3, "x y", "a"), (3, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(c) for c in HELPERS})


def same(df, out):
    return all(r[c] == c for r in df.collect() for c in HELPERS if c != out)


def test_fresh():
    assert names.fresh("_a", ["_A", "__a", "b"]) == "___a" and names.fresh("x", []) == "x"


def test_quality_keeps_columns(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    judged = quality.judge(docs(spark), labels)
    assert judged.count() == 43 and same(judged, "quality")
    assert judged.where("doc_id is null").first().quality.n_words == 0
    kept = quality.keep(judged)
    assert set(kept.columns) == set(docs(spark).columns) and same(kept, None)


def test_mix_keeps_columns(spark):
    mixed = mixing.mix(docs(spark), border="whole")
    assert mixed.count() == 43 and same(mixed, "mix")
    assert same(mixing.by_position(mixed), "mix") and same(mixing.curriculum(mixed), "mix")
    assert same(mixing.mix(docs(spark), out="target"), "target")


def test_keyless_documents_are_spread(spark):
    rows = [(None, f"word {i} " * (i % 5), "s") for i in range(500)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slices=64).collect()
    assert len({r.mix.order for r in mixed}) > 300
    assert sum(r.mix.taken for r in mixed) == round(mixed[0].mix.target)


def test_encoding_keeps_columns(spark):
    rules = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    coded = bpe.encode(docs(spark), **rules)
    assert same(coded, "ids") and same(bpe.decode(coded, path=rules["path"]), "ids") is False
    assert {"doc_id", "_in_", "_row"} <= set(coded.columns)


def test_packing_splits_repeated_rows(spark):
    one = [(1, "the same words again")] * 300 + [(None, None)] * 5 + [(2, "others")]
    df = spark.createDataFrame(one, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = packing.write_packed(df, packing.folder_for(spark), path=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(folder).select("part").distinct().count() > 2
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in packing.read_packed(spark, folder, ids=False).collect())
    assert [k for _, k, _ in got] == [None] * 5 + [1] * 300 + [2]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
