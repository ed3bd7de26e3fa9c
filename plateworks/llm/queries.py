"""The opN_ queries, the pipeline and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plateworks.llm import bpe, chat, counts, jaccard, langid, lines, merkle, mixing, negatives, neighbours, packing, quality, scoring
from plateworks.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.by_position(mixing.mix(docs).drop("text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.position")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out), key="doc_id", text="text", lang="lang")
    said = langid.predict(docs.select("doc_id", "text"), model).drop("text")
    return said.select("doc_id", held_out.alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    both = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), **rules)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = counts.count_tokens(docs, path=public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels")).drop("text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judged.select("doc_id", *[F.col(f"quality.{c}") for c in names])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_hash")


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = packing.write_packed(docs, packing.folder_for(spark), path=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packing.read_packed(spark, folder, ids=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lowered = F.when(picked, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    made = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tree="source", key="doc_id", tampered={"text": lowered})
    return made.select("doc_id", "merkle.*", "source")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0, label=label)


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    held_out = F.coalesce(scoring.fold(F.col("doc_id")) == 2, F.lit(False))
    scored = scoring.score(docs, ~held_out, key="doc_id", text="text", **rules)
    return scored.select("doc_id", held_out.alias("held_out"), "lm.*")


OP6_SQL = r"""
with t as (select distinct conv_id, turn, role, text from conversations),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n from t),
e as (select *, md5(n || '|' || coalesce('r' || role, '') || '|' || coalesce('t' || text, '')) as m from r),
p as (select *, string_agg(m, '') over (partition by conv_id order by n) as k, count(*) over (partition by conv_id) as total from e),
f as (select k, min(conv_id) as conv_id, count(*) as n_copies from p where n = total group by k),
kept as (select conv_id, n_copies from f where k not in (select k from p where n < total))
select kept.conv_id, count(*) as n_turns, max(n_copies) as n_copies,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' order by n) as chat
from kept join p on kept.conv_id is not distinct from p.conv_id group by kept.conv_id
"""

OP4_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, text, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
o as (select *, row_number() over (order by source nulls last) - 1 as ord from s),
w as (select *, [3, 1, 2][(ord % 3 + 1)::int] as w, source_size * 4 as cap, (sum(source_size) over ()) * 3 as al from o),
p as (select *, al - coalesce(sum(cap) over b, 0) as lft, sum(w) over () - coalesce(sum(w) over b, 0) as wlft from w window b as (order by cap / w, ord rows between unbounded preceding and 1 preceding)),
f as (select *, cap * wlft <= w * lft as full_ from p),
r as (select *, al - sum(case when full_ then cap else 0 end) over () as rest, sum(case when full_ then 0 else w end) over () as wrest from f),
t as (select source, ord, source_size, case when full_ then (source_size * 2)::double else (w * rest)::double / (wrest * 2)::double end as target, [-0.5::double, 0.0::double, 0.5::double][(ord % 3 + 1)::int] as slope from r),
c as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::bigint as demand, t.slope,
      coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
      from d join t on d.source is not distinct from t.source),
q as (select *, case when source_size > 0 then floor(demand / source_size)::bigint else 0 end as rounds from c),
e as (select *, (rounds * size + greatest(0, least(size, demand - rounds * source_size - pos)))::bigint as taken, pos / demand as u from q)
select doc_id, size, source_size, target, taken,
  case when taken > 0 then round(case when slope = 0 then u else (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) end, 9) + 0.0 end as position
from e
"""

# crc32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce([4294967295::bigint] || list_transform(string_split({c}::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: list_reduce([xor(c, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_FIELD = "case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"


def _levels(name: str, group: str, most: int) -> str:
    """CTEs of the nodes (group, level, i, d, k: nodes of the level) of trees over name(group, i, d), and of their siblings."""
    steps = [f"{name}0 as (select {group}, 0 as level, i, d, count(*) over (partition by {group}) as k from {name})"]
    for n in range(1, most + 1):
        steps.append(f"{name}{n} as (select {group}, {n} as level, i // 16 as i, sha256(string_agg(d, '' order by i)) as d, count(*) over (partition by {group}) as k from {name}{n - 1} where k > 1 group by {group}, i // 16)")
    every = " union all ".join(f"select * from {name}{n}" for n in range(most + 1))
    steps.append(f"{name}_all as ({every})")
    steps.append(f"{name}_run as (select {group}, level, i // 16 as run, list(d order by i) as ds from {name}_all where k > 1 group by all)")
    return ",\n".join(steps)


OP11_SQL = f"""
with docs as (select doc_id, source, {_LEAF.format(text=_FIELD.format(c="text"))} as leaf, {_LEAF.format(text=_FIELD.format(c="(case when " + _CRC.format(c="doc_id") + " % 5 = 0 then translate(text, '" + ascii_uppercase + "', '" + ascii_lowercase + "') else text end)"))} as bent from documents),
t as (select coalesce('=' || source, '-') as g, row_number() over (partition by source order by doc_id, leaf, bent) - 1 as i, leaf as d, doc_id, source, bent from docs),
{_levels("t", "g", 5)},
s as (select '' as a, row_number() over (order by nullif(g, '-') nulls first) - 1 as i, d, g from t_all where k = 1),
{_levels("s", "a", 5)},
low as (select t.g, t.i, list(struct_pack(l := array_to_string(ds[:(t.i // pow(16, level)::bigint) % 16], ''), r := array_to_string(ds[(t.i // pow(16, level)::bigint) % 16 + 2:], '')) order by level) as p
  from t join t_run on t_run.g = t.g and t_run.run = t.i // pow(16, level + 1)::bigint group by all),
high as (select s.g, list(struct_pack(l := array_to_string(ds[:(s.i // pow(16, level)::bigint) % 16], ''), r := array_to_string(ds[(s.i // pow(16, level)::bigint) % 16 + 2:], '')) order by level) as p
  from s join s_run on s_run.run = s.i // pow(16, level + 1)::bigint group by all),
done as (select t.doc_id, t.source, t.d as leaf, t.bent, s.d as subroot, (select d from s_all where k = 1) as root, coalesce(low.p, []) || coalesce(high.p, []) as p
  from t join s on s.g = t.g left join low on low.g = t.g and low.i = t.i left join high on high.g = t.g),
folded as (select *, list_reduce([struct_pack(d := bent, l := '', r := '')] || list_transform(p, lambda x: struct_pack(d := '', l := x.l, r := x.r)), lambda a, b: struct_pack(d := sha256(b.l || a.d || b.r), l := '', r := '')).d as folded_root from done)
select doc_id, source, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.l || x.r), '')) as proof_sha256, folded_root, folded_root = root as verified from folded
"""

OP12_SQL = r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as s from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b as p, n.b, p.s as ps, n.s as ns, row_number() over (partition by p.a, p.b order by n.s desc, n.b) as r
  from p join s n on n.a = p.a and not n.same and 50 * p.s <= 100 * n.s and 100 * n.s <= 95 * p.s)
select a as anchor_id, p as positive_id, r::int as rank, b as negative_id, ps as positive_score, ns as negative_score from n where r <= 3
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_nearest": op3_nearest,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_packed_ids": op10_packed_ids,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lm_score": op13_lm_score,
}
SQL: dict[str, str] = {
    "op11_merkle_manifest": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op4_mix_sources": OP4_SQL,
    "op6_chat_format": OP6_SQL,
}


def queries() -> dict[str, Query]:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
