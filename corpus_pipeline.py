"""Corpus pipeline over documents: quality rules, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage is written as Parquet in the shared folder and read again by the next one. All but the last keep the columns that they get, whatever their
names; columns besides those of documents ride along. Null and empty texts have no words. Texts are whole, of any length. Rows that
repeat are rows each, unless a stage says otherwise, and no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.llm import bpe, jaccard, lines, mixing, quality
from plateworks.llm.names import fresh
from plateworks.llm.store import mark, release, written
from plateworks.sources import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject. A null or empty text has too few words and is rejected; rows that repeat are judged alike."""
    out = fresh("_quality", docs.columns)
    return quality.keep(quality.judge(docs, table(spark, sf_dir, "labels"), out=out), out=out)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier elsewhere, exactly or nearly; n_chars is counted again.

    A document of which no word is left is a copy of others and goes; one that had none to begin with stays. Of documents with the same lines, rows that
    repeat among them, the first by the operator's order keeps them. A null text stays null.
    """
    out = fresh("_lines", docs.columns)
    done = lines.dedup_lines(docs, out=out)
    left = F.col(f"{out}.kept_text")
    emptied = (F.size(f"{out}.dropped") > 0) & (F.length(F.translate(left, " \t\n\x0b\x0c\r", "")) == 0)
    done = done.where(~F.coalesce(emptied, F.lit(False)))
    changed = F.size(f"{out}.dropped") > 0
    n_chars = F.when(changed, F.char_length(left).cast("long")).otherwise(F.col("n_chars"))
    return done.withColumns({"text": left, "n_chars": n_chars}).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of 5-word Jaccard similarity 0.8 or more; of rows that repeat, one. Texts under five words, null ones among them, are in no class and stay."""
    return jaccard.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, sorted by training position. A null source is a source; documents without words are never taken."""
    out = fresh("_mix", docs.columns)
    return mixing.curriculum(mixing.mix(docs, border="whole", out=out), out=out).drop(out)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number, and whether decoding them gives the text back. A null text has no ids and comes back empty. Other columns go."""
    rules = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    # A digest stands for the text, which need not come back from the workers.
    slim = docs.select("doc_id", "source", "lang", "text", digest(F.coalesce("text", F.lit(""))).alias("_digest"))
    both = bpe.round_trip(slim, **rules)
    return both.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", (digest(F.col("decoded")) == F.col("_digest")).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", byte_bpe),
]

#: SQL can't express the learned rules, the joins under similarity or the byte-pair merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        begin = mark()
        made = stage(spark, docs, sf_dir)
        end = mark()
        docs = written(made, name)
        release(spark, begin, end)  # what the stage wrote on its way
    return docs
