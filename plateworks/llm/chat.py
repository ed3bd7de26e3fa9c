"""Chat formatting after cumulative-snapshot collapse (DataFrame functions only).

A logger that writes a conversation after each turn leaves snapshots, each a prefix of the next. Every turn gets the rolling
hash of the turns up to it: running sums of two 64-bit hashes of (rank, role, text). A conversation whose last hash occurs in
a longer one is a prefix of it; an anti-join keeps the others. Of conversations with the same turns the least key stays. Only
then are the kept ones rendered.

The hashes of a frequent first turn are summed up before they are shuffled. A window's running sums hold one row at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plateworks.llm.store import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_HASH = ["_n", "_h1", "_h2"]


def turn_hashes(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The distinct turns as (_conv, _turn, _role, _text) with _n (rank in the conversation), _h1 and _h2 (hashes of its first _n turns)."""
    t = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text")).distinct()
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    t = t.withColumn("_n", F.row_number().over(order).cast("long"))
    parts = [F.col("_n"), F.col("_role").isNull(), F.col("_role"), F.col("_text").isNull(), F.col("_text")]
    # Sums wrap around; a decimal keeps them exact in ANSI mode, and its remainder is the rolling hash.
    h = [F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)") for seed in (11, 97)]
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wrap = F.lit(2**62).cast("decimal(20,0)")
    return t.withColumns({f"_h{i + 1}": F.pmod(F.sum(x).over(upto), wrap).cast("long") for i, x in enumerate(h)})


def collapse(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hashed turns, maximal conversations as (_conv, _n, _copies)).

    Repeated rows count once. Turns are ordered by turn, role and text (nulls first), so a turn number may repeat or be null.
    Null roles and texts equal only nulls. Rows whose conversation is null make one conversation. No rows give no rows.
    """
    hashed = written(turn_hashes(turns, conv, turn, role, text), "turns")
    last = hashed.groupBy("_conv").agg(F.max_by(F.struct(*_HASH), "_n").alias("l")).select("_conv", "l.*")
    full = last.groupBy(*_HASH).agg(F.min("_conv").alias("_least"), F.count("*").alias("_copies"), F.count_if(F.col("_conv").isNull()).alias("_nulls"))
    # A turn that another follows ends a proper prefix; the hashes of such prefixes are what the anti-join looks up.
    follows = F.lead("_n").over(Window.partitionBy("_conv").orderBy("_n"))
    prefixes = hashed.withColumn("_next", follows).where(F.col("_next").isNotNull()).select(*_HASH).distinct()
    kept = full.join(prefixes, _HASH, "left_anti")
    # min() passes over nulls: the null conversation stands for its copies only if no other has the same turns.
    return hashed, kept.select(F.col("_least").alias("_conv"), "_n", "_copies")


def render(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", out: str = "chat") -> DataFrame:
    """A row for each maximal conversation: conv, n_turns, n_copies (logged conversations with just these turns) and its rendering.

    A turn is rendered as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed; a null role as "unknown", a null text as
    empty, and a marker inside a text with a space after its ``<`` so that it can't end or begin a turn. What collapse() says
    of nulls and repeats holds. Other columns are not read.
    """
    hashed, kept = collapse(turns, conv=conv, turn=turn, role=role, text=text)
    body = F.coalesce(F.col("_text"), F.lit(""))
    for marker in (OPEN, CLOSE):
        body = F.replace(body, F.lit(marker), F.lit("< " + marker[1:]))
    line = F.concat(F.lit(OPEN), F.coalesce("_role", F.lit("unknown")), F.lit("\n"), body, F.lit(CLOSE + "\n"))
    same = F.col("h._conv").eqNullSafe(F.col("k._conv"))
    rows = hashed.select("_conv", "_n", line.alias("_line")).alias("h").join(kept.select("_conv", "_copies").alias("k"), same).select("h._conv", "h._n", "_line", "_copies")
    made = rows.groupBy("_conv").agg(F.count("*").alias("n_turns"), F.max("_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_l"))
    return made.select(F.col("_conv").alias(conv), "n_turns", "n_copies", F.array_join(F.col("_l._line"), "").alias(out))
