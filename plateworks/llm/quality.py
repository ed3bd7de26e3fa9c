"""Quality rules: base measures of texts and a decision list learned from labels (DataFrame functions only).

Sequential covering: labelled documents are cut into threshold bins and summed up to statistics (bins, grow or prune half,
label, count). A rule grows by the condition of the best information gain for the low-quality label, all candidates being
counted in one aggregation of the statistics; its last conditions are pruned while the other half's balance does not fall. A
rule that is precise enough on that half joins the list and what it covers leaves the statistics. The list is emitted as one
ordered CASE expression. Only sums by feature and bin come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.llm.names import fresh, packed, unpacked
from plateworks.llm.store import checkpointed

_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Labelled documents that the rules learn from at most (by the hash of their id; the bound holds in expectation).
LABELLED = 20_000
#: Thresholds tried for a feature.
BINS = 24
MAX_RULES, MAX_CONDITIONS = 8, 4
#: Least share of low-quality documents among what a rule covers in the prune half, and least number of them.
PRECISION, SUPPORT = 0.9, 3

FEATURES = ("n_words", "mean_word", "symbol_share", "bang_share", "upper_share", "dup_line_share", "repeat_share")


def _count(text: Column, chars: str) -> Column:
    """How many characters of a text are among chars."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def measures(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """docs with a struct column ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bang, n_upper.

    Words are runs of characters other than space and the controls 9 to 13. n_repeat_words counts the words that stand in a
    5-word window which the text holds twice or more. Null and empty texts have 0 everywhere. Columns named as out are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    d = packed(docs, _text=value, _words=F.filter(F.split(value, r"[\x20\x09-\x0D]+", -1), lambda x: x != ""), _lines=lines)
    value = F.col("_text")
    d = d.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(F.col("_hash"), i + k) for k in range(5)]))
    d = d.withColumn("_windows", F.when(n >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat no window, which a set of hashes tells at once; only the others sort theirs with the places.
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_placed", F.when(repeats, placed))

    def again(p: Column, x: Column, j: Column) -> Column:
        near = lambda k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        return near(j - 1) | near(j + 1)

    found = F.sort_array(F.transform(F.filter("_placed", lambda x, j: again(F.col("_placed"), x, j)), lambda x: x["i"]))
    d = d.withColumn("_found", F.when(repeats, found))
    # A place covers 5 words, or those up to the next place.
    step = F.transform("_found", lambda i, j: F.coalesce(F.least(F.lit(5), F.get(F.col("_found"), j + 1) - i), F.lit(5)))
    covered = F.when(F.col("_found").isNull(), 0).otherwise(F.aggregate(step, F.lit(0), lambda a, x: a + x))
    made = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.translate(value, _SPACE, "")).cast("long").alias("word_chars"),
        _count(value, "#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count(value, "!").alias("n_bang"),
        _count(value, _UPPER).alias("n_upper"),
    )
    return unpacked(d, docs.columns, out, made)


def base_failed(m: Column) -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)


def features(m: Column) -> dict[str, Column]:
    """The features rules test, from the measures; 0 for texts without words."""
    share = lambda a, b: F.when(m[b] > 0, m[a] / m[b]).otherwise(F.lit(0.0))
    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "bang_share": share("n_bang", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """feature > threshold, or feature <= threshold if not above. bin: of the threshold."""

    feature: str
    above: bool
    threshold: float
    bin: int

    def on(self, cols: dict[str, Column]) -> Column:
        c = cols[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def on_bins(self) -> Column:
        c = F.col(f"_b_{self.feature}")
        return c > self.bin if self.above else c <= self.bin


Rule = tuple[Condition, ...]


def statistics(labelled: DataFrame, names: tuple[str, ...], bad: str, key: str, bins: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """(statistics, thresholds by feature): labelled rows by bins, half and label. Bin b of a value is the number of thresholds below it."""
    q = [(i + 1) / (bins + 1) for i in range(bins)]
    # Quantiles of each class, so that a rare class has thresholds of its own.
    asked = [F.percentile_approx(F.when(F.col(bad) == side, F.col(f)), q, 10_000).alias(f"{f}_{int(side)}") for f in names for side in (True, False)]
    row = labelled.agg(*asked).first()
    edges = {f: sorted({x for side in (0, 1) for x in row[f"{f}_{side}"] or []}) for f in names}
    below = lambda f: F.size(F.filter(F.array(*[F.lit(x) for x in edges[f]]).cast("array<double>"), lambda e: e < F.col(f)))
    cut = {f"_b_{f}": below(f) for f in names}
    half = (F.pmod(F.xxhash64(F.lit("half"), F.col(key)), F.lit(3)) == 0).alias("_prune")
    binned = labelled.select(half, F.col(bad).alias("_bad"), *[c.alias(n) for n, c in cut.items()])
    return binned.groupBy("_prune", "_bad", *cut).agg(F.count("*").alias("_n")), edges


def grow(stats: DataFrame, edges: dict[str, list[float]], most: int) -> Rule:
    """The conjunction that information gain builds for the low-quality label in the grow half."""
    names, rule = [f for f in edges if edges[f]], ()
    rows = stats.where(~F.col("_prune"))
    while len(rule) < most and names:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in names]))
        counted = rows.select("_bad", "_n", each.alias("e")).groupBy("e.f", "e.b").agg(F.sum(F.when(F.col("_bad"), F.col("_n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("_bad"), 0).otherwise(F.col("_n"))).alias("q")).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in names}
        for r in counted:
            by[r["f"]][r["b"]] = (r["p"], r["q"])
        all_p, all_q = (sum(v[i] for v in by[names[0]].values()) for i in (0, 1))
        if not all_p or not all_q:
            break
        best, gain = None, 1e-9
        for f in names:
            p = q = 0
            for b, t in enumerate(edges[f]):
                x = by[f].get(b, (0, 0))
                p, q = p + x[0], q + x[1]
                for above, (cp, cq) in ((False, (p, q)), (True, (all_p - p, all_q - q))):
                    if cp < SUPPORT:
                        continue
                    g = cp * (math.log2(cp / (cp + cq)) - math.log2(all_p / (all_p + all_q)))
                    if g > gain:
                        best, gain = Condition(f, above, t, b), g
        if best is None:
            break
        rule = (*rule, best)
        rows = rows.where(best.on_bins())
    return rule


def prune(stats: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The shortest beginning of the rule with the best balance in the prune half, and what it covers there: low-quality, other."""
    rows, asked, so_far = stats.where(F.col("_prune")), [], F.lit(True)
    for i, c in enumerate(rule):
        so_far = so_far & c.on_bins()
        asked += [F.sum(F.when(so_far & F.col("_bad"), F.col("_n")).otherwise(0)).alias(f"p{i}"), F.sum(F.when(so_far & ~F.col("_bad"), F.col("_n")).otherwise(0)).alias(f"q{i}")]
    r = rows.agg(*asked).first()
    seen = [(r[f"p{i}"] or 0, r[f"q{i}"] or 0) for i in range(len(rule))]
    balance = [(p - q) / (p + q) if p + q else -1.0 for p, q in seen]
    i = max(range(len(rule)), key=lambda j: (balance[j], -j))
    return rule[: i + 1], *seen[i]


def learn(labelled: DataFrame, names: tuple[str, ...] = FEATURES, *, bad: str = "bad", key: str = "doc_id", bins: int = BINS, rules: int = MAX_RULES, conditions: int = MAX_CONDITIONS, precision: float = PRECISION) -> list[Rule]:
    """The ordered rules for low quality. No labelled rows, or one label only, give none. Null labels take no part."""
    stats, edges = statistics(labelled.where(F.col(bad).isNotNull()), names, bad, key, bins)
    stats, found = checkpointed(stats), []
    while len(found) < rules:
        rule = grow(stats, edges, conditions)
        if not rule:
            break
        rule, p, q = prune(stats, rule)
        if p < SUPPORT or p < precision * (p + q):
            break
        found.append(rule)
        covered = F.lit(True)
        for c in rule:
            covered = covered & c.on_bins()
        stats = stats.where(~covered)
    return found


def verdict(rules: list[Rule], cols: dict[str, Column]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out, first = F.lit(0), None
    for i, rule in enumerate(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.on(cols)
        first = F.when(holds, i + 1) if first is None else first.when(holds, i + 1)
    return out if first is None else first.otherwise(0)


def sampled(docs: DataFrame, labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """Labelled documents with _label, about ``most`` at most: labels by the hash of their key, so of bounded size for a broadcast."""
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    n = named.count()
    if n > most:
        named = named.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    # A document with several labels takes the lower one; about `most` rows of two numbers.
    one = named.groupBy(key).agg(F.min(label).alias("_label"))
    return docs.join(F.broadcast(one), key)


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED, out: str = "quality") -> DataFrame:
    """docs with a struct column ``out``: the measures, base_failed, rule (the first rule that rejects it, 0 if none) and kept.

    Rules learn from at most about ``labelled`` labelled documents (label 0 is low quality) that do not fail the base rules.
    Without labels nothing but the base rules rejects. Null keys have no label. Repeated rows get the same verdict; repeated labels of a
    document count as the lowest. Null and empty texts fail the base rules. A column named as out is replaced.
    """
    known = sampled(docs.select(key, text), labels.select(key, label), key, label, labelled)
    m, cols = F.col("quality"), features(F.col("quality"))
    bad = F.when(~base_failed(m), F.col("_label") == 0)
    # Written first: a filter would else be pushed below the measures and compute them anew inside their own functions.
    told = checkpointed(measures(known, text).select(key, bad.alias("bad"), *[c.alias(f) for f, c in cols.items()]))
    rules = learn(told, key=key)
    d = measures(docs, text, out)
    failed = base_failed(F.col(out))
    rule = verdict(rules, features(F.col(out)))
    return d.withColumn(out, F.col(out).withField("base_failed", failed).withField("rule", rule).withField("kept", ~failed & (rule == 0)))


def keep(judged: DataFrame, out: str = "quality") -> DataFrame:
    """The kept rows of what judge() returns, without its column.

    The row numbers hold the filter above the measures, which Spark would else compute again to push it below them.
    """
    row = fresh("_row", judged.columns)
    d = judged.withColumn(row, F.monotonically_increasing_id())
    return d.where(F.col(out)["kept"] & (F.col(row) >= 0)).drop(row, out)
