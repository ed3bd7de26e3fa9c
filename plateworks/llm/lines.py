"""Line dedup by a segment-partition edit join (DataFrame functions only).

Two lines within ``most`` edits, cut into most + 1 segments, share one of them unchanged and at nearly the same place. Every distinct line puts
its segments into an index under (length, number, text); every line probes, for its own and each shorter length within
reach, the substrings that can be such a segment: those that a match to the left and to the right leaves possible, 5, 4 and 3 of
them for two edits and a difference in length of 0, 1 and 2. Index and probes are hashes, joined by equality. What meets is verified by an edit
distance whose band of 2 * most + 1 diagonals is a bit vector for each number of edits, all stepped forward by shifts and masks, a character at a time.

One measure holds for all lengths: lines are near if they are within ``most`` edits and within one edit for each ``per`` characters of the shorter
one, so that of very short lines only exact copies are near.

Lines are compared as distinct lines, so that a line of a third of all documents is one row; of each the first occurrence stays. What is asked of
a line is whether an earlier one is near, not with how many it pairs. A key that more than HOT lines put into the index (numbered lines of one template do)
is left out of the join: its lines come together in blocks of bounded bytes, a pair of blocks is one row, and a line stops at the first earlier
one that is near. Each block of probes first meets one block of the index, and only what has found nothing there meets the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.llm.names import packed, unpacked
from plateworks.llm.store import checkpointed, written

#: Edits within which lines are near duplicates, and characters that each edit takes at least.
EDITS, PER = 2, 12
#: Lines under one key of the index up to which they are joined row by row.
HOT = 32
#: Bytes of lines in a block of a hot key, on average.
BLOCK_BYTES = 1 << 16
#: Two 64-bit hashes tell lines apart; behind the table of distinct lines their number does, which takes far less room in a shuffle.
NAME, ID = ["_h1", "_h2"], ["_u"]
#: Characters of a chunk that is compared as a whole.
CHUNK = 12
_LETTERS = "etaoinshrdlucmfw"


def distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of a and b, no null among them, or most + 1 if it is over most: one bit vector of diagonals for each number of edits.

    Bit j of vector d after i characters of a: those are at most d edits from the first i + j - most characters of b.
    """
    full = (1 << (2 * most + 1)) - 1
    # Let-bindings: transform over an array of one evaluates its argument once.
    one = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.char_length(a).alias("m"), F.char_length(b).alias("n")))

    def both(s: Column) -> Column:
        start = F.array(*[F.lit(sum(1 << j for j in range(most, min(2 * most, most + d) + 1))).cast("int") for d in range(most + 1)])

        def step(state: Column, at: Column) -> Column:
            bits = [F.when(F.get(s["y"], at + j - most) == F.get(s["x"], at), 1 << j).otherwise(0) for j in range(2 * most + 1)]
            match = reduce(lambda p, q: p + q, bits)
            new = [state[0].bitwiseAND(match)]
            for d in range(1, most + 1):
                before, now = state[d - 1], new[d - 1]
                new.append(state[d].bitwiseAND(match).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(now, 1)).bitwiseAND(F.lit(full)))
            return F.array(*new)

        last = F.aggregate(F.sequence(F.lit(0), s["m"] - 1), start, step)
        place = s["n"] - s["m"] + most
        # A vector holds what those of fewer edits hold, so the distance is the number of vectors without the bit.
        return F.aggregate(last, F.lit(0), lambda d, v: d + (F.getbit(v, place) == 0).cast("int"))

    shorter, off = F.least(F.char_length(a), F.char_length(b)), F.abs(F.char_length(a) - F.char_length(b))
    over = F.lit(most + 1)
    return F.when(off > most, over).when(shorter == 0, off).otherwise(F.get(F.transform(one, both), F.lit(0)))


def within(a: Column, b: Column, most: int) -> Column:
    """Whether a and b, no null among them, are within so many edits."""
    return distance(a, b, most) <= most


def allowed(shorter: Column, most: int, per: int) -> Column:
    """Edits that a pair may be apart, by the length of the shorter line."""
    return F.least(F.lit(most), F.floor(shorter / per).cast("int"))


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line: the last ones are longer by one where it does not divide."""
    base, rest = F.floor(length / parts), length % parts
    short = parts - rest
    start = base * i + F.greatest(F.lit(0), F.lit(i) - short)
    return (start + 1).cast("int"), (base + (F.lit(i) >= short).cast("int")).cast("int")


def index_hashes(line: Column, length: Column, most: int) -> Column:
    """Hashes of a line's segments, by their number."""
    return F.array(*[F.hash(F.substring(line, *_segment(length, i, most + 1))) for i in range(most + 1)])


def _places(most: int) -> list[tuple[int, int, int]]:
    """(characters fewer, segment, shift) of all substrings that a line probes for."""
    return [
        (less, i, shift)
        for less in range(most + 1)
        for i in range(most + 1)
        for shift in range(max(-i, less - (most - i)), min(i, less + (most - i)) + 1)
    ]


def probe_hashes(line: Column, length: Column, most: int) -> Column:
    """Hashes of all substrings that can be a segment of a line shorter by at most ``most`` characters, in the order of _places."""
    out = []
    for less, i, shift in _places(most):
        start, n = _segment(length - less, i, most + 1)
        out.append(F.hash(F.substring(line, start + shift, n)))
    return F.array(*out)


def _sketch(line: Column) -> Column:
    """Whether the count of each of some frequent letters is odd, a bit for each: an edit turns two bits at most."""
    odd = lambda c: (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))).bitwiseAND(F.lit(1)).cast("long")
    return reduce(lambda p, q: p.bitwiseOR(q), [F.shiftleft(odd(c), i) for i, c in enumerate(_LETTERS)])


def _cut_sketches(line: Column, most: int) -> Column:
    """(g, w) of a line, from one array of its characters.

    g: whether each of 64 hashes of pairs of neighbouring characters comes an odd number of times: an edit takes two pairs and makes two at most.
    w: hashes of its chunks of CHUNK characters, as they are (the first array) and moved by up to ``most`` characters either way.
    """
    one = F.array(F.struct(F.split(line, "").alias("c"), F.char_length(line).alias("n")))

    def each(s: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(F.get(s["c"], i - 1), F.get(s["c"], i)).bitwiseAND(F.lit(63)))
        pairs = F.aggregate(F.sequence(F.lit(1), s["n"] - 1), F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(bit(i)))
        at = F.sequence(F.lit(0), F.floor(s["n"] / CHUNK).cast("int"))
        moved = lambda j: F.transform(at, lambda k: F.when(k * CHUNK + j >= 0, F.hash(F.slice(s["c"], F.greatest(k * CHUNK + j, F.lit(0)) + 1, CHUNK))))
        return F.struct(F.when(s["n"] > 1, pairs).otherwise(F.lit(0).cast("long")).alias("g"), F.array(*[moved(j) for j in _moves(most)]).alias("w"))

    return F.get(F.transform(one, each), F.lit(0))


def _moves(most: int) -> list[int]:
    return sorted(range(-most, most + 1), key=lambda j: (abs(j), j))


def _chunks_alike(a: Column, b: Column, most: int) -> Column:
    """Whether all but ``most`` chunks of a stand in b, moved by so many characters at most: each edit spoils one, and moves the others by one."""
    whole = F.slice(a["w"][0], 1, F.size(a["w"][0]) - 1)
    there = lambda h, k: reduce(lambda p, q: p | q, [F.coalesce(F.get(b["w"][i], k) == h, F.lit(False)) for i in range(2 * most + 1)])
    return F.size(F.filter(whole, lambda h, k: ~there(h, k))) <= most


def _ids(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(1), line).alias("_h2")]


def coded(lines: DataFrame, most: int) -> DataFrame:
    """lines (_line and others) with _n (length), the name, _i and _p (hashes of segments and probes), without the text."""
    others = [c for c in lines.columns if c != "_line"]
    d = lines.withColumn("_n", F.char_length("_line"))
    line, n = F.col("_line"), F.col("_n")
    return d.select(*others, "_n", *_ids(line), index_hashes(line, n, most).alias("_i"), probe_hashes(line, n, most).alias("_p"))


def entries(distinct: DataFrame, most: int, ids: Sequence[str] = NAME) -> tuple[DataFrame, DataFrame]:
    """(_k, ids) of the index and (_k, ids, _longer) of the probes of distinct coded lines. _longer: the probe is for shorter lines."""
    parts, places = most + 1, _places(most)
    less, nth = (F.array(*[F.lit(p[k]).cast("long") for p in places]) for k in (0, 1))

    def keyed(hashes: str, length: Column, number: Column, *more: Column) -> DataFrame:
        e = distinct.select(*ids, "_n", F.posexplode(hashes).alias("_at", "_h"))
        # Length and number of the segment stand above its hash in one number.
        key = F.shiftleft(length * parts + number, 32).bitwiseOR(F.col("_h").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        return e.select(key.alias("_k"), *ids, *more)

    n = F.col("_n").cast("long")
    fewer = F.get(less, F.col("_at"))
    return keyed("_i", n, F.col("_at").cast("long")), keyed("_p", n - fewer, F.get(nth, F.col("_at")), (fewer > 0).alias("_longer"))


#: Rows up to which a set of keys goes to all executors (16 bytes each); a larger one is joined by shuffling both sides.
SMALL = 200_000


def _semi(left: DataFrame, right: DataFrame, on, how: str = "left_semi") -> DataFrame:
    return left.join(F.broadcast(right) if right.count() <= SMALL else right, on, how)


def _near(a: Column, b: Column, most: int, per: int) -> Column:
    """Whether two structs (s, g, w, line, n) are near: letters, pairs of letters and chunks spare most pairs the distance."""
    odd = lambda c, bits: F.bit_count(a[c].bitwiseXOR(b[c])) <= bits * most
    alike = odd("s", 2) & odd("g", 4) & _chunks_alike(a, b, most)
    return alike & (distance(a["line"], b["line"], most) <= allowed(F.least(a["n"], b["n"]), most, per))


def _joined(index: DataFrame, probes: DataFrame, ids: Sequence[str] = NAME) -> DataFrame:
    """(a, b): structs of the ids of lines that meet under a key, each pair once."""
    a, b = (F.struct(*[F.col(f"{s}.{c}") for c in ids]) for s in "ip")
    met = index.alias("i").join(probes.alias("p"), "_k").select(a.alias("a"), b.alias("b"), "_longer")
    return met.where((F.col("a") != F.col("b")) & (F.col("_longer") | (F.col("a") < F.col("b")))).select("a", "b").distinct()


def _blocks(side: DataFrame, texts: DataFrame, hot: DataFrame, count: str, name: str, block_bytes: int) -> DataFrame:
    """(_k, _ib, _pb, name_block, name): blocks of one side's lines under hot keys, as arrays of structs by rising place. hot is small or shuffled; a block is bounded by its bytes."""
    n = F.greatest(F.lit(1), F.ceil(F.col(count) * (F.col("_n") + 64) / block_bytes)).cast("int")
    d = side.join(hot, "_k").join(texts, ID)
    d = d.withColumn("_b", F.pmod(F.xxhash64(F.lit(name), *ID), n).cast("int"))
    line = F.struct("_first", *ID, F.col("_s").alias("s"), F.col("_g").alias("g"), F.col("_w").alias("w"), F.col("_line").alias("line"), F.col("_n").alias("n"))
    return d.groupBy("_k", "_b").agg(F.array_sort(F.collect_set(line)).alias(name))


def _hot_near(index: DataFrame, probes: DataFrame, hot: DataFrame, texts: DataFrame, most: int, per: int, block_bytes: int) -> DataFrame:
    """Ids of the lines under hot keys that are near an earlier one. texts: (id, _line, _n, _s, _g, _w, _first). hot: (_k, _ci, _cp)."""
    left = written(_blocks(index, texts, hot, "_ci", "I", block_bytes), "index-blocks").withColumnRenamed("_b", "_ib")
    right = written(_blocks(probes.drop("_longer"), texts, hot, "_cp", "P", block_bytes), "probe-blocks").withColumnRenamed("_b", "_pb")
    sizes = left.groupBy("_k").agg((F.max("_ib") + 1).alias("_gi")).join(right.groupBy("_k").agg((F.max("_pb") + 1).alias("_gp")), "_k")
    left, right = left.join(sizes, "_k"), right.join(sizes, "_k").withColumn("_home", F.col("_pb") % F.col("_gi"))
    earlier = lambda x, y: (x["_first"] < y["_first"]) & _near(x, y, most, per)
    # Lines of one length probe for each other; only longer probes are left the other way round.
    by_index = F.filter("P", lambda y: F.exists("I", lambda x: earlier(x, y)))
    by_probe = F.filter("I", lambda x: F.exists("P", lambda y: (y["n"] > x["n"]) & earlier(y, x)))

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ids(met: DataFrame, *found: Column) -> DataFrame:
        # A number of partitions, as few bytes mean much work here: adaptive execution would put them together.
        lines = met.repartition(parts, "_k", "_ib", "_pb").select(F.explode(F.concat(*found)).alias("l"))
        return lines.select(*[F.col(f"l.{c}") for c in ID]).distinct()

    def open_(blocks: DataFrame, of: str, *by: str) -> DataFrame:
        """The blocks without the lines that are near already."""
        each = blocks.select("_k", *by, F.explode(of).alias("l"), *[F.col(f"l.{c}").alias(c) for c in ID])
        return _semi(each, first, ID, "left_anti").groupBy("_k", *by).agg(F.array_sort(F.collect_list("l")).alias(of))

    home = left.select("_k", "_ib", "I").join(right.select("_k", F.col("_home").alias("_ib"), "_pb", "P"), ["_k", "_ib"])
    first = checkpointed(ids(home, by_index, by_probe))
    probe_rest = open_(right.where("_gi > 1"), "P", "_gi", "_home", "_pb")
    probe_rest = probe_rest.withColumn("_ib", F.explode(F.filter(F.sequence(F.lit(0), F.col("_gi") - 1), lambda b: b != F.col("_home"))))
    index_rest = open_(left.where("_gi > 1"), "I", "_ib", "_gi", "_gp")
    index_rest = index_rest.withColumn("_pb", F.explode(F.filter(F.sequence(F.lit(0), F.col("_gp") - 1), lambda b: b % F.col("_gi") != F.col("_ib"))))
    more = ids(left.select("_k", "_ib", "I").join(probe_rest.select("_k", "_ib", "_pb", "P"), ["_k", "_ib"]), by_index)
    other = ids(index_rest.select("_k", "_ib", "_pb", "I").join(right.select("_k", "_pb", "P"), ["_k", "_pb"]), by_probe)
    return first.unionByName(more).unionByName(other)


def near_lines(distinct: DataFrame, lines_of, most: int = EDITS, per: int = PER, *, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Ids of the lines to which an earlier one is near.

    distinct: a written table of coded lines (id, name, _n, _first, _i, _p), each once. lines_of gives, for a table of (name, _first), their texts as (name, _line).
    """
    long = distinct.where(F.col("_n") >= per)
    index, probes = entries(long, most, ID)
    counted = index.groupBy("_k").agg(F.count("*").alias("_ci")).where(F.col("_ci") > hot)
    busy = checkpointed(counted)
    n_hot = busy.count()
    small = lambda df: F.broadcast(df) if n_hot <= SMALL else df
    usual = index.join(small(busy), "_k", "left_anti") if n_hot else index
    maybe = checkpointed(_joined(usual, probes, ID))
    asked = maybe.select(F.explode(F.array("a", "b")).alias("x")).select("x.*").distinct()
    if n_hot:
        hot_index, hot_probes = (checkpointed(e.join(small(busy), "_k", "left_semi")) for e in (index, probes))
        keys = small(busy.join(hot_probes.groupBy("_k").agg(F.count("*").alias("_cp")), "_k"))
        asked = asked.unionByName(hot_index.select(*ID)).unionByName(hot_probes.select(*ID)).distinct()
    named = checkpointed(_semi(distinct.select(*ID, *NAME, "_first"), asked, ID))
    texts = lines_of(named.select(*NAME, "_first")).join(named, NAME)
    texts = written(texts.select(*ID, "_first", "_line", F.char_length("_line").alias("_n"), _sketch(F.col("_line")).alias("_s"), _cut_sketches(F.col("_line"), most).alias("_c")), "line-texts")
    texts = texts.select(*ID, "_first", "_line", "_n", "_s", F.col("_c.g").alias("_g"), F.col("_c.w").alias("_w"))

    told = texts.select(F.struct(*ID).alias("_id"), F.struct("_first", F.col("_s").alias("s"), F.col("_g").alias("g"), F.col("_w").alias("w"), F.col("_line").alias("line"), F.col("_n").alias("n")).alias("_t"))
    x, y = told.toDF("a", "x"), told.toDF("b", "y")
    found = maybe.join(x, "a").join(y, "b").where(_near(F.col("x"), F.col("y"), most, per))
    later = found.select(F.when(F.col("x._first") < F.col("y._first"), F.col("b")).otherwise(F.col("a")).alias("l")).select("l.*").distinct()
    if not n_hot:
        return checkpointed(later)
    return checkpointed(later.unionByName(_hot_near(hot_index, hot_probes, keys, texts, most, per, block_bytes)).distinct())


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) == ""


def _lines(docs: DataFrame) -> DataFrame:
    """docs (_key, _hash, _text) as (_key, _hash, _pos, _line) for lines that are not blank."""
    split = docs.select("_key", "_hash", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    return split.where(~_blank(F.col("_line")))


def marks(docs: DataFrame, *, most: int = EDITS, per: int = PER, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_key, _hash, _firsts): for each document (_key, _hash, _text) in which a line stands first, those lines as (pos, near).

    Earlier is meant by the order of key (null last), hash of the text and place. All other lines of a document stand earlier
    elsewhere, so that nothing needs to be joined by line once more. near: an earlier line is near.
    """
    place = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_hash").alias("hash"), F.col("_pos").alias("pos"))
    all_lines = coded(_lines(docs), most).select(*NAME, place.alias("_at"), "_n", "_i", "_p")
    one = all_lines.groupBy(*NAME).agg(F.min("_at").alias("_first"), *[F.any_value(c).alias(c) for c in ("_n", "_i", "_p")])
    distinct = written(one.select(F.monotonically_increasing_id().alias("_u"), "*"), "distinct")

    def lines_of(named: DataFrame) -> DataFrame:
        # Only documents in which such a line stands first are cut again.
        homes = named.select(F.col("_first.hash").alias("_hash")).distinct()
        cut = _lines(_semi(docs, homes, "_hash")).select(*_ids(F.col("_line")), "_line")
        return _semi(cut, named.select(*NAME), NAME).dropDuplicates(NAME)

    later = near_lines(distinct, lines_of, most, per, hot=hot, block_bytes=block_bytes).withColumn("_near", F.lit(True))
    first = _semi(distinct.select(*ID, "_first"), later, ID, "left")
    mine = F.struct(F.col("_first.pos").alias("pos"), F.coalesce("_near", F.lit(False)).alias("near"))
    return first.groupBy(F.col("_first.key").alias("_key"), F.col("_first.hash").alias("_hash")).agg(F.collect_list(mine).alias("_firsts"))


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_key"), F.xxhash64(value).alias("_hash"), value.alias("_text"))


def _told(d: DataFrame, found: DataFrame) -> DataFrame:
    """d (_key, _hash, _sizes of its lines, and others) with n_lines, n_exact, n_near and dropped."""
    f = found.toDF("_k", "_h", "_firsts")
    d = d.join(f, d["_key"].eqNullSafe(f["_k"]) & (d["_hash"] == f["_h"]), "left").drop("_k", "_h")
    none = F.array().cast("array<struct<pos:int,near:boolean>>")
    d = d.withColumns({"_firsts": F.coalesce("_firsts", none), "_lines": _places_of(F.col("_sizes"))})
    near = F.filter("_firsts", lambda x: x["near"])
    stays = F.transform(F.filter("_firsts", lambda x: ~x["near"]), lambda x: x["pos"])
    n = F.size("_lines").cast("long")
    return d.withColumns({"n_lines": n, "n_exact": n - F.size("_firsts"), "n_near": F.size(near).cast("long"), "dropped": F.sort_array(F.array_except("_lines", stays))})


def _sizes_of(text: Column) -> Column:
    """Characters of each line of a text, less one and negative for blank lines."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(_blank(x), -1 - F.char_length(x)).otherwise(F.char_length(x)))


def _places_of(sizes: Column) -> Column:
    """Places (from 0) of the lines that are not blank."""
    return F.filter(F.transform(sizes, lambda n, i: F.when(n >= 0, i)), lambda i: i.isNotNull())


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = EDITS, per: int = PER) -> DataFrame:
    """(key, n_lines, n_exact, n_near, dropped, kept_chars) for each row of docs: what dedup_lines() does, without the texts."""
    slim = _slim(docs, key, text)
    d = slim.select("_key", "_hash", _sizes_of(F.col("_text")).alias("_sizes"))
    d = _told(d, marks(slim, most=most, per=per))
    left = F.filter("_sizes", lambda x, i: ~F.array_contains("dropped", i))
    # A line feed stands between lines.
    kept = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + F.when(x < 0, -1 - x).otherwise(x)) + F.greatest(F.size(left) - 1, F.lit(0))
    return d.select(F.col("_key").alias(key), "n_lines", "n_exact", "n_near", "dropped", kept.cast("long").alias("kept_chars"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = EDITS, per: int = PER, out: str = "line_dedup") -> DataFrame:
    """docs with a struct column ``out``: n_lines (compared), n_exact, n_near, dropped (places), kept_text.

    A line is dropped as exact if it stands elsewhere earlier, by the order of key (null last), hash of the text and place; as near if an earlier
    line is within ``most`` edits and within one for each ``per`` characters of the shorter one, whether or not that one stays. dropped: the places
    (from 0) of such lines in the split by line feed. kept_text is the text without them. Blank lines are neither compared nor dropped, all
    others are, whatever their length. Null texts stay null, with no lines; empty texts stay empty. Null keys come last in the order and may repeat. Rows that
    repeat key and text keep the same lines. A column named as out is replaced, other columns stay, whatever their names. No rows give no rows.
    """
    slim = _slim(docs, key, text)
    value = F.coalesce(F.col(text), F.lit(""))
    d = packed(docs, _key=F.col(key), _hash=F.xxhash64(value), _text=F.col(text), _sizes=_sizes_of(value))
    d = _told(d, marks(slim, most=most, per=per))
    rest = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    text_left = F.when(F.size("dropped") > 0, rest).otherwise(F.col("_text"))
    made = F.struct("n_lines", "n_exact", "n_near", "dropped", text_left.alias("kept_text"))
    return unpacked(d, docs.columns, out, made)
