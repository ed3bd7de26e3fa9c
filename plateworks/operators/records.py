"""The text of a drawing as a table of records and back.

A text has one record a line: PART (the head), FEAT, BLEND, VIEW, a row for each primitive, DIM. ``parse`` gives a row for each of them with the
fields it has, and with the view that a primitive's row stands under; ``emit`` writes the same lines again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of primitives by type.
TYPES = {"line": "L", "polyline": "PL", "circle": "CI", "arc": "A", "point": "PT", "ellipse": "EL"}
#: Columns of a record besides the drawing's id and ``n``, by which the records of a drawing are ordered.
FIELDS = {
    "record": "string", "view": "string", "axes": "array<string>", "name": "string", "kind": "string", "role": "string", "axis": "string", "dir": "string", "sel": "string",
    "value": "double", "r": "double", "rmaj": "double", "rmin": "double", "rot": "double", "c": "array<double>", "pts": "array<array<double>>", "arc": "array<double>", "tags": "array<string>", "dias": "array<double>",
    "bbox": "array<double>", "grid": "long", "ext": "double", "low": "double", "high": "double",
}
_N = r"-?\d+(?:\.\d+)?"


def number(v: Column) -> Column:
    """Canonical text of a number: two decimals without trailing zeros, no negative zero."""
    v = v.cast("double")
    # Formatter and pattern are slow: whole numbers and decimals, which round alike, go without. What has no decimal (infinite or too large) is left.
    whole = F.when((F.abs(v) < 1e15) & (v == F.floor(v)), v.cast("long").cast("string"))
    decimal = v.try_cast("decimal(38,2)").cast("string")
    short = F.rtrim(F.rtrim(decimal, F.lit("0")), F.lit("."))
    return F.when(v.isNotNull(), F.coalesce(whole, short, F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")))


def complete(df: DataFrame, key: str) -> DataFrame:
    """df as a table of records: fields that it lacks are null."""
    return df.select(key, F.col("n").cast("long").alias("n"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])


def parse(df: DataFrame, key: str, text: str) -> DataFrame:
    """The records of the texts (key, text). n is the number of the line.

    Coordinate tokens are read as their numbers. Empty lines, lines of no known kind, and primitives before any view or without geometry are
    passed over; a field that can't be read is null. A null text has no records.
    """
    plain = F.regexp_replace(text, r"<\|coord_0*(\d+)\|>", "$1")
    lines = df.select(key, F.posexplode(F.split(plain, r"\r\n|\r|\n")).alias("n", "line")).withColumn("t", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "))
    first = F.col("t")[0]
    view = F.when(first == "VIEW", F.struct(F.get("t", F.lit(1)).alias("name"), F.col("n").alias("at")))
    lines = lines.withColumn("under", F.last(view, ignorenulls=True).over(Window.partitionBy(key).orderBy("n")))
    token = lambda i: F.get("t", F.lit(i))
    is_row = first.isin(*TYPES.values()) & F.col("under").isNotNull() & (F.size("t") >= 3)
    record = F.when(first.isin("PART", "FEAT", "BLEND", "VIEW", "DIM"), first).when(is_row, "ROW")
    d = lines.withColumn("record", record).where("record is not null")
    # A primitive's tokens from the third on are found by one pattern each in their text, once a row: each column below is used several times, so it is made before.
    row = F.when(F.col("record") == "ROW", F.concat(F.lit(" "), F.array_join(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0))), " "), F.lit(" ")))
    d = d.select(key, "n", "record", "t", "under", F.array_join("t", " ").alias("_line"), row.alias("_row"))
    of = lambda kind, c: F.when(F.col("record") == kind, c)
    last = lambda mark, pattern: F.regexp_extract("_row", rf"(?s)^.* {mark}({pattern}) ", 1)
    every = lambda mark, pattern: F.regexp_extract_all("_row", F.lit(rf"(?<= {mark})({pattern})(?= )"), 1)
    arc = F.when(F.col("t")[0] == TYPES["ellipse"], last("e", rf"{_N}\.\.{_N}")).otherwise(last("a", rf"{_N}\.\.{_N}"))
    found = {"_c": last("c", f"{_N},{_N}"), "_pts": every("", f"{_N},{_N}"), "_arc": arc, "_tags": last("", r"C\d+(?:,C\d+)*"), "_dias": every("DIA", _N)} | {f"_{k}": last(m, _N) for k, m in {"r": "r", "rmaj": "rj", "rmin": "rn", "rot": "rot"}.items()}
    d = d.withColumns(found)
    given = lambda name: F.regexp_extract("_line", rf" {name}=(\S*)", 1)
    have = lambda name: F.nullif(given(name), F.lit(""))
    real = lambda c: c.try_cast("double")
    reals = lambda a: F.transform(a, lambda v: v.try_cast("double"))
    # An empty text would cost try_cast an exception.
    some = lambda name, c: F.when(F.col(name) != "", c)
    many = lambda name, f: F.when(F.size(name) > 0, F.transform(name, f))
    span = F.regexp_extract_all(token(6), F.lit(rf"^([A-Za-z])({_N})\.\.({_N})$"), 0)
    group = lambda i: F.when(F.size(span) > 0, F.regexp_extract(token(6), rf"^([A-Za-z])({_N})\.\.({_N})$", i))
    columns = {
        "view": F.when(F.col("record") == "VIEW", token(1)).when(F.col("record") == "ROW", F.col("under.name")).when(F.col("record") == "DIM", token(5)),
        "axes": of("VIEW", F.split(F.coalesce(have("axes"), F.lit(",")), ",")),
        "name": F.when(F.col("record").isin("FEAT", "DIM"), token(1)),
        "kind": F.when(F.col("record").isin("FEAT", "DIM"), token(2)).when(F.col("record") == "BLEND", token(1)).when(F.col("record") == "ROW", first),
        "role": F.when(F.col("record") == "ROW", token(1)).when(F.col("record") == "DIM", token(3)),
        "axis": F.when(F.col("record") == "FEAT", F.coalesce(have("axis"), F.lit("-"))).when(F.col("record") == "DIM", group(1)),
        "dir": of("FEAT", have("dir")),
        "sel": of("BLEND", token(2)),
        "value": F.when(F.col("record") == "DIM", real(token(4))).when(F.col("record") == "BLEND", real(F.regexp_replace(token(3), "^v", ""))),
        "r": F.when(F.col("record") == "FEAT", real(have("r"))).when(F.col("record") == "ROW", some("_r", real(F.col("_r")))),
        "rmaj": some("_rmaj", real(F.col("_rmaj"))),
        "rmin": some("_rmin", real(F.col("_rmin"))),
        "rot": some("_rot", real(F.col("_rot"))),
        "c": some("_c", reals(F.split("_c", ","))),
        "pts": many("_pts", lambda p: reals(F.split(p, ","))),
        "arc": some("_arc", reals(F.split("_arc", r"\.\."))),
        "tags": some("_tags", F.split("_tags", ",")),
        "dias": many("_dias", real),
        "bbox": of("PART", F.transform(F.filter(F.split(F.coalesce(have("bbox"), F.lit("")), ","), lambda x: x != ""), lambda x: x.try_cast("double"))),
        "grid": of("PART", have("grid").try_cast("long")),
        "ext": of("PART", F.when(have("grid").isNotNull(), F.coalesce(real(have("ext")), F.lit(0.0)))),
        "low": of("DIM", real(group(2))),
        "high": of("DIM", real(group(3))),
    }
    return complete(d.withColumns(columns), key)


def line(tokens: bool = False) -> Column:
    """The line of a record. With ``tokens``, whole coordinates are written as coordinate tokens, the sign before them."""
    coordinate = (lambda v: F.concat(F.when(v < 0, "-").otherwise(""), F.lit("<|coord_"), F.abs(v).cast("long").cast("string"), F.lit("|>"))) if tokens else number
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    maybe = lambda c: F.coalesce(c, F.lit(""))
    plain = lambda a: F.array_join(F.transform(a, number), ",")
    head = text("PART unit=mm bbox=", plain("bbox"), maybe(text(" grid=", F.col("grid").cast("string"), " ext=", number(F.col("ext")))))
    feat = text("FEAT ", F.col("name"), " ", F.col("kind"), " axis=", F.col("axis"), " r=", F.coalesce(number(F.col("r")), F.lit("-")), maybe(text(" dir=", F.col("dir"))))
    blend = text("BLEND ", F.col("kind"), " ", F.col("sel"), " v", F.coalesce(number(F.col("value")), F.lit("-")))
    view = text("VIEW ", F.col("view"), " axes=", F.array_join("axes", ","))
    points = F.array_join(F.transform("pts", lambda p: F.concat(coordinate(p[0]), F.lit(","), coordinate(p[1]))), " ")
    at = text("c", coordinate(F.col("c")[0]), ",", coordinate(F.col("c")[1]))
    turned = lambda mark: maybe(text(mark, number(F.col("arc")[0]), "..", number(F.col("arc")[1])))
    ellipse = text(at, " rj", coordinate(F.col("rmaj")), " rn", coordinate(F.col("rmin")), " rot", number(F.col("rot")), turned(" e"))
    geometry = F.coalesce(points, ellipse, text(at, " r", coordinate(F.col("r")), turned(" a")))
    dias = F.array_join(F.transform("dias", lambda d: F.concat(F.lit(" DIA"), number(d))), "")
    row = text(F.col("kind"), " ", F.col("role"), " ", geometry, maybe(text(" ", F.array_join("tags", ","))), maybe(dias))
    span = F.coalesce(text(F.col("axis"), coordinate(F.col("low")), "..", coordinate(F.col("high"))), F.lit("-"))
    dim = text("DIM ", F.col("name"), " ", F.col("kind"), " ", F.col("role"), " ", number(F.col("value")), " ", F.col("view"), " ", span)
    out = F.when(F.col("record") == "PART", head)
    for name, c in {"FEAT": feat, "BLEND": blend, "VIEW": view, "ROW": row, "DIM": dim}.items():
        out = out.when(F.col("record") == name, c)
    return out


def emit(records: DataFrame, key: str, tokens: bool = False) -> DataFrame:
    """(key, text): the records of each drawing by n, a line each; records without what their line needs are left out."""
    lines = records.select(key, F.struct("n", line(tokens).alias("t")).alias("s"))
    # Records without a line go after the aggregate: a filter before it would make each line twice.
    texts = lines.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]).alias("_t"))
    return texts.where(F.exists("_t", lambda t: t.isNotNull())).select(key, F.array_join("_t", "\n").alias("text"))
