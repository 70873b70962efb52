"""Structure expansion and clause identifiers: Column and DataFrame functions, all built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clause types by first letter, with the names used for clauses and those used for headings.
CLAUSE_TYPES = {"a": "abbreviation", "c": "clause", "m": "technique / measure", "o": "objective", "r": "requirement", "s": "scope", "t": "term", "u": "text", "x": "root"}
HEADING_TYPES = {"u": "text", "r": "requirement", "s": "scope definition", "o": "objective", "t": "term definition", "c": "clause"}
#: What stands in for a missing title or text, by type.
DEFAULT_TITLES = {"r": "REQUIREMENT", "s": "SCOPE", "o": "OBJECTIVE", "t": "TERM", "c": "CLAUSE", "m": "TECHNIQUE"}
#: Ids of rows that structure files may hold, and of clauses.
ROW_ID = r"^([A-Z\s]+\s+\d{4,5})-?(\d*):\d{4}\s+([1-9A-Z][0-9.]*)"
CLAUSE_ID = r"^([A-Z\s]+\s+\d{4,5})-?(\d*):\d{4}\s+([1-9A-Z]+[0-9.]*)"
GENERIC_ID = r"^([\p{L}\p{N}_]+)-?(\d*)-([1-9A-Z]+[0-9.]*)"
MAX_SEGMENTS = 6


def lookup(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


# --- structure strings ---------------------------------------------------------------------------------------------
def expand_items(volumes: DataFrame, items: str = "items") -> DataFrame:
    """One row per item of the blank-separated ``items``; ``{lo..hi}`` ranges, any number of them, are expanded in order.

    Adds item and ord (array of positions, whose order is that of the structure).
    """
    out = volumes.select("*", F.posexplode(F.filter(F.split(F.trim(items), r"\s+"), lambda x: x != "")).alias("pos", "item")).withColumn("ord", F.array("pos")).drop("pos")
    ranged = r"^([^{]*)\{(-?\d+)\.\.(-?\d+)\}(.*)$"
    while True:
        m = [F.regexp_extract("item", ranged, k) for k in range(1, 5)]
        spread = F.when(F.col("item").rlike(ranged), F.transform(F.sequence(F.try_to_number(m[1], F.lit("S99999")).cast("int"), F.try_to_number(m[2], F.lit("S99999")).cast("int")), lambda n: F.concat(m[0], n.cast("string"), m[3]))).otherwise(F.array("item"))
        cols = [c for c in out.columns if c not in ("item", "ord")]
        out = out.select(*cols, "ord", F.posexplode(spread).alias("pos", "item")).select(*cols, F.concat("ord", F.array("pos")).alias("ord"), "item")
        if out.filter(F.col("item").rlike(ranged)).isEmpty():
            return out


def pad2(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def parse_items(items: DataFrame) -> DataFrame:
    """Splits each item, ``[volume-][type][enum:]index``, and builds its identifiers.

    Needs item, name, year, digits, part_shift, part_digits, original_year. Adds std_part, part_nr, enum, type, index,
    level, uid, clause_id, hash, legacy_hash, warning (multi-digit fourth or fifth sub-level, too many levels, or none).
    """
    has_part = F.col("item").contains("-")
    part = F.when(has_part, F.replace(F.substring_index("item", "-", 1), F.lit("§"), F.lit("-")))
    rest = F.when(has_part, F.split("item", "-")[1]).otherwise(F.col("item"))
    a = items.withColumn("part", part).withColumn("rest", rest)
    # the part's number is arithmetic: "3-1" is two
    ints = F.transform(F.split("part", "-"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    value = F.aggregate(F.slice(ints, F.lit(2), F.lit(10)), F.get(ints, F.lit(0)), lambda s, x: s - x) + F.col("part_shift")
    text = value.cast("string")
    shifted = F.when(F.length(text) < F.col("part_digits"), F.lpad(text, F.col("part_digits"), F.lit("0"))).otherwise(text)
    has_enum = F.col("rest").contains(":")
    b = a.withColumn("part_nr", F.when(F.col("part").isNotNull(), F.replace(shifted, F.lit("-"), F.lit("")))).withColumn("enum", F.when(has_enum, F.substring_index("rest", ":", 1)))
    b = b.withColumn("tokens", F.split(F.when(has_enum, F.split("rest", ":")[1]).otherwise(F.col("rest")), r"\."))
    first = F.get("tokens", F.lit(0))
    lower = first.rlike("[a-z]")
    kind = F.when(lower, F.substring(first, 1, 1)).otherwise("u")
    b = b.withColumn("clause", F.when(lower, F.expr("substring(tokens[0], 2)")).otherwise(first)).withColumn("type", F.when(kind.isin("r", "s", "o", "t", "c", "m"), kind).otherwise("u"))
    b = b.withColumn("subs", F.slice("tokens", 2, MAX_SEGMENTS - 1))

    def piece(x: Column, i: Column) -> Column:
        wide = x.startswith("+") & (i < 2)
        bare = F.when(x.startswith("+"), F.substring(x, F.lit(2), F.length(x))).otherwise(x)
        return F.when(wide, F.lpad(bare, 3, "0")).when(i < 3, pad2(bare)).otherwise(bare)

    plain = F.transform("subs", lambda x, i: F.when(x.startswith("+") & (i < 2), F.substring(x, F.lit(2), F.length(x))).otherwise(x))
    b = b.withColumn("plain", plain).withColumn("pieces", F.transform("subs", piece))
    std_part = F.when(F.col("part").isNotNull(), F.concat(F.lit("-"), "part")).otherwise("")
    raw = F.concat(F.coalesce("part_nr", F.lit("")), pad2(F.col("clause")), F.array_join("pieces", ""))
    c = b.withColumn("std_part", std_part).withColumn("index", F.concat_ws(".", "clause", "plain")).withColumn("level", F.concat_ws(".", "part_nr", F.coalesce("enum", "clause"), "plain"))
    c = c.withColumn("uid", F.when(F.length(raw) < F.col("digits"), F.rpad(raw, F.col("digits"), F.lit("0"))).otherwise(raw))
    c = c.withColumn("clause_id", F.concat("name", "std_part", F.lit(":"), "year", F.lit(" "), "index"))
    long_sub = (F.length(F.get("plain", F.lit(3))) > 1) | (F.length(F.get("plain", F.lit(4))) > 1)
    warning = F.when(F.size("tokens") > MAX_SEGMENTS, "too many levels").when(F.coalesce(long_sub, F.lit(False)), "multi-digit sub-level")
    legacy = F.concat("name", F.lit(":"), F.col("original_year").cast("string"), "std_part", F.lit(" "), "index")
    return c.withColumn("hash", F.md5("clause_id")).withColumn("legacy_hash", F.md5(legacy)).withColumn("warning", warning).drop("part", "rest", "tokens", "clause", "subs", "plain", "pieces")


def uid_collisions(parsed: DataFrame) -> DataFrame:
    """(std_key, uid, clause_ids) for UIDs that more than one item of a standard gets."""
    return parsed.groupBy("std_key", "uid").agg(F.array_sort(F.collect_set("clause_id")).alias("clause_ids")).filter(F.size("clause_ids") > 1)


def join_titles(parsed: DataFrame, toc: DataFrame, texts: DataFrame, basic: bool = False, readable: bool = False) -> DataFrame:
    """Titles, texts and type markers of parsed items, with every default the catalogue applies.

    ``toc`` (std_key, hash, heading, marker, is_local) and ``texts`` (std_key, hash, headline, text, is_local): local
    rows replace titles and markers altogether and come first for headlines and texts. ``basic`` blanks what is
    generated (upper-case marker); ``readable`` takes the index instead of the UID as locator.
    """
    def side(df: DataFrame, local: bool, **names: str) -> DataFrame:
        picked = df.filter(F.col("is_local") == local).groupBy("std_key", "hash").agg(*[F.min(c).alias(n) for c, n in names.items()])
        return picked.select(F.col("std_key").alias("k"), F.col("hash").alias("h"), *names.values())

    out = parsed
    for df, local, key, names in (
        (toc, False, "hash", {"heading": "t_data", "marker": "m_data"}),
        (toc, False, "legacy_hash", {"heading": "t_old"}),
        (toc, True, "hash", {"heading": "t_local", "marker": "m_local"}),
        (texts, True, "hash", {"headline": "h_local", "text": "x_local"}),
        (texts, False, "hash", {"headline": "h_data", "text": "x_data"}),
    ):
        s = side(df, local, **names)
        out = out.join(s, (out["std_key"] == s["k"]) & (out[key] == s["h"]), "left").drop("k", "h")
    locals_ = toc.filter("is_local").select(F.col("std_key").alias("lk")).unionByName(texts.filter("is_local").select(F.col("std_key").alias("lk"))).distinct().withColumn("has_local", F.lit(True))
    out = out.join(locals_, out["std_key"] == locals_["lk"], "left").drop("lk")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    local = F.coalesce("has_local", F.lit(False))
    title = F.when(local, blank("t_local")).otherwise(F.coalesce(blank("t_data"), blank("t_old")))
    marker = F.when(local, blank("m_local")).otherwise(blank("m_data"))
    headline, text = F.coalesce(blank("h_local"), blank("h_data")), F.coalesce(blank("x_local"), blank("x_data"))
    out = out.select("*", F.coalesce(title, headline).alias("title0"), marker.alias("marker0"), text.alias("text0"))
    hide = F.lit(basic) & F.coalesce(F.col("marker0").rlike("[A-Z]"), F.lit(False))
    default = lookup(F.col("type"), DEFAULT_TITLES, "TOC")
    shown = F.when(~hide, F.col("title0"))
    known = F.when(~hide, F.col("marker0"))
    out = out.withColumn("title", F.coalesce(shown, default)).withColumn("text", decode_text(F.coalesce(F.when(~hide, F.col("text0")), default)))
    mismatch = known.isNotNull() & (F.lower(known) != F.col("type"))
    out = out.withColumn("marker", F.when(known.isNull() | F.lower(known).eqNullSafe(F.col("type")), F.coalesce(known, "type")).otherwise(F.when(known.rlike("[A-Z]"), F.upper("type")).otherwise(F.col("type"))))
    out = out.withColumn("marker_mismatch", mismatch).withColumn("header", F.substring("title", 1, 40)).withColumn("locator", F.col("clause_id") if readable else F.col("uid"))
    return out.drop("t_data", "m_data", "t_old", "t_local", "m_local", "h_local", "x_local", "h_data", "x_data", "has_local", "title0", "marker0", "text0")


def decode_text(text: Column, indent: int = 4) -> Column:
    """Stored text: quotes go, tildes become line ends, each line is indented."""
    lines = F.split(F.replace(text, F.lit('"'), F.lit("")), "~")
    return F.array_join(F.transform(lines, lambda s: F.concat(F.lit(" " * indent), s)), "\n")


# --- clause ids ----------------------------------------------------------------------------------------------------
def row_id_parts(text: Column) -> Column:
    """struct(series, part, chapter) of a structure row's id; null fields if it is none."""
    ok = text.rlike(ROW_ID)
    return F.struct(*[F.when(ok, F.regexp_extract(text, ROW_ID, k)).alias(n) for k, n in enumerate(("series", "part", "chapter"), 1)])


def clause_id_parts(text: Column, generic: bool = False) -> Column:
    """struct(series, part, chapter, level); an id that does not parse is its own series at chapter 0.0, level 0."""
    pattern = GENERIC_ID if generic else CLAUSE_ID
    ok = text.rlike(pattern)
    chapter = F.regexp_extract(text, pattern, 3)
    return F.struct(
        F.when(ok, F.replace(F.regexp_extract(text, pattern, 1), F.lit(" "), F.lit(""))).otherwise(text).alias("series"),
        F.when(ok, F.regexp_extract(text, pattern, 2)).otherwise("").alias("part"),
        F.when(ok, chapter).otherwise("0.0").alias("chapter"),
        F.when(ok, depth(chapter) + 1).otherwise(0).alias("level"),
    )


def depth(chapter: Column) -> Column:
    return (F.length(chapter) - F.length(F.replace(chapter, F.lit("."), F.lit("")))).cast("int")


def parent_path(clause: Column) -> Column:
    """The id without its last segment; an id without a dot is its own."""
    return F.regexp_replace(clause, r"\.[^.]*$", "")


def parent_id(clause: Column, level: Column) -> Column:
    return F.when(level > 1, parent_path(clause))


def is_multipart(part: Column) -> Column:
    return part != ""


def type_name(kind: Column, headings: bool = False) -> Column:
    return lookup(F.lower(kind), HEADING_TYPES if headings else CLAUSE_TYPES)


def context_sentence(title: Column, chapter_depth: Column, parent_title: Column, top_title: Column) -> Column:
    return (
        F.when(chapter_depth == 0, F.lit("is top level content"))
        .when(chapter_depth == 1, F.concat(F.lit('is a subclause of clause "'), parent_title, F.lit('"')))
        .otherwise(F.concat(F.lit('is contained in subclause "'), parent_title, F.lit('" under "'), top_title, F.lit('"')))
    )


def natural_key(chapter: Column) -> Column:
    """Sort key that orders 2 before 10, and numbers before letters."""
    return F.transform(F.split(chapter, r"\."), lambda x: F.struct(F.coalesce(x.try_cast("int"), F.lit(2**31 - 1)).alias("n"), x.alias("s")))
