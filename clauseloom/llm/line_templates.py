"""Line dedup by a log-template tree, with aggregations instead of growing clusters one line after another.

Each line is tokenised; tokens that hold a digit are variable fields at once. The tree has a fixed depth: below the token
count come the leading tokens, with a wildcard branch for one of them. A line's leaf is the first of these that more than
``max_docs`` documents reach: its first two tokens; its second and third, whatever the first; its first and third,
whatever the second (the latter two for lines of ``MIN_WILD`` tokens or more). Lines without such a leaf belong to no
template. In a leaf a token stays constant at its position if more than ``max_docs`` documents have it there; any other
token is a variable field. The line with its variable fields generalised is its template. A template with at least
``MIN_CONSTANT`` constant tokens in proportion that occurs in more than ``max_docs`` documents is recurring.

Lines that recur word for word are judged as they stand, numbers included: a line is recurring if more than ``max_docs``
documents hold it, or more than one if it has ``LONG`` tokens or more, as no two authors write the same long passage.

Recurring lines are dropped from every document but the first one (smallest id) of their template, or of their wording,
so that the text itself is not lost.

Documents count by their texts: exact copies count once, as copies are a matter of document dedup and say nothing about
lines. All that is counted is pre-aggregated before it moves, and joins on leaves, templates and wordings are salted, so a
line shared by a third of all documents is no hot group. The leaves that are reached are broadcast while they are at most
``MAX_BROADCAST`` (checked by a count); beyond that hashes find the lines that have one.

Defined edge cases: a null text has no lines and stays null; blank lines belong to no template; a document whose lines
all go keeps an empty text; repeated rows get equal results; null ids are allowed; other columns, whatever their names,
pass through (but n_dropped, which is made anew); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import BLANKS, cut

MAX_DOCS = 20
MIN_CONSTANT = 0.5
MIN_WILD = 4
LONG = 50
MAX_BROADCAST = 500_000
SALTS = 8


def even_lines(text: Column) -> Column:
    """Each line of the text with its tokens joined by one space; '' for a blank line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # most lines hold no run of blanks; the replacement is left to those that do
    return F.transform(lines, lambda s: F.trim(F.when(s.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(s, BLANKS, " ")).otherwise(s)))


def masked(line: Column) -> Column:
    """An even line with the tokens that hold a digit masked."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(line)


def spaces(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))


def leaves_of(line: Column) -> Column:
    """Hashes of the leaves that a masked line may have, the preferred one first."""
    n = spaces(line)
    third = F.substring_index(line, " ", 3)
    wild = n >= MIN_WILD - 1
    return F.array(
        F.xxhash64(n, F.lit(0), F.substring_index(line, " ", 2)),
        F.when(wild, F.xxhash64(n, F.lit(1), F.substring_index(third, " ", -2))),
        F.when(wild, F.xxhash64(n, F.lit(2), F.substring_index(line, " ", 1), F.substring_index(third, " ", -1))),
    )


def _salt(by: str) -> Column:
    return F.pmod(F.col(by), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    """``df``, the small side of a join, once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    """explode would add a filter on the array's size and so make the array twice."""
    return df.withColumn(name, F.explode_outer(array)).filter(F.col(name).isNotNull())


def _but_first(rows: DataFrame, key: str, least: Column, max_broadcast: int) -> DataFrame:
    """(id, th, at) of ``rows`` (id, th, at, key, ...) whose key recurs, without those of the key's first document."""
    texts = rows.groupBy(key, "th").agg(F.min("id").alias("id"), F.max(least).alias("least"))
    often = texts.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("id", "th")).alias("first"), F.max("least").alias("least")).filter("n > least").select(F.col(key).alias("of"), "first")
    often = cut(often)
    if often.count() <= max_broadcast:
        gone = rows.join(F.broadcast(often), F.col(key) == F.col("of"))
    else:
        gone = rows.withColumn("salt", _salt("th")).join(_salted(often).withColumnRenamed("salt", "s2"), (F.col(key) == F.col("of")) & (F.col("salt") == F.col("s2")))
    return gone.filter(~F.struct("id", "th").eqNullSafe(F.col("first"))).select("id", "th", "at")


def in_leaves(rows: DataFrame, even: DataFrame, max_docs: int, max_broadcast: int) -> DataFrame:
    """(id, th, at, leaf, line) of the masked lines that have a leaf.

    ``rows`` (th, at, l: leaves) of all lines; ``even`` (id, th, e: lines), from which the few lines are taken.
    """
    leaves = rows.select("th", F.explode("l").alias("leaf")).filter("leaf is not null").distinct()
    reached = cut(leaves.groupBy("leaf").count().filter(F.col("count") > max_docs).select(F.col("leaf").alias("rl")))
    each = _exploded(even, _worded(lambda s, i: F.struct(i.alias("at"), masked(s).alias("line"))), "x").select("id", "th", "x.at", "x.line")
    if reached.count() <= max_broadcast:
        known = F.broadcast(reached)
        found = each.withColumn("l", leaves_of(F.col("line"))).select("id", "th", "at", "line", *[F.get("l", F.lit(k)).alias(f"l{k}") for k in range(3)])
        for k in range(3):
            found = found.join(known.select(F.col("rl").alias(f"r{k}")), F.col(f"l{k}") == F.col(f"r{k}"), "left")
        return found.select("id", "th", "at", F.coalesce("r0", "r1", "r2").alias("leaf"), "line").filter("leaf is not null")
    offered = rows.select("th", "at", F.posexplode("l").alias("rank", "leaf")).filter("leaf is not null").distinct().withColumn("salt", _salt("th"))
    known = _salted(reached).withColumnRenamed("salt", "s2")
    chosen = offered.join(known, (F.col("leaf") == F.col("rl")) & (F.col("salt") == F.col("s2")), "left_semi")
    chosen = chosen.groupBy("th", "at").agg(F.min(F.struct("rank", "leaf"))["leaf"].alias("leaf"))
    return each.join(chosen, ["th", "at"]).select("id", "th", "at", "leaf", "line")


def _worded(f) -> Column:
    """``f(line, place)`` of the lines ``e`` that are not blank."""
    return F.filter(F.transform("e", lambda s, i: F.when(s != "", f(s, i))), lambda x: x.isNotNull())


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS, min_constant: float = MIN_CONSTANT, long: int = LONG, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, th, gone): per document and text hash, the sorted places of the lines to drop; no row if there are none."""
    even = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), even_lines(F.col(text)).alias("e"))
    # the masked line is made first, as leaves_of names it more than once
    facts = F.transform(
        _worded(lambda s, i: F.struct(i.alias("at"), s.alias("s"), masked(s).alias("line"))),
        lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["s"]).alias("vh"), (spaces(x["s"]) >= long - 1).alias("long"), leaves_of(x["line"]).alias("l")),
    )
    # one narrow row per line: all counting starts from these
    rows = cut(_exploded(even.select("id", "th", facts.alias("v")), F.col("v"), "x").select("id", "th", "x.*"))
    verbatim = _but_first(rows.drop("l"), "vh", F.when(F.col("long"), 1).otherwise(max_docs), max_broadcast)

    lines = cut(in_leaves(rows, even, max_docs, max_broadcast).withColumn("lh", F.xxhash64("line")).distinct())
    # one row per different line, with its number of different texts
    kinds = lines.select("leaf", "lh", "line", "th").distinct().groupBy("leaf", "lh", "line").agg(F.count("*").alias("docs"))
    tokens = kinds.select("leaf", "lh", "docs", F.posexplode(F.split("line", " ", -1)).alias("spot", "token"))
    stays = tokens.groupBy("leaf", "spot", "token").agg(F.sum("docs").alias("n")).filter((F.col("n") > max_docs) & (F.col("token") != "<*>"))
    stays = _salted(stays.select(F.col("leaf").alias("sl"), F.col("spot").alias("sa"), F.col("token").alias("st"))).withColumnRenamed("salt", "s2")
    marked = tokens.withColumn("salt", _salt("lh")).join(stays, (F.col("leaf") == F.col("sl")) & (F.col("spot") == F.col("sa")) & (F.col("token") == F.col("st")) & (F.col("salt") == F.col("s2")), "left")
    part = F.struct("spot", F.coalesce("st", F.lit("<*>")).alias("token"))
    general = marked.groupBy("leaf", "lh").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.count("st").alias("constant"), F.count("*").alias("size"))
    named = general.filter(F.col("constant") >= min_constant * F.col("size")).select(
        F.col("leaf").alias("nl"), F.col("lh").alias("nh"), F.xxhash64("size", F.array_join(F.transform("parts", lambda x: x["token"]), " ")).alias("template")
    )
    # a line is one row of ``named``, but may be one of many documents
    named = _salted(named).withColumnRenamed("salt", "s2")
    of = lines.withColumn("salt", _salt("th")).join(named, (F.col("leaf") == F.col("nl")) & (F.col("lh") == F.col("nh")) & (F.col("salt") == F.col("s2"))).select("id", "th", "at", "template")
    gone = _but_first(cut(of), "template", F.lit(max_docs), max_broadcast).unionByName(verbatim)
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with the recurring lines dropped and, last, n_dropped (lines); n_chars follows the text."""
    gone = recurring_lines(docs, doc_id, text, **kw).select(F.col("id").alias("gid"), F.col("th").alias("gth"), "gone")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("rid"), F.xxhash64(F.col(text)).alias("rth"))
    both = row.join(gone, F.col("rid").eqNullSafe(F.col("gid")) & (F.col("rth") == F.col("gth")), "left")
    t = F.col("row").getField(text)
    cutup = both.select("row", "gone", F.when(F.col("gone").isNotNull(), F.split(t, "\n", -1)).alias("l"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone")), lambda k: F.get("l", k))
    new = F.when(F.col("gone").isNull(), t).otherwise(F.array_join(left, "\n"))
    done = cutup.select("row", new.alias("new"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
    return done.select(*[F.col("new").alias(c) if c == text else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_dropped"], "n_dropped")


def op3_line_templates(docs: DataFrame) -> DataFrame:
    """doc_id, n_dropped, n_chars and md5 of the remaining text: one row per row of ``docs``."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
