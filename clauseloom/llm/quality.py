"""Quality rules: per-document word rules and cross-document line frequency, in built-in functions only.

Line frequency: lines are normalised (lower case, blanks collapsed, trimmed) and hashed with their host. A line is
over the limit if more than ``max_docs`` documents of one host with different texts hold it (exact copies count once).
Such a line is removed from every document of the host but the first one (smallest id), which keeps it, so that no
content is lost altogether. A document is depleted, and rejected, if its removed lines make up more than
``max_removed`` of its distinct lines' characters.

Defined edge cases: a null text has no words and no lines and fails the base rules; a null host is a host of its own;
null ids and repeated rows are allowed (repeated rows get equal verdicts, each stays a row); other columns are ignored
by the verdict and passed through by :func:`apply_quality`. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import BLANKS, blank_words, joined_hashes

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_DOCS = 20
MAX_REMOVED = 0.8
SYMBOLS = r"[#*$%&|<>]"


def base_profile(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, one row per row.

    Repeated windows: nearly all documents are settled by comparing the number of windows with that of distinct ones;
    the others sort (hash, position) pairs and compare neighbours, so a long text costs n log n, not n squared.
    """
    kept = [f"k{i}" for i in range(len(keep or []))]
    names = [docs.select(c).columns[0] for c in keep or []]
    t = F.col("t")
    symbols = sum((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))) for c in "#*$%&|<>")
    worded = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(*[c.alias(k) for c, k in zip(keep or [], kept, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    pieces = F.transform(F.split(t, r"[\x20\x09-\x0D]", -1), lambda w: F.xxhash64(w))  # one piece more than there are blanks
    counted = first.select(
        *kept, pieces.alias("h"), F.length(t).cast("long").alias("n_points"),
        F.when(t.rlike(SYMBOLS), symbols).otherwise(0).cast("long").alias("n_symbols"), worded.alias("l"),
    )
    one = counted.select(
        *kept, (F.col("n_points") - F.size("h") + 1).alias("word_chars"), "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.array_remove("h", F.xxhash64(F.lit(""))).alias("h"),
    )
    profile = [*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    two = one.select(*kept, F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "h", joined_hashes(F.col("h"), F.col("h"), 1).alias("h2"))
    four = two.select(*profile, "h", joined_hashes(F.col("h2"), F.col("h2"), 2).alias("h4"))
    five = four.select(*profile, joined_hashes(F.col("h4"), F.col("h"), 4).alias("h"))
    h, c = F.col("h"), F.col("c")
    places = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
    sorted_ = five.select(*profile, F.when(F.size(F.array_distinct(h)) < F.size(h), places).alias("c"))
    hash_at = lambda k: F.get(c, k)["h"]
    same = F.transform(c, lambda x, k: F.when((hash_at(k + 1) == x["h"]) | (hash_at(k - 1) == x["h"]), x["i"]))
    places = sorted_.select(*profile, F.sort_array(F.filter(same, lambda x: x.isNotNull())).alias("s"))
    s = F.col("s")
    repeat = F.aggregate(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda x, y: F.least(F.coalesce(y - x, F.lit(5)), F.lit(5)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    out = places.select(*profile, F.coalesce(repeat, F.lit(0)).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(*[F.col(k).alias(n) for k, n in zip(kept, names, strict=True)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def line_hashes(host: Column, text: Column) -> Column:
    """Hash of (host, normalised line) for each line of the text, in order; null for a line without a word."""
    norm = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.trim(F.regexp_replace(F.lower(line), BLANKS, " ")))
    return F.transform(norm, lambda s: F.when(s != "", F.struct(F.xxhash64(host, F.lit("\n"), s).alias("k"), F.length(s).alias("c"))))


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """(id, th, removed_chars, removed): per document and text hash, the lines over the limit; no row if it has none.

    The rows that move are (line hash, id, text hash, length). Counting goes by (line, text) first, so a line that a
    third of all documents share is counted by many tasks.
    """
    rows = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"),
        F.explode_outer(F.array_distinct(F.filter(line_hashes(F.col(host), F.col(text)), lambda x: x.isNotNull()))).alias("x"),
    ).filter("x is not null")  # explode would add a filter on the array's size and so make the array twice
    held = rows.select("x.k", "id", "th", "x.c").distinct()
    texts = held.groupBy("k", "th").agg(F.count("*").alias("copies"), F.min("id").alias("id"))  # the count keeps ``held`` one shared exchange
    frequent = (
        texts.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("id", "th")).alias("first"), F.sum("copies").alias("copies"))
        .filter((F.col("n") > max_docs) & (F.col("copies") > 0)).select(F.col("k").alias("fk"), "first")
    )
    own = F.struct("id", "th")
    over = held.join(frequent, F.col("k") == F.col("fk")).filter(~own.eqNullSafe(F.col("first")))
    return over.groupBy("id", "th").agg(F.sum("c").alias("removed_chars"), F.collect_set("k").alias("removed"))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per document row: doc_id, the base profile, line_chars, removed_chars, kept."""
    all_chars = F.aggregate(F.array_distinct(F.filter(line_hashes(F.col(host), F.col(text)), lambda x: x.isNotNull())), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    base = base_profile(docs, text, [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("bth"), all_chars.alias("line_chars")])
    gone = removed_lines(docs, doc_id, host, text, max_docs).select("id", "th", "removed_chars")
    both = base.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("bth") == F.col("th")), "left")
    removed = F.coalesce("removed_chars", F.lit(0)).cast("long")
    depleted = removed > max_removed * F.col("line_chars")
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "line_chars", removed.alias("removed_chars"))


def apply_quality(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """``docs`` without the rejected rows and without the lines over the limit; n_chars, if there, follows the text."""
    all_chars = F.aggregate(F.array_distinct(F.filter(line_hashes(F.col(host), F.col(text)), lambda x: x.isNotNull())), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    base = base_profile(docs, text, [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("bth"), all_chars.alias("line_chars")])
    # the filter stands above the aggregate: pushed through base_profile's steps it would be expanded again and again
    good = base.groupBy("doc_id", "bth").agg(F.max("line_chars").alias("line_chars"), F.bool_or("base_failed").alias("failed")).filter(~F.col("failed"))
    gone = removed_lines(docs, doc_id, host, text, max_docs)
    both = good.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("bth") == F.col("th")), "left")
    keep = both.filter(~(F.coalesce("removed_chars", F.lit(0)) > max_removed * F.col("line_chars"))).select(F.col("doc_id").alias("kid"), "bth", "removed")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("rid"), F.xxhash64(F.col(text)).alias("rth"))
    kept = row.join(keep, F.col("rid").eqNullSafe(F.col("kid")) & (F.col("rth") == F.col("bth")))
    t = F.col(f"row.{text}")
    named = F.zip_with(F.split(t, "\n", -1), line_hashes(F.col(f"row.{host}"), t), lambda s, x: F.when(x.isNull() | ~F.array_contains("removed", x["k"]), s))
    new = F.when(F.col("removed").isNull(), t).otherwise(F.array_join(F.filter(named, lambda s: s.isNotNull()), "\n"))
    done = kept.select("row", new.alias("new"))
    return done.select(*[F.col("new").alias(c) if c == text else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    return verdicts(docs)
