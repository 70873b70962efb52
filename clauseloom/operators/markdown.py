"""Segmentation of noisy Markdown into clauses, and what does not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as tx

BARE = r"^#+\s+([1-9A-Z][0-9.]*)\s?$"
TITLED = r"^#+\s+([1-9A-Z][0-9.]*)\s(.*)"


def heading_parts(line: Column) -> Column:
    """struct(chapter, title) of a heading line; a chapter of '' if it is none of a clause."""
    clean = F.replace(F.rtrim(line), F.lit("Annex "), F.lit(""))
    bare = F.regexp_extract(clean, BARE, 1)
    chapter = F.when(bare != "", bare).otherwise(F.regexp_extract(clean, TITLED, 1))
    return F.struct(F.rtrim(chapter, F.lit(".")).alias("chapter"), F.when(bare != "", "").otherwise(F.regexp_extract(clean, TITLED, 2)).alias("title"))


def segment(lines: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, headings, dropped) of lines (series, part, line_no, line) by chapters (series, part, chapter, clause_id).

    texts: (clause_id, text array in order). headings: matched heading lines with their titles. dropped: heading lines
    that match no clause; they do not end the clause they stand in.
    """
    is_heading = F.col("line").startswith("#")
    marked = lines.withColumn("h", F.when(is_heading, heading_parts(F.col("line"))))
    c = chapters.select(F.col("series").alias("cs"), F.col("part").alias("cp"), F.col("chapter").alias("cc"), "clause_id")
    found = marked.join(c, (F.col("series") == F.col("cs")) & (F.col("part") == F.col("cp")) & (F.col("h.chapter") == F.col("cc")), "left").drop("cs", "cp", "cc")
    so_far = Window.partitionBy("series", "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = found.withColumn("current", F.last("clause_id", ignorenulls=True).over(so_far))
    body = run.filter(F.col("h").isNull() & F.col("current").isNotNull())
    texts = body.groupBy(F.col("current").alias("clause_id")).agg(F.sort_array(F.collect_list(F.struct("line_no", F.rtrim("line").alias("line")))).alias("l")).select("clause_id", F.transform("l", lambda x: x["line"]).alias("text"))
    headings = found.filter(F.col("h").isNotNull() & F.col("clause_id").isNotNull()).select("series", "part", "line_no", "clause_id", "h.chapter", "h.title")
    dropped = found.filter(F.col("h").isNotNull() & F.col("clause_id").isNull()).select("series", "part", "line_no", "line", F.col("h.chapter").alias("chapter"))
    return texts, headings, dropped


def title_findings(headings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds the title in effect and finding (mismatch, overridden, none) for headings against (clause_id, title)."""
    known = catalogue.select("clause_id", F.col("title").alias("listed"))
    both = headings.join(known, "clause_id")
    generic = tx.is_generic(F.col("listed"))
    effective = F.when(F.col("title") != "", F.col("title")).when(~generic, F.col("listed")).otherwise("none")
    finding = F.when((F.col("title") != "") & (F.col("title") != F.col("listed")) & ~generic, "mismatch").when((F.col("title") == "") & ~generic, "overridden").when(F.col("title") == "", "none")
    return both.withColumn("effective", effective).withColumn("finding", finding)


def missed(chapters: DataFrame, headings: DataFrame, lines: DataFrame) -> DataFrame:
    """Chapters of parsed parts that no heading matched."""
    parsed = lines.select("series", "part").distinct()
    return chapters.join(parsed, ["series", "part"], "left_semi").join(headings.select("series", "part", "chapter"), ["series", "part", "chapter"], "left_anti")


def type_report(clauses: DataFrame) -> DataFrame:
    """(clause_id, type, hinted): clauses (clause_id, type, text string) whose words hint at another type."""
    return clauses.select("clause_id", "type", F.explode(tx.type_findings(F.col("text"), F.col("type"))).alias("hinted"))
