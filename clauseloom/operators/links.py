"""Links between clauses, and references in running text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as tx


def bijective(relations: DataFrame, uids: DataFrame) -> DataFrame:
    """(src, dst, src_uid, dst_uid), src < dst: pairs related both ways, both with a UID. Each pair once."""
    one = relations.select("src", "dst").distinct()
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = one.join(back, ["src", "dst"], "left_semi").filter("src < dst")
    u = uids.select("clause_id", "uid").distinct()
    return pairs.join(u.select(F.col("clause_id").alias("src"), F.col("uid").alias("src_uid")), "src").join(u.select(F.col("clause_id").alias("dst"), F.col("uid").alias("dst_uid")), "dst").select("src", "dst", "src_uid", "dst_uid")


def adjacency(pairs: DataFrame) -> DataFrame:
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("links"))


def curated(mappings: DataFrame, uids: DataFrame, digits: DataFrame) -> DataFrame:
    """Mapping rows with both UIDs padded to their standard's width, (std_key, digits), and the clauses they name."""
    d = F.broadcast(digits)
    padded = mappings.join(d.select(F.col("std_key").alias("from_std"), F.col("digits").alias("fd")), "from_std").join(d.select(F.col("std_key").alias("to_std"), F.col("digits").alias("td")), "to_std")
    pad = lambda uid, n: F.when(F.length(uid) < F.col(n), F.lpad(uid, F.col(n), F.lit("0"))).otherwise(F.col(uid))
    padded = padded.withColumn("from_uid", pad("from_uid", "fd")).withColumn("to_uid", pad("to_uid", "td")).drop("fd", "td")
    side = lambda end: uids.select(F.col("std_key").alias(f"{end}_std"), F.col("uid").alias(f"{end}_uid"), F.col("clause_id").alias(f"{end}_clause"))
    return padded.join(side("from"), ["from_std", "from_uid"], "left").join(side("to"), ["to_std", "to_uid"], "left")


def resolve(lines: DataFrame, uids: DataFrame, trim_dot: bool = False, strict: bool = False) -> DataFrame:
    """One row per reference in lines (file, line_no, line): pos, ref, and the link it becomes; uids (clause_id, std_key, uid)."""
    found = lines.select("file", "line_no", F.posexplode(tx.references(F.col("line"), strict)).alias("pos", "ref"))
    found = found.withColumn("key", F.rtrim("ref", F.lit(".")) if trim_dot else F.col("ref"))
    u = uids.groupBy(F.col("clause_id").alias("key")).agg(F.min(F.struct("uid", "std_key")).alias("u"))
    page = F.concat(F.lit("["), "key", F.lit("](../requirements/"), F.col("u.std_key"), F.lit(".html#"), F.col("u.uid"), F.lit(")"), F.when(F.col("ref") != F.col("key"), F.lit(".")).otherwise(""))
    return found.join(u, "key", "left").select("file", "line_no", "pos", "ref", F.col("u").isNotNull().alias("resolved"), F.coalesce(page, F.concat(F.lit(">>"), "ref", F.lit("<<"))).alias("link"))


def rewrite(lines: DataFrame, uids: DataFrame, trim_dot: bool = False, strict: bool = False) -> DataFrame:
    """lines with every reference replaced by its link, or marked as unresolved."""
    pattern = tx.STRICT_REFERENCE if strict else tx.REFERENCE
    links = resolve(lines, uids, trim_dot, strict).groupBy("file", "line_no").agg(F.sort_array(F.collect_list(F.struct("pos", "link"))).alias("links"))
    both = lines.join(links, ["file", "line_no"], "left")
    woven = F.zip_with(F.split("line", pattern, -1), F.transform("links", lambda x: x["link"]), lambda s, n: F.concat(s, F.coalesce(n, F.lit(""))))
    return both.select("file", "line_no", F.when(F.col("links").isNull(), F.col("line")).otherwise(F.array_join(woven, "")).alias("line"))


def find_keywords(lines: DataFrame, keywords: DataFrame, path_pattern: str = ".*") -> DataFrame:
    """(keyword, file, line_no): pattern references. Lines of matching files that hold a keyword between non-word characters.

    Keywords are ids: the ids in a line are taken out and joined, so many keywords cost one pass.
    """
    words = F.array_distinct(F.concat(tx.references(F.col("line")), F.regexp_extract_all("line", F.lit(r"([\p{L}\p{N}_-]+)"), 1)))
    each = lines.filter(F.col("file").rlike(path_pattern)).select("file", "line_no", F.explode(words).alias("keyword"))
    return each.join(keywords.select("keyword").distinct(), "keyword", "left_semi").select("keyword", "file", "line_no")


def reference_kinds(rows: DataFrame) -> DataFrame:
    """Adds kind: a reference with a keyword pattern may have many places ('pattern'), one with a path has one ('file')."""
    return rows.withColumn("kind", F.when(F.col("pattern").isNotNull(), "pattern").when(F.col("path").isNotNull(), "file").otherwise("invalid"))
