"""Readers of the pipeline's text formats. Files are read as text and never executed; bad rows go to a second frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.functions import ids

DEFAULTS = {"parent": "", "digits": 3, "partShift": 0, "partDigits": 0, "name": "", "oyr": 0}


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, line_no, line): numbered lines of each file, read as whole files so that numbers are stable."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.posexplode(F.split("value", r"\r?\n", -1)).alias("line_no", "line"))


def file_name(path: Column) -> Column:
    return F.url_decode(F.substring_index(path, "/", -1))


def _setting(body: Column, name: str) -> Column:
    return F.regexp_extract(body, rf'(?m)^{name}="?([^"\n]*)"?\s*$', 1)


def standards(spark: SparkSession, path: str) -> DataFrame:
    """std_key, parent, digits, part_shift, part_digits, name, original_year, volumes: one row per standard file."""
    return parse_standards(spark.read.text(path, wholetext=True).select(file_name(F.input_file_name()).alias("std_key"), "value"))


def parse_standards(body: DataFrame) -> DataFrame:
    """The same of (std_key, value), a file each."""
    number = lambda n: F.coalesce(_setting(F.col("value"), n).try_cast("int"), F.lit(DEFAULTS[n]))
    structure = F.regexp_extract("value", r"(?s)\bstructure=\((.*?)\n\)", 1)
    return body.select(
        "std_key", _setting(F.col("value"), "parent").alias("parent"), number("digits").alias("digits"), number("partShift").alias("part_shift"),
        number("partDigits").alias("part_digits"), _setting(F.col("value"), "name").alias("name"), number("oyr").alias("original_year"),
        F.regexp_extract_all(structure, F.lit(r'"([^"]*)"'), 1).alias("volumes"),
    )


def with_missing(found: DataFrame, wanted: list[str], parent: str = "") -> DataFrame:
    """Standards that were asked for and have no file, with defaults and no volumes, beside those found."""
    spark = found.sparkSession
    keys = spark.createDataFrame([(k,) for k in wanted], "std_key string")
    missing = keys.join(found, "std_key", "left_anti").select(
        "std_key", F.lit(parent).alias("parent"), F.lit(3).alias("digits"), F.lit(0).alias("part_shift"), F.lit(0).alias("part_digits"),
        F.col("std_key").alias("name"), F.lit(0).alias("original_year"), F.array().cast("array<string>").alias("volumes"),
    )
    return found.unionByName(missing)


def volumes(found: DataFrame) -> DataFrame:
    """One row per volume: year (first four characters) and items."""
    each = found.select("*", F.posexplode("volumes").alias("vol_idx", "volume")).drop("volumes")
    return each.select("*", F.substring("volume", 1, 4).alias("year"), F.expr("substring(volume, 6)").alias("items")).drop("volume")


def records(spark: SparkSession, path: str, local_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """TOC and TEXT records as (toc, texts); those under ``local_path`` are marked as local."""
    read = lambda p, local: spark.read.text(p).select(file_name(F.input_file_name()).alias("std_key"), "value", F.lit(local).alias("is_local"))
    return parse_records(read(path, False) if local_path is None else read(path, False).unionByName(read(local_path, True)))


def parse_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(toc, texts) of lines (std_key, value, is_local); other lines are left out."""
    both = rows.select("std_key", "is_local", F.split("value", ";", -1).alias("f")).filter(F.get("f", F.lit(0)).isin("TOC", "TEXT"))
    f = lambda k: F.get("f", F.lit(k))
    toc = both.filter(f(0) == "TOC").select("std_key", f(1).alias("hash"), f(2).alias("clause_id"), f(3).alias("heading"), f(4).alias("marker"), "is_local")
    texts = both.filter(f(0) == "TEXT").select("std_key", f(1).alias("hash"), f(2).alias("clause_id"), f(3).alias("headline"), f(4).alias("text"), "is_local")
    return toc, texts


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=";", quote="|", header=False)


def structure_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clauses, rejects) of a structure table TOC;hash;id;title;type."""
    rows = _csv(spark, path, "tag string, hash string, clause_id string, title string, type string")
    return split_structure(rows)


def split_structure(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("clause_id").rlike(ids.ROW_ID), F.lit(False))
    return rows.filter(ok).withColumn("id", ids.row_id_parts(F.col("clause_id"))), rows.filter(~ok)


def uid_map(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "hash string, uid string, clause_id string")


def relations(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, score, line_no): relations; line_no rises in the order of each file, but skips numbers.

    Large files are read in splits. A line's number is its split's first byte and its place in the task: splits of a file
    are whole but for the last one, and hold more bytes than lines.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    each = spark.read.text(path).select("value", (F.col("_metadata.file_block_start") + place).alias("line_no")).filter(F.col("value") != "").withColumn("f", F.split("value", ";"))
    return each.select(F.get("f", F.lit(0)).alias("src"), F.get("f", F.lit(1)).alias("dst"), F.get("f", F.lit(2)).try_cast("double").alias("score"), "line_no")


def known_relations(rows: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): both ends have to be clauses; an unknown source is skipped, an unknown target is reported."""
    known = clauses.select(F.col("clause_id").alias("known")).distinct()
    sources = rows.join(known, F.col("src") == F.col("known"), "left_semi")
    return sources.join(known, F.col("dst") == F.col("known"), "left_semi"), sources.join(known, F.col("dst") == F.col("known"), "left_anti")


def known_uids(uids: DataFrame, clauses: DataFrame) -> DataFrame:
    return uids.join(clauses.select("clause_id").distinct(), "clause_id", "left_semi")


def _floats(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x != ""), lambda x: x.try_cast("double"))


def weights(spark: SparkSession, path: str) -> DataFrame:
    return parse_weights(_csv(spark, path, "clause_id string, scatter string, significance string"))


def parse_weights(rows: DataFrame) -> DataFrame:
    return rows.select("clause_id", _floats(F.col("scatter")).alias("scat"), _floats(F.col("significance")).alias("sign"))


def check_weights(rows: DataFrame, sentence_counts: DataFrame) -> DataFrame:
    """Adds status: ok, unknown clause, or length mismatch against (clause_id, sentences)."""
    status = F.when(F.col("sentences").isNull(), "unknown clause").when((F.size("scat") != F.col("sentences")) | (F.size("sign") != F.col("sentences")), "length mismatch").otherwise("ok")
    return rows.join(sentence_counts, "clause_id", "left").withColumn("status", status)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(series, part, line_no, line) of files named series[-part].md."""
    return parse_markdown(lines(spark, path, "*.md"))


def parse_markdown(rows: DataFrame) -> DataFrame:
    """The same of numbered lines (path, line_no, line)."""
    named = rows.withColumn("name", F.regexp_replace(file_name(F.col("path")), r"\.md$", ""))
    return named.select(F.substring_index("name", "-", 1).alias("series"), F.when(F.col("name").contains("-"), F.expr("substring(name, instr(name, '-') + 1)")).otherwise("").alias("part"), "line_no", "line")


def travelogues(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, "*.md").select(file_name(F.col("path")).alias("file"), "line_no", "line")


def blocks(rows: DataFrame, file: str = "path") -> DataFrame:
    """Cache files: lines under a ``# clause_id`` line. (clause_id, line_no, line) of non-blank lines, in file order."""
    opened = F.when(F.col("line").startswith("# "), F.trim(F.expr("substring(line, 3)")))
    order = Window.partitionBy(file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    under = rows.withColumn("opened", opened).withColumn("clause_id", F.last("opened", ignorenulls=True).over(order))
    return under.filter(F.col("opened").isNull() & F.col("clause_id").isNotNull() & (F.trim("line") != "")).select("clause_id", "line_no", "line")


def cached_texts(rows: DataFrame) -> DataFrame:
    """(clause_id, lines): the lines of each cached block in order."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return blocks(rows).groupBy("clause_id").agg(ordered.alias("l")).select("clause_id", F.transform("l", lambda x: x["line"]).alias("lines"))


def mappings(spark: SparkSession, path: str) -> DataFrame:
    """from_std, to_std, type, note, from_uid, from_label, to_label, to_uid of mapping files."""
    return parse_mappings(spark.read.text(path, wholetext=True))


def parse_mappings(body: DataFrame) -> DataFrame:
    """The same of (value), a file each."""
    parts = [_setting(F.col("value"), n).alias(a) for n, a in (("from", "from_std"), ("to", "to_std"), ("type", "type"), ("note", "note"))]
    rows = body.select(*parts, F.explode(F.split("value", r"\r?\n")).alias("line")).withColumn("f", F.split("line", ";", -1)).filter(F.size("f") == 4)
    return rows.select("from_std", "to_std", "type", "note", *[F.trim(F.get("f", F.lit(k))).alias(n) for k, n in enumerate(("from_uid", "from_label", "to_label", "to_uid"))])
