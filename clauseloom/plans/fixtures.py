"""Clause views over the star-schema tables, each with the SQL that gives the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clause_tree(spark: SparkSession, d: str) -> DataFrame:
    """(id, w): regions, nations and customers as three levels of clauses."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(1).alias("w"))
    nations = n.select(F.concat(F.lit("R"), "n_regionkey", F.lit("."), "n_nationkey").alias("id"), F.lit(2).alias("w"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return regions.unionByName(nations).unionByName(c.select(F.concat(F.lit("R"), "n_regionkey", F.lit("."), "n_nationkey", F.lit("."), "c_custkey").alias("id"), F.lit(3).alias("w")))


TREE_SQL = """tree AS (
  SELECT 'R' || r_regionkey AS id, 1 AS w FROM region
  UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey, 2 FROM nation
  UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey || '.' || c_custkey, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def clause_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", F.concat(F.lit("IEC 61508-"), F.col("o_custkey") % 7, F.lit(":2010 "), F.col("o_orderkey") % 9 + 1, F.lit("."), F.col("o_orderkey") % 13).alias("clause_id"))


IDS_SQL = "ids AS (SELECT o_orderkey, 'IEC 61508-' || (o_custkey % 7) || ':2010 ' || (o_orderkey % 9 + 1) || '.' || (o_orderkey % 13) AS clause_id FROM orders)"


def sentence_vectors(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    k = F.floor(F.col("vec_id") / 3) % 6
    rows = e.select(
        "vec_id", (F.col("vec_id") % 3).cast("int").alias("domain"), F.concat(F.lit("D"), F.col("vec_id") % 3, F.lit("-1:2020 "), F.col("label") + 1, F.lit("."), k + 1).alias("clause_id"),
        F.when(k % 2 == 0, "requirement").otherwise("clause").alias("type"), F.col("embedding").alias("vec"),
    )
    return rows.withColumn("sent_no", F.row_number().over(Window.partitionBy("clause_id").orderBy("vec_id")))


VECTORS_SQL = """sv AS (
  SELECT vec_id, vec_id % 3 AS domain, 'D' || (vec_id % 3) || '-1:2020 ' || (label + 1) || '.' || (vec_id // 3 % 6 + 1) AS clause_id,
         CASE WHEN vec_id // 3 % 6 % 2 = 0 THEN 'requirement' ELSE 'clause' END AS type, embedding::DOUBLE[] AS vec,
         row_number() OVER (PARTITION BY 'D' || (vec_id % 3) || '-1:2020 ' || (label + 1) || '.' || (vec_id // 3 % 6 + 1) ORDER BY vec_id) AS sent_no
  FROM embeddings)"""


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """(series, part, doc_id, line_no, line): every fifth line is a heading ``# n``."""
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    line = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("# "), F.floor(F.col("line_no") / 5) + 1, F.lit(" Title"))).otherwise(F.regexp_replace("line", "^#+", ""))
    return each.select(F.col("doc_id").cast("string").alias("series"), F.lit("").alias("part"), "line_no", line.alias("line"))


LINES_SQL = """raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
ln AS (SELECT CAST(doc_id AS VARCHAR) AS series, unnest(range(len(l))) AS line_no, unnest(l) AS line0 FROM raw),
lines AS (SELECT series, line_no, CASE WHEN line_no % 5 = 0 THEN '# ' || (line_no // 5 + 1) || ' Title' ELSE regexp_replace(line0, '^#+', '') END AS line FROM ln)"""


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters 1, 2 and 4 of each document; 3 and those beyond are unknown."""
    doc = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("series"))
    return doc.select("series", F.lit("").alias("part"), F.explode(F.array(*[F.lit(x) for x in ("1", "2", "4")])).alias("chapter")).withColumn("clause_id", F.concat("series", F.lit(" "), "chapter"))


CHAPTERS_SQL = "chapters AS (SELECT CAST(doc_id AS VARCHAR) AS series, unnest(['1', '2', '4']) AS chapter FROM documents)"
