"""Writers: each builds a DataFrame first; files come from Spark's writers, partitioned, and overwrite what was there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import ids
from clauseloom.functions import text as tx

#: View colours by clause type; other types have none.
COLOURS = {
    "u": "(215,95,0,255)", "c": "(215,95,0,255)", "x": "(215,0,0,255)", "r": "(215,135,255,255)", "o": "(215,215,0,255)", "t": "(135,135,255,255)", "s": "(95,135,0,255)", "m": "(255,255,0,255)",
}


def items(titled: DataFrame) -> DataFrame:
    """The record written for each catalogue item, as a JSON document in ``body``."""
    body = F.to_json(F.struct("type", F.col("header").alias("header"), F.col("text").alias("text"), F.col("clause_id").alias("name"), F.col("uid").alias("numID"), F.col("hash").alias("refID"), "level", F.struct(F.lit("pattern").alias("type"), F.col("clause_id").alias("keyword")).alias("reference")))
    return titled.select("std_key", "uid", "level", body.alias("body"))


def heading_data(titled: DataFrame) -> DataFrame:
    return titled.select("std_key", F.concat_ws(";", F.lit("TOC"), "hash", "clause_id", "title", "marker").alias("line"))


def uid_rows(titled: DataFrame) -> DataFrame:
    return titled.select("std_key", F.concat_ws(";", "hash", F.concat("std_key", F.lit("-"), "uid"), "clause_id").alias("line"))


def marker(clauses: DataFrame) -> Column:
    """The clause's type, in upper case if its heading was neither listed nor parsed."""
    authored = tx.heading_state(F.col("display"), F.col("alternatives")).isin("loaded", "parsed")
    return F.when(authored, F.col("type")).otherwise(F.upper("type"))


def heading_dump(clauses: DataFrame) -> DataFrame:
    """(dfs_key, line) of clauses (clause_id, type, display, alternatives, dfs_key): TOC;md5;id;heading;type."""
    heading = tx.best_heading(F.col("display"), F.col("alternatives"))
    return clauses.select("dfs_key", F.concat_ws(";", F.lit("TOC"), F.md5("clause_id"), "clause_id", heading, marker(clauses)).alias("line"))


def node_dump(clauses: DataFrame) -> DataFrame:
    """(clause_id, line) of clauses (clause_id, type, display, alternatives, resonance): id;heading;type;colour;(size,size,size)."""
    size = F.when(F.col("resonance") > 1, F.col("resonance").cast("string")).otherwise("1")
    heading, kind = tx.best_heading(F.col("display"), F.col("alternatives")), marker(clauses)
    body = F.concat(F.lit("("), F.concat_ws(",", size, size, size), F.lit(")"))
    return clauses.select("clause_id", F.concat_ws(";", "clause_id", heading, kind, F.coalesce(ids.lookup(F.lower("type"), COLOURS), F.lit("")), body).alias("line"))


def edge_dump(edges: DataFrame, key: str = "dfs_key") -> DataFrame:
    return edges.select(*[c for c in (key,) if c in edges.columns], F.concat_ws(";", "parent_id", "child_id").alias("line"))


def text_dump(clauses: DataFrame) -> DataFrame:
    """TEXT;md5;id;heading;"line~line" of clauses (clause_id, heading, text array)."""
    return clauses.select("clause_id", F.concat(F.concat_ws(";", F.lit("TEXT"), F.md5("clause_id"), "clause_id", F.coalesce("heading", F.lit(""))), F.lit(';"'), F.array_join("text", "~"), F.lit('"')).alias("line"))


def text_print(clauses: DataFrame) -> DataFrame:
    """Markdown of each clause (clause_id, level, heading, text array): heading line, blank line, body."""
    head = F.concat_ws(" ", F.repeat(F.lit("#"), F.col("level")), "clause_id", "heading")
    return clauses.select("clause_id", F.concat(head, F.lit("\n\n"), F.trim(F.array_join("text", "\n"))).alias("body"))


def regenerated(chapters: DataFrame) -> DataFrame:
    """(series, part, body): a document's chapters (series, part, chapter, title, text array) in natural order."""
    piece = F.concat(F.repeat(F.lit("#"), ids.depth(F.col("chapter")) + 1), F.lit(" "), "chapter", F.lit(" "), "title", F.lit("\n"), F.array_join("text", "\n"))
    ordered = F.sort_array(F.collect_list(F.struct(ids.natural_key(F.col("chapter")).alias("k"), piece.alias("p"))))
    return chapters.groupBy("series", "part").agg(ordered.alias("l")).select("series", "part", F.array_join(F.transform("l", lambda x: x["p"]), "\n").alias("body"))


def json_rows(rows: DataFrame, key: str = "clause_id") -> DataFrame:
    """(key, body): each row as JSON; for summary stores and the clause index."""
    return rows.select(key, F.to_json(F.struct(*sorted(rows.columns))).alias("body"))


def cluster_report(rows: DataFrame) -> DataFrame:
    """(parent, peer_parent, body): Markdown tables of cluster rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "member", F.round("score", 3), F.round("revscore", 3), "peer"), F.lit(" |"))
    table = rows.groupBy("parent", "peer_parent").agg(F.sort_array(F.collect_list(F.struct("member", "peer", line.alias("line")))).alias("l"))
    head = F.lit("| Clause | Score | RevScore | Peer |\n|---|---|---|---|\n")
    return table.select("parent", "peer_parent", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("body"))


def write_lines(rows: DataFrame, path: str, by: str | None = None, order: list[str] | None = None) -> None:
    """One text file per value of ``by`` (or part files), sorted by ``order``; overwrites."""
    out = rows.repartition(by).sortWithinPartitions(by, *(order or [])) if by else rows.sort(*order) if order else rows
    out = out.select(*([by] if by else []), F.col("line").alias("value"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def write_relations(relations: DataFrame, path: str) -> None:
    relations.select("src", "dst", "score").write.mode("overwrite").csv(path, sep=";", quote="|")


def write_weights(arrays: DataFrame, path: str) -> None:
    arrays.write.mode("overwrite").parquet(path)
