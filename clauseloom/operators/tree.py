"""The clause hierarchy. Ids hold their paths, so ancestors come from the id: no recursion, one shuffle for a roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import ids


def ancestors(clause: Column, own: bool = True) -> Column:
    """Ids of the clause (if ``own``) and all clauses above it, the top one first, cut from the id at its dots."""
    segments = F.split(clause, r"\.")
    last = F.size(segments) - (0 if own else 1)
    paths = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "."))
    return F.when(last >= 1, paths).otherwise(F.array().cast("array<string>"))


def subtree_sums(clauses: DataFrame, clause: str = "id", weight: Column | None = None, extra: list[Column] | None = None) -> DataFrame:
    """(ancestor, tree_size, tree_weight): each clause counts for itself, every clause above it and ``extra`` roots.

    Partial sums are formed before the shuffle, so a root that is above everything is no hot group.
    """
    up = ancestors(F.col(clause))
    if extra:
        up = F.concat(up, F.array(*extra))
    weight = F.lit(1) if weight is None else weight
    rows = clauses.select(F.explode(up).alias("ancestor"), weight.cast("long").alias("w"))
    return rows.groupBy("ancestor").agg(F.count("*").alias("tree_size"), F.sum("w").alias("tree_weight"))


def text_weight(lines: Column) -> Column:
    return F.coalesce(F.length(F.array_join(lines, " ")), F.lit(0)).cast("long")


def context_paths(clauses: DataFrame, separator: str = "->") -> DataFrame:
    """(clause_id, path): headings of clauses (clause_id, heading) from the top down to the clause itself."""
    up = clauses.select(F.col("clause_id").alias("of"), F.posexplode(ancestors(F.col("clause_id"))).alias("at", "above"))
    named = up.join(clauses.select(F.col("clause_id").alias("above"), "heading"), "above")
    ordered = named.groupBy(F.col("of").alias("clause_id")).agg(F.sort_array(F.collect_list(F.struct("at", "heading"))).alias("l"))
    return ordered.select("clause_id", F.array_join(F.transform("l", lambda x: x["heading"]), separator).alias("path"))


def attach(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, orphans) of clauses (clause_id, level): edges (parent_id, child_id); orphans name a parent that isn't there."""
    wanted = clauses.select(F.col("clause_id").alias("child_id"), ids.parent_id(F.col("clause_id"), F.col("level")).alias("parent_id")).filter("parent_id is not null")
    there = clauses.select(F.col("clause_id").alias("there")).distinct()
    on = F.col("parent_id") == F.col("there")
    return wanted.join(there, on, "left_semi").select("parent_id", "child_id"), wanted.join(there, on, "left_anti").select("parent_id", "child_id")


def roots(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root clauses, edges) for clauses (clause_id, series, part, level): a root for each series and each of its parts."""
    top = clauses.filter("level <= 1")
    part_id = F.concat("series", F.lit("-"), "part")
    series = top.select(F.col("series").alias("clause_id"), F.lit("x").alias("type"), F.concat(F.lit("Root Clause for "), "series").alias("title")).distinct()
    multi = top.filter(ids.is_multipart(F.col("part")))
    parts = multi.select(part_id.alias("clause_id"), F.lit("x").alias("type"), F.concat(F.lit("Part "), "part", F.lit(" Clause for "), "series").alias("title")).distinct()
    edges = multi.select(F.col("series").alias("parent_id"), part_id.alias("child_id")).distinct()
    edges = edges.unionByName(top.select(F.when(ids.is_multipart(F.col("part")), part_id).otherwise(F.col("series")).alias("parent_id"), F.col("clause_id").alias("child_id")))
    return series.unionByName(parts), edges


def series_sums(clauses: DataFrame, weight: Column | None = None) -> DataFrame:
    """(series, size, weight) of each document series, its synthetic roots included in the size."""
    weight = F.lit(0) if weight is None else weight
    part = F.when(F.col("part") != "", F.col("part"))
    sums = clauses.groupBy("series").agg(F.count("*").alias("n"), F.count_distinct(part).alias("parts"), F.sum(weight.cast("long")).alias("weight"))
    return sums.select("series", (F.col("n") + F.col("parts") + 1).alias("size"), "weight")


def documents(clauses: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Series that hold clauses; with ``allowed`` (domain, series), those of a domain."""
    found = clauses.select("series").filter("series is not null").distinct()
    return found if allowed is None else found.join(F.broadcast(allowed), "series")


def traverse(clauses: DataFrame, chapter: str = "chapter") -> DataFrame:
    """Adds dfs_key: sorted by it, clauses come depth first, children in numeric order."""
    return clauses.withColumn("dfs_key", ids.natural_key(F.col(chapter)))


def fold_up(clauses: DataFrame, combine, cut=lambda df: df) -> DataFrame:
    """Bottom-up fold over (clause_id, parent_id, level, ord, value): ``combine(value, children)`` gives a clause's result.

    ``children`` are the children's results in order. One join per level of the hierarchy, however deep; ``cut`` is given
    each level's frame and may materialise it.
    """
    done, below = None, None
    for level in range(clauses.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = clauses.filter(F.col("level") == level)
        if below is None:
            result = here.withColumn("children", F.array().cast("array<string>"))
        else:
            lists = below.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("ord", "result"))).alias("c"))
            lists = lists.select(F.col("parent_id").alias("p"), F.transform("c", lambda x: x["result"]).alias("children"))
            result = here.join(lists, here["clause_id"] == lists["p"], "left").drop("p").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
        below = cut(result.withColumn("result", combine(F.col("value"), F.col("children"))).drop("children"))
        done = below if done is None else done.unionByName(below)
    return done
