"""Relation mining between clauses of different domains. Order matters: boost, maximum, mean, filter, weight, sum, top 3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import ids

KEPT = 3
CLUSTER = 5
#: Fixed value: domains in canonical order.
DOMAIN_ORDER = ["automotive", "industry", "railway"]
EPSILON = 1e-9


def fused(matches: DataFrame, boost: float = 2.0) -> DataFrame:
    """Best score of each peer clause for each sentence, with the sentence's mean and significance; above-average only.

    ``matches`` (clause_id, sent_no, clause_type, own, domain, peer_id, peer_type, score), one row per retrieved node.
    """
    score = F.col("score") * F.when(F.col("peer_type") == F.col("clause_type"), F.lit(boost)).otherwise(1.0)
    best = matches.groupBy("clause_id", "sent_no", "own", "domain", "peer_id").agg(F.max(score).alias("s"))
    sentence = Window.partitionBy("clause_id", "sent_no", "domain")
    each = best.withColumn("mean", F.avg("s").over(sentence)).withColumn("sig", F.max("s").over(sentence) - F.col("mean"))
    return each.filter(F.col("s") >= F.col("mean") - EPSILON)


def weights(fused_rows: DataFrame) -> DataFrame:
    """(clause_id, sent_no, scat, sign): scatter and significance of each sentence in its own domain, over the clause's means."""
    each = fused_rows.filter(F.col("domain") == F.col("own")).groupBy("clause_id", "sent_no").agg(F.count("*").alias("n"), F.max("sig").alias("sig"))
    clause = Window.partitionBy("clause_id")
    mean = lambda c: F.avg(c).over(clause)
    return each.select("clause_id", "sent_no", (F.col("n") / F.when(mean("n") != 0, mean("n"))).alias("scat"), (F.col("sig") / F.when(mean("sig") != 0, mean("sig"))).alias("sign"))


def weight_arrays(sentence_weights: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("sent_no", "scat", "sign")))
    return sentence_weights.groupBy("clause_id").agg(ordered.alias("w")).select("clause_id", F.transform("w", lambda x: x["scat"]).alias("scat"), F.transform("w", lambda x: x["sign"]).alias("sign"))


def peers(fused_rows: DataFrame, sentence_weights: DataFrame | None = None) -> DataFrame:
    """(clause_id, own, domain, peer_id, score, hits): scores summed over sentences, weighted by significance (1 if unknown)."""
    rows = fused_rows
    weight = F.lit(1.0)
    if sentence_weights is not None:
        rows = rows.join(sentence_weights.select("clause_id", "sent_no", "sign"), ["clause_id", "sent_no"], "left")
        weight = F.coalesce("sign", F.lit(1.0))
    return rows.groupBy("clause_id", "own", "domain", "peer_id").agg(F.round(F.sum(F.col("s") * weight), 6).alias("score"), F.count("*").alias("hits"))


def best(peer_rows: DataFrame, kept: int = KEPT) -> DataFrame:
    """The best peers of each clause and domain; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("clause_id", "domain").orderBy(F.desc("score"), "peer_id"))
    return peer_rows.withColumn("rank", rank).filter(F.col("rank") <= kept)


def relate(peer_rows: DataFrame, selfaware: DataFrame | None = None, done: DataFrame | None = None, kept: int = KEPT) -> DataFrame:
    """(src, dst, score): relations to foreign domains, without clauses that are done or fail to find themselves."""
    rows = peer_rows.filter("domain <> own")
    if selfaware is not None:
        rows = rows.join(selfaware.filter("selfaware >= 1").select("clause_id"), "clause_id", "left_semi")
    if done is not None:
        rows = rows.join(done.select("clause_id", "domain").distinct(), ["clause_id", "domain"], "left_anti")
    return best(rows, kept).select(F.col("clause_id").alias("src"), F.col("peer_id").alias("dst"), "score")


def self_identification(peer_rows: DataFrame) -> DataFrame:
    """(clause_id, own, hit, selfaware): whether the best peer in the own domain is the clause itself."""
    top = best(peer_rows.filter("domain = own"), 1)
    hit = F.col("peer_id") == F.col("clause_id")
    return top.select("clause_id", "own", hit.alias("hit"), F.when(hit, 1.0).otherwise(0.5).alias("selfaware"))


def accuracy(hits: DataFrame, series: Column | None = None) -> DataFrame:
    """(series, hits, misses, accuracy) with the true ratio."""
    key = (ids.clause_id_parts(F.col("clause_id"))["series"] if series is None else series).alias("series")
    counted = hits.groupBy(key).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return counted.withColumn("accuracy", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


def level_up(peer_rows: DataFrame) -> DataFrame:
    """(parent, own, domain, peer_parent, score, hit): for each parent clause the parent that its children's peers favour."""
    up = peer_rows.groupBy(ids.parent_path(F.col("clause_id")).alias("parent"), "own", "domain", ids.parent_path(F.col("peer_id")).alias("peer_parent")).agg(F.round(F.sum("score"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("parent", "domain").orderBy(F.desc("score"), "peer_parent"))
    top = up.withColumn("rank", rank).filter("rank = 1").drop("rank")
    return top.withColumn("hit", F.when(F.col("domain") == F.col("own"), F.col("parent") == F.col("peer_parent")))


def memorized(relations: DataFrame) -> DataFrame:
    """(src, dst, score): the last row (by line_no) of each pair counts."""
    return relations.groupBy("src", "dst").agg(F.max_by("score", "line_no").alias("score"))


def resonance(relations: DataFrame) -> DataFrame:
    """(clause_id, impulse, resonance): scores received, over their mean. Repeated relations add up."""
    impulse = relations.groupBy(F.col("dst").alias("clause_id")).agg(F.sum("score").alias("impulse"))
    mean = impulse.agg(F.avg("impulse").alias("mean"))
    return impulse.join(F.broadcast(mean)).select("clause_id", "impulse", F.round(F.col("impulse") / F.col("mean"), 6).alias("resonance"))


def clusters(relations: DataFrame, clauses: DataFrame, least: int = CLUSTER) -> DataFrame:
    """(parent, peer_parent, domain, members): siblings with peers under one parent, ``least`` or more of them."""
    domain = clauses.select(F.col("clause_id").alias("dst"), "domain")
    rows = relations.join(domain, "dst").select(ids.parent_path(F.col("src")).alias("parent"), ids.parent_path(F.col("dst")).alias("peer_parent"), "domain", "src")
    return rows.groupBy("parent", "peer_parent", "domain").agg(F.array_sort(F.collect_set("src")).alias("members")).filter(F.size("members") >= least)


def cluster_scores(found: DataFrame, relations: DataFrame) -> DataFrame:
    """(member, peer_parent, peer, score): each member's peer under the cluster's parent; of several the best."""
    member = found.select(F.explode("members").alias("src"), "peer_parent")
    rows = relations.withColumn("peer_parent", ids.parent_path(F.col("dst")))
    return member.join(rows, ["src", "peer_parent"]).groupBy(F.col("src").alias("member"), "peer_parent").agg(F.max(F.struct("score", "dst")).alias("m")).select("member", "peer_parent", F.col("m.dst").alias("peer"), F.col("m.score").alias("score"))


def reciprocal(found: DataFrame) -> DataFrame:
    """Clusters whose peer's parent has a cluster in return."""
    back = found.select(F.col("parent").alias("peer_parent"), F.col("peer_parent").alias("parent")).distinct()
    return found.join(back, ["parent", "peer_parent"], "left_semi")


def cluster_rows(found: DataFrame, relations: DataFrame) -> DataFrame:
    """(parent, peer_parent, member, peer, score, revscore): the report's rows."""
    member = found.select("parent", "peer_parent", F.explode("members").alias("src"))
    rows = relations.withColumn("peer_parent", ids.parent_path(F.col("dst")))
    back = relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("score").alias("revscore"))
    return member.join(rows, ["src", "peer_parent"]).join(back, ["src", "dst"], "left").select("parent", "peer_parent", F.col("src").alias("member"), F.col("dst").alias("peer"), "score", F.coalesce("revscore", F.lit(0.0)).alias("revscore"))


def comparisons(found: DataFrame, parents: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Each unordered pair of parents once, in canonical domain order; ``parents`` (clause_id, domain)."""
    order = DOMAIN_ORDER if order is None else order
    rank = lambda c: reduce(lambda w, kv: w.when(F.col(c) == kv[1], F.lit(kv[0])), enumerate(order), F).otherwise(F.lit(len(order)))
    d = lambda end: parents.select(F.col("clause_id").alias(end), F.col("domain").alias(f"{end}_domain"))
    both = found.select("parent", "peer_parent").join(d("parent"), "parent").join(d("peer_parent"), "peer_parent")
    swap = (rank("parent_domain") > rank("peer_parent_domain")) | ((rank("parent_domain") == rank("peer_parent_domain")) & (F.col("parent") > F.col("peer_parent")))
    return both.select(F.when(swap, F.col("peer_parent")).otherwise(F.col("parent")).alias("first"), F.when(swap, F.col("parent")).otherwise(F.col("peer_parent")).alias("second")).distinct()


def contexts(pairs: DataFrame, rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """(first, second, first_text, second_text): headings and texts of each side's clauses for a comparison.

    ``rows`` as of :func:`cluster_rows`; ``clauses`` (clause_id, heading, text string).
    """
    sides = rows.select("parent", F.col("peer_parent").alias("other"), F.col("member").alias("clause_id")).unionByName(rows.select(F.col("peer_parent").alias("parent"), F.col("parent").alias("other"), F.col("peer").alias("clause_id"))).distinct()
    told = sides.join(clauses, "clause_id").groupBy("parent", "other").agg(F.sort_array(F.collect_list(F.struct("clause_id", F.concat_ws("\n", "heading", "text").alias("t")))).alias("l"))
    told = told.select("parent", "other", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("t"))
    first = told.select(F.col("parent").alias("first"), F.col("other").alias("second"), F.col("t").alias("first_text"))
    second = told.select(F.col("other").alias("first"), F.col("parent").alias("second"), F.col("t").alias("second_text"))
    return pairs.join(first, ["first", "second"], "left").join(second, ["first", "second"], "left")
