"""Whole runs: from files to catalogue, knowledge, relations, links. Each returns named frames; nothing runs before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import ids
from clauseloom.functions import text as tx
from clauseloom.operators import generate, links, markdown, relations, tree, vectors
from clauseloom.sources import files, sinks

#: Document series by domain.
DOMAINS = {"railway": ["EN 50126", "EN 50129", "EN 50716"], "industry": ["IEC 61508"], "automotive": ["ISO 26262", "ISO PAS 8926"], "infotec": ["IEC 11889"]}


def catalogue(spark: SparkSession, data: str, local: str | None = None, standards: list[str] | None = None, parent: str = "", basic: bool = False, readable: bool = False, content_only: bool = False) -> dict[str, DataFrame]:
    """Items, their headings and UIDs from standard files. ``content_only`` gives no items and readable locators."""
    found = files.standards(spark, data)
    if standards is not None:
        found = files.with_missing(found.filter(F.col("std_key").isin(standards)), standards, parent)
    parsed = ids.parse_items(ids.expand_items(files.volumes(found)))
    toc, texts = files.records(spark, data, local)
    titled = ids.join_titles(parsed, toc, texts, basic=basic, readable=readable or content_only)
    out = {"headings": sinks.heading_data(titled), "uids": sinks.uid_rows(titled), "collisions": ids.uid_collisions(parsed), "mismatches": titled.filter("marker_mismatch").groupBy("std_key").count(), "warnings": parsed.filter("warning is not null")}
    return out if content_only else out | {"items": sinks.items(titled), "catalogue": titled}


def clauses(rows: DataFrame, domains: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clauses, rejects) of structure rows (clause_id, title, type): series, part, chapter, level, domain, context."""
    kept, rejects = files.split_structure(rows)
    p = ids.clause_id_parts(F.col("clause_id"))
    base = kept.select("clause_id", F.lower("type").alias("type"), F.col("type").rlike("[A-Z]").alias("is_generated"), "title", *[p[n].alias(n) for n in ("series", "part", "chapter", "level")])
    pairs = [(s.replace(" ", ""), d) for d, series in (DOMAINS if domains is None else domains).items() for s in series]
    named = base.join(F.broadcast(rows.sparkSession.createDataFrame(pairs, "series string, domain string")), "series", "left")
    above = named.select(F.col("clause_id").alias("up"), F.col("title").alias("parent_title"))
    top = named.select(F.col("clause_id").alias("high"), F.col("title").alias("top_title"))
    wide = named.join(above, ids.parent_path(F.col("clause_id")) == F.col("up"), "left").join(top, F.substring_index("clause_id", ".", 1) == F.col("high"), "left")
    return wide.withColumn("context", ids.context_sentence(F.col("title"), ids.depth(F.col("chapter")), F.col("parent_title"), F.col("top_title"))).drop("up", "high", "parent_title", "top_title"), rejects


def knowledge(rows: DataFrame, lines: DataFrame, related: DataFrame | None = None, weights: DataFrame | None = None, uids: DataFrame | None = None, least: int = relations.CLUSTER) -> dict[str, DataFrame]:
    """Clauses with their texts, what is missing or odd, resonance, clusters and the cluster report."""
    c, rejects = clauses(rows)
    chapters = c.select("series", "part", "chapter", "clause_id")
    texts, heads, dropped = markdown.segment(lines, chapters)
    full = c.join(texts, "clause_id", "left")
    edges, orphans = tree.attach(c)
    out = {
        "clauses": full, "rejects": rejects, "edges": edges, "orphans": orphans, "dropped": dropped, "missed": markdown.missed(chapters, heads, lines),
        "titles": markdown.title_findings(heads, c.select("clause_id", "title")), "types": markdown.type_report(full.select("clause_id", "type", tx.joined(F.col("text")).alias("text"))),
        "series": tree.series_sums(c.join(texts, "clause_id", "left"), tree.text_weight(F.col("text"))),
    }
    if related is not None:
        kept, bad = files.known_relations(related, c)
        peers = relations.memorized(kept)
        found = relations.clusters(peers, c, least)
        out |= {"unknown_targets": bad, "resonance": relations.resonance(kept), "clusters": found, "report": sinks.cluster_report(relations.cluster_rows(relations.reciprocal(found), peers))}
    if weights is not None:
        counts = full.select("clause_id", F.size(tx.sentences(tx.joined(F.col("text")))).alias("sentences"))
        out["weights"] = files.check_weights(weights, counts)
    if uids is not None:
        out["uids"] = files.known_uids(uids, c)
    return out


def mine(full: DataFrame, embed: vectors.Embedder | None = None, k: int = 10) -> dict[str, DataFrame]:
    """Relations and weights of clauses (clause_id, domain, series, type, title, text array): both passes as one plan."""
    docs = vectors.documents(full.withColumnRenamed("title", "heading")).join(full.select("clause_id", "domain"), "clause_id").filter("domain is not null")
    nodes = vectors.sentence_nodes(docs, embed).withColumn("nid", F.concat_ws("#", "clause_id", "sent_no"))
    found = vectors.top_k(nodes.select(F.col("nid").alias("qid"), F.col("vec").alias("qvec")), nodes.select("nid", "domain", F.col("vec").alias("nvec")), k)
    of = nodes.select(F.col("nid").alias("qid"), "clause_id", "sent_no", F.col("type").alias("clause_type"), F.col("domain").alias("own"))
    to = nodes.select("nid", F.col("clause_id").alias("peer_id"), F.col("type").alias("peer_type"))
    fused = relations.fused(found.join(of, "qid").join(to, "nid"))
    weights = relations.weights(fused)
    peers = relations.peers(fused, weights)
    hits = relations.self_identification(peers)
    return {"weights": relations.weight_arrays(weights), "peers": peers, "accuracy": relations.accuracy(hits), "relations": relations.relate(peers, hits), "parents": relations.level_up(peers)}


def references(lines: DataFrame, uids: DataFrame, trim_dot: bool = False) -> dict[str, DataFrame]:
    return {"resolved": links.resolve(lines, uids, trim_dot), "lines": links.rewrite(lines, uids, trim_dot)}


def headings(full: DataFrame, cached: DataFrame | None = None, generator: generate.Generator = generate.extractive, force: bool = False) -> dict[str, DataFrame]:
    """Candidates for clauses with a text whose title says nothing; those with candidates in a cache (path, line_no, line) are not asked for."""
    none = F.array().cast("array<struct<heading:string,status:string,source:string>>")
    wanted = full.filter("text is not null").select("clause_id", F.col("title").alias("display"), none.alias("alternatives"), tx.joined(F.col("text")).alias("text"))
    if cached is None or force:
        return {"headings": generate.headings(wanted, generator, force=force)}
    old = generate.cached_headings(files.blocks(cached))
    new = generate.headings(wanted.join(old.select("clause_id").distinct(), "clause_id", "left_anti"), generator)
    return {"headings": old.drop("line_no").unionByName(new)}


def summaries(full: DataFrame, cached: DataFrame | None = None, generator: generate.Generator = generate.extractive, force: bool = False) -> dict[str, DataFrame]:
    """A summary of each clause, its children's first; those in a cache (path, line_no, line) are not asked for."""
    rows = full.select("clause_id", ids.parent_id(F.col("clause_id"), F.col("level")).alias("parent_id"), "level", ids.natural_key(F.col("chapter")).alias("ord"), F.coalesce(tx.joined(F.col("text")), F.lit("")).alias("value"))
    old = None if cached is None else files.cached_texts(cached).select("clause_id", F.array_join("lines", "\n").alias("summary"))
    return {"summaries": generate.summaries(rows, generator, old, force)}


def compare(full: DataFrame, related: DataFrame, generator: generate.Generator = generate.extractive, least: int = relations.CLUSTER) -> dict[str, DataFrame]:
    """Each pair of parents with a cluster once, with a comparison of their clauses' headings and texts."""
    peers = relations.memorized(files.known_relations(related, full)[0])
    found = relations.clusters(peers, full, least)
    pairs = relations.comparisons(found, full.select("clause_id", "domain"))
    told = relations.contexts(pairs, relations.cluster_rows(found, peers), full.select("clause_id", F.col("title").alias("heading"), tx.joined(F.col("text")).alias("text")))
    return {"contexts": told, "comparisons": generate.compare(told, generator)}


def curated(mappings: DataFrame, uids: DataFrame, standards: DataFrame) -> dict[str, DataFrame]:
    """Curated links of mapping rows; ``uids`` as of a UID map ('standard-number'), ``standards`` with their digits."""
    known = uids.select(F.regexp_replace("uid", "-[^-]*$", "").alias("std_key"), F.substring_index("uid", "-", -1).alias("uid"), "clause_id")
    return {"curated": links.curated(mappings, known, standards.select("std_key", "digits").distinct())}
