"""python -m clauseloom catalogue|knowledge|mine|headings|summaries|compare|references|links|curated ... : whole runs from files to Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clauseloom.operators import links, relations
from clauseloom.plans import lifecycle
from clauseloom.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="clauseloom")
    sub = out.add_subparsers(dest="run", required=True)
    a = sub.add_parser("catalogue", help="items, headings and UIDs from standard files")
    a.add_argument("data")
    a.add_argument("--local", help="overlay whose titles replace the others")
    a.add_argument("--standards", nargs="*")
    a.add_argument("--parent", default="")
    a.add_argument("--basic", action="store_true", help="without generated content")
    a.add_argument("--readable", action="store_true", help="index instead of UID as locator")
    a.add_argument("--content-only", action="store_true", help="headings only")
    runs = {"knowledge": "clauses, texts, clusters", "mine": "relations between domains", "headings": "headings for clauses without one", "summaries": "a summary of each clause", "compare": "comparisons of clusters"}
    for name, told in runs.items():
        b = sub.add_parser(name, help=told)
        b.add_argument("content", help="structure table")
        b.add_argument("markdown")
        b.add_argument("--relations")
        b.add_argument("--weights")
        b.add_argument("--refmap")
        b.add_argument("--cache", help="what was generated before")
        b.add_argument("--force", action="store_true", help="generate again what is there")
        b.add_argument("--least", type=int, default=relations.CLUSTER, help="members of a cluster")
    c = sub.add_parser("references", help="links in running text")
    c.add_argument("texts")
    c.add_argument("refmap")
    c.add_argument("--trim-dot", action="store_true")
    d = sub.add_parser("links", help="links of clauses related both ways")
    d.add_argument("relations")
    d.add_argument("refmap")
    e = sub.add_parser("curated", help="links of mapping files")
    e.add_argument("mappings")
    e.add_argument("refmap")
    e.add_argument("data", help="standard files, for the width of their UIDs")
    for p in sub.choices.values():
        p.add_argument("--out", required=True)
    return out


def frames(spark: SparkSession, args: argparse.Namespace) -> dict:
    if args.run == "catalogue":
        return lifecycle.catalogue(spark, args.data, args.local, args.standards, args.parent, args.basic, args.readable, args.content_only)
    if args.run in ("knowledge", "mine", "headings", "summaries", "compare"):
        rows = files._csv(spark, args.content, "tag string, hash string, clause_id string, title string, type string")
        related, weights, uids = (read(spark, path) if path else None for read, path in ((files.relations, args.relations), (files.weights, args.weights), (files.uid_map, args.refmap)))
        if args.run == "compare" and related is None:
            raise SystemExit("compare needs --relations")
        known = lifecycle.knowledge(rows, files.markdown(spark, args.markdown), related, weights, uids, args.least)
        full = known["clauses"]
        cached = files.lines(spark, args.cache) if args.cache else None
        runs = {
            "knowledge": lambda: known, "mine": lambda: lifecycle.mine(full), "headings": lambda: lifecycle.headings(full, cached, force=args.force),
            "summaries": lambda: lifecycle.summaries(full, cached, force=args.force), "compare": lambda: lifecycle.compare(full, related, least=args.least),
        }
        return runs[args.run]()
    if args.run == "curated":
        return lifecycle.curated(files.mappings(spark, args.mappings), files.uid_map(spark, args.refmap), files.standards(spark, args.data))
    uids = files.uid_map(spark, args.refmap).withColumn("std_key", F.regexp_replace("uid", "-[^-]*$", ""))
    if args.run == "references":
        return lifecycle.references(files.travelogues(spark, args.texts), uids, args.trim_dot)
    pairs = links.bijective(files.relations(spark, args.relations), uids)
    return {"pairs": pairs, "adjacency": links.adjacency(pairs)}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    for name, frame in frames(SparkSession.builder.getOrCreate(), args).items():
        frame.write.mode("overwrite").parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
