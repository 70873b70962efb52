"""Sentences as vectors: ingestion, exact top-k retrieval in blocks, neighbouring texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as tx

Embedder = Callable[[list[str]], np.ndarray]
#: Bytes of a block of queries or nodes as doubles, and scores that are made at once: two blocks and these are what a task
#: holds. Each side moves once for each block of the other, so blocks are as large as memory allows.
BLOCK_BYTES, SCORES, LEAST_BLOCK = 32 << 20, 4 << 20, 4096


def hashed_embedder(dim: int = 64) -> Embedder:
    """Deterministic default without a model: signed hashing of words, normalised."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def documents(clauses: DataFrame) -> DataFrame:
    """Text and metadata of clauses (clause_id, series, type, heading, text array), NULs removed."""
    return clauses.select("clause_id", "series", "type", "heading", F.replace(tx.joined(F.col("text")), F.lit("\0"), F.lit("")).alias("text"))


def sentence_nodes(docs: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """One row per sentence of ``docs`` (clause_id, text, ...): sent_no, sentence and its vector; whole-table ingestion."""
    each = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(tx.sentences(F.col("text"))).alias("sent_no", "sentence"))
    embed = embed or hashed_embedder()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vec=list(embed(batch["sentence"].tolist()))) if len(batch) else batch.assign(vec=pd.Series(dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema)
    return each.mapInPandas(add, f"{schema}, vec array<float>")


def save_index(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("domain").parquet(path)


def load_index(spark, path: str, domain: str | None = None) -> DataFrame:
    nodes = spark.read.parquet(path)
    return nodes if domain is None else nodes.filter(F.col("domain") == domain)


def top_k(queries: DataFrame, nodes: DataFrame, k: int = 10, block: int | None = None) -> DataFrame:
    """(qid, domain, nid, score, rank): the k nodes of each domain nearest to each query by dot product, exact.

    ``queries`` (qid, qvec), ``nodes`` (nid, domain, nvec). Both sides are cut into blocks; each pair of blocks is one
    matrix product, in slices, that keeps its best k per query, and the best of the blocks' bests are ranked. Ties go to
    the smaller nid. ``block`` (rows) follows from the vectors' length
    and leaves a pair of blocks for each core.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("dim")).first()
    n_nodes = nodes.count()
    if block is None:
        tasks = queries.sparkSession.sparkContext.defaultParallelism
        block = min(max(1, BLOCK_BYTES // (8 * max(1, size["dim"] or 1))), max(LEAST_BLOCK, math.isqrt(size["n"] * n_nodes // tasks)))
    nq = max(1, -(-size["n"] // block))
    nn = max(1, -(-n_nodes // block))
    domains = nodes.select("domain").distinct().select(F.col("domain").alias("domain"))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).join(F.broadcast(domains))
    q = q.withColumn("nb", F.explode(F.sequence(F.lit(0), F.lit(nn - 1))))
    n = nodes.select(*[F.col(c).alias(c) for c in nodes.columns]).withColumn("nb", F.pmod(F.xxhash64("nid"), F.lit(nn)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "domain": [], "nid": [], "score": []})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("nid", kind="stable")
        a = np.stack(left["qvec"].to_numpy()).astype(np.float64)
        b = np.stack(right["nvec"].to_numpy()).astype(np.float64)
        m, step = min(k, len(b)), max(1, SCORES // len(b))
        parts = []
        for at in range(0, len(a), step):
            scores = a[at : at + step] @ b.T
            # all that reach the m-th best score, so that ties are settled below and not by the partition
            least = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
            rows, cols = np.nonzero(scores >= least[:, None] - 1e-12)
            parts.append(pd.DataFrame({"qid": left["qid"].to_numpy()[at + rows], "nid": right["nid"].to_numpy()[cols], "score": scores[rows, cols]}))
        out = pd.concat(parts)
        out["domain"] = right["domain"].iloc[0]
        out = out.sort_values(["qid", "score", "nid"], ascending=[True, False, True], kind="stable")
        return out.groupby("qid", sort=False).head(m)[["qid", "domain", "nid", "score"]]

    types = dict(queries.dtypes) | dict(nodes.dtypes)
    found = q.groupBy("domain", "qb", "nb").cogroup(n.groupBy("domain", "qb", "nb")).applyInPandas(best, f"qid {types['qid']}, domain {types['domain']}, nid {types['nid']}, score double")
    rank = F.row_number().over(Window.partitionBy("qid", "domain").orderBy(F.desc("score"), "nid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def neighbours(sentences: DataFrame, width: int = 2) -> DataFrame:
    """Adds previous_texts (nearest first) and next_texts of rows (clause_id, sent_no, sentence)."""
    w = Window.partitionBy("clause_id").orderBy("sent_no")
    before = F.collect_list("sentence").over(w.rowsBetween(-width, -1)) if width else F.array().cast("array<string>")
    after = F.collect_list("sentence").over(w.rowsBetween(1, width)) if width else F.array().cast("array<string>")
    return sentences.withColumn("previous_texts", F.reverse(before)).withColumn("next_texts", after)


def chunks(found: DataFrame) -> DataFrame:
    """Retrieved rows with the defaults of a chunk: no score is 0, no document is '-'."""
    return found.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("doc_id", F.coalesce("doc_id", F.lit("-")))


cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
