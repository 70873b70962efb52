"""Benchmark decontamination by n-gram windows, in built-in functions only.

Windows are runs of 13 words of a benchmark item, or the whole item if it is shorter. Their hashes are joined to the
windows of every document; a hit is verified word by word. The benchmark side is broadcast if it has at most
``MAX_BROADCAST`` windows of ``MAX_BYTES`` bytes in all (checked by an aggregate). Beyond that only hashes move: document
windows (id, text hash, place, hash) meet benchmark windows (hash) in a shuffle join, whose hits are few; their places go
back to their documents, where the words are cut out, and meet the benchmark's words by hash and words.

Defined edge cases: a null or wordless document has no hit and is not contaminated; a null or wordless item has no
window; items with equal text all count; repeated document rows each keep their row; null ids are allowed (as an item
id: not listed); other columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import alnum_words

WINDOW = 13
CHUNK = 64
MAX_BROADCAST = 1_000_000
MAX_BYTES = 256 << 20
MIN_SHARE = 20


def _windows(df: DataFrame, lengths: list[int], *cols: str) -> DataFrame:
    """One row per window of the array ``w``: ``cols``, n (words), at (start, -1 for the row that stands for the text), len, h.

    Windows come out of chunks of ``CHUNK`` starts, so a row holds the words of a chunk (c; i: the start there), not those of its text.
    """
    n, m = F.size("w"), F.size("c")
    none = F.array().cast("array<int>")
    bases = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(CHUNK))
    chunk = F.transform(bases, lambda s: F.struct(s.alias("base"), F.slice("w", s + 1, CHUNK + WINDOW - 1).alias("c")))
    parts = df.select(*cols, n.alias("n"), F.explode_outer(chunk).alias("part")).select(*cols, "n", "part.base", "part.c")
    starts = [F.when(m >= size, F.transform(F.sequence(F.lit(0), F.least(m - size, F.lit(CHUNK - 1))), lambda i: i * 16 + size)).otherwise(none) for size in lengths]
    own = F.when(F.col("base") == 0, F.array(F.lit(-1))).otherwise(none)
    coded = parts.select(*cols, "n", "base", "c", F.explode_outer(F.concat(own, *starts)).alias("code")).filter("code is not null")
    i, size = F.shiftright("code", 4), F.col("code") % 16
    at = F.when(F.col("code") < 0, -1).otherwise(F.col("base") + i)
    return coded.select(*cols, "n", "c", i.alias("i"), at.alias("at"), size.alias("len"), F.xxhash64(size, *[F.when(size > k, F.get("c", i + k)) for k in range(WINDOW)]).alias("h"))


def _verified(read: DataFrame, bench: DataFrame, lengths: list[int]) -> tuple[DataFrame, Column, Column]:
    """Rows as the broadcast join gives them, and when a row is a hit; no row of the joins holds a text's words.

    ``read`` (doc_id, th, w). A row of at = -1 stands for each row of ``read``.
    """
    narrow = _windows(read, lengths, "doc_id", "th").filter("at >= 0").select("doc_id", "th", "at", "len", "h").distinct()
    hashes = bench.select("bh").distinct()
    places = narrow.join(hashes, F.col("h") == F.col("bh"), "left_semi")
    by_text = places.groupBy(F.col("doc_id").alias("pid"), F.col("th").alias("pth")).agg(F.collect_list(F.struct("at", "len", "h")).alias("places"))
    texts = read.dropDuplicates(["doc_id", "th"]).join(by_text, F.col("doc_id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth")))
    spot = lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["h"].alias("h"), F.slice("w", x["at"] + 1, x["len"]).alias("cut"))
    cut = texts.select("doc_id", "th", F.explode_outer(F.transform("places", spot)).alias("x")).select("doc_id", "th", "x.*")
    found = cut.join(bench, (F.col("h") == F.col("bh")) & (F.col("cut") == F.col("words"))).select("doc_id", "th", F.lit(None).cast("int").alias("n"), "at", "len", "items")
    own = read.select("doc_id", "th", F.size("w").alias("n"), F.lit(-1).alias("at"), F.lit(-1).alias("len"), F.lit(None).cast("array<string>").alias("items"))
    return own.unionByName(found), F.col("at") >= 0, F.col("n").cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``; and th, the text's hash."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), alnum_words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    short = [r[0] for r in items.filter(F.size("w") < WINDOW).select(F.size("w")).distinct().collect()]  # at most 12 values
    lengths = sorted({*short, WINDOW})
    spans = _windows(items, lengths, "item").filter((F.col("at") >= 0) & ((F.col("len") == WINDOW) | (F.col("len") == F.col("n"))))
    bench = (
        spans.select("h", F.slice("c", F.col("i") + 1, F.col("len")).alias("words"), "item")
        .groupBy("h", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumnRenamed("h", "bh")
    )
    size = bench.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("words", " ")) + 8 * F.size("words") + F.octet_length(F.array_join("items", ","))).alias("b")).first()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), alnum_words(F.col(text)).alias("w"))
    if size["n"] <= max_broadcast and (size["b"] or 0) <= max_bytes:
        rows = _windows(read, lengths, "doc_id", "th")
        joined = rows.join(F.broadcast(bench), F.col("h") == F.col("bh"), "left").filter((F.col("at") < 0) | F.col("bh").isNotNull())
        same = F.col("words").isNotNull() & (F.slice("c", F.greatest(F.col("i"), F.lit(0)) + 1, F.greatest(F.col("len"), F.lit(0))) == F.col("words"))
        n_words = F.col("n").cast("long")
    else:
        joined, same, n_words = _verified(read, bench, lengths)
    hits = joined.select("doc_id", "th", n_words.alias("n_words"), F.when(same, F.struct("at", "len")).alias("hit"), F.when(same, F.col("items")).alias("items"), (F.col("at") < 0).alias("own"))
    grouped = hits.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("items").alias("sets"), F.count_if("own").cast("int").alias("copies")
    )
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))
    found = F.array_sort(F.array_distinct(F.flatten("sets")))
    counted = grouped.select("doc_id", "th", "n_words", F.size(places).cast("long").alias("n_hit"), found.alias("found"), "copies")
    one = counted.select(
        "doc_id", "th", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "copies",
    )
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the contaminated documents; all others stay as they are."""
    bad = contamination(docs, benchmark, doc_id, text, **kw).filter("contaminated").select(F.col("doc_id").alias("bid"), F.col("th").alias("bth"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("rid"), F.xxhash64(F.col(text)).alias("rth"))
    return row.join(bad, F.col("rid").eqNullSafe(F.col("bid")) & (F.col("rth") == F.col("bth")), "left_anti").select("row.*")


def op5_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("th")
