"""Language-model scores from a probabilistic suffix tree over bytes, with word statistics beside it.

A text is lower-cased (A-Z) and cut into words between ASCII blanks; its symbols are the bytes of the words joined by
one space, then one end mark. The tree predicts each symbol from a variable-length context, which may reach into the words
before:

1. counts of all runs of ``DEPTH`` + 1 bytes of the training texts, pre-aggregated by each task and summed by Spark;
   shorter contexts' counts follow by summing out the oldest byte;
2. a context is considered if it occurs ``MIN_COUNT`` times or more (so states grow with the corpus) and its share of all
   symbols is at least ``MIN_SHARE`` (so there are never more than 1 / MIN_SHARE of one length: this bounds what the driver
   and the workers hold). It is retained if the divergence of its next-symbol distribution from that of its longest proper
   suffix, times its count, reaches ``MIN_GAIN`` nats; suffixes of retained contexts are retained;
3. the distributions are smoothed towards those of the suffix, with as many pseudo-counts as there are different next
   symbols, down to the uniform one over all 256 byte values;
4. each symbol is scored from its longest retained suffix; equal runs are looked up once.

The word statistics (count of each word, tokens, distinct tokens) are exact, without a bound, and distributed: the frequent
words (share of at least ``HEAD_SHARE`` of all tokens, hence at most 1 / HEAD_SHARE of them) are known to all workers, the
others are joined by hash. No hash can be hot in that join, as frequent words do not take part in it. Rows of a document
meet again by (id, text hash), which do not depend on the order in which tasks read.

Defined edge cases: a null text counts as empty: its one token is the end; a null id counts as the text '' when the
held-out part is chosen; repeated rows each keep a row; other columns are ignored; an empty table gives an empty table;
without training texts all counts are zero and the tree is uniform.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import by_value, cut

DEPTH = 5
MIN_COUNT = 8
MIN_SHARE = 5e-6
MIN_GAIN = 12.0
HEAD_SHARE = 1e-6
END = 0xFF  # no byte of UTF-8
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLAB = 1 << 21


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def run_codes(words: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text, the code of the run that ends in it, and where each text starts.

    A code is the symbol, and above it the ``depth`` symbols before it, the nearest first (end marks before the text).
    """
    parts = [b" ".join(w) + b"\xff" for w in words]
    stream, lengths = np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    offset = np.arange(len(stream)) - np.repeat(starts, lengths)
    code = stream.astype(np.int64)
    for d in range(1, depth + 1):
        before = np.full(len(stream), END, dtype=np.int64)
        before[d:] = stream[:-d]
        before[offset < d] = END
        code |= before << (8 * d)
    return code, starts


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def corpus_counts(train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, code, n) from (text): kind 0 are runs of bytes, kind 1 hashes of words, kind 2 (code 0) the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        runs: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter = Counter()
        texts = held = 0

        def rows(kind: int, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(code), pa.array(n)], ["kind", "code", "n"])

        def word_rows() -> pa.RecordBatch:
            code = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)
            out = rows(1, code, np.fromiter(words.values(), dtype=np.int64, count=len(words)))
            words.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                split = [tokens(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                texts += len(split)
                for w in split:
                    words.update(w)
                runs.append(np.unique(run_codes(split, depth)[0], return_counts=True))
                held += len(runs[-1][0])
                if held > SLAB:
                    runs = [_merged([c for c, _ in runs], [n for _, n in runs])]
                    held = len(runs[0][0])
                    if held > SLAB // 2:
                        yield rows(0, *runs.pop())
                        held = 0
                if len(words) > SLAB // 2:
                    yield word_rows()
        if runs:
            yield rows(0, *_merged([c for c, _ in runs], [n for _, n in runs]))
        if words:
            yield word_rows()
        if texts:
            yield rows(2, np.zeros(1, np.int64), np.array([texts], np.int64))

    return train.mapInArrow(count, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


class Tree:
    """Retained contexts and smoothed probabilities, by length of the context, in sorted arrays."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], min_gain: float = MIN_GAIN):
        """``levels[d]``: sorted codes and counts of runs of d bytes and the next one, whose contexts are considered."""
        codes, counts = levels[0]
        by_byte = np.bincount(codes, weights=counts, minlength=256) if len(codes) else np.zeros(256)
        kinds = max(int((by_byte > 0).sum()), 1)
        self.root = (by_byte + kinds / 256) / (by_byte.sum() + kinds)
        raw = [by_byte / max(by_byte.sum(), 1.0)]
        found = []
        for d in range(1, len(levels)):
            codes, counts = levels[d]
            context, which = np.unique(codes >> 8, return_inverse=True)
            whole = np.bincount(which, weights=counts, minlength=len(context))
            p = counts / whole[which] if len(codes) else counts
            if d == 1:
                q = raw[0][codes & 0xFF]
            else:
                q = raw[-1][np.searchsorted(levels[d - 1][0], codes & ((1 << 8 * d) - 1))] if len(codes) else p
            gain = np.bincount(which, weights=counts * np.log(p / q), minlength=len(context)) if len(codes) else np.zeros(0)
            raw.append(p)
            found.append([context, gain >= min_gain, whole, which])
        for d in range(len(found) - 1, 0, -1):  # suffixes of retained contexts stay
            context, keep, _, _ = found[d]
            found[d - 1][1] |= np.isin(found[d - 1][0], context[keep] & ((1 << 8 * d) - 1))
        self.contexts, self.escapes, self.entries, self.chances = [], [], [], []
        for d, (context, keep, whole, which) in enumerate(found, 1):
            codes, counts = levels[d]
            kinds = np.bincount(which, minlength=len(context))
            mine = keep[which] if len(codes) else np.zeros(0, bool)
            above = self.chance(codes[mine], d - 1)
            w, k = whole[which][mine], kinds[which][mine]
            self.contexts.append(context[keep])
            self.escapes.append((kinds / (whole + kinds))[keep])
            self.entries.append(codes[mine])
            self.chances.append((counts[mine] + k * above) / (w + k))

    def chance(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Probability of each run's last byte from its longest retained suffix of at most ``depth`` bytes."""
        out = self.root[codes & 0xFF]
        live = np.arange(len(codes))
        for d in range(1, depth + 1):
            own = codes[live] & ((1 << 8 * (d + 1)) - 1)
            at = np.searchsorted(self.contexts[d - 1], own >> 8)
            if not len(self.contexts[d - 1]):
                break
            there = self.contexts[d - 1][np.minimum(at, len(self.contexts[d - 1]) - 1)] == own >> 8
            live, own, at = live[there], own[there], at[there]
            if not len(live):
                break
            spot = np.minimum(np.searchsorted(self.entries[d - 1], own), len(self.entries[d - 1]) - 1)
            seen = self.entries[d - 1][spot] == own
            out[live] = np.where(seen, self.chances[d - 1][spot], out[live] * self.escapes[d - 1][at])
        return out

    def scores(self, words: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text."""
        codes, starts = run_codes(words, len(self.contexts))
        logs = np.empty(len(codes))
        for at in range(0, len(codes), 2 * SLAB):
            different, which = np.unique(codes[at : at + 2 * SLAB], return_inverse=True)
            logs[at : at + 2 * SLAB] = np.log10(self.chance(different, len(self.contexts)))[which]
        return np.add.reduceat(logs, starts)


def considered_runs(runs: DataFrame, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels for :class:`Tree` out of (code, n). A level has at most 1 / min_share contexts of up to 256 next bytes."""
    total = runs.agg(F.sum("n")).first()[0] or 0
    levels = F.array(*[F.struct(F.lit(d).alias("d"), F.col("code").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)).alias("code")) for d in range(depth + 1)])
    each = cut(runs.select(F.explode(levels).alias("x"), "n").groupBy("x.d", "x.code").agg(F.sum("n").alias("n")))
    context = F.shiftright("code", 8)
    often = each.groupBy("d", context.alias("c")).agg(F.sum("n").alias("all")).filter((F.col("d") == 0) | (F.col("all") >= max(float(min_count), min_share * total))).select(F.col("d").alias("od"), "c")
    kept = each.join(often, (F.col("d") == F.col("od")) & (context == F.col("c"))).select("d", "code", "n").toPandas().sort_values(["d", "code"])
    return [(part["code"].to_numpy(np.int64), part["n"].to_numpy(np.float64)) for part in (kept[kept["d"] == d] for d in range(depth + 1))]


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, head_share: float = HEAD_SHARE, min_share: float = MIN_SHARE, depth: int = DEPTH, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    kind = docs.select(doc_id).dtypes[0][1]

    def held(col: str):
        return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds == fold

    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    counts = cut(corpus_counts(read.filter(~held("doc_id")).select("text"), depth))
    sums = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    texts = sums.get(2, (0, 0))[0]
    n, v = sums.get(1, (0, 0))[0] + texts, sums.get(1, (0, 0))[1] + bool(texts)
    known, least = counts.filter("kind = 1").select("code", F.col("n").alias("c")), max(1.0, head_share * n)
    head = known.filter(F.col("c") >= least).toPandas()  # at most 1 / head_share rows
    tree = Tree(considered_runs(counts.filter("kind = 0").select("code", "n"), min_count, min_share, depth), min_gain)
    model = sc.broadcast((vars(tree), head["code"].to_numpy(np.int64), np.log10(head["c"].to_numpy(np.float64) + 1), float(np.log10(texts + 1)), bool(texts)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        fields, codes, logs, end_log, end_known = model.value
        tree = Tree.__new__(Tree)
        vars(tree).update(fields)
        of_hash = dict(zip(codes.view(np.uint64).tolist(), logs.tolist(), strict=True))
        of_word: dict[bytes, float] = {}

        def scored(part: pa.RecordBatch, split: list[list[bytes]]) -> pa.RecordBatch:
            of: list[int] = []
            hashes: list[int] = []
            many: list[int] = []
            base, known_ = [], []
            for k, w in enumerate(split):
                total, seen = end_log, int(end_known)
                for word, times in Counter(w).items():
                    x = of_word.get(word)
                    if x is None:
                        h = xxhash.xxh64_intdigest(word, 42)
                        x = of_hash.get(h)
                        if x is None:
                            of.append(k)
                            hashes.append(h)
                            many.append(times)
                            continue
                        of_word[word] = x
                    total += times * x
                    seen += times
                base.append(total)
                known_.append(seen)
            size, more = len(split), len(of)
            place = pa.array(np.concatenate([np.arange(size), np.array(of, np.int64)]))
            whole = lambda x, t: pa.array(np.concatenate([np.asarray(x, t), np.zeros(more, t)]))
            own = part.column(1).fill_null(0).to_numpy()  # rows of documents meet no word; their text's hash spreads them
            return pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(place), part.column(1).take(place), pa.array(np.concatenate([own, np.array(hashes, np.uint64).view(np.int64)])), pa.array(np.concatenate([np.zeros(size, np.int64), np.array(many, np.int64)])),
                    whole(base, np.float64), whole(known_, np.int64), whole([len(w) + 1 for w in split], np.int64), whole(tree.scores(split), np.float64),
                ],
                ["doc_id", "th", "h", "n", "base", "known", "n_tokens", "score"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield scored(part, [tokens(t) for t in part.column(2).to_pylist()])

    rows = read.mapInArrow(score, f"doc_id {kind}, th bigint, h bigint, n bigint, base double, known bigint, n_tokens bigint, score double")
    joined = rows.join(known.filter(F.col("c") < least), (F.col("h") == F.col("code")) & (F.col("n") > 0), "left").select(
        "doc_id", "th", (F.col("base") + F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"), (F.col("known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"), "n_tokens", "score"
    )
    # equal rows are summed and then shared out again
    summed = joined.groupBy("doc_id", "th").agg(F.sum("base").alias("base"), F.sum("score").alias("score"), F.sum("known").alias("known"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("n_tokens") > 0).cast("int").alias("copies"))
    one = lambda c: (F.col(c) / F.col("copies")).cast("long")
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("n", one("n_tokens"))
    return each.select(
        "doc_id", held("doc_id").alias("held_out"), F.col("n").alias("n_tokens"), one("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") - F.col("n") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )


def op7_suffix_tree(docs: DataFrame) -> DataFrame:
    return lm_scores(docs)


by_value(__name__)
