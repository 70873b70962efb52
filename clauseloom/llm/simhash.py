"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints: 64 bits over the XXH64 (seed 42) of word shingles, computed batch by batch with NumPy. Only distinct
fingerprints go on. The 64 bits are split into six blocks; two fingerprints that differ in at most three bits agree on
at least three whole blocks, so each is filed under its 20 choices of three blocks (keys of about 32 bits, which keep
buckets small even for 10^10 fingerprints). Rows are dealt and sorted by key; each run of equal keys is searched with
Hamming distances and gives a spanning forest of its links, never all pairs. Runs longer than ``max_run`` are cut into
chunks, and each pair of chunks becomes a run of its own, so no task gathers an unbounded bucket and no link is lost.
Components follow from alternating large-star and small-star rounds, cut by checkpoints.

Defined edge cases: null and wordless texts have fingerprint zero and link like any other; fewer words than a shingle
form one shingle; repeated rows and equal texts share a fingerprint and so a component; a null id never becomes the
component's id unless the component has no other; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import by_value, cut, release

SHINGLE = 3
DISTANCE = 3
MAX_RUN = 50_000
#: Runs up to this length are compared pair by pair, all runs of a batch at once.
SMALL_RUN = 12
#: Words of a wide fingerprint, and how many of its first 128 bits may differ for a pair to be compared (19 are expected
#: at a similarity of 0.8, more than 34 once in some 10,000 pairs; texts that share nothing differ in 64).
WIDE = 16
WIDE_DISTANCE = 34
#: Share of bits that differ at a similarity of 0.8, and of such pairs, how many are to meet in a block.
DIFFERENT = 0.148
RECALL = 0.99
#: Bits of a block, at least; two more than that for each fourfold of BLOCK_ROWS texts, so that buckets do not grow.
BLOCK_BITS = 20
BLOCK_ROWS = 1 << 22
#: Blocks whose links are followed before the others are searched.
FIRST_BLOCKS = 8
#: Least similarity (Jaccard) of shingle sets, as a ratio of whole numbers.
SIMILAR = (4, 5)
#: Shingles that one side of a comparison holds at a time.
MAX_SHINGLES = 1 << 21
#: Bounds of the six blocks.
BLOCKS = [(0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64)]
#: For each byte, its bits from the lowest up as the eight bytes of a word.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles_of(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """Hashes of the text's shingles, in order; none if there is no word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return []
    if len(words) <= shingle:
        return [digest(b" ".join(words), 42)]
    if shingle == 3:
        return [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:], strict=False)]
    return [digest(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted set of hashes; of a text without words, that of the empty shingle alone."""
    return np.unique(np.array(shingles_of(text, shingle) or [0], dtype="<u8"))


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE, width: int = 1) -> np.ndarray:
    """Signed fingerprints of ``width`` 64-bit words each (without that axis for one word)."""
    return bits_of((shingles_of(t, shingle) for t in texts), len(texts), width)


def bits_of(shingles: Iterable[Sequence[int]], size: int, width: int = 1) -> np.ndarray:
    """Fingerprints of ``size`` lists of hashes.

    The first word counts the bits of the shingles' hashes, each further one those of the hashes mixed once more. Bits
    are counted in slabs of 2^15 hashes, so a long text takes no more memory.
    """
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    hashes: list[int] = []
    owners: list[int] = []
    lengths: list[int] = []
    sums = np.zeros((width, size, 64), dtype=np.int64)
    totals = np.zeros(size, dtype=np.int64)

    def count() -> None:
        if not hashes:
            return
        h = np.array(hashes, dtype="<u8")
        # a byte's bits as eight lanes of a word: runs of up to 255 hashes are summed lane by lane without a carry
        starts = np.concatenate([np.arange(at, at + n, 255) for at, n in zip(np.cumsum([0, *lengths[:-1]]).tolist(), lengths, strict=True)])
        of = np.repeat(owners, [-(-n // 255) for n in lengths])
        for w in range(width):
            lanes = LANES[(h if w == 0 else mixed(h, w)).view(np.uint8).reshape(-1, 8)]
            np.add.at(sums[w], of, np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(len(starts), 64))
        np.add.at(totals, owners, lengths)
        hashes.clear(), owners.clear(), lengths.clear()

    for k, found in enumerate(shingles):
        for at in range(0, len(found), 1 << 15):
            part = found[at : at + (1 << 15)]
            hashes += part
            owners.append(k)
            lengths.append(len(part))
            if len(hashes) >= 1 << 15:
                count()
    count()
    set_bits = 2 * sums > totals[None, :, None]
    out = (set_bits * weights).sum(axis=2, dtype=np.uint64).T
    return np.ascontiguousarray(out[:, 0] if width == 1 else out).view(np.int64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes derived from hashes: a multiplication and shifts with a different constant for each ``k``."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row of ``docs``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1).to_pylist(), shingle))], ["doc_id", "fp"])

    kind = docs.select(doc_id).dtypes[0][1]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(make, f"doc_id {kind}, fp bigint")


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Positions in ``values`` (rows of words) whose links connect whatever Hamming distances up to ``distance`` connect."""
    rest, links = np.arange(len(values)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(values[rest] ^ values[x]).sum(axis=1, dtype=np.int32) <= distance
            if near.any():
                found = rest[near]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return links


def spanning(pairs: list[tuple[int, int]], names: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of places, by name, that connect what none before them does."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for i, j in pairs:
        a, b = top(i), top(j)
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((int(names[i]), int(names[j])))
    return out


def links_in_runs(distance: int = DISTANCE, width: int = 1):
    """mapInArrow function over rows (key columns..., words...) sorted by key: the links of each run of equal keys.

    A link names the first words of its two rows; if there are more words, the distance is that of the others.
    """
    named = width > 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        held: list[np.ndarray] = []

        def linked(values: np.ndarray) -> list[tuple[int, int]]:
            values = np.unique(values, axis=0)
            if len(values) < 2:
                return []
            names = values[:, 0].tolist()
            return [(names[x], names[y]) for x, y in forest(values[:, 1:] if named else values, distance) if names[x] != names[y]]

        def close() -> list[tuple[int, int]]:
            out = linked(np.concatenate(held)) if held else []
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_columns - width
            keys = [batch.column(i).to_numpy() for i in range(n)]
            words = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(n, batch.num_columns)], axis=1)
            change = np.zeros(len(words) - 1, dtype=bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [len(words)]])
            out: list[tuple[int, int]] = []
            first = tuple(k[0] for k in keys)
            if last is not None and first != last:
                out += close()
            if len(bounds) > 2:
                held.append(words[: bounds[1]])
                out += close()
                few, lengths = words[bounds[1] : bounds[-2]], np.diff(bounds[1:-1])
                run, small = np.repeat(np.arange(len(lengths)), lengths), lengths <= SMALL_RUN
                bits = few[:, 1:] if named else few
                found = []
                for lag in range(1, int(lengths[small].max(initial=1))):  # short runs all at once, each row with the one ``lag`` rows on
                    at = np.flatnonzero((run[lag:] == run[:-lag]) & small[run[:-lag]])
                    far = np.bitwise_count(bits[at] ^ bits[at + lag]).sum(axis=1, dtype=np.int32)
                    near = at[(far <= distance) & (few[at, 0] != few[at + lag, 0])]
                    found += zip(near.tolist(), (near + lag).tolist(), strict=True)
                out += spanning(sorted(found), few[:, 0])
                for i in np.flatnonzero(~small) + 1:
                    out += linked(words[bounds[i] : bounds[i + 1]])
            held.append(words[bounds[-2] :])
            last = tuple(k[-1] for k in keys)
            if out:
                yield _links(out)
        out = close()
        if out:
            yield _links(out)

    return runs


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], ["a", "b"])


def links(fps: DataFrame, distance: int = DISTANCE, max_run: int = MAX_RUN) -> DataFrame:
    """Distinct links (a, b), a < b, whose components are those of all pairs within ``distance`` (up to 3) bits."""
    if distance > 3:
        raise ValueError("three of six blocks agree only up to three differing bits")
    masks = []
    for choice in combinations(range(len(BLOCKS)), 3):
        mask = sum(((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in (BLOCKS[i] for i in choice))
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for k, m in enumerate(masks)])).alias("x")).select("x.c", "x.m", "fp")
    return bucket_links(keyed, ["fp"], distance, len(masks) * fps.count(), max_run)


def bucket_links(keyed: DataFrame, words: list[str], distance: int, total: int, max_run: int = MAX_RUN) -> DataFrame:
    """Distinct links within buckets (c, m) of ``total`` rows with ``words``; crowded buckets are cut into pairs of chunks.

    Buckets are first counted in so many groups that one without a crowded bucket has an eighth of ``max_run`` rows; nearly
    always no group reaches ``max_run``, and the buckets themselves need no counting.
    """
    group = F.pmod(F.xxhash64("c", "m"), F.lit(max(1, -(-8 * total // max_run))))
    full = cut(keyed.groupBy(group.alias("g")).count().filter(F.col("count") > max_run).select("g"))
    split = not full.isEmpty()
    if split:
        counted = keyed.withColumn("g", group).join(full, "g", "left_semi").groupBy("c", "m").count().filter(F.col("count") > max_run)
        crowded = cut(counted.select("c", "m", F.ceil(F.col("count") / max_run).cast("int").alias("chunks")))
        split = not crowded.isEmpty()
    plain = keyed.join(crowded, ["c", "m"], "left_anti") if split else keyed
    rows = plain.select("c", "m", F.lit(0).alias("i"), F.lit(0).alias("j"), *words)
    if split:
        own = F.pmod(F.xxhash64(*words), F.col("chunks")).cast("int")
        dealt = keyed.join(crowded, ["c", "m"]).select("c", "m", *words, own.alias("o"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        rows = rows.unionByName(dealt.select("c", "m", F.least("o", "other").alias("i"), F.greatest("o", "other").alias("j"), *words))
    key = ["c", "m", "i", "j"]
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sorted by their names, too, the runs' links lead to few of them, the smallest
    return rows.repartition(n, *key).sortWithinPartitions(*key, words[0]).mapInArrow(links_in_runs(distance, len(words)), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    mark = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, max_run: int = MAX_RUN) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest id that links reach), fp: one row per row of ``docs``."""
    fp = cut(fingerprints(docs, doc_id, text, shingle))
    first = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = cut(components(links(first.select("fp"), distance, max_run)))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    named = rooted.filter("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    whole = rooted.join(named, "root", "left").select(F.col("fp").alias("of"), F.coalesce("component_id", "least").alias("component_id"))
    return fp.join(whole, fp["fp"] == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def block_plan(rows: int, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a block, number of blocks) for so many different texts.

    A pair at a similarity of 0.8 shares a given block of b bits with probability (1 - DIFFERENT) ** b; there are as many
    blocks as it takes for ``recall``. With the rows the bits grow by their logarithm, and the blocks by their 0.23rd power.
    """
    bits = BLOCK_BITS + max(0, math.ceil(math.log2(max(rows, 1) / BLOCK_ROWS)))
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-((1 - DIFFERENT) ** bits)))


def block_bits(bits: int, blocks: int) -> np.ndarray:
    """Which bits of a wide fingerprint each block takes: rounds through all of them in ever new orders, always the same."""
    rng, order = np.random.default_rng(20), []
    while len(order) < bits * blocks:
        order += rng.permutation(64 * WIDE).tolist()
    return np.array(order[: bits * blocks]).reshape(blocks, bits)


def wide_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, th, sid, size, bits) of shingle sets: text hash, hash and size of the set, 1,024 bits as bytes."""
    names = ["doc_id", "th", "sid", "size", "bits"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, shingle) for t in part.column(2).to_pylist()]
                sid = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], dtype=np.uint64).view(np.int64)
                words = bits_of((x.tolist() if x[-1] else [] for x in sets), len(sets), WIDE).astype("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sid), pa.array([len(x) for x in sets], pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())], names)

    kind = docs.select(doc_id).dtypes[0][1]
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text")).mapInArrow(make, f"doc_id {kind}, th bigint, sid bigint, size bigint, bits binary")


def block_rows(sets: DataFrame, bits: int, blocks: range) -> DataFrame:
    """(c, m, name, f0, f1) for each block of each row of ``sets`` (name, bits): number and value of the block, first 128 bits."""
    chosen, first = block_bits(bits, blocks.stop)[blocks.start :], blocks.start

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<i8").reshape(-1, WIDE)
                spread = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
                value = (spread[:, chosen] * weights).sum(axis=2)
                n = len(chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(first, first + n, dtype=np.int32), len(words))), pa.array(value.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(words[:, 0], n)), pa.array(np.repeat(words[:, 1], n))],
                    ["c", "m", "name", "f0", "f1"],
                )

    return sets.select("name", "bits").mapInArrow(make, "c int, m bigint, name bigint, f0 bigint, f1 bigint")


def exact_forest(words: np.ndarray, sets: list[np.ndarray], distance: int) -> list[tuple[int, int]]:
    """Positions whose links connect whatever pairs are similar and within ``distance``; similarity is that of the sets."""
    sizes = np.array([len(x) for x in sets])
    rest, links = np.arange(len(words)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.flatnonzero(np.bitwise_count(words[rest] ^ words[x]).sum(axis=1, dtype=np.int32) <= distance)
            if not len(near):
                continue
            other = rest[near]
            every, own = np.concatenate([sets[y] for y in other]), sets[x]
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            shared = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[other])[:-1]]), dtype=np.int64)
            alike = SIMILAR[1] * shared >= SIMILAR[0] * (len(own) + sizes[other] - shared)
            links += [(int(x), int(y)) for y in other[alike]]
            queue += list(other[alike])
            rest = np.delete(rest, near[alike])
    return links


def exact_links(shingle: int, distance: int):
    """mapInArrow function over (root, i, j, sid, bits, text) sorted by the first three: links of ``sid`` in each run of equal keys."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, words, sets = None, [], [], []

        def close() -> list[tuple[int, int]]:
            found = exact_forest(np.array(words), sets, distance) if len(names) > 1 else []
            return [(names[x], names[y]) for x, y in found if names[x] != names[y]]

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for *key, sid, bits, text in zip(*(x.to_pylist() for x in batch.slice(at, 200).columns), strict=True):
                    if key != last:
                        out += close()
                        last, names, words, sets = key, [], [], []
                    names.append(sid), words.append(np.frombuffer(bits, dtype="<u8", count=2)), sets.append(shingle_set(text, shingle))
                if out:
                    yield _links([(x & 0xFFFFFFFFFFFFFFFF, y & 0xFFFFFFFFFFFFFFFF) for x, y in out])
        out = close()
        if out:
            yield _links([(x & 0xFFFFFFFFFFFFFFFF, y & 0xFFFFFFFFFFFFFFFF) for x, y in out])

    return runs


def similar_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = WIDE_DISTANCE, max_run: int = MAX_RUN, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """(doc_id, th, least): per row its text hash and the first (id, text hash) of its component, null ids last.

    Two documents are linked if their shingle sets have a similarity (Jaccard) of 0.8 or more. At that similarity some
    15 % of the bits differ, far more than blocks of 64 bits can bridge. So fingerprints have 1,024 bits, and blocks of
    20 bits or more (see :func:`block_plan`): two documents that share any of them (a pair at 0.8 with probability 0.99,
    at 0.85 with more than 0.999) and differ in at most ``distance`` of 128 bits are candidates. Components of candidates
    bring the texts together, in chunks of bounded size and pairs of chunks; there the sets themselves decide each link.
    Large groups are connected by the first few blocks already; after these, rows bear their component's name, and the
    other blocks give links between components only. A fingerprint belongs to a set, named by the hash of the set, so equal sets are one row everywhere.
    """
    release(docs.sparkSession)
    wide = cut(wide_fingerprints(docs, doc_id, text, shingle))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("least")
    distinct = cut(wide.groupBy("sid").agg(first, F.first("size").alias("size"), F.first("bits").alias("bits")))
    rows = distinct.count()
    bits, blocks = block_plan(rows)
    sets = distinct.withColumn("name", F.col("sid"))
    for some in (range(min(FIRST_BLOCKS, blocks)), range(min(FIRST_BLOCKS, blocks), blocks)):
        found = bucket_links(block_rows(sets, bits, some), ["name", "f0", "f1"], distance, rows * len(some), max_run)
        loose = cut(components(found))
        sets = cut(sets.join(loose, F.col("name") == F.col("node"), "left").select("sid", "least", "size", "bits", F.coalesce("root", "name").alias("name")))
        del found, loose
        release(docs.sparkSession)
    sets = sets.withColumnRenamed("name", "root")
    groups = sets.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / max_shingles).cast("int").alias("chunks")).filter("n > 1").select(F.col("root").alias("of"), "chunks")
    live = sets.join(groups, F.col("root") == F.col("of")).select("sid", "root", "chunks", "bits", F.col("least.doc_id").alias("lid"), F.col("least.th").alias("lth"))
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    whole = texts.join(live, F.col("id").eqNullSafe(F.col("lid")) & (F.col("th") == F.col("lth"))).withColumn("o", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    dealt = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("root", F.least("o", "other").alias("i"), F.greatest("o", "other").alias("j"), "sid", "bits", "text")
    key = ["root", "i", "j"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exact = dealt.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(exact_links(shingle, distance), "a bigint, b bigint").distinct()
    roots = cut(components(exact).select(F.col("node").alias("of"), F.col("root").alias("top")))
    del exact
    release(docs.sparkSession)
    named = sets.select("sid", "least").join(roots, F.col("sid") == F.col("of"), "left").select("sid", "least", F.coalesce("top", "sid").alias("top"), F.col("top").isNotNull().alias("linked"))
    firsts = named.filter("linked").groupBy("top").agg(F.min("least").alias("first"))
    found = named.join(firsts, "top", "left").select(F.col("sid").alias("of"), F.coalesce("first", "least").alias("least"))
    return wide.select("doc_id", "th", "sid").join(found, F.col("sid") == F.col("of")).select("doc_id", "th", "least")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = WIDE_DISTANCE, max_run: int = MAX_RUN, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """(doc_id, component_id): the smallest id of the documents that links of similar shingle sets reach."""
    return similar_rows(docs, doc_id, text, shingle, distance, max_run, max_shingles).select("doc_id", F.col("least.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = WIDE_DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of similar documents: the first by id (null ids last), then by text hash.

    Rows of the same id, or without one, whose texts are not similar all stay.
    """
    found = similar_rows(docs, doc_id, text, shingle, distance)
    kept = found.select(F.col("least.doc_id").alias("kid"), F.col("least.th").alias("kth")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("rid"), F.xxhash64(F.col(text)).alias("rth"))
    one = row.join(kept, F.col("rid").eqNullSafe(F.col("kid")) & (F.col("rth") == F.col("kth")), "left_semi")
    # partitioned as the null-safe join deals the rows, so that the texts are dealt once
    order = Window.partitionBy(F.coalesce("rid", F.lit(0).cast(docs.select(doc_id).dtypes[0][1])), F.isnull("rid"), "rth").orderBy("rth")
    return one.withColumn("n", F.row_number().over(order)).filter("n = 1").select("row.*")


def op9_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("fp")


by_value(__name__)
