"""Packing by minimum bin slack.

Each task tokenises its documents and cuts those longer than a window into full windows. What remains goes, by length,
into a pool. While the pool is large, each window is filled by a subset-sum search over the pool's multiset of lengths:
reachable sums are the bits of an integer, each length adds its count in powers of two, and the search stops at the
first subset that fills the window (seeded with the longest remainder); backtracking through the recorded integers
gives how many remainders of each length to take. At the end of a task the pool is emptied the same way, taking the
closest fill; the few windows that stay short are cut into powers of two, which need no padding.

There is no shuffle: windows are packed where their documents are read, memory is bounded by the pool, and a lost task
is simply repeated. Sequence ids are (task, running number); documents never mix across tasks.

Defined edge cases: a null text counts as empty and is the end id alone; repeated rows and null ids are packed like any
other; very long texts become several windows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import by_value, worker_state

WINDOW = 2048
POOL = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct words that a worker keeps the ids of; beyond that it starts afresh.
CACHE = 500_000

SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


#: Texts of ASCII and Latin letters, whose pre-tokens the pattern below finds as the tokenizer does: no white space but
#: ASCII's, no combining marks, no letters that change their length in lower case.
LATIN = "[\x00-\x1b\x20-\x7f\xa1\xab\xbb\xbf-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]*"
#: Fixed value: the tokenizer's own pre-tokens, for such texts in lower case.
PRETOKEN = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017e]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\u017e]+"


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of each text as little-endian 32-bit bytes, equal to encoding whole texts.

    Pre-tokens never join, so the ids of each are remembered. Those not met before are encoded many at once, and the
    result is cut after each piece that ends a word. Texts outside of Latin script, and those that may hold special
    tokens, are cut at ASCII blanks only, and their words encoded one by one.
    """
    import re

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
    latin, find = re.compile(LATIN).fullmatch, re.compile(PRETOKEN).findall
    parts: dict[str, bytes] = {}
    words: dict[str, bytes] = {}

    def learn_parts(new: list[str]) -> None:
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            ids = np.array(tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):  # some pre-token holds several words of the tokenizer: each is encoded on its own
                for part, e in zip(some, tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                    parts[part] = np.array(e.ids, dtype="<u4").tobytes()
                continue
            data, start = ids.tobytes(), 0
            for part, end in zip(some, cuts, strict=True):
                parts[part] = data[start:end]
                start = end

    def learn_words(new: list[str]) -> None:
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            for w, e in zip(some, tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                words[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        for known in (parts, words):
            if len(known) > CACHE:
                known.clear()
        split = [(parts, find(t.lower())) if "<|" not in t and latin(t) else (words, _ascii_split(t)) for t in texts]
        for known, learn in ((parts, learn_parts), (words, learn_words)):
            learn(list(set().union(*(p for k, p in split if k is known)) - known.keys()))
        return [b"".join(map(known.__getitem__, p)) for known, p in split]

    return encode


def _ascii_split(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many remainders of each length to take, so that their sum is the largest one up to ``room``."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        many, power = min(counts[length], room // length), 1
        while many and not reach >> room & 1:
            take = min(power, many)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & full
            many -= take
            power *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += take
            at -= length * take
    return dict(taken)


class Packer:
    """Packs pieces (key, start, length) into sequences; ``emit`` gets (key, start, length, sequence, offset)."""

    def __init__(self, emit: Callable, window: int = WINDOW, pool: int = POOL):
        self.emit, self.window, self.most = emit, window, pool
        self.pool: dict[int, list] = defaultdict(list)
        self.held = self.sequence = 0

    def add(self, key: object, length: int) -> None:
        start = 0
        while length - start >= self.window:
            self.emit(key, start, self.window, self.sequence, 0)
            self.sequence += 1
            start += self.window
        if length > start:
            self.pool[length - start].append((key, start))
            self.held += 1
        while self.held >= self.most:
            self.fill()

    def fill(self) -> None:
        longest = max(k for k, v in self.pool.items() if v)
        counts = {k: len(v) - (k == longest) for k, v in self.pool.items() if len(v) > (k == longest)}
        taken = best_fill(counts, self.window - longest)
        taken[longest] = taken.get(longest, 0) + 1
        used = sum(k * n for k, n in taken.items())
        pieces = [(*self.pool[k].pop(), k) for k in sorted(taken, reverse=True) for _ in range(taken[k])]
        for k in taken:
            if not self.pool[k]:
                del self.pool[k]
        self.held -= len(pieces)
        self.lay(pieces, used)

    def lay(self, pieces: list[tuple], used: int) -> None:
        """One sequence if ``used`` needs no padding, else sequences of falling powers of two."""
        sizes = [used] if used == self.window else [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        at, left = 0, sizes[0]
        for key, start, length in pieces:
            while length:
                part = min(length, left)
                self.emit(key, start, part, self.sequence, at)
                start, length, at, left = start + part, length - part, at + part, left - part
                if not left:
                    self.sequence += 1
                    sizes = sizes[1:]
                    at, left = 0, sizes[0] if sizes else 0

    def close(self) -> None:
        """Whole windows while there are any; the remainders of the short ones at the end are joined before they are cut."""
        while self.held:
            self.fill()


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, window: int = WINDOW, pool: int = POOL, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    kind = docs.select(doc_id).dtypes[0][1]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        state = worker_state()
        encode = state.setdefault(("ids", tokenizer_path), None) or encoder(tokenizer_path)
        state["ids", tokenizer_path] = encode
        rows: list[tuple] = []

        def emit(key: tuple, start: int, length: int, sequence: int, offset: int) -> None:
            name, ids = key
            rows.append((name, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + sequence, offset))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        packer = Packer(emit, window, pool)
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for name, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    packer.add((name, ids), len(ids) // 4)
                if len(rows) > 5000:
                    yield flush()
        packer.close()
        if rows:
            yield flush()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op10_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)


by_value(__name__)
