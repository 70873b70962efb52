"""Token counts of a byte-pair model by rank-synchronous array merging.

Texts are cut into pre-tokens at the word mark, which no piece of the vocabulary holds inside. Pre-tokens not met
before are laid side by side in one flat array of symbol ids with sequence bounds (a ragged array). In each round every
sequence merges its lowest-ranking adjacent pair (the leftmost of equals), all sequences at once; sequences without a
mergeable pair drop out. The surviving symbols are counted; characters outside the vocabulary count their UTF-8 bytes.
Counts of pre-tokens are remembered, so frequent words cost a look-up.

Pre-tokens longer than ``LONG`` symbols take the same merges from a heap, so one endless word costs n log n.

Defined edge cases: a null text counts as empty: 0 bytes, 0 tokens; repeated rows and null ids each keep their row;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import by_value, worker_state

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
LONG = 128
CACHE = 500_000
MARK = "▁"
NONE = np.iinfo(np.int32).max


class Counter:
    """Counts the tokens of texts as the model's own library does."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the word mark inside")
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.rank = {p: ranks[s] for p, s in pieces.items()}
        pairs = {}
        for p in pieces:
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in self.ids and b in self.ids:
                    pairs[self.ids[a] << 32 | self.ids[b]] = (self.rank[p], self.ids[p])
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = keys
        self.merge_rank = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        # open addressing with linear probing; answers most look-ups with one array access
        size = 1 << (max(len(keys), 1) * 4).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.table = np.full(size, -1, dtype=np.int32)
        for i, h in enumerate(self._slot(keys).tolist()):
            while self.table[h] >= 0:
                h = (h + 1) % size
            self.table[h] = i
        self.known: dict[str, int] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair's merge, or -1."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            got = self.table[slot[open_]]
            hit = got >= 0
            same = hit.copy()
            same[hit] = self.keys[got[hit]] == keys[open_[hit]]
            out[open_[same]] = got[same]
            open_ = open_[hit & ~same]
            slot[open_] = (slot[open_] + 1) % len(self.table)
        return out

    def merge(self, words: list[str]) -> list[int]:
        """Token counts of pre-tokens."""
        counts = np.zeros(len(words), dtype=np.int64)
        symbols: list[int] = []
        owner: list[int] = []
        get = self.ids.get
        for k, w in enumerate(words):
            if len(w) > LONG:
                counts[k] = self.merge_long(w)
                continue
            for c in w:
                i = get(c)
                if i is None:
                    counts[k] += len(c.encode("utf-8", "surrogatepass"))
                    i = -1
                symbols.append(i)
                owner.append(k)
        s, o = np.array(symbols, dtype=np.int64), np.array(owner, dtype=np.int64)
        counts += np.bincount(o[s >= 0], minlength=len(words)) if len(s) else 0
        while len(s) > 1:
            found = self._find(np.where(o[:-1] == o[1:], s[:-1], -1), s[1:])
            at = np.flatnonzero(found >= 0)
            if not len(at):
                break
            rank = self.merge_rank[found[at]].astype(np.int64)
            own = o[at]
            # the lowest rank of each sequence, and of equal ranks the leftmost
            bounds = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            code = rank << 32 | at
            best = np.minimum.reduceat(code, bounds) & 0xFFFFFFFF
            s[best] = self.merged[found[best]]
            np.subtract.at(counts, o[best], 1)
            live = np.zeros(len(words), dtype=bool)
            live[own] = True
            keep = live[o]
            keep[best + 1] = False
            s, o = s[keep], o[keep]
        return counts.tolist()

    def merge_long(self, word: str) -> int:
        parts: list[str] = list(word)
        size = len(parts)
        nxt, prv = list(range(1, size + 1)), list(range(-1, size - 1))
        rank = self.rank.get
        heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(size - 1) if (r := rank(parts[i] + parts[i + 1])) is not None and parts[i] in self.ids and parts[i + 1] in self.ids]
        heapq.heapify(heap)
        while heap:
            _, i, n = heapq.heappop(heap)
            j = nxt[i]
            if not parts[i] or j >= size or len(parts[i]) + len(parts[j]) != n:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            nxt[i] = nxt[j]
            if nxt[i] < size:
                prv[nxt[i]] = i
                if (r := rank(parts[i] + parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[nxt[i]])))
            if prv[i] >= 0 and (r := rank(parts[prv[i]] + parts[i])) is not None:
                heapq.heappush(heap, (r, prv[i], len(parts[prv[i]]) + len(parts[i])))
        return sum(1 if p in self.ids else len(p.encode("utf-8", "surrogatepass")) for p in parts if p)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.pretokens(t) for t in texts]
        new = list({w for words in split for w in words} - self.known.keys())
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            self.known.update(zip(part, self.merge(part), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in split]

    @staticmethod
    def pretokens(text: str) -> list[str]:
        """Runs of the mark with what follows, up to the next mark: the text starts with one, and blanks become one."""
        if not text:
            return []
        words = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        if "" not in words:
            return [MARK + w for w in words]
        out, lead = [], ""
        for w in words:
            lead += MARK
            if w:
                out.append(lead + w)
                lead = ""
        return [*out, lead] if lead else out


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    kind = docs.select(doc_id).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        counter = state.get(("counter", model_path)) or Counter(model_path)
        state["counter", model_path] = counter
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = counter.count([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs)


by_value(__name__)
