"""Operator 1: byte-level BPE encoding and decoding.

Distinct words fold ranked merges over their byte arrays: each step looks up the rank of every adjacent pair in a
literal rank map and merges the lowest, until no pair has a rank. Decoding concatenates the binary pieces of the ids.

The fold runs in numpy over all new distinct words of a slice at once. `merge_words` is the same fold as Spark
higher-order functions over a literal rank map; the README has its figures and why documents do not take it.

Nulls and empty texts have no ids. Rows are encoded one by one, so repeated rows and clashing names do no harm; only
the id and text columns are read. Words longer than LONG_WORD bytes merge through a heap, in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, pieces, table

LONG_WORD = 48
#: Distinct words in each of two generations that a worker remembers; forgetting costs time only.
MEMORY = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """The rank map as a hash table of pairs of ids, and the ids' pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.piece = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.piece[rank] = piece
        self.text = [str(i) for i in range(len(self.piece))]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {(ranks[p[:i]] << 20) | ranks[p[i:]]: r for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}
        self._table(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.older: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # bytes, since the garbage collector need not walk them

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = 2 + int(len(keys)).bit_length()
        self.keys, self.values, self.probes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
        left = np.arange(len(keys))
        while len(left):  # every key takes the first free slot after its own
            slot = (self._slot(keys[left]) + self.probes) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[left[won]], values[left[won]]
            left = np.delete(left, won)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slot, out = self._slot(keys), np.full(keys.shape, none, np.int64)
        for i in range(self.probes):
            at = (slot + i) & ((1 << self.bits) - 1)
            there = self.keys[at]
            np.copyto(out, self.values[at], where=there == keys)
            if not ((there != -1) & (there != keys)).any():
                break
        return out

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of words of one length class: all rows merge their lowest pair at a time."""
        none = 1 << 30
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max()) + 2
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), none, np.int32)  # of each id with the next one
        row, column = np.nonzero(ids[:, 1:] >= 0)
        rank[row, column] = self.pair_ranks(ids[row, column], ids[row, column + 1], none)
        rows, out, column = np.arange(len(words)), [None] * len(words), np.arange(width)
        while True:
            at = rank.argmin(1)
            every = np.arange(len(ids))
            low = rank[every, at]
            done = low == none
            if done.any():
                raw, step = ids[done].tobytes(), 4 * ids.shape[1]
                for i, (r, n) in enumerate(zip(rows[done].tolist(), size[done].tolist())):
                    out[r] = raw[i * step : i * step + 4 * n]
                keep = ~done
                if not keep.any():
                    return out
                ids, rank, rows, size, at, low = ids[keep], rank[keep], rows[keep], size[keep], at[keep], low[keep]
                every = every[: len(ids)]
            behind = column[:-1] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            ids[every, at] = low
            size = size - 1
            rank[every, at] = none
            has = at + 1 < size
            rank[every[has], at[has]] = self.pair_ranks(low[has], ids[every[has], at[has] + 1], none)
            has = at > 0
            rank[every[has], at[has] - 1] = self.pair_ranks(ids[every[has], at[has] - 1], low[has], none)

    def fold_long(self, word: bytes) -> bytes:
        n, piece, ranks = len(word), self.piece, self.ranks
        ids = [int(self.byte[b]) for b in word]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[ids[i]] + piece[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := ranks.get(piece[ids[x]] + piece[ids[y]])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive) if ok], np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Folds the words not known yet, together by length."""
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        known, older, by_class = self.known, self.older, {}
        for w in words:
            if w not in known:
                if (ids := older.get(w)) is not None:
                    known[w] = ids
                else:
                    raw = w.encode()
                    by_class.setdefault(min(len(raw), LONG_WORD + 1) + 3 >> 2, []).append((w, raw))
        for some in by_class.values():
            short = [x for x in some if len(x[1]) <= LONG_WORD]
            for i in range(0, len(short), 4096):
                part = short[i : i + 4096]
                known.update(zip([w for w, _ in part], self.fold([raw for _, raw in part])))
            known.update((w, self.fold_long(raw)) for w, raw in some if len(raw) > LONG_WORD)

    def forget(self) -> None:
        """A worker lives on after its task, and others need the memory."""
        self.older, self.known = {}, {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.find(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, words)), np.int32) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))


@lru_cache(2)
def merges(path: str, pattern: str) -> Merges:
    return Merges(load_ranks(path), pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; `vocabulary` is a file that every executor has in the same place."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary, pattern)
        for b in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.encode(b.column(1).to_pylist()), pa.list_(pa.int32()))], ["id", "ids"])
        m.forget()

    kind = dict(docs.dtypes)[id_col]
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the pieces of the ids, concatenated; null ids give null."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary, pattern)
        for b in batches:
            out = [None if x is None else m.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    kind = dict(encoded.dtypes)[id_col]
    return mapped(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encodes every row, then decodes the ids, in one pass."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary, pattern)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for b in pieces(batches, "text"):
            ids = [x.tolist() for x in m.encode(b.column(1).to_pylist())]
            columns = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(" ".join(map(m.text.__getitem__, x)).encode()) for x in ids], pa.string()), pa.array([sha(m.decode(x)) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        m.forget()

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def merge_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", buckets: int = 4096) -> DataFrame:
    """Adds `ids array<int>` to a table of distinct words of up to LONG_WORD bytes, with higher-order functions alone.

    The literal rank map is an array of small maps, one for each value of a hash of the piece, since a lookup in a map
    literal walks its entries.
    """
    parts: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
    for piece, rank in ranks.items():
        parts[zlib.crc32(piece) % buckets].append((piece, rank))
    literal = F.array(*[F.create_map(*[F.lit(x) for kv in p for x in kv]) if p else F.create_map(F.lit(b"\x00none"), F.lit(-1)) for p in parts])
    return _fold_words(words, literal, word_col, buckets)


def _fold_words(words: DataFrame, literal: Column, word_col: str, buckets: int) -> DataFrame:
    rank = lambda piece: F.element_at(F.get(literal, (F.crc32(piece) % buckets).cast("int")), piece)
    raw = F.col(word_col).cast("binary")
    start = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.substring(raw, i, F.lit(1)))

    def step(now: Column, _: Column) -> Column:
        ranked = F.transform(F.sequence(F.lit(1), F.greatest(F.size(now) - 1, F.lit(1))), lambda i: F.struct(rank(F.concat(F.get(now, i - 1), F.get(now, i))).alias("r"), i.alias("i")))
        low = F.array_min(F.filter(ranked, lambda x: x["r"].isNotNull()))
        merged = F.concat(F.slice(now, F.lit(1), low["i"] - 1), F.array(F.concat(F.get(now, low["i"] - 1), F.get(now, low["i"]))), F.slice(now, low["i"] + 2, F.size(now)))
        return F.when((F.size(now) < 2) | low.isNull(), now).otherwise(merged)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(raw) - 1, F.lit(1))), start, step)
    return words.withColumn("ids", F.when(F.length(raw) == 0, F.array().cast("array<int>")).otherwise(F.transform(folded, rank)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
