"""Operator 10: removal of long byte strings that occur more than once, by suffix arrays.

Every start of a string of `length` bytes is assigned to one place inside the string: the smallest of the hashed
k-byte pieces in it (the leftmost, if several). Equal strings have equal pieces at equal distances, so only starts
whose pieces are equal can begin equal strings. Pieces that occur once need nothing more. The stretches around the
others are cut out, equal stretches become one with a count, and stretches with a common piece go to one shard. A
shard's suffix array comes from Larsson-Sadakane refinement in numpy: ranks by 8 bytes, doubled while suffixes are
tied. Kasai's pass, in many blocks of positions at once, gives the common prefixes of neighbours.

A piece with very many different stretches is spread over several shards; these hand over a 128-bit hash of each
distinct string, and shards are merged by binary search of each one's hashes in those of the shards before, range by
range of the hashes. Whole texts that occur twice are one class from the start.

Passages of more than `passage` words that other documents hold too, be they shorter than `length` bytes or not, are
counted besides (n_shared) and not removed: fingerprints, the smallest hash of `GRAM` successive words in each run of
`passage` + 1 words, are looked up among those of the other texts. So each such passage has a shared fingerprint, and
no text has one that shares fewer than GRAM words.

Null and empty texts, and those shorter than `length`, lose nothing. Repeated rows are copies of each other. Only the
id and text columns are read; results carry no other column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Scratch, flat, mapped, mix64, pieces, table

PIECE = 64
#: Bytes of stretches in a shard, and different stretches of one piece beyond which it is spread.
SHARD_BYTES, SPREAD = 1_500_000, 6_000
#: Blocks of positions that Kasai's pass takes at once, and hashes of a range that is merged.
LANES, MERGED = 4096, 400_000
#: Words of a fingerprint.
GRAM = 32
#: An equal share of all rows beyond which a piece is met by broadcast: fewer than this many pieces have one.
HOT = 4096
#: Bits of the filter that keeps texts without shared pieces out of a shuffle: 1024 rows of 4 KB.
SEEN = 25

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True

_ROLLING = Rolling(10)
_POSITION = np.uint64((1 << 30) - 1)


def stretches(texts: pa.Array, length: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash of the piece, first start and end of starts (exclusive) of all stretches, in order."""
    data, offsets = flat(texts)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none
    window = length - piece + 1
    prefix = _ROLLING.prefix(data)
    m = len(data) - piece + 1
    hashes = mix64((prefix[piece:] - prefix[:m]) * _ROLLING.down[:m])
    values = (hashes & ~_POSITION) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = values
    padded = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = np.diff(offsets)
    starts = np.maximum(n - length + 1, 0)  # of each row
    row = np.repeat(np.arange(len(n)), starts)
    if not len(row):
        return none, none.astype(np.uint64), none, none
    first = np.concatenate([[0], np.cumsum(starts)[:-1]])
    local = np.arange(len(row)) - first[row]
    at = offsets[row] + local
    place = (np.minimum(behind[at], ahead[at + window - 1]) & _POSITION).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(row)]])
    return row[begin], hashes[place[begin]], local[begin], local[end - 1] + 1


def fingerprints(texts: pa.Array, passage: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the least gram of each run of `passage` + 1 words, once where successive runs share it."""
    data, offsets = flat(texts)
    inner = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inner & ~(np.concatenate([[False], inner[:-1]]) & ~first[:-1])) if len(data) else np.zeros(0, np.int64)
    window = passage + 2 - gram
    if len(starts) <= passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.flatnonzero(inner & ~(np.concatenate([inner[1:], [False]]) & ~first[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    words = _ROLLING.spans(_ROLLING.prefix(data), starts, ends)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _ROLLING.up[: len(words)], out=sums[1:])
    least = mix64((sums[gram:] - sums[:-gram]) * _ROLLING.down[: len(words) - gram + 1])
    size = 1
    while size < window:  # the least of ever more successive grams
        step = min(size, window - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    whole = np.flatnonzero(row[: len(least)] == row[passage:])
    least, row = least[whole], row[whole]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    return row[new], least[new]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number in their order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(">u8").reshape(-1).astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes or more; the end comes before any byte."""
    n = len(data)
    key = _eights(data)
    order = np.argsort(key, kind="stable")
    new = _changes(key[order])
    if (data == 0).any():  # suffixes shorter than the key are told apart from zero bytes by their length
        size = np.minimum(n - np.arange(n), 8)
        order = np.lexsort((size, key))
        new = _changes(key[order]) | _changes(size[order])
    rank = np.zeros(n, np.int32)  # shards stay far below 2**31 bytes; a rank is the place of the first of its suffixes
    rank[order] = _heads(new)
    active = order[_tied(new)]  # the others keep their places for good
    h = 8
    while h < depth and len(active):
        after = np.where(active + h < n, rank[np.minimum(active + h, n - 1)] + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + after
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = key // (n + 1)
        start = _heads(_changes(group))
        new = _changes(key)
        order[group + np.arange(len(active)) - start] = active
        rank[active] = group + _heads(new) - start
        active = active[_tied(new)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in the suffix array, the bytes (up to `most`) that its suffix shares with the one before.

    Kasai's pass: going on by a position, at most one byte of what is shared is lost, provided the suffix before goes on
    to one that is before, too. Suffixes tied beyond the array's depth need not, so their successors start anew. Blocks
    of positions go in step. The array is sorted by its first `most` bytes at least.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[place - 1], n)  # the suffix before; n has no bytes
    padded = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    eights = np.concatenate([_eights(data), np.zeros(most + 1, np.uint64)])
    out = np.zeros(n + 1, np.int32)
    step = max(1, -(-n // LANES))
    lanes = np.arange(0, n, step)
    shared, other = np.zeros(len(lanes), np.int64), np.full(len(lanes), n)
    for i in range(step):
        at = lanes + i
        inside = at < n
        at = np.minimum(at, n - 1)
        still = place[np.minimum(other + 1, n - 1)] < place[at]
        other = before[at]
        shared = np.where(still & (other < n), np.maximum(shared - 1, 0), 0)
        open_ = np.flatnonzero(inside & (other < n))
        going = open_
        while len(going):  # eight bytes at a time, then one by one
            x, y = at[going] + shared[going], other[going] + shared[going]
            same = (shared[going] + 8 <= most) & (np.maximum(x, y) + 8 <= n) & (eights[x] == eights[y])
            going = going[same]
            shared[going] += 8
        going = open_
        while len(going):
            x, y = at[going] + shared[going], other[going] + shared[going]
            same = (shared[going] < most) & (padded[x] == padded[y]) & (padded[x] >= 0)
            going = going[same]
            shared[going] += 1
        out[np.where(inside, at, n)] = shared
    return out[order]


def _changes(values: np.ndarray) -> np.ndarray:
    """Which values differ from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _heads(new: np.ndarray) -> np.ndarray:
    """The place where each value's run begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _tied(new: np.ndarray) -> np.ndarray:
    """Which values are in a run of several."""
    return ~(new & np.append(new[1:], True))


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the given starts: a number for each string of `length` bytes, and whether another start has it too."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = suffix_array(data, length)
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(common_prefixes(data, order, length) < length)
    number = number[starts]
    return number, np.bincount(number)[number] > 1


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


class Dedup:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, piece: int = PIECE, passage: int = 50):
        self.docs, self.id, self.text, self.length, self.piece, self.passage = docs, id_col, text_col, length, piece, passage
        self.spark = docs.sparkSession
        self.scratch, self.counts = Scratch(self.spark, "suffix"), []

    def _shared(self, each: DataFrame, apart: str | None = None) -> DataFrame:
        """The rows whose h occurs in several rows, or in some with different values of `apart`."""
        aims = [F.min(apart).alias("p"), F.max(apart).alias("q")] if apart else []
        counts = self.scratch.write(each.groupBy("h").agg(F.count(F.lit(1)).alias("m"), *aims).filter("p <> q" if apart else "m > 1").select("h", "m"))
        self.counts.append(counts)
        most = (counts.agg(F.sum("m")).first()[0] or 0) // HOT + 1
        hot = F.broadcast(counts.filter(F.col("m") > most).select("h"))  # fewer than HOT rows
        return each.join(hot, "h").union(each.join(hot, "h", "left_anti").join(counts.filter(F.col("m") <= most).select("h"), "h"))

    def _may_hold(self, texts: DataFrame, classes: DataFrame) -> DataFrame:
        """The texts but those whose class is surely not among the given ones, by a filter of fixed size."""
        slot = F.shiftrightunsigned(F.xxhash64("c"), 64 - SEEN) + 1
        bits = classes.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        place = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        both = texts.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket")
        bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8).cast("int") + 1)
        return both.filter(byte.bitwiseAND(bit) != 0).select(*texts.columns)

    def spans(self) -> DataFrame:
        """(c, whole, spans, n_shared): for each class of texts (by MD5) that repeats anything, the starts that do."""
        length, piece, passage, scratch = self.length, self.piece, self.passage, self.scratch

        def lists(row: np.ndarray, n: int) -> pa.Array:
            return pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())

        def find(batches) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "t"):
                n = b.num_rows
                row, h, lo, hi = stretches(b.column(1), length, piece)
                marked, prints = fingerprints(b.column(1), passage)
                data, offsets = flat(b.column(1))
                raw = data.tobytes()
                c = [hashlib.md5(raw[offsets[i] : offsets[i + 1]]).digest() for i in range(n)]
                fields = [pa.array(h.view(np.int64)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())]
                found = pa.ListArray.from_arrays(lists(row, n), pa.StructArray.from_arrays(fields, ["h", "lo", "hi"]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.binary()), found, pa.ListArray.from_arrays(lists(marked, n), pa.array(prints.view(np.int64)))], ["id", "c", "found", "prints"])

        kind = dict(self.docs.dtypes)[self.id]
        long_ = self.docs.select(F.col(self.id).alias("id"), F.col(self.text).alias("t")).filter(F.octet_length("t") >= min(length, 2 * passage + 1))
        found = mapped(long_, find, f"id {kind}, c binary, found array<struct<h:long,lo:int,hi:int>>, prints array<long>")
        classes = found.groupBy("c").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"), F.first("found").alias("found"), F.first("prints").alias("prints"))
        classes = scratch.write(classes.withColumn("num", F.monotonically_increasing_id()))
        prints = self._shared(classes.select("num", F.explode("prints").alias("h")), "num").groupBy("num").agg(F.count(F.lit(1)).alias("n_shared"))
        whole = F.col("copies") > 1
        marks = classes.select("c", "num", whole.alias("whole"), F.size("prints").alias("all")).join(prints, "num", "left")
        marks = scratch.write(marks.select("c", "whole", F.when(F.col("whole"), F.col("all")).otherwise(F.coalesce("n_shared", F.lit(0))).cast("long").alias("n_shared")).filter("whole or n_shared > 0"))
        each = classes.select("c", "rep", F.explode("found").alias("x")).select("c", "rep", "x.h", "x.lo", "x.hi")
        places = self._shared(each).groupBy("c", "rep").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("found"))
        places = scratch.write(places)
        scratch.drop(classes, *self.counts)
        texts = long_.filter(F.octet_length("t") >= length).select("id", F.unhex(F.md5(F.col("t").cast("binary"))).alias("c"), "t")
        texts = self._may_hold(texts, places)
        cut = places.join(texts, (places.c == texts.c) & places.rep.eqNullSafe(texts.id)).select(places.c, F.col("t").cast("binary").alias("t"), F.explode("found").alias("x"))
        cut = cut.select("x.h", "c", "x.lo", "x.hi", F.substring("t", F.col("x.lo") + 1, F.col("x.hi") - F.col("x.lo") + (length - 1)).alias("bytes")).withColumn("s", F.xxhash64("h", F.unhex(F.md5("bytes"))))
        cut = scratch.write(cut)
        groups = cut.groupBy("h", "s").agg(F.count(F.lit(1)).alias("m"), F.first("bytes").alias("bytes"))
        groups = scratch.write(groups)
        sizes = scratch.write(groups.groupBy("h").agg(F.count(F.lit(1)).alias("different")).filter("different > 1"))
        total = groups.join(sizes, "h").agg(F.sum(F.length("bytes"))).first()[0] or 0
        shards = 1 + total // SHARD_BYTES
        spread = F.ceil(F.col("different") / SPREAD)
        part = F.when(spread > 1, F.xxhash64("h", F.pmod("s", spread))).otherwise(F.xxhash64("h"))
        work = groups.join(sizes, "h").select("h", "s", "m", "bytes", (spread > 1).alias("spread"), F.pmod(part, F.lit(shards)).alias("shard"))
        work = work.repartition(int(shards), "shard")  # small tasks, however small the shuffle
        marked = scratch.write(work.groupBy("shard").applyInArrow(_shard(length), "h long, s long, a int, b int, shard long, x1 long, x2 long"))
        alone = marked.filter("x1 is not null")  # distinct strings of spread pieces, by their hashes
        ranges = 1 + alone.count() // MERGED
        merged = alone.withColumn("range", F.pmod("x1", F.lit(ranges))).groupBy("range").applyInArrow(_merge, "h long, s long, a int, b int")
        runs = marked.filter("x1 is null").select("h", "s", "a", "b").union(merged).groupBy("h", "s").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
        runs = scratch.write(runs)  # a table, so that Spark can split the places of a frequent stretch
        # equal stretches in two places repeat as a whole
        more = groups.filter("m > 1").select("h", "s")
        keys = cut.select("h", "s", "c", "lo", "hi")
        spans = keys.join(runs, ["h", "s"]).select("c", "lo", F.explode("runs").alias("x")).select("c", (F.col("lo") + F.col("x.a")).alias("a"), (F.col("lo") + F.col("x.b")).alias("b"))
        spans = spans.union(keys.join(more, ["h", "s"]).select("c", F.col("lo").alias("a"), F.col("hi").alias("b")))
        spans = spans.groupBy("c").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
        both = spans.join(marks, "c", "full")
        out = scratch.write(both.select("c", F.coalesce("whole", F.lit(False)).alias("whole"), "spans", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared")))
        scratch.drop(places, marks, cut, groups, sizes, marked, runs)
        return out

    def run(self) -> DataFrame:
        """id, n_bytes, n_removed, n_spans, kept_sha256, n_shared of every row."""
        length, spans = self.length, self.spans()

        def keep(batches) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "t"):
                rows = []
                for text, whole, starts, shared in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                    raw = text or b""
                    gone = [(0, len(raw))] if whole and len(raw) >= length else merge([(x["a"], x["b"] - 1 + length) for x in starts or ()])
                    kept, at = hashlib.sha256(), 0
                    for a, z in gone:
                        kept.update(raw[at:a])
                        at = z
                    kept.update(raw[at:])
                    rows.append((len(raw), sum(z - a for a, z in gone), len(gone), kept.hexdigest(), shared))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

        kind = dict(self.docs.dtypes)[self.id]
        texts = self.docs.select(F.col(self.id).alias("id"), F.col(self.text).cast("binary").alias("t")).withColumn("c", F.unhex(F.md5("t")))
        both = texts.join(spans, "c", "left").select("id", "t", F.coalesce("whole", F.lit(False)).alias("whole"), "spans", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
        return mapped(both, keep, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long").withColumnRenamed("id", self.id)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shard(length: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["h", "s", "a", "b", "shard", "x1", "x2"]

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        data, offsets = flat(group["bytes"].chunk(0) if group["bytes"].num_chunks else pa.array([], pa.binary()))
        h, s, m, spread, shard = (group[x].to_pylist() for x in ("h", "s", "m", "spread", "shard"))
        n = np.diff(offsets) - length + 1
        seg = np.repeat(np.arange(len(n)), n)
        local = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[seg] + local
        number, again = repeated(data, starts, length)
        rows: list[tuple] = []
        ends = np.cumsum(n)
        for i in range(len(n)):
            if m[i] == 1:
                rows += [(h[i], s[i], a, b, shard[i], None, None) for a, b in _runs(again[ends[i] - n[i] : ends[i]])]
        hot = np.array(spread, bool)[seg] if len(seg) else np.zeros(0, bool)
        if hot.any():
            _, first = np.unique(number[hot], return_index=True)  # one of each distinct string
            at = starts[hot][first]
            x = [_window(data, at, length, seed) for seed in (1, 2)]
            where, offset = seg[hot][first], local[hot][first]
            rows += [(h[i], s[i], o, o + 1, shard[i], p, q) for i, o, p, q in zip(where.tolist(), offset.tolist(), x[0].tolist(), x[1].tolist())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names)

    return work


def _merge(group: pa.Table) -> pa.Table:
    """The rows (h, s, a, b) whose hash another shard has too: each shard's is sought in the sorted ones before it."""
    shard = group["shard"].to_numpy()
    raw = np.stack([group["x1"].to_numpy(), group["x2"].to_numpy()], 1).astype(">i8").tobytes()
    keys = np.frombuffer(raw, "S16") if len(shard) else np.zeros(0, "S16")
    again = np.zeros(len(shard), bool)
    seen, owner = np.zeros(0, "S16"), np.zeros(0, np.int64)
    for one in np.unique(shard):
        own = np.flatnonzero(shard == one)
        own = own[np.argsort(keys[own], kind="stable")]
        at = np.searchsorted(seen, keys[own])
        hit = np.zeros(len(own), bool)
        inside = at < len(seen)
        hit[inside] = seen[at[inside]] == keys[own[inside]]
        again[own[hit]] = again[owner[at[hit]]] = True
        seen, owner = np.insert(seen, at[~hit], keys[own[~hit]]), np.insert(owner, at[~hit], own[~hit])
    return group.select(["h", "s", "a", "b"]).filter(pa.array(again))


def _window(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    rolling = Rolling(100 + seed)
    return rolling.spans(rolling.prefix(data), at, at + length).view(np.int64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dedup(table(spark, sf_dir, "documents")).run()
