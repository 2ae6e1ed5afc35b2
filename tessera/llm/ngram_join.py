"""Operator 6: n-gram Jaccard join by rare-first prefix filtering.

The sets are distinct word shingles, hashed to 64 bits. Equal sets become one class. Each class keeps as its prefix the
shingles that a partner must share one of, rarest first; rarity comes from a table of 2**20 counters over all
documents, so what is broadcast has a fixed size. Classes join on prefix shingles under the length and positional
filters; pairs are made distinct, pass a suffix filter (a lower bound of the Hamming distance, from bit signatures),
and are verified once on their whole sets.

A shingle that many classes share would make pairs with the square of their number. So the pairs of every shingle are
first those with its smallest class alone; links found so join components, and later rounds pair a new class of each
shingle only with classes of other components. When few pairs are left between components, all of them are verified.
No link between different components can stay unseen, hence components are exact. Every link lies within a component,
so where the rounds have not listed all pairs of one, its classes are then compared with each other, all of them, in
blocks that meet pairwise: n_links counts every link.

Null, empty and blank texts have empty sets, and are linked with nothing. Equal rows are in one class. Null ids take no
part as component ids unless a component has no other. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Scratch, flat, mapped, mix64, pieces, table
from .graph import components

SLOTS = 20  # bits of a counter's number
PARTS = 16  # rows in which a task hands over its counters
FAN_IN = 16  # tasks whose counters one task sums
SIGNATURE = 16  # longs of a signature
KEY = 44  # bits of a prefix shingle's hash; unequal shingles that share them make a candidate, which is verified
SEEN = 24  # bits of the filter that picks the rows whose sets are needed
BLOCK = 256  # classes of a block, as long as their sets
WEIGHT = 1 << 18  # hold no more shingles than this
COLUMNS = 2048  # shingles whose sharing is counted at a time

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_ROLLING = Rolling(6)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of all rows, sorted by both."""
    data, offsets = flat(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = _FOLD[data]
    inner = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inner[:-1]]) & ~first[:-1]
    after = np.concatenate([inner[1:], [False]]) & ~first[1:]
    starts, ends = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = _ROLLING.spans(_ROLLING.prefix(data), starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    n = np.bincount(row, minlength=len(offsets) - 1)
    odd = np.random.default_rng(k).integers(1, 2**62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    m = max(0, len(words) - k + 1)
    value = np.zeros(m, np.uint64)
    for i in range(k):
        value += words[i : i + m] * odd[i]
    whole = row[:m] == row[k - 1 :] if m else np.zeros(0, bool)
    rows, values = row[:m][whole], mix64(value[whole])
    few = np.flatnonzero((n > 0) & (n < k))  # their whole sequence is one shingle
    if len(few):
        at = np.searchsorted(row, few)
        short = np.zeros(len(few), np.uint64)
        for i in range(k - 1):
            has = n[few] > i
            short[has] += words[at[has] + i] * odd[i]
        rows, values = np.concatenate([rows, few]), np.concatenate([values, mix64(short + n[few].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SLOTS)).astype(np.int64)


def counters(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How many rows' shingles fall on each of 2**SLOTS counters: 4 MB, whatever the input."""
    size = (1 << SLOTS) // PARTS

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS, np.int64)
        for b in pieces(batches, "t"):
            total += np.bincount(_slot(shingles(b.column(0), k)[1]), minlength=1 << SLOTS)
        if total.any():
            raw = np.minimum(total, 2**32 - 1).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": [zlib.compress(raw[i * size : (i + 1) * size].tobytes(), 1) for i in range(PARTS)]})

    def add(batches) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[part] = np.minimum(np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64) + total.get(part, 0), 2**32 - 1)
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "counts": [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in total.values()]})

    kind = "part int, counts binary"
    each = mapped(docs.select(F.col(text_col).alias("t")), count, kind)
    n = docs.rdd.getNumPartitions()
    while n > FAN_IN:  # a tree of sums, so that a task reads FAN_IN tasks' counters at most
        n = -(-n // FAN_IN)
        each = mapped(each.repartition(n), add, kind)
    some = mapped(each.repartition(PARTS, "part"), add, kind)
    out = np.zeros((PARTS, size), np.int64)
    for part, raw in some.collect():
        out[part] += np.frombuffer(zlib.decompress(bytes(raw)), np.uint32)
    return np.minimum(out.reshape(-1), 2**32 - 1).astype(np.uint32)


_SALTS = (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)


def _key(values: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each row's set, whatever the order of its n values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix64(values ^ np.uint64(salt)), out=sums[1:])
    ends = np.cumsum(n)
    return mix64(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)


def _needed(n: np.ndarray, share: int) -> np.ndarray:
    """Least overlap of a set of size n with any partner."""
    return (n * share + 99) // 100


def profiles(docs: DataFrame, id_col: str, text_col: str, k: int, share: int, counts) -> DataFrame:
    """id, n, k1, k2 (128 bits of the set), prefix (rarest first) and signature of every row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        rarity = counts.value
        for b in pieces(batches, "t"):
            rows, values = shingles(b.column(1), k)
            order = np.lexsort((values, rarity[_slot(values)], rows))
            values = values[order]
            n = np.bincount(rows, minlength=b.num_rows)
            ends = np.cumsum(n)
            begins = ends - n
            keys = [pa.array(_key(values, n, salt)) for salt in _SALTS]
            take = np.where(n > 0, n - _needed(n, share) + 1, 0)
            inside = np.arange(len(values)) - np.repeat(begins, n) < np.repeat(take, n)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array((values[inside] >> np.uint64(64 - KEY)).astype(np.int64)))
            bits = np.zeros((b.num_rows, SIGNATURE * 64), np.uint8)
            np.bitwise_xor.at(bits, (rows, (mix64(values) >> np.uint64(54)).astype(np.int64)), 1)
            signature = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * SIGNATURE, pa.int32()), pa.array(np.packbits(bits, axis=1).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *keys, prefix, signature], ["id", "n", "k1", "k2", "prefix", "signature"])

    kind = dict(docs.dtypes)[id_col]
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), run, f"id {kind}, n long, k1 long, k2 long, prefix array<long>, signature array<long>")


def _similar(a: Column, b: Column, overlap: Column, share: int) -> Column:
    return overlap * 100 >= (a + b - overlap) * share


def _close(na: Column, nb: Column, pa_: Column, pb: Column, share: int) -> Column:
    """Length filter, and the positional one: what two sets can share from the given places on.

    Similar sets pass at the first shingle that their prefixes share, where nothing is shared before.
    """
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * share) & _similar(na, nb, F.least(na - pa_, nb - pb), share)


def _overlaps(values: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left rows' sets with the right ones'; the sets lie end to end, n values each."""
    row = np.repeat(np.arange(len(n)), n)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, (wide, column) = row[shared], np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, len(wide), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(n), min(COLUMNS, len(wide) - start)), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _links_within(given: pa.Table, share: int) -> pa.Table:
    """(c, n_links) from pairs of blocks (component, x, y); `mine` is the block of a row, x or y."""
    component, x, y, mine, c, n = (given.column(name).to_numpy() for name in ("component", "x", "y", "mine", "c", "n"))
    sets = given.column("set").combine_chunks()
    values, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
    links = np.zeros(len(c), np.int64)
    order = np.lexsort((mine, y, x, component))
    new = (np.diff(component[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    for at in np.split(order, np.flatnonzero(new) + 1):
        left = np.flatnonzero(mine[at] == x[at])
        same = x[at[0]] == y[at[0]]
        right = left if same else np.flatnonzero(mine[at] != x[at])
        if not len(left) or not len(right):
            continue
        own = n[at]
        overlap = _overlaps(np.concatenate([values[offsets[i] : offsets[i + 1]] for i in at]), own, left, right)
        similar = overlap * 100 >= (own[left][:, None] + own[right][None] - overlap) * share
        if same:
            np.fill_diagonal(similar, False)
        else:
            links[at[right]] += similar.sum(0)
        links[at[left]] += similar.sum(1)
    return pa.table({"c": c, "n_links": links})


class Join:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, share: int = 90, most_rounds: int = 4):
        self.docs, self.id, self.text, self.k, self.share, self.most_rounds = docs, id_col, text_col, k, share, most_rounds
        self.spark = docs.sparkSession
        self.scratch, self.done = Scratch(self.spark, "ngram"), []

    def run(self, count_links: bool = True) -> DataFrame:
        """id, n_shingles, component_id, n_links (links from its class to other classes) of every row.

        Without count_links, n_links is left out.
        """
        spark, scratch = self.spark, self.scratch
        counts = spark.sparkContext.broadcast(counters(self.docs, self.text, self.k))
        rows = scratch.write(profiles(self.docs, self.id, self.text, self.k, self.share, counts))
        classes = scratch.write(rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix"), F.first("signature").alias("signature")).withColumn("c", F.monotonically_increasing_id()))
        members = classes.select("c", "n", F.posexplode("prefix").alias("pos", "key"))
        shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1").drop("m")
        # no partner is smaller than the smallest set under the shingle, or than the length filter lets pass
        partner = F.greatest("least", F.ceil(F.col("n") * self.share / 100))
        members = members.join(shared, "key").filter(_similar(F.col("n"), partner, F.col("n") - F.col("pos"), self.share)).drop("least")
        members = scratch.write(members)
        signatures = classes.select("c", "k1", "n", "signature")
        owners = None  # (c, component) of linked classes
        links = None
        for turn in range(self.most_rounds + 1):
            now = members.withColumn("component", F.col("c")) if owners is None else members.join(owners, members.c == owners.id, "left").select("key", "c", "n", "pos", F.coalesce("component", "c").alias("component"))
            if turn:
                per = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
                mixed = per.groupBy("key").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
                mixed = scratch.write(mixed)
                left = mixed.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.sum("all")).first()
                if not left[0]:
                    break
                now = scratch.write(now.join(mixed.select("key"), "key"))
                last = left[0] <= 8 * left[1] + 1_000_000 or turn == self.most_rounds
            else:
                last = False
            pairs = self._between(now) if last else self._pivots(now, turn)
            new = self._verified(pairs, signatures)
            links = new if links is None else scratch.write(links.union(new).distinct())
            if owners is None or new.limit(1).count():
                owners = scratch.write(components(scratch, links))
            if last:
                break
        scratch.drop(members, *self.done)
        groups = classes.select("c", "k1", "k2", "n", "rep")
        if owners is None:
            labelled = groups.withColumn("component_id", F.col("rep")).withColumn("n_links", F.lit(0).cast("long"))
        else:
            degree = self._degrees(links, owners, classes) if count_links else owners.select("id", F.lit(0).cast("long").alias("n_links"))
            known = groups.join(owners, groups.c == owners.id).drop("id")
            least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
            known = known.join(least, "component").join(degree, F.col("c") == degree.id).select("c", "component_id", "n_links")
            labelled = groups.join(known, "c", "left").select("k1", "k2", "n", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        full = rows.select("id", "n", "k1", "k2").join(labelled, ["k1", "k2", "n"], "left")
        out = full.select(F.col("id").alias(self.id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return out if count_links else out.drop("n_links")

    def _pivots(self, now: DataFrame, turn: int) -> DataFrame:
        """Pairs of each shingle's chosen class with the classes of other components under it.

        The choice falls on the class with the fewest rarer shingles, of some component: copies with few changes are
        near to most others.
        """
        order = F.struct(*([F.xxhash64("component", F.lit(turn)).alias("h")] if turn else []), "pos", "c", "n", "component")
        chosen = now.groupBy("key").agg(F.min(order).alias("p"))
        both = now.join(chosen, "key").filter((F.col("c") != F.col("p.c")) & (F.col("component") != F.col("p.component")))
        both = both.filter(_close(F.col("n"), F.col("p.n"), F.col("pos"), F.col("p.pos"), self.share))
        return both.select(F.least("c", "p.c").alias("a"), F.greatest("c", "p.c").alias("b")).distinct()

    def _band(self) -> Column:
        """Sets of similar texts lie in one band of lengths or in adjacent ones."""
        return F.floor(F.log(F.col("n").cast("double")) / -np.log(self.share / 100 - 1e-9)).cast("long")

    def _degrees(self, links: DataFrame, owners: DataFrame, classes: DataFrame) -> DataFrame:
        """(id, n_links) of every linked class: all links within its component, listed by the rounds or not."""
        scratch, share = self.scratch, self.share
        own = classes.select("c", "k1", "n").join(owners, classes.c == owners.id).drop("id")
        listed = links.join(owners, links.a == owners.id).groupBy("component").agg(F.count(F.lit(1)).alias("listed"))
        heavy = lambda m, total: F.ceil(F.greatest(m / BLOCK, total / WEIGHT)).cast("long")
        sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).join(listed, "component")
        sizes = sizes.select("component", (F.col("m") - 1).alias("others"), (F.col("listed") * 2 == F.col("m") * (F.col("m") - 1)).alias("whole"), (heavy(F.col("m"), F.col("total")) > 1).alias("large"))
        own = scratch.write(own.join(sizes, "component").withColumn("band", F.when(F.col("large"), self._band()).otherwise(0)))
        known = own.filter("whole").select(F.col("c").alias("id"), F.col("others").alias("n_links"))
        own = own.filter("not whole").select("component", "c", "k1", "n", "band")
        cells = own.groupBy("component", "band").agg(heavy(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
        place = lambda band, block: band * (1 << 32) + block
        own = own.join(cells, ["component", "band"]).withColumn("mine", place(F.col("band"), F.pmod(F.xxhash64("c"), "blocks"))).drop("blocks")
        near = cells.select("component", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), F.col("band").alias("to"), "blocks")
        met = own.join(near, ["component", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        other = place(F.col("to"), F.col("block"))
        met = scratch.write(met.select("component", F.least("mine", other).alias("x"), F.greatest("mine", other).alias("y"), "mine", "c", "k1", "n"))
        bins = -(-(met.agg(F.sum("n")).first()[0] or 0) // (2 * WEIGHT))
        if not bins:
            return known
        sets = self._sets(met.select("c", "k1").distinct())
        dealt = met.drop("k1").join(sets, "c").withColumn("bin", F.pmod(F.xxhash64("component", "x", "y"), F.lit(bins)))
        found = dealt.groupBy("bin").applyInArrow(lambda given: _links_within(given, share), "c long, n_links long")
        out = scratch.write(found.groupBy(F.col("c").alias("id")).agg(F.sum("n_links").alias("n_links")))
        scratch.drop(sets, met)
        return known.union(out)

    def _between(self, now: DataFrame) -> DataFrame:
        """All pairs under a shingle between different components; bands of lengths keep distant lengths apart."""
        banded = now.withColumn("band", self._band())
        a = banded.select("key", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("at"), *[F.col(x).alias(f"a_{x}") for x in ("c", "n", "pos", "component", "band")])
        b = banded.select("key", F.col("band").alias("at"), *[F.col(x).alias(f"b_{x}") for x in ("c", "n", "pos", "component", "band")])
        both = a.join(b, ["key", "at"]).filter((F.col("a_component") != F.col("b_component")) & ((F.col("a_band") < F.col("b_band")) | (F.col("a_c") < F.col("b_c"))))
        both = both.filter(_close(F.col("a_n"), F.col("b_n"), F.col("a_pos"), F.col("b_pos"), self.share))
        return both.select(F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b")).distinct()

    def _verified(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        """The pairs that are links, by their whole sets; none is looked at twice."""
        scratch, share = self.scratch, self.share
        side = lambda x: signatures.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
        apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        # |a - b| + |b - a| is apart at least, so twice the overlap is na + nb - apart at most
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("na") + F.col("nb") - apart) * 100 >= (F.col("na") + F.col("nb") + apart) * share)
        near = near.select("a", "b", "na", "nb")
        for before in self.done:
            near = near.join(before.select("a", "b"), ["a", "b"], "left_anti")
        near = scratch.write(near)
        self.done.append(near)
        sets = self._sets(near.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(signatures.select("c", "k1"), "c"))
        overlap = F.size(F.array_intersect("xa", "xb")).cast("long")
        whole = near.join(sets.select(F.col("c").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("xb")), "b")
        out = scratch.write(whole.filter(_similar(F.col("na"), F.col("nb"), overlap, share)).select("a", "b"))
        scratch.drop(sets)
        return out

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(c, set) of the wanted classes (c, k1), from the texts.

        A filter of 2**SEEN bits picks the rows, a task hands over each class once, and the join drops what passed by
        chance.
        """
        bit = F.shiftrightunsigned("k1", 64 - SEEN) + 1
        buckets = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
        seen = np.zeros((1 << SEEN) // 8, np.uint8)
        for bucket, bits in buckets:
            seen[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), np.uint8)
        picked, k = self.spark.sparkContext.broadcast(seen), self.k

        def run(batches) -> Iterator[pa.RecordBatch]:
            given: set[int] = set()
            for b in pieces(batches, "t"):
                rows, values = shingles(b.column(0), k)
                n = np.bincount(rows, minlength=b.num_rows)
                ends = np.cumsum(n)
                keys = _key(values, n, _SALTS[0])
                at = keys.view(np.uint64) >> np.uint64(64 - SEEN)
                hit = np.flatnonzero((n > 0) & ((picked.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1)).tolist()
                out = [i for i in hit if not (keys[i] in given or given.add(keys[i]))]
                sets = [values[ends[i] - n[i] : ends[i]].view(np.int64) for i in out]
                yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(sets, pa.list_(pa.int64()))], ["k1", "set"])

        sets = mapped(self.docs.select(F.col(self.text).alias("t")), run, "k1 long, set array<long>")
        return self.scratch.write(sets.join(wanted, "k1").groupBy("c").agg(F.first("set").alias("set")))


def join(docs: DataFrame, **how) -> DataFrame:
    return Join(docs, **how).run()


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents of which each group keeps the one with the smallest id; texts without words all stay.

    Rows equal in id and text stay once.
    """
    found = Join(docs, **how).run(count_links=False)
    kept = found.filter((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if again else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
