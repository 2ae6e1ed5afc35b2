"""Operators on whole tables against brute force: nearest neighbours, sharding, mixing, joins, dedup, the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, line_dedup, mixing, ngram_join, sharding, suffix_dedup

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """(doc_id, text, source) rows as documents with a column whose name clashes."""
    full = [(i, t, "en", s, len(t or ""), 0) for i, t, s in rows]
    return spark.createDataFrame(full, KIND + ", size long").repartition(3)


def words(rng, n, size=400):
    return " ".join(f"w{j}" for j in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = [words(rng, 120, 4000) for _ in range(6)]
    out = [(i, words(rng, int(rng.integers(1, 90)), 3000), f"s{i % 4}") for i in range(60)]
    for k, text in enumerate(base):  # near and exact copies
        parts = text.split(" ")
        for j in range(8):
            own = list(parts)
            for at in rng.choice(len(own), j // 2, replace=False):
                own[at] = f"x{k}{j}{at}"
            out.append((100 + 10 * k + j, " ".join(own), "hot"))
    out += [(i, base[0], "hot") for i in range(200, 230)]
    passage = "\n".join(words(rng, 30, 5000) for _ in range(4))
    out += [(i, words(rng, 60, 5000) + "\n" + passage + "\n" + words(rng, 20, 5000), None) for i in range(300, 306)]
    out += [(400, None, "s1"), (401, "", "s1"), (402, "  \n ", None), (403, "one", "s2"), (404, "One", "s2"), (405, "two words", "s2"), (406, "x" * 3000, "s3"), (407, "ab " * 2000, "s3"), (400, None, "s1"), (1, out[1][1], "s1"), (None, "null id text here", "s1")]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x[500:1500] = x[500]  # a vector that a third of all rows hold
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] + [1.0] * 7), (9004, [None] + [1.0] * 7), (9005, [1.0] * 3), (20, [float(v) for v in x[20]])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    out = ann.Index(df, leaf=32).search(F.col("vec_id") % 20 == 0).toPandas()
    y, ids, found = x.astype(float), np.arange(3000), []
    for q in range(0, 3000, 20):
        score = (y * y[q]).sum(1)
        score[q] = -np.inf
        true = np.lexsort((ids, -score))[:20]
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own["score"], score[own["vec_id"]], rtol=0, atol=1e-12)
        found.append(len(set(true) & set(own["vec_id"])) / 20)
        assert own[["score", "vec_id"]].apply(lambda r: (-r["score"], r["vec_id"]), axis=1).is_monotonic_increasing
    assert np.mean(found) >= 0.9


@pytest.mark.parametrize("data", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])]])
def test_few_neighbours(spark, data):
    out = ann.Index(spark.createDataFrame(data, "vec_id long, embedding array<float>")).search(F.col("vec_id") % 20 == 0).collect()
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == ([2, 1] if len(data) == 3 else [])


def test_sharding(spark, rows):
    out = sharding.Propagation(table(spark, rows), shards=5).run().toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == len(rows) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    texts = dict((i, t) for i, t, _ in rows)
    for r in out.dropna(subset=["doc_id"]).to_dict("records"):
        raw = (texts[int(r["doc_id"])] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    groups = out.groupby(["text_crc32"])["shard"].agg(["size", "nunique"])
    small = groups[(groups["size"] > 1) & (groups["size"] < 10)]
    assert (small["nunique"] == 1).mean() >= 0.8
    assert sharding.Propagation(table(spark, rows).limit(0), shards=5).run().count() == 0


def test_sharding_hot_group_and_wishes_left(spark):
    """A third of all rows are copies; everything that could be granted was: no two wishes are opposed, and no free row is left to pay."""
    texts = ["copy"] * 300 + [f"pair {i // 2}" for i in range(200)] + [f"own {i}" for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    found = sharding.Propagation(docs, shards=6)
    out = found.run().toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == 900 and sizes.max() - sizes.min() <= 1 and found.left == 0
    pairs = out[(out["doc_id"] >= 300) & (out["doc_id"] < 500)].assign(pair=lambda x: x["doc_id"] // 2)
    assert (pairs.groupby("pair")["shard"].nunique() == 1).all()
    assert out[out["doc_id"] < 300]["shard"].nunique() <= 3


def test_grants_keep_sizes():
    granted, ends = sharding.grants({(0, 1): 5, (1, 0): 2, (2, 1): 4}, {1: 4, 0: 9}, 3)
    assert granted[0][1] == 5 and granted[1][0] == 2 and granted[2][1] == 1 and ends[1] == [3, 3, 4]
    flow = [sum(granted[i]) - sum(g[i] for g in granted) for i in range(3)]
    back = [sum(b - a for a, b in zip([0, *ends[j]], ends[j])) for j in range(3)]
    back_in = [sum((ends[j][i] - ([0, *ends[j]][i])) for j in range(3)) for i in range(3)]
    assert [f + b - c for f, b, c in zip(flow, back, back_in)] == [0, 0, 0]


def _targets(size):
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in open_) if open_ else 0
        new = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not new:
            return {s: 3 * size[s] if s in full else weight[s] * level for s in names}
        full |= new


def test_mixing(spark, rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = _targets(size)
    docs = table(spark, rows)
    plan = mixing.Mix(docs).plan().withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])).collect()
    taken = Counter()
    for r in plan:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
    assert len(plan) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.Mix(docs.repartition(7)).plan().collect()
    same = lambda found: sorted(repr((r["doc_id"], r["key"], r["copies"])) for r in found)
    assert same(again) == same(plan)
    whole = mixing.Mix(docs, whole=True).mixed()
    got = Counter()
    for r in whole.collect():
        got[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert Counter(whole.columns) == Counter([*docs.columns, "shard"]) and all(abs(got[s] - want[s]) <= max(60, 0.25 * want[s]) for s in want)
    assert mixing.Mix(docs.limit(0)).plan().count() == 0


def test_mixing_takes_what_the_tree_deals(spark, rows):
    """Every copy of a block goes to the shard of its place in the tree's draw, and shards are equal in copies."""
    docs = spark.createDataFrame([(i, "w " * 5, "s") for i in range(4000)], "doc_id long, text string, source string")
    plan = mixing.Mix(docs, shards=4).plan().collect()
    assert all(len(r["copies"]) == 1 and r["copies"][0]["words"] == 5 for r in plan)
    dealt = {(r["copies"][0]["place"], r["copies"][0]["shard"]) for r in plan}
    assert len(dealt) == 8 and sorted(Counter(s for _, s in dealt).values()) == [2, 2, 2, 2]


def test_mixing_clashes_ties_and_hot_sources(spark):
    rows = [(1, "a b", "s", 9, None), (1, "a b", "s", 9, None), (1, "a b", None, 9, None), (2, None, "s", 9, 1.0), (None, "a b", "s", 9, 1.0), (3, "x " * 30_000, "t", 9, 1.0)]
    rows += [(10 + i, "same text here", "hot", i % 3, 0.0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, key double")
    plan = mixing.Mix(docs).plan().withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])).collect()
    assert len(plan) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in plan)
    got = Counter()
    for r in plan:
        got[r["source"]] += r["taken"]
    assert all(abs(got[r["source"]] - r["target"]) <= 1 for r in plan)
    mixed = mixing.Mix(docs, whole=True).mixed(shard_col=None)
    assert mixed.columns == docs.columns
    known = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in mixed.collect()} <= known
    assert sorted(mixing.Mix(docs, whole=True).mixed().columns) == sorted(docs.columns)


def test_large_draws_are_exact(monkeypatch):
    rng, own = np.random.default_rng(1), np.array([3 * 10**9, 0, 7, 10**9])
    out = mixing._draw(rng, own, 10**9)
    assert out.sum() == 10**9 and (out <= own).all() and abs(out[3] / 10**9 - 0.25) < 0.01


def test_targets_share_the_excess(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 1000, "c")], "doc_id long, text string, source string")
    plan = {r["source"]: r["target"] for r in mixing.Mix(docs).plan().collect()}
    assert plan == pytest.approx(_targets({"a": 10, "b": 1000, "c": 1000})) and plan["a"] == 30


def test_splitting_tree_is_exact():
    counts = np.array([100, 0, 7, 50])
    out = mixing.split_counts(counts, 6, 1)
    assert (out.sum(1) == counts).all() and np.ptp(out.sum(0)) <= 3


def _set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k, share", [(3, 90), (5, 80)])
def test_ngram_join(spark, rows, k, share):
    kept = [r for r in rows if r[0] is not None]
    sets = [(i, _set(t, k)) for i, t, _ in kept]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= share * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    out = ngram_join.join(table(spark, rows), k=k, share=share).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert r["component_id"] == root(r["doc_id"]) and (r["doc_id"], r["n_shingles"]) in {(i, len(s)) for i, s in sets}


@pytest.mark.parametrize("block", [2, 256])
def test_ngram_join_counts_all_links(spark, rows, monkeypatch, block):
    """Also those that no shingle's central class has a part in."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = {_set(t, 3) for _, t, _ in rows} - {frozenset()}
    links = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in sets) for a in sets}
    assert max(links.values()) > 5
    want = Counter((i, links.get(_set(t, 3), 0)) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_links"]) for r in ngram_join.join(table(spark, rows), share=80).collect()) == want


def test_ngram_join_rounds(spark, rows):
    """Further rounds and the last one find what one round finds."""
    df = table(spark, [r for r in rows if r[0] is not None])
    one = {r["doc_id"]: r["component_id"] for r in ngram_join.Join(df, share=80, most_rounds=1).run().collect()}
    many = {r["doc_id"]: r["component_id"] for r in ngram_join.Join(df, share=80, most_rounds=4).run().collect()}
    assert one == many


def test_ngram_join_empty(spark, rows):
    assert ngram_join.join(table(spark, rows).limit(0)).count() == 0
    blank = ngram_join.join(table(spark, [(1, None, "s"), (2, "", "s")])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in blank) == [(1, 0, 1), (2, 0, 2)]


def _deleted_lines(docs, gram, words_, window):
    """The definition in the operator's docstring, by loops; docs are distinct (id, text)."""
    state = []
    for i, t in docs:
        lines = (t or "").split("\n") if t is not None else []
        at = [n for n, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        x = [lines[n].strip(" \t\n\x0b\f\r") for n in at]
        w = [len(re.findall(r"[^\x20\x09-\x0D]+", y)) for y in x]
        n = []
        for k in range(len(x)):
            total, e = 0, k
            while e < len(x) and total < words_:
                total, e = total + w[e], e + 1
            if total < words_:
                break
            n.append(e - k)
        state.append((i, at, x, n))
    prints = defaultdict(list)
    for d, (i, at, x, n) in enumerate(state):
        g = [gram[tuple(x[k : k + n[k]])] for k in range(len(n))]
        chosen = {k for k in range(len(n)) if n[k] == 1}
        for j in range(max(len(n) - window, 0) + 1 if n else 0):
            chosen.add(min(range(j, min(j + window, len(n))), key=lambda k: (g[k], -k)))
        for k in chosen:
            prints[g[k]].append((i, d, k))
    gone = defaultdict(set)
    for same in prints.values():
        first = min(same, key=lambda p: (p[0], p[2]))
        _, da, pa_ = first
        for _, d, p in same:
            if (d, p) == (da, pa_):
                continue
            at, x, n = state[d][1:]
            xa, na = state[da][2:]
            left = 0
            while left < window - 1 and p > left and pa_ > left and x[p - left - 1] == xa[pa_ - left - 1]:
                left += 1
            end = lambda m, q: min(q + window - 1, len(m) - 1) + m[min(q + window - 1, len(m) - 1)]
            right = n[p]
            while p + right < end(n, p) and pa_ + right < end(na, pa_) and x[p + right] == xa[pa_ + right]:
                right += 1
            gone[d].update(at[p - left : p + right])
    return gone


def test_line_dedup(spark, rows):
    rng = np.random.default_rng(9)
    block = [words(rng, 3, 900) for _ in range(9)]
    docs = [r for r in rows if r[0] not in (None, 1, 400)]
    docs += [(500 + i, "\n".join([words(rng, 5, 900), *block[: 4 + i % 5], "", words(rng, 12, 900) if i % 2 else "", *block[2:]]), "b") for i in range(12)]
    docs += [(600, "\n".join(["same line of some eight words is here", "x"] * 40), "b"), (601, None, "b"), (602, "a\n\nb", "b")]
    df = table(spark, docs)
    pairs = sorted({(i, t) for i, t, _ in docs}, key=lambda p: p[0])
    grams = set()
    for _, t in pairs:
        x = [y.strip(" \t\n\x0b\f\r") for y in (t or "").split("\n") if y.strip(" \t\n\x0b\f\r")]
        grams |= {tuple(x[a : a + n]) for a in range(len(x)) for n in range(1, 9)}
    listed = sorted(grams)
    hashed = spark.createDataFrame([(i, list(g)) for i, g in enumerate(listed)], "i long, x array<string>").select("i", F.xxhash64(F.transform("x", lambda v: F.xxhash64(v))).alias("h")).collect()
    gone = _deleted_lines(pairs, {listed[r["i"]]: r["h"] for r in hashed}, 8, 4)
    out = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    assert sum(map(len, gone.values())) > 100
    for d, (i, t) in enumerate(pairs):
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])
        assert (out[i]["text"], out[i]["n_removed"]) == (kept, len(gone[d])), i
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_line_dedup_finds_runs_behind_other_places(spark):
    """Runs of documents 2 and 3 go whole, though their long lines occur in document 1 among other lines."""
    docs, want = [], {}
    for s in range(0, 200, 10):  # whether a gram over two lines is a fingerprint too, is up to the hashes
        long = [f"line number {s} {i} has more than eight words in it" for i in range(2)]
        run = [f"short head {s}", long[0], f"short middle {s}", f"other middle {s}", long[1], f"short tail {s}"]
        ends = [f"document {s + i} ends in more than eight words of its own" for i in range(4)]
        alone = "\n".join([f"alone a{s}", long[0], f"alone b{s}", long[1], f"alone c{s}"])
        docs += [(s + 1, alone, "s"), (s + 2, "\n".join([*run, ends[2]]), "s"), (s + 3, "\n".join([f"own words {s}", *run, ends[3]]), "s")]
        want |= {s + 1: alone, s + 2: "\n".join([*(x for x in run if x not in long), ends[2]]), s + 3: f"own words {s}\n{ends[3]}"}
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(table(spark, docs)).collect()} == want


def test_line_dedup_clashes_nulls_ties_and_long_texts(spark):
    line = "a line of eight words that repeats itself here"
    rows = [(1, f"{line}\n{line}\nx", 5, 6, "k"), (1, f"{line}\ny", 5, 6, "k"), (2, f"z\n{line}", 5, 6, None), (None, line, 5, 6, "k"), (3, None, 5, 6, "k"), (4, "", 5, 6, "k"), (5, "\n".join([line, "b"] * 8_000), 5, 6, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, `__flags` int, c0 string")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "__flags", "c0", "n_lines", "n_removed"]
    found = Counter((r["doc_id"], r["text"]) for r in out.collect())
    kept = [t for _, t in found.elements() if t]
    assert sum(t.count(line) for t in kept) == 1 and (None, line) in found  # the null id comes first
    assert found[3, None] == found[4, ""] == 1 and (2, "z") in found
    plain = line_dedup.dedup(df, counts=False)
    assert plain.columns == df.columns and plain.count() == len(rows)


def test_line_dedup_equal_rows(spark):
    text = "a line of eight words that repeats itself here\nother"
    out = line_dedup.dedup(table(spark, [(1, text, "s"), (1, text, "s"), (2, text, "s")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, text), (1, text), (2, "other")]


@pytest.mark.parametrize("spread", [2, 6000])
def test_suffix_dedup(spark, rows, spread, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
    length = 100
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    count = Counter(r[p : p + length] for _, r in raw for p in range(len(r) - length + 1))
    want = []
    for i, r in raw:
        spans = suffix_dedup.merge([(p, p + length) for p in range(len(r) - length + 1) if count[r[p : p + length]] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + r[at:a], b
        want.append((i, len(r), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + r[at:]).hexdigest()))
    out = suffix_dedup.Dedup(table(spark, rows), length=length, piece=20).run().collect()
    grams = lambda raw, k: {tuple(raw.split()[p : p + k]) for p in range(len(raw.split()) - k + 1)}
    held = {k: Counter(g for _, r in raw for g in grams(r, k)) for k in (51, 32)}
    texts = dict(raw)
    for r in out:
        if r["doc_id"] is not None:
            long_, short = (any(held[k][g] > 1 for g in grams(texts[r["doc_id"]], k)) for k in (51, 32))
            assert long_ <= (r["n_shared"] > 0) <= short
    assert sum(r["n_shared"] > 0 for r in out) > 10
    out = [tuple(r)[:5] for r in out]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 5000


def test_suffix_ranks():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    starts = np.arange(3000 - 37)
    number, again = suffix_dedup.repeated(data, starts, 37)
    raw = data.tobytes()
    count = Counter(raw[p : p + 37] for p in starts)
    assert [count[raw[p : p + 37]] > 1 for p in starts] == again.tolist() and len(set(number.tolist())) == len(count)


@pytest.mark.parametrize("n, letters, length", [(3000, 2, 37), (500, 1, 40), (9000, 3, 9), (5, 2, 9), (1, 1, 9)])
def test_suffix_array_and_kasai(n, letters, length):
    data = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    raw, order = data.tobytes(), suffix_dedup.suffix_array(data, length)
    cut = [raw[i : i + length] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(n)) and cut == sorted(cut)
    shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(cut, cut[1:])]
    assert suffix_dedup.common_prefixes(data, order, length).tolist() == shared


def test_suffix_ranks_of_passages_longer_than_the_order_is_deep():
    """Two places of a passage may stand in another order than what follows them; blocks of positions are several long."""
    rng = np.random.default_rng(11)
    letters = lambda n: rng.integers(97, 101, n).astype(np.uint8)
    cores = [letters(rng.integers(420, 700)) for _ in range(60)]
    texts = [np.concatenate([letters(150), core, letters(150)]) for core in cores for _ in range(2)] + [letters(900) for _ in range(60)]
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([np.arange(end - len(t), end - 399) for t, end in zip(texts, ends)])
    raw = np.concatenate(texts).tobytes()
    number, again = suffix_dedup.repeated(np.frombuffer(raw, np.uint8), starts, 400)
    count = Counter(raw[p : p + 400] for p in starts)
    assert len(raw) > 10 * suffix_dedup.LANES and 0 < again.sum() < len(again)
    assert [count[raw[p : p + 400]] > 1 for p in starts] == again.tolist() and len(set(number.tolist())) == len(count)


def test_suffix_merge():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x, shard = rng.integers(-3, 3, (400, 2)), rng.integers(0, 7, 400)
    _, first = np.unique(np.column_stack([x, shard]), axis=0, return_index=True)  # a shard has each string once
    x, shard = x[first], shard[first]
    given = pa.table({"h": np.arange(len(x)), "s": np.arange(len(x)), "a": pa.array(range(len(x)), pa.int32()), "b": pa.array(range(len(x)), pa.int32()), "shard": shard, "x1": x[:, 0], "x2": x[:, 1]})
    count = Counter(map(tuple, x.tolist()))
    assert suffix_dedup._merge(given)["h"].to_pylist() == [i for i, k in enumerate(x.tolist()) if count[tuple(k)] > 1]


def test_suffix_dedup_empty(spark, rows):
    assert suffix_dedup.Dedup(table(spark, rows).limit(0)).run().count() == 0


def test_pipeline_stages_against_plain_python(spark, sf):
    """Each stage on what its predecessor kept: rows by rows, by another way."""
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    from tessera.llm import byte_bpe, toxicity

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    given = {n: f for n, f in corpus_pipeline.STAGES}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "source mixing", "byte-level BPE"]
    known = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    # toxicity: the same counts and rows, gathered without Spark
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    learned = [(known[i][0], y) for i, y in toxic.items() if i in known and y is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    model = toxicity.fit(learned, sum(toxicity.count_trigrams([t]) for t, _ in known.values()))
    now = given["toxicity"](spark, docs, sf)
    assert now.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    assert kept == {i: t for i, (t, _) in known.items() if model.score(t) < 0.7}
    assert np.mean([(i in kept) == (y == 0) for i, y in toxic.items()]) > 0.9
    now = spark.createDataFrame(now.collect(), docs.schema)
    # line dedup: see test_line_dedup for the rule; here, that a kept line of eight words never repeats an earlier one
    out = given["line dedup"](spark, now, sf)
    rows_ = sorted(out.collect(), key=lambda r: r["doc_id"])
    seen = set()
    for r in rows_:
        assert r["n_chars"] == len(r["text"])
        for x in r["text"].split("\n"):
            if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 8:
                assert x.strip() not in seen
                seen.add(x.strip())
    now = spark.createDataFrame(rows_, docs.schema)
    # near duplicates: all pairs
    out = {r["doc_id"] for r in given["n-gram Jaccard join"](spark, now, sf).collect()}
    sets, parent = {r["doc_id"]: _set(r["text"], 5) for r in rows_}, {r["doc_id"]: r["doc_id"] for r in rows_}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    assert out == {i for i in ids if root(i) == i}
    now = now.filter(F.col("doc_id").isin(list(out)))
    # mixing: whole documents, near each source's target
    mixed = given["source mixing"](spark, now, sf)
    assert mixed.columns == docs.columns
    rows_ = mixed.collect()
    size = Counter()
    for r in now.collect():
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    want, got, most = _targets(size), Counter(), Counter()
    for r in rows_:
        got[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        most[r["doc_id"]] += 1
    longest = Counter()
    for r in now.collect():
        longest[r["source"]] = max(longest[r["source"]], len(r["text"].split()))
    assert {r["doc_id"] for r in rows_} <= out and max(most.values()) <= 3 and all(abs(got[s] - want[s]) <= longest[s] for s in want)
    # tokens: the library
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in given["byte-level BPE"](spark, spark.createDataFrame(rows_, docs.schema), sf).collect():
        ids_ = library.encode_ordinary(next(x["text"] for x in rows_ if x["doc_id"] == r["doc_id"]))
        assert r["ids"] == ids_ and r["n_tokens"] == len(ids_)


def test_pipeline_runs_as_a_whole(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_pipeline_of_odd_tables(spark, sf, tmp_path):
    """No documents, and documents of nulls, empties, equal rows and clashing columns."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(1, None, None, None, None, 7), (None, "", "en", "s", 0, 7), (None, None, None, None, None, 7), (2, "one two", "en", "s", 7, 7), (2, "one two", "en", "s", 7, 7), (3, "x " * 20_000, "en", None, 40_000, 7), (4, "word " * 3 + "\n" * 5000, "en", "s", 5015, 7)]
    for name, rows_ in (("empty", []), ("odd", odd)):
        folder = tmp_path / name
        docs.limit(0).withColumn("shard", F.lit(1)).unionByName(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long, shard int")).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r["doc_id"] for r in out} <= {r[0] for r in rows_} and (not rows_ or {2, 3} <= {r["doc_id"] for r in out})


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
