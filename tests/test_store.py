"""The store end to end, and operators whose work is split, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import activity, chunk, fusion, ingest, keyword, store, vector


@pytest.mark.parametrize("rows, lead", [(10_000, 256), (300, 256)])
def test_velocities_in_stretches(spark, rows, lead):
    rng = np.random.default_rng(2)
    track = [(a, n, float(n // 2 if a else n), rng.normal(size=3).tolist()) for a in range(2) for n in range(1000)]
    out = activity.velocities(spark.createDataFrame(track, "agent int, seq long, s double, v array<double>").repartition(5), "agent", "seq", "s", "v", 3, rows=rows, lead=lead)
    want = {}
    for a in range(2):
        own, now = [t for t in track if t[0] == a], np.zeros(3)
        for before, x in zip([None, *own], own):
            if before is not None and x[2] > before[2]:
                now = 0.3 * (np.array(x[3]) - np.array(before[3])) / (x[2] - before[2]) + 0.7 * now
            want[a, x[1]] = now
    found = {(r["agent"], r["seq"]): r["velocity"] for r in out.collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], rtol=0, atol=1e-12) for k in want)


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).round(1)
    x[10:20] = x[10]  # ties by id
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one = sorted(map(tuple, vector.knn_by_queries(vectors, queries, 5, 4).select("query_id", "vec_id", "rank").collect()))
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 14)
    assert sorted(map(tuple, vector.knn_by_queries(vectors, queries, 5, 4).select("query_id", "vec_id", "rank").collect())) == one
    norm = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    score = (norm @ norm.T).round(9)
    want = [(q, int(v), n + 1) for q in range(60) for n, v in enumerate(np.lexsort((np.arange(60), -score[q]))[:5])]
    assert len(one) == 300 and np.mean([a == b for a, b in zip(one, sorted(want))]) > 0.98


def test_saved_keyword_index(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = spark.createDataFrame([(1, "green stone water"), (2, "stone stone"), (3, None)], "id long, text string")
    docs.write.parquet(path)
    asked = spark.createDataFrame([(0, "stone"), (1, "water stone")], "query_id long, text string")
    found = lambda index: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in keyword.search(index, asked).collect())
    built = found(keyword.build(docs, "id", "text"))
    kept = keyword.kept(spark.read.parquet(path), "id", "text", str(tmp_path / "index"))
    assert found(kept) == built and len(list((tmp_path / "index").iterdir())) == 1
    spark.createDataFrame([(4, "stone of water")], "id long, text string").write.mode("append").parquet(path)
    again = keyword.kept(spark.read.parquet(path), "id", "text", str(tmp_path / "index"))
    assert len(list((tmp_path / "index").iterdir())) == 2 and again.stats.first()["n_docs"] == 3


def test_terms_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} stone") for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} stone") for q in range(7)], "query_id long, text string")
    found = lambda: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in keyword.search(keyword.build(docs, "id", "text"), asked).collect())
    one = found()
    monkeypatch.setattr(keyword, "BROADCAST_TERMS", 2)
    assert found() == one


@pytest.mark.parametrize("rows", [3, 100_000])
def test_renumber_with_skew_and_ties(spark, rows):
    values = [5] * 50 + [1, 2, 10**12, 7, 7]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "seq long, i long").repartition(4)
    out = sorted((r["seq"], r["i"]) for r in ingest.renumber(df, "seq", ["i"], rows=rows).collect())
    assert out == [(n, i) for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))]
    assert ingest.renumber(df.limit(0), "seq").count() == 0


def test_markdown_parents(spark):
    text = "intro\n# A\nx\n### C\ny\n## B\nz\n### D\n# E\n## F\n"
    out = chunk.markdown(spark.createDataFrame([(1, text)], "k long, text string"), "k", "text").orderBy("start_line").collect()
    assert [(r["name"], r["parent"]) for r in out] == [(None, None), ("A", None), ("C", None), ("B", "A"), ("D", "B"), ("E", None), ("F", "E")]


def test_fixed_chunks_keep_the_tail(spark):
    text = "x" * 33_047
    out = chunk.fixed(spark.createDataFrame([("p", text)], "path string, text string"), "path", "text").orderBy("chunk").collect()
    assert len(out) == 23 and "".join(r["content"] for r in out) == text
    assert chunk.fixed(spark.createDataFrame([("p", text)], "path string, text string"), "path", "text", most=20).count() == 20


def test_rounds(spark):
    e = spark.createDataFrame([(1, 0, 3, "b", "z"), (1, 0, 1, "a", "x"), (1, 0, 2, "B", "y"), (1, 1, 4, "c", "w")], "topic int, round int, seq int, agent string, text string")
    assert sorted((r["round"], r["n"], r["participants"]) for r in activity.rounds(e, "topic", "round", "agent").collect()) == [(0, 3, ["A", "B"]), (1, 1, ["C"])]
    assert [(r["place"], r["agent"], r["content"]) for r in activity.round_entries(e, "topic", "round", "agent", "text").orderBy("round", "place").collect()] == [(1, "A", "x"), (2, "B", "y"), (3, "B", "z"), (1, "C", "w")]


def test_index_and_delete_files(spark):
    empty = store.State(
        spark.createDataFrame([], "path string, hash string, version int, size long, deleted boolean"),
        spark.createDataFrame([], "path string, chunk_index int, hash string, size long"),
        spark.createDataFrame([], "id long, path string, hash string, deleted boolean"),
        spark.createDataFrame([], "operation string, doc_id string, payload string, checksum string, applied boolean"),
    )
    files = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    keep = lambda s: store.State(*[spark.createDataFrame(x.collect(), x.schema) for x in s])
    one = keep(store.index_files(empty, files(("a", "x" * 4000), ("b", "short"))))
    assert sorted((r["path"], r["version"]) for r in one.store.collect()) == [("a", 1), ("b", 1)] and one.index.count() == 4
    same = store.index_files(one, files(("b", "short")))
    assert same.index.count() == 4 and same.log.count() == 2
    two = keep(store.index_files(one, files(("a", "new"))))
    assert sorted((r["path"], r["version"], r["deleted"]) for r in two.store.collect()) == [("a", 2, False), ("b", 1, False)]
    assert sorted(r["id"] for r in two.index.filter("not deleted").collect()) != [] and two.index.filter("deleted and path = 'a'").count() == 3
    three = keep(store.delete_files(two, files(("a", ""), ("unknown", ""))))
    assert [r["path"] for r in store.live(three.store).collect()] == ["b"] and [r["path"] for r in three.index.filter("not deleted").collect()] == ["b"]
    kept, chunks = store.purge(three.store, three.chunks)
    assert {r["path"] for r in chunks.collect()} == {"b"} and kept.count() == 1
    back = keep(store.index_files(three, files(("a", "new"))))
    assert {(r["path"], r["version"]) for r in store.live(back.store).collect()} == {("a", 3), ("b", 1)}


def test_bloom_has_no_false_negative(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(200)], "k string")
    out = store.Bloom(keys.filter("k like '%7%'"), F.col("k")).probe(keys, F.col("k")).collect()
    assert all(r["maybe"] for r in out if "7" in r["k"]) and sum(not r["maybe"] for r in out) > 100


def test_recover(spark):
    log = spark.createDataFrame([], "id long, operation string, doc_id long, payload string, checksum string, applied boolean")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, payload string")
    state, how = store.recover((docs, 0), log, docs, slack=0)
    assert how == "snapshot" and state.count() == 2
    assert store.recover((docs.limit(1), 0), log, docs, slack=0)[1] == "rebuilt" and store.recover(None, log, None)[1] == "empty"


def test_answer_without_local_hits_is_remote(spark):
    local = spark.createDataFrame([], "query_id long, path string, score double, rank int, text string")
    cloud = spark.createDataFrame([(1, "c", 0.8, 1)], "query_id long, path string, score double, pos int")
    assert [tuple(r) for r in fusion.answer(local, cloud, 3, F.length("text")).collect()] == [(1, "c", 0.8, "cloud", 1)]


def test_arrivals_are_indexed(spark, tmp_path):
    """Files that appear are handed to a batch, each once."""
    from tessera.streaming import changes

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "b.bin").write_text("no")
    seen = []
    stream = changes.arrivals(spark, str(tmp_path / "in"), "*.txt").writeStream.option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(lambda frame, _: seen.extend((r["path"].rsplit("/", 1)[-1], r["text"]) for r in frame.collect())).start()
    try:
        stream.processAllAvailable()
        assert seen == [("a.txt", "one")]
        (tmp_path / "in" / "c.txt").write_text("three")
        stream.processAllAvailable()
        assert seen[1:] == [("c.txt", "three")]
    finally:
        stream.stop()


def test_polled_changes(spark):
    from tessera.streaming import changes

    scan = lambda *rows: spark.createDataFrame(rows, "path string, mtime long, size long")
    found = changes.polled(scan(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), scan(("a", 1, 1), ("b", 2, 1), ("d", 1, 1)))
    assert sorted(map(tuple, found.collect())) == [("b", "modified"), ("c", "deleted"), ("d", "created")]
    assert [tuple(r) for r in changes.polled(None, scan(("a", 1, 1))).collect()] == [("a", "created")]


TS = """import { a } from "./lib/x";
import y from 'y';
// class Not { }
export class Foo<T> extends ns.Base<T> implements One, Two {
  constructor(x: number) { super(); this.run(x); }
  async run(x: number): Promise<void> {
    if (x > 1) { helper(x); }
    const s = "fake(";
  }
}
interface Shape { area(): number; }
export const go = async (z: string) => { foo.bar(z); }
function helper(q: {a: number}) { return made(q); }
go("x");
"""


def test_typescript_graph(spark):
    df = spark.createDataFrame([("d/m.ts", TS), ("d/n.py", "def f():\n    g()\n"), ("x.tsx", None)], "path string, text string")
    out = chunk.code_graph(df, "path", "text").collect()
    nodes = {(r["type"], r["name"], r["line"]) for r in out if r["kind"] == "node" and r["path"] == "d/m.ts"}
    assert nodes == {("file", "m.ts", 1), ("class", "Foo", 4), ("method", "constructor", 5), ("method", "run", 6), ("interface", "Shape", 11), ("function", "go", 12), ("function", "helper", 13)}
    edges = {(r["type"], r["from"].split("::")[-1], r["to"]) for r in out if r["kind"] == "edge" and r["path"] == "d/m.ts" and r["type"] != "CONTAINS"}
    assert edges == {("IMPORTS", "d/m.ts", "./lib/x"), ("IMPORTS", "d/m.ts", "y"), ("EXTENDS", "Foo", "Base"), ("IMPLEMENTS", "Foo", "One"), ("IMPLEMENTS", "Foo", "Two"), ("CALLS", "constructor", "run"), ("CALLS", "run", "helper"), ("CALLS", "go", "bar"), ("CALLS", "helper", "made"), ("CALLS", "d/m.ts", "go")}
    assert {r["name"] for r in out if r["path"] == "d/n.py" and r["kind"] == "node"} == {"n.py", "f"}


def _embeddings(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/embeddings.parquet").sort_by("vec_id")
    return t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)


def test_reason_vector_against_numpy(spark, sf):
    from tessera import plans

    ids, x = _embeddings(sf)
    now = x[0].copy()
    size, before, want = np.linalg.norm(now), np.zeros(len(now)), []
    for i in range(5):
        d = ((x - now) ** 2).sum(1)
        near = np.lexsort((ids, d.round(9)))[:5]
        w = 1 / (1 + d[near])
        centre = (w[:, None] * x[near]).sum(0) / w.sum()
        before = 0.7 * (centre - now) + 0.3 * before
        after = now + 0.4 * before
        after = after / np.linalg.norm(after) * size
        moved, now = np.linalg.norm(after - now), after
        want.append((i + 1, moved, now @ centre / (np.linalg.norm(now) * np.linalg.norm(centre)), moved < 0.02))
        if moved < 0.02:
            break
    out = sorted(map(tuple, plans.queries()["reason_vector"](spark, sf).collect()))
    assert len(out) == len(want) and all(a[0] == b[0] and np.allclose(a[1:3], b[1:3], atol=1e-9) and a[3] == b[3] for a, b in zip(out, want))


def test_pca_against_numpy(spark, sf):
    from tessera import plans

    ids, x = _embeddings(sf)
    c = x - x.mean(0)
    p = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    want = (p - p.min(0)) / (np.ptp(p, axis=0) + 1e-8)
    out = plans.queries()["grid_pca"](spark, sf).toPandas().sort_values("vec_id")[["x", "y"]].to_numpy()
    for k in (0, 1):  # a component's sign is free
        assert np.allclose(out[:, k], want[:, k], atol=1e-5) or np.allclose(out[:, k], 1 - want[:, k], atol=1e-5)


def test_lsh_finds_most_neighbours(spark, sf):
    from tessera import plans

    assert plans.queries()["knn_lsh_recall"](spark, sf).first()["recall"] >= 0.5
