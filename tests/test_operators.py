"""Golden cases of single operators."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import keywords, search_tokens
from tessera.operators import activity, chunk, crdt, fusion, graph, ingest, keyword, log, registry
from tessera.sources.rules import excluded, glob


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens(spark):
    text = "particle count minimum: 120 million a - __ x 7 ADR-0050, the v1.0 café"
    out = spark.createDataFrame([(text,), (None,)], "t string").select(search_tokens(F.col("t")).alias("x")).collect()
    assert out[0]["x"] == ["particle", "count", "minimum", "120", "million", "7", "adr-0050", "v1.0", "caf"] and out[1]["x"] == []


def test_keywords_end_at_letters_of_any_script(spark):
    out = spark.createDataFrame([("words über_alles wörter _four 4word that what Tree tree",)], "t string").select(keywords(F.col("t")).alias("x")).first()
    assert out["x"] == ["words", "_four", "tree", "tree"]


def test_bm25_public_form(spark):
    docs = spark.createDataFrame([("doc1", "disk gpu particles"), ("doc2", "memory store agents"), ("doc3", "particle count thresholds"), ("doc4", "the a")], "id string, text string")
    asked = spark.createDataFrame([(0, "disk gpu disk")], "query_id long, text string")
    index = keyword.build(docs, "id", "text")
    assert index.stats.first()["n_docs"] == 3
    (hit,) = keyword.search(index, asked).collect()
    idf = 0.5108256237659907  # ln(2.5) - ln(1.5)
    assert hit["id"] == "doc1" and hit["score"] == pytest.approx(3 * idf, abs=1e-9)


def test_rank_fusion(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), (" ", 3)], "id string, rank int")
    b = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    out = {r["id"]: r["score"] for r in fusion.ranked(fusion.reciprocal_rank([(a, 0.7), (b, 0.3)]).withColumn("q", F.lit(0)), 9).collect()}
    assert out == pytest.approx({"b": 0.7 / 62 + 0.3 / 61, "a": 0.7 / 61, "c": 0.3 / 62})


def test_fallback(spark):
    data = [("one", 1, 0.3), ("two", 1, 0.8), ("two", 2, 0.7), ("three", 1, 0.8), ("three", 2, 0.7), ("three", 3, 0.6), ("edge", 1, 0.45), ("edge", 2, 0.4), ("edge", 3, 0.4), ("low", 1, 0.449), ("low", 2, 0.4), ("low", 3, 0.4)]
    out = fusion.needs_fallback(spark.createDataFrame(data, "q string, rank int, score double"), ["q"])
    assert rows(out) == [("edge", False), ("low", True), ("one", True), ("three", False), ("two", True)]


def test_merge(spark):
    kind = "path string, score double, pos int, source string"
    local = spark.createDataFrame([("a", 0.7, 0, None), ("b", 0.5, 1, None)], kind)
    cloud = spark.createDataFrame([("c", 0.8, 0, "cloud"), ("a", 0.75, 1, "cloud")], kind)
    out = fusion.merge(local.withColumn("q", F.lit(0)), cloud.withColumn("q", F.lit(0)), 5, "local", ["q"]).orderBy("rank").collect()
    assert [(r["path"], r["score"], r["source"]) for r in out] == [("c", 0.8, "cloud"), ("a", 0.7, "local"), ("b", 0.5, "local")]


def test_clocks(spark):
    pairs = [({"x": 3}, {"y": 2}), ({"x": 4}, {"x": 3, "y": 1}), ({"a": 1}, {"a": 2}), ({"a": 1}, {"a": 1}), ({"a": 2}, {"a": 1}), ({}, {})]
    df = spark.createDataFrame(pairs, "a map<string,long>, b map<string,long>")
    out = [r[0] for r in df.select(crdt.clock_compare(F.col("a"), F.col("b"))).collect()]
    assert out == ["CONCURRENT", "CONCURRENT", "A_BEFORE_B", "EQUAL", "B_BEFORE_A", "EQUAL"]
    merged = df.limit(1).select(crdt.clock_merge(F.col("a"), F.col("b")).alias("m"), crdt.clock_increment(F.col("a"), "x").alias("i")).first()
    assert merged["m"] == {"x": 3, "y": 2} and merged["i"] == {"x": 4}


def test_register_and_set(spark):
    w = spark.createDataFrame([("k", "initial", 1.0, "p"), ("k", "updated", 2.0, "q"), ("k", "stale", 1.5, "p"), ("z", "never", 0.0, "p")], "k string, v string, t double, w string")
    assert rows(crdt.lww_register(w, "k", "v", "t", "w")) == [("k", "updated", 2.0, "q")]
    adds = spark.createDataFrame([("S145", "1"), ("S97", "2")], "element string, tag string")
    dead = crdt.orset_remove(adds, spark.createDataFrame([], "tag string"), spark.createDataFrame([("S97",)], "element string"))
    again = adds.union(spark.createDataFrame([("S97", "3")], adds.schema))
    assert rows(crdt.orset_value(again, dead, [])) == [("S145",), ("S97",)]


def test_registry_folds_in_order(spark):
    e = spark.createDataFrame([("d", 1, "h", "x", {"h": 0}, False), ("d", 2, "j", "y", {"j": 1}, False), ("d", 3, "h", "y", None, True), ("d", 4, "h", "z", None, False)], "entry string, seq long, agent string, hash string, clock map<string,long>, freeze boolean")
    assert [r["result"] for r in registry.replay(e).orderBy("seq").collect()] == ["new", "conflict", "accepted", "frozen"]


def test_outcomes(spark):
    v = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("c", True), ("c", False)], "k string, ok boolean")
    assert {r["k"]: r["outcome"] for r in registry.outcome(v, "k", "ok").collect()} == {"a": "UNANIMOUS", "b": "UNANIMOUS", "c": "SPLIT"}


@pytest.mark.parametrize("n, want", [(10, (6, 10, 10)), (20, (11, 20, 20)), (100, (51, 96, 100))])
def test_percentiles(spark, n, want):
    out = activity.percentiles(spark.range(1, n + 1).select(F.lit("o").alias("o"), F.col("id").cast("double").alias("ms")), "o", "ms").first()
    assert (out["p50"], out["p95"], out["p99"]) == want


def test_fixed_chunks(spark):
    df = spark.createDataFrame([("a", "x" * 2000), ("b", "y" * 2001), ("c", "z" * 33047)], "p string, t string")
    out = chunk.fixed(df, "p", "t", most=20).select("path", F.length("content").alias("n")).collect()
    assert ("a", 2000) in out and ("b#chunk0", 1500) in out and ("b#chunk1", 501) in out and sum(r["path"][0] == "c" for r in out) == 20


def test_markdown(spark):
    text = "\n# Introduction\nHello.\n\n\n## Getting Started\nText\n\n\n### Prerequisites\nMore\n\n\n## Advanced Topics\nEnd\n"
    out = chunk.markdown(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("start_line").collect()
    assert [(r["name"], r["parent"]) for r in out] == [("Introduction", None), ("Getting Started", "Introduction"), ("Prerequisites", "Getting Started"), ("Advanced Topics", "Introduction")]
    assert out[0]["start_line"] == 2


def test_python_parts():
    text = "\nimport os\n\ndef hello():\n    return 1\n\nclass Greeter:\n    x = 1\n\n    def __init__(self):\n        pass\n\n    def greet(self):\n        def inner(): pass\n\ndef goodbye():\n    pass\n"
    assert [(k, n, p) for k, n, p, *_ in chunk.python_parts(text)] == [("module", None, None), ("function", "hello", None), ("class", "Greeter", None), ("method", "__init__", "Greeter"), ("method", "greet", "Greeter"), ("function", "goodbye", None)]


def test_powershell_and_generic_parts():
    assert [r[1] for r in chunk.powershell_parts("x\nfunction Get-It {\n if (1) { 2 }\n}\ny\nFunction Other\n{\n}")] == ["Get-It", "Other"]
    text = "\n".join(["line " + "x" * 60] * 60)
    parts = list(chunk.generic_parts(text))
    assert parts[0][3] == 1 and parts[1][3] == parts[0][4] - 1 and parts[-1][4] == 60


def test_chunks_and_code_by_extension(spark):
    df = spark.createDataFrame([("a.py", "import os\nclass A(B):\n    def f(self):\n        os.g()\n"), ("b.txt", "short"), ("c", None)], "p string, t string")
    assert {r["chunk_type"] for r in chunk.by_extension(df, "p", "t").collect()} == {"module", "class", "method", "document"}
    edges = {(r["type"], r["from"], r["to"]) for r in chunk.code_graph(df.filter("p = 'a.py'"), "p", "t").filter("kind = 'edge'").collect()}
    assert {("IMPORTS", "a.py", "os"), ("EXTENDS", "a.py::A", "B"), ("CALLS", "a.py::A::f", "g"), ("CONTAINS", "a.py::A", "a.py::A::f")} <= edges


def test_ignore_rules(spark):
    paths = ["a/node_modules/x.js", "build/out.o", "src/main.py", "docs/deep/er/x.md", "secret.key"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    out = df.filter(~excluded(F.col("p"), ["node_modules", "build/", "**/*.md", "# no", "*.key"])).collect()
    assert [r[0] for r in out] == ["src/main.py"] and glob("a?[!b]*") == "^a.[^b].*$"


def test_upsert_and_diff(spark):
    kind = "path string, hash string, version int, size long, deleted boolean"
    store = spark.createDataFrame([("a", "1", 3, 10, True), ("b", "2", 1, 20, False)], kind)
    new = spark.createDataFrame([("a", "9", 11), ("c", "3", 5)], "path string, hash string, size long")
    assert rows(ingest.upsert(store, new)) == [("a", "9", 4, 11, False), ("b", "2", 1, 20, False), ("c", "3", 1, 5, False)]
    assert rows(ingest.diff(store, new, "path", "hash")) == [("a", "MODIFIED"), ("b", "DELETED"), ("c", "NEW")]


def test_read_through(spark):
    docs = spark.createDataFrame([("h1", "one"), ("h2", "two"), ("h2", "two")], "hash string, text string")
    cache = spark.createDataFrame([("h1", "m", [1.0]), ("h2", "other", [2.0])], "hash string, model string, embedding array<double>")
    out = ingest.read_through(docs, cache, "m", lambda t: F.array(F.length(t).cast("double") * 10))
    assert rows(out.select("hash", F.get("embedding", F.lit(0)))) == [("h1", 1.0), ("h2", 30.0), ("h2", 30.0)]


def test_graph_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "`from` string, `to` string")
    starts = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.traverse(starts, edges, 5).select(F.array_join("path", ""))) == [("abcd",)]
    assert rows(graph.connections(starts, edges, 4)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/snaps"
    for i in (1, 2):
        log.write_snapshot(spark.range(i * 10).withColumn("x", F.lit("y")), root, f"s{i}", i)
    state, position = log.latest_valid(spark, root)
    assert state.count() == 20 and position == 2
    spark.range(3).withColumn("x", F.lit("z")).write.mode("append").parquet(f"{root}/s2/state")
    assert log.latest_valid(spark, root)[1] == 1
