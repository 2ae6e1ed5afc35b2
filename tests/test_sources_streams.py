"""Readers, writers and streams against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import activity
from tessera.sources import tables
from tessera.streaming import changes


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    for name, text in (("a.md", "x" * 60), ("sub/b.PY", "y" * 60), ("sub/c.md", "short"), (".git/d.md", "z" * 60), ("e.bin", "w" * 60)):
        (tmp_path / name).write_text(text)
    out = tables.scan(spark, f"file://{tmp_path}", [".md", ".py"]).select("path", "size").collect()
    assert sorted(tuple(r) for r in out) == [("a.md", 60), ("sub/b.PY", 60)]


def test_table(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/t", ["k"])
    assert t.read() is None
    kind = "k int, v string"
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], kind))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], kind))
    t.delete(spark.createDataFrame([(1, "")], kind))
    t.update(F.col("k") == 3, v=F.lit("e"))
    assert sorted(tuple(r) for r in t.read().collect()) == [(2, "c"), (3, "e")] and t.versions() == [0, 1, 2, 3]


def test_log_and_graph_files(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3), "a", "hi")], "timestamp timestamp, agent string, text string")
    tables.append_log(rows, f"file://{tmp_path}/log")
    tables.append_log(rows, f"file://{tmp_path}/log")
    assert tables.read_log(spark, f"file://{tmp_path}/log", "timestamp timestamp, text string, agent string, date date").count() == 2
    nodes, edges = spark.createDataFrame([("n",)], "id string"), spark.createDataFrame([("n", "m")], "`from` string, `to` string")
    tables.write_graph(nodes, edges, f"file://{tmp_path}/g")
    assert [x.count() for x in tables.read_graph(spark, f"file://{tmp_path}/g")] == [1, 1]


def test_payload(spark):
    p = spark.createDataFrame([("s", "c", [(None, "text", {"k": "v"}), ("id1", "more", None)])], "source string, category string, documents array<struct<id:string,content:string,metadata:map<string,string>>>")
    out = tables.ingest(p).collect()
    assert len(out) == 2 and out[1]["id"] == "id1" and out[0]["id"].startswith("s_")


def _stream(spark, tmp_path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.json(f"{tmp_path}/in")
    return spark.readStream.schema(kind).json(f"{tmp_path}/in")


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_debounce_stream_equals_batch(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    rows = [("a", "created", at(0)), ("a", "modified", at(1)), ("a", "deleted", at(10)), ("b", "created", at(1)), ("z", "created", at(500))]
    kind = "path string, op string, ts timestamp"
    out = _run(changes.debounced(_stream(spark, tmp_path, rows, kind)), "debounced").filter("path <> 'z'")
    batch = activity.sessions(spark.createDataFrame(rows, kind), "path", "ts", 2).filter("path <> 'z'")
    assert sorted(tuple(r) for r in out.select("path", "start", "n").collect()) == sorted(tuple(r) for r in batch.select("path", "start", "n").collect())
    assert {(r["path"], r["op"]) for r in out.collect()} == {("a", "modified"), ("a", "deleted"), ("b", "created")}


def test_positions_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, at(0), [0.0, 0.0]), (1, at(1), [1.0, 0.0]), (1, at(2), [1.0, 0.0])]
    out = _run(changes.positions(_stream(spark, tmp_path, rows, "agent long, ts timestamp, position array<double>"), 2), "speeds")
    assert [round(r["speed"], 6) for r in out.orderBy("ts").collect()] == [0.0, 0.3, 0.21]


def test_batches_go_to_index_and_delete(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", "created", at(0)), ("a", "deleted", at(1)), ("b", "created", at(2))]
    seen = {"index": [], "delete": []}
    take = lambda name: lambda df: seen[name].extend(r["path"] for r in df.collect())
    q = changes.on_batch(_stream(spark, tmp_path, rows, "path string, op string, ts timestamp"), take("index"), take("delete"), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert seen == {"index": ["b"], "delete": ["a"]}


def test_cache_keeps_young_rows(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    puts = spark.createDataFrame([("a", at(0), "1"), ("a", at(100), "2"), ("b", at(10), "3")], "key string, ts timestamp, value string")
    out = changes.cached(puts, F.lit(at(320)).cast("timestamp")).collect()
    assert [(r["key"], r["value"]) for r in out] == [("a", "2")]
