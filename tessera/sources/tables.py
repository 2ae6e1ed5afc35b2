"""Readers and writers: files as rows, JSON lines by agent and day, tables with upserts, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from .rules import excluded

SKIPPED_FOLDERS = ("node_modules", "dist", "__pycache__", ".git")


def scan(spark: SparkSession, root: str, extensions: list[str], ignore: list[str] = (), least: int = 50, most: int | None = None) -> DataFrame:
    """(path, text, hash, mtime, size) of text files below a folder: by extension, past ignore patterns, long enough.

    Paths are relative to the root. With `most`, exactly the first so many by path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + prefix.replace(".", r"\.") + "/", "")
    ending = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    rows = files.withColumn("path", path).filter(ending.isin([e.lower() for e in extensions]))
    rows = rows.filter(~excluded(F.col("path"), [*SKIPPED_FOLDERS, *ignore]))
    rows = rows.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).filter(F.length("text") >= least)
    rows = rows.withColumn("hash", content_hash(F.col("text"), 16))
    return rows.orderBy("path").limit(most) if most else rows


def categories(files: DataFrame, registry: dict[str, list[str]], ignore: list[str] = ()) -> DataFrame:
    """(category, path): each file once in every category that one of its patterns puts it in."""
    kept = files.filter(~excluded(F.col("path"), list(ignore)))
    found = F.filter(F.array(*[F.when(excluded(F.col("path"), patterns), F.lit(name)) for name, patterns in registry.items()]), lambda c: c.isNotNull())
    return kept.select(F.explode(found).alias("category"), "path").distinct()


def ingest(payload: DataFrame) -> DataFrame:
    """Rows of payloads (source, category, documents array<struct<id, content, metadata>>), with ids where they lack one."""
    each = payload.select("source", "category", F.posexplode("documents").alias("pos", "d"))
    return each.select("source", "category", F.coalesce("d.id", F.concat_ws("_", "source", content_hash(F.col("d.content"), 16), "pos")).alias("id"), F.col("d.content").alias("text"), F.col("d.metadata").alias("metadata"))


def append_log(rows: DataFrame, root: str, most_rows: int = 100_000) -> None:
    """JSON lines in folders by agent and day, in files of bounded length."""
    rows.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("agent", "date").option("maxRecordsPerFile", most_rows).json(root)


def read_log(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(root)


class Table:
    """A table as numbered folders of Parquet; a reader takes the greatest complete one, so an upsert is all or nothing."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self._path)]
        done = lambda n: self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and done(n))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.root}/v{found[-1]}") if found else None

    def write(self, rows: DataFrame) -> None:
        found = self.versions()
        rows.write.parquet(f"{self.root}/v{found[-1] + 1 if found else 0}")

    def upsert(self, rows: DataFrame) -> None:
        """Rows with known keys replace, others are added."""
        held = self.read()
        self.write(rows if held is None else held.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows))

    def delete(self, rows: DataFrame) -> None:
        held = self.read()
        if held is not None:
            self.write(held.join(rows.select(*self.keys), self.keys, "left_anti"))

    def update(self, where: Column, **values: Column) -> None:
        held = self.read()
        if held is not None:
            self.write(held.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()}))


def session_markdown(turns: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """(session, text): front matter, and a section for each turn in order."""
    part = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text", F.lit("\n"))
    body = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("x")))), lambda t: t["x"])
    text = F.concat(F.lit("---\nsession: "), F.col(session).cast("string"), F.lit("\nturns: "), F.size("body").cast("string"), F.lit("\n---\n\n"), F.concat_ws("\n", "body"))
    return turns.groupBy(session).agg(body.alias("body")).select(session, text.alias("text"))


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    nodes.write.mode("overwrite").json(f"{root}/nodes")
    edges.write.mode("overwrite").json(f"{root}/edges")


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{root}/nodes"), spark.read.json(f"{root}/edges")
