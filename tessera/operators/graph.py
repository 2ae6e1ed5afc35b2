"""Graphs as vertex and edge tables: neighbours, chains, traversal, supports, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def find(nodes: DataFrame, name: str) -> DataFrame:
    """By exact name, or by a part of name or id in any case."""
    low = name.lower()
    return nodes.filter((F.col("name") == name) | F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("id"), F.lit(low)))


def out_edges(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("type") == kind)


def contained(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CONTAINS edges whose child is a known node."""
    return out_edges(edges, "CONTAINS").join(nodes.select(F.col("id").alias("to")), "to", "left_semi")


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(callee, caller): a callee is the last part of an edge's target; each known caller once for each callee."""
    calls = out_edges(edges, "CALLS").select(F.substring_index("to", "::", -1).alias("callee"), F.col("from").alias("caller")).distinct()
    return calls.join(nodes.select(F.col("id").alias("caller")), "caller", "left_semi").select("callee", "caller")


def impact(edges: DataFrame, name: str) -> DataFrame:
    """(id, hop): what imports a name, and what imports that; hop 2 leaves out hop 1."""
    imports = out_edges(edges, "IMPORTS").select("from", "to").distinct()
    one = imports.filter((F.substring_index("to", "/", -1) == name) | F.contains("to", F.lit(name))).select(F.col("from").alias("id")).distinct()
    two = imports.join(one, F.col("to") == F.col("id")).select(F.col("from").alias("id")).distinct().join(one, "id", "left_anti")
    return one.withColumn("hop", F.lit(1)).union(two.withColumn("hop", F.lit(2)))


def hotspots(edges: DataFrame, k: int = 20) -> DataFrame:
    """(callee, n, rank) of the most called, ties by name."""
    n = out_edges(edges, "CALLS").groupBy(F.col("to").alias("callee")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col("callee")]
    return n.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def complexity(nodes: DataFrame, edges: DataFrame, kinds: list[str], k: int = 20) -> DataFrame:
    """(id, n, rank) of the nodes with most calls of their own."""
    n = out_edges(edges, "CALLS").groupBy(F.col("from").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n = n.join(nodes.filter(F.col("type").isin(kinds)).select("id"), "id", "left_semi")
    order = [F.desc("n"), F.col("id")]
    return n.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def paths(starts: DataFrame, edges: DataFrame, depth: int, stop: Column | None = None) -> DataFrame:
    """(path, end, n): simple paths of up to `depth` edges from the starts (id); a path that met `stop` (over `end`) grows
    no further. Each step is one join; paths are arrays of ids."""
    now = starts.select(F.array("id").alias("path"), F.col("id").alias("end"), F.lit(0).alias("n"))
    steps, every = edges.select(F.col("from").alias("__f"), F.col("to").alias("__t")).distinct(), now
    for i in range(depth):
        open_ = now.filter(~F.coalesce(stop, F.lit(False))) if stop is not None else now
        now = open_.join(steps, F.col("end") == F.col("__f")).filter(~F.array_contains("path", F.col("__t"))).select(F.concat("path", F.array("__t")).alias("path"), F.col("__t").alias("end"), F.lit(i + 1).alias("n"))
        every = every.unionByName(now)
    return every


def traverse(starts: DataFrame, edges: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """Paths of at least one edge that end where no edge leads on."""
    steps = edges.select(F.col("to").alias("from"), F.col("from").alias("to")) if reverse else edges.select("from", "to")
    return paths(starts, steps, depth).filter("n > 0").join(steps.select(F.col("from").alias("end")).distinct(), "end", "left_anti")


def connections(starts: DataFrame, edges: DataFrame, most_nodes: int = 4) -> DataFrame:
    """(start, end, n): the length of a shortest path to each other node within the given number of nodes.

    Levels grow by one join each; nodes met before, from the same start, leave.
    """
    steps = edges.select(F.col("from").alias("__f"), F.col("to").alias("__t")).distinct()
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("n"))
    level = seen
    for i in range(most_nodes - 1):
        level = level.join(steps, F.col("end") == F.col("__f")).select("start", F.col("__t").alias("end")).distinct().join(seen.select("start", "end"), ["start", "end"], "left_anti").withColumn("n", F.lit(i + 1))
        seen = seen.unionByName(level)
    return seen.filter("n > 0")


def cross(nodes: DataFrame, related: DataFrame, least: float = 0.5) -> DataFrame:
    """(source, relationship, target, strength) between known nodes; a missing strength is 1."""
    strong = related.withColumn("strength", F.coalesce("strength", F.lit(1.0))).filter(F.col("strength") >= least)
    known = nodes.select("id")
    return strong.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "relationship", "target", "strength")


def support(related: DataFrame) -> DataFrame:
    """(hypothesis, evidence, code, confidence): supported by evidence that cites code; strengths multiply."""
    first = related.filter(F.col("relationship").isin("supported_by", "evidenced_by")).select(F.col("source").alias("hypothesis"), F.col("target").alias("evidence"), F.col("strength").alias("a"))
    second = related.filter("relationship = 'cites'").select(F.col("source").alias("evidence"), F.col("target").alias("code"), F.col("strength").alias("b"))
    return first.join(second, "evidence").select("hypothesis", "evidence", "code", (F.col("a") * F.col("b")).alias("confidence"))


def boost(complexity_: Column, called_by: Column, blocked: Column, open_: Column, root: Column, confidence: Column) -> Column:
    """The product of the boosts that apply."""
    pick = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(1.0)
    return pick(complexity_ > 5, 1.5) * pick(called_by > 5, 1.8) * pick(blocked, 3.0) * pick(open_, 2.5) * pick(root, 3.0) * pick((confidence > 0.3) & (confidence < 0.7), 1.8)


def node_id(name: Column) -> Column:
    """A stable 64-bit number without sign, from the first 16 hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def validation(nodes: DataFrame, related: DataFrame) -> DataFrame:
    """One row: nodes, relations, those between known nodes, and nodes without any."""
    known = nodes.select("id").distinct()
    inner = related.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    used = inner.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    counts = [known.agg(F.count(F.lit(1)).alias("nodes")), related.agg(F.count(F.lit(1)).alias("relations")), inner.agg(F.count(F.lit(1)).alias("inner")), known.join(used, "id", "left_anti").agg(F.count(F.lit(1)).alias("alone"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(F.broadcast(c))
    return out


def embed_text(nodes: DataFrame, edges: DataFrame, most_calls: int = 10, code: int = 500) -> DataFrame:
    """(id, embed_text): type and name, the beginning of the code, and the first calls by name."""
    calls = edges.filter("type = 'CALLS'").groupBy(F.col("from").alias("id")).agg(F.slice(F.array_sort(F.collect_set("to")), 1, most_calls).alias("calls"))
    line = F.when(F.size("calls") > 0, F.concat(F.lit("Calls: "), F.array_join("calls", ", ")))
    return nodes.join(calls, "id", "left").select("id", F.concat_ws("\n", F.concat_ws(" ", "type", "name"), F.substring("code", 1, code), line).alias("embed_text"))


def query(nodes: DataFrame, equal: dict[str, object], where: Column | None = None, k: int | None = None, order: list[str] = ()) -> DataFrame:
    """Nodes whose fields have the given values and that `where` keeps; the first k in the given order."""
    for name, value in equal.items():
        nodes = nodes.filter(F.col(name) == F.lit(value))
    nodes = nodes.filter(where) if where is not None else nodes
    return nodes.orderBy(*order).limit(k) if k else nodes


def upsert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes replace those with their id, others are added."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new)


def investigation_impact(hypotheses: DataFrame) -> DataFrame:
    """(thread, hypotheses, files): for each thread, its hypotheses (thread, hypothesis, files) that affect files."""
    return hypotheses.filter("files > 0").groupBy("thread").agg(F.count(F.lit(1)).alias("hypotheses"), F.sum("files").alias("files"))


#: The perspectives that a request may name.
PERSPECTIVES = ("technical", "investigation", "narrative")


def by_perspective(nodes: DataFrame, perspective: str, k: int, most: int = 100) -> DataFrame:
    """Ids of the first k nodes (100 at most) with a perspective."""
    if perspective not in PERSPECTIVES:
        raise ValueError(f"unknown perspective: {perspective}")
    return nodes.filter(F.col("perspectives")[perspective].isNotNull()).select("id").orderBy("id").limit(min(k, most))


def cross_count(related: DataFrame, source: str, target: str) -> DataFrame:
    """(relationship, n) between nodes whose ids start as given."""
    return related.filter(F.col("source").startswith(source) & F.col("target").startswith(target)).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


def neighbour_arrays(edges: DataFrame, most: int = 50) -> DataFrame:
    """(id, calls, called_by): the first `most` distinct neighbours each way, by name; no more than these are gathered."""

    def first(key: str, other: str, name: str) -> DataFrame:
        each = edges.select(F.col(key).alias("id"), F.col(other).alias("x")).distinct()
        kept = each.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("x"))).filter(F.col("n") <= most)
        return kept.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias(name))

    out = first("from", "to", "calls").join(first("to", "from", "called_by"), "id", "full")
    none = F.array().cast("array<string>")
    return out.select("id", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"))
