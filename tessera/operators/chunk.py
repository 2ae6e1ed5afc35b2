"""Cutting texts into chunks: by length, by Markdown sections, by definitions, by lines."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "chunk_type string, name string, parent string, start_line int, end_line int, content string"


def fixed(docs: DataFrame, path: str, text: str, whole: int = 2000, size: int = 1500, most: int | None = None) -> DataFrame:
    """(path, chunk, content): texts longer than `whole` in slices, as path#chunkN; with `most`, the first ones alone."""
    n = F.length(text)
    slices = F.ceil(n / size).cast("int")
    count = F.when(n > whole, F.least(F.lit(most), slices) if most else slices).otherwise(1)
    each = docs.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"), n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    long_ = F.col("n") > whole
    return each.select(F.when(long_, F.concat("path", F.lit("#chunk"), F.col("chunk"))).otherwise(F.col("path")).alias("path"), "chunk", F.when(long_, F.substring(F.col("text"), F.col("chunk") * size + 1, F.lit(size))).otherwise(F.col("text")).alias("content"))


def markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_type, name, parent, start_line, end_line, content): a section for each header, and the preamble.

    The parent is the last header exactly one level up, unless a shallower one came between. Blank sections leave.
    """
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+(.+)", 1)
    lines = lines.withColumn("level", F.length(mark)).withColumn("name", F.when(F.col("level") > 0, F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)", 2))))
    before = W.partitionBy("key").orderBy("i")
    lines = lines.withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(before))
    parts = lines.groupBy("key", "part").agg(F.max("level").alias("level"), F.max("name").alias("name"), (F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("lines"))
    parts = parts.withColumn("content", F.trim(F.concat_ws("\n", F.transform("lines", lambda x: x["line"]))))
    # the last header of each level before, so no section carries all headers of its document
    earlier = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    heads = [F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.struct("part", "level", "name")), ignorenulls=True).over(earlier)) for n in range(1, 6)]
    parts = parts.withColumn("nearest", F.greatest(*heads))
    return parts.filter(F.regexp_replace("content", r"\s", "") != "").select(
        "key", F.lit("section").alias("chunk_type"), "name", F.when(F.col("nearest.level") == F.col("level") - 1, F.col("nearest.name")).alias("parent"), "start_line", "end_line", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content")
    )


def _rows(kind, name, parent, start, lines) -> tuple:
    return kind, name, parent, start + 1, start + len(lines), "\n".join(lines)


def python_parts(text: str) -> Iterator[tuple]:
    """Classes, their methods, functions, and module text between them, by indentation."""
    lines = text.split("\n")
    heads = []
    owner = None
    for i, line in enumerate(lines):
        if m := re.match(r"class\s+(\w+)", line):
            owner = m[1]
            heads.append((i, "class", m[1], None))
        elif m := re.match(r"(?:async\s+)?def\s+(\w+)", line):
            owner = None
            heads.append((i, "function", m[1], None))
        elif (m := re.match(r"    (?:async\s+)?def\s+(\w+)", line)) and owner:
            heads.append((i, "method", m[1], owner))
    bounds = [0 if not heads or heads[0][0] else None, *[h[0] for h in heads], len(lines)]
    if bounds[0] == 0:
        own = lines[: bounds[1]]
        if "".join(own).strip():
            yield _rows("module", None, None, 0, own)
    for (start, kind, name, parent), stop in zip(heads, bounds[2:]):
        yield _rows(kind, name, parent, start, lines[start:stop])


def powershell_parts(text: str) -> Iterator[tuple]:
    """Functions, closed where their braces balance."""
    lines, i = text.split("\n"), 0
    while i < len(lines):
        m = re.match(r"\s*function\s+([\w-]+)", lines[i], re.I)
        if not m:
            i += 1
            continue
        start, depth, opened = i, 0, False
        while i < len(lines):
            depth += lines[i].count("{") - lines[i].count("}")
            opened |= "{" in lines[i]
            i += 1
            if opened and depth <= 0:
                break
        yield _rows("function", m[1], None, start, lines[start:i])


def generic_parts(text: str, size: int = 1000, overlap: int = 2) -> Iterator[tuple]:
    """Runs of lines of at least `size` signs that share their last lines with the next run."""
    if len(text) <= size:
        if text.strip():
            yield _rows("document", None, None, 0, text.split("\n"))
        return
    lines, start, own, n, fresh = text.split("\n"), 0, [], 0, 0
    for i, line in enumerate(lines):
        own.append(line)
        n += len(line) + 1
        fresh += 1
        if n >= size:
            yield _rows("chunk", None, None, start, own)
            own = own[-overlap:]
            start, n, fresh = i + 1 - len(own), sum(map(len, own)), 0
    if fresh and "".join(own).strip():
        yield _rows("chunk", None, None, start, own)


PARTS = {".py": python_parts, ".ps1": powershell_parts}


def by_extension(docs: DataFrame, path: str, text: str, parts: dict | None = None) -> DataFrame:
    """(path, chunk_type, name, parent, start_line, end_line, content) by the chunker of the path's extension.

    `parts` adds or replaces chunkers: functions from a text to rows.
    """
    known = PARTS | (parts or {})

    def run(frames):
        for frame in frames:
            rows = [(p, *row) for p, t in zip(frame["path"], frame["text"]) if t is not None for row in known.get("." + p.rsplit(".", 1)[-1].lower() if p and "." in p else "", generic_parts)(t)]
            yield pd.DataFrame(rows, columns=["path", "chunk_type", "name", "parent", "start_line", "end_line", "content"])

    return docs.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, f"path string, {SCHEMA}")


_QUOTED = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_FROM = re.compile(r"""^[ \t]*(?:import|export)\b[^;'"]*?(?:\bfrom\s*)?['"]([^'"\n]+)['"]""", re.M)
_TS = re.compile(
    r"""\b(?P<kind>class|interface)\s+(?P<type>\w+)(?P<bases>[^{};]*)\{
    |\bfunction\s*\*?\s*(?P<function>\w+)\s*(?=[(<])
    |\b(?:const|let|var)\s+(?P<arrow>\w+)\s*(?::[^=;{}]+)?=\s*(?:async\s+)?(?:\([^()]*\)|\w+)\s*(?::[^=;{}]+)?=>
    |^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<method>\w+)\s*(?:<[^<>;{}]*>)?\((?P<given>[^;{}]*)\)\s*(?::[^;{}=]+)?\{
    |(?P<call>\w+)\s*\(
    |(?P<brace>[{}])""",
    re.M | re.X,
)
_ROUND = re.compile(r"[()]")
_NO_CALL = frozenset("if for while switch catch return function typeof await new super constructor import do else with".split())


def typescript_rows(p: str, source: str) -> Iterator[tuple]:
    """Nodes and edges of TypeScript or JavaScript: a subset by patterns, with comments and strings blanked out.

    Classes, interfaces, functions, named arrow functions, methods; CONTAINS, EXTENDS, IMPLEMENTS, IMPORTS, CALLS.
    """
    ends = [m.start() for m in re.finditer("\n", source)]
    line_at = lambda at: bisect_left(ends, at) + 1
    yield "node", p, "file", p.rsplit("/", 1)[-1], p, 1, None, None
    for m in _FROM.finditer(source):
        yield "edge", None, "IMPORTS", None, p, line_at(m.start()), p, m[1]
    code = _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    owners, depth, pending = [(p, "file", 0)], 0, None  # id, kind, depth inside its braces

    def node(name: str, kind: str, at: int) -> Iterator[tuple]:
        own = f"{owners[-1][0]}::{name}"
        yield "node", own, kind, name, p, line_at(at), None, None
        yield "edge", None, "CONTAINS", None, p, line_at(at), owners[-1][0], own

    at = 0
    while m := _TS.search(code, at):
        at, start = m.end(), m.start(m.lastgroup)
        if m["kind"]:
            own = f"{owners[-1][0]}::{m['type']}"
            yield from node(m["type"], m["kind"], start)
            for word, kind in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
                part = re.split(rf"\b{word}\b", m["bases"])
                for base in re.sub(r"<[^<>]*>", "", re.split(r"\b(?:extends|implements)\b", part[1])[0]).split(",") if len(part) > 1 else ():
                    yield "edge", None, kind, None, p, line_at(start), own, base.strip().rsplit(".", 1)[-1]
            depth += 1
            owners.append((own, m["kind"], depth))
        elif m["function"] or m["arrow"]:
            name = m["function"] or m["arrow"]
            yield from node(name, "function", start)
            opens = re.compile(r"\s*\{").match(code, at) if m["arrow"] else True
            pending = (f"{owners[-1][0]}::{name}", "function") if opens else None
            if m["function"]:  # its parameters come before its braces
                inside = 0
                for x in _ROUND.finditer(code, at):
                    inside += 1 if x[0] == "(" else -1
                    if inside <= 0:
                        at = x.end()
                        break
        elif m["method"] and owners[-1][1] == "class" and depth == owners[-1][2] and m["method"] not in _NO_CALL - {"constructor"}:
            yield from node(m["method"], "method", start)
            depth += 1
            owners.append((f"{owners[-1][0]}::{m['method']}", "method", depth))
        elif m["method"] or m["call"]:
            name, at = m["method"] or m["call"], m.end("method") if m["method"] else at
            if name not in _NO_CALL and owners[-1][1] != "interface":
                yield "edge", None, "CALLS", None, p, line_at(m.start("method") if m["method"] else start), owners[-1][0], name
        elif m["brace"] == "{":
            depth += 1
            if pending:
                owners.append((*pending, depth))
                pending = None
        else:
            if len(owners) > 1 and owners[-1][2] == depth:
                owners.pop()
            depth = max(0, depth - 1)


def code_graph(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(kind, id, type, name, path, line, from, to): nodes and edges of Python texts, and of TypeScript and JavaScript by
    extension (ts, tsx, js, jsx)."""
    import ast

    def walk(p: str, source: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return
        yield "node", p, "file", p.rsplit("/", 1)[-1], p, 1, None, None

        def visit(node, owner: str) -> Iterator[tuple]:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    inside = owner != p
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside and owner in classes else "function"
                    own = f"{owner}::{child.name}"
                    if kind == "class":
                        classes.add(own)
                        for base in child.bases:
                            yield "edge", None, "EXTENDS", None, p, child.lineno, own, ast.unparse(base).rsplit(".", 1)[-1]
                    yield "node", own, kind, child.name, p, child.lineno, None, None
                    yield "edge", None, "CONTAINS", None, p, child.lineno, owner, own
                    yield from visit(child, own)
                    continue
                if isinstance(child, ast.Import):
                    for name in child.names:
                        yield "edge", None, "IMPORTS", None, p, child.lineno, p, name.name
                elif isinstance(child, ast.ImportFrom) and child.module:
                    yield "edge", None, "IMPORTS", None, p, child.lineno, p, child.module
                elif isinstance(child, ast.Call):
                    yield "edge", None, "CALLS", None, p, child.lineno, owner, ast.unparse(child.func).rsplit(".", 1)[-1]
                yield from visit(child, owner)

        classes: set[str] = set()
        yield from visit(tree, p)

    def run(frames):
        for frame in frames:
            by_path = lambda p, t: (typescript_rows if p.rsplit(".", 1)[-1].lower() in ("ts", "tsx", "js", "jsx") else walk)(p, t)
            yield pd.DataFrame([row for p, t in zip(frame["path"], frame["text"]) if t for row in by_path(p, t)], columns=["kind", "id", "type", "name", "path", "line", "from", "to"])

    return docs.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, "kind string, id string, type string, name string, path string, line int, `from` string, `to` string")


def embed_text(docs: DataFrame) -> DataFrame:
    """Adds `embed_text`: path, type, name and parent lines where given, an empty line, the content."""
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c)))
    return docs.withColumn("embed_text", F.concat_ws("\n", line("File", "path"), line("Type", "chunk_type"), line("Name", "name"), line("Parent", "parent"), F.lit(""), F.col("content")))
