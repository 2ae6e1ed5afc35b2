"""Operator 9: line dedup by winnowing over line hashes, in DataFrame operations alone.

Lines are compared without surrounding white space; blank lines are never compared. A gram is the shortest run of
lines from a given one on that holds `min_words` words. Its hash is a fingerprint if the gram is a single line, or if
it is the least of `window` successive grams (the last, if tied). So any repeated run with a line of `min_words` words,
or with `window` grams, has a fingerprint in every place. Around a fingerprint that repeats, every extension is hashed,
both ways, as far as further lines can lie before the next fingerprint: `window` - 1 lines back, and to the end of the
gram that starts `window` - 1 lines ahead. Each extension joins its own first place (by id, then by text), so a run meets
the earlier run itself, wherever its fingerprints occur before. Lines so matched are deleted in the later place, hence a
copy of each deleted line stays in an earlier one.

Null texts stay null, empty ones empty. Rows with equal id and text are one document: what they repeat of each other
is kept in both, what they repeat of others goes in both. Other columns are not read. Line order is kept, and the text
of a document without deletions is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"


def _places(a: Column) -> Column:
    """0 .. size - 1, or nothing."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def _computed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, each computed once for a row: Spark would repeat an expression for each element of a lambda that
    refers to it, but not what a generator has put out."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def fingerprints(docs: DataFrame, min_words: int, window: int) -> DataFrame:
    """id, key (hash of the text), line (of the gram's first line), and g, n, back, ahead of every fingerprint."""
    lines = F.split("text", "\n")
    all_ = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, r"[\x09-\x0D]", " ")).alias("x")))
    base = _computed(docs, "id", F.xxhash64("text").alias("key"), F.filter(all_, lambda s: s["x"] != "").alias("all"))
    base = _computed(base, "id", "key", F.transform("all", lambda s: s["i"]).alias("at"), F.transform("all", lambda s: F.xxhash64(s["x"])).alias("h"), F.transform("all", lambda s: F.regexp_count(s["x"], F.lit(WORD))).alias("w"))
    none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    grow = lambda s, c: F.when(s["sum"] >= min_words, s).otherwise(F.struct((s["sum"] + c).alias("sum"), (s["n"] + 1).alias("n")))
    end = lambda s: F.when(s["sum"] >= min_words, s["n"])
    n = F.transform(_places(F.col("h")), lambda i: F.aggregate(F.slice("w", i + 1, F.lit(min_words)), none, grow, end))
    base = _computed(base, "id", "key", "at", "h", n.alias("n"))
    grams = F.filter(F.transform("n", lambda n, i: F.struct(F.xxhash64(F.slice("h", i + 1, F.coalesce(n, F.lit(0)))).alias("g"), (-i).alias("i"), n.alias("n"))), lambda s: s["n"].isNotNull())
    base = _computed(base, "id", "key", "at", "h", "n", grams.alias("grams")).filter(F.size("grams") > 0)  # grams begin at the first lines
    windows = F.sequence(F.lit(1), F.greatest(F.size("grams") - (window - 1), F.lit(1)))
    least = F.transform(windows, lambda j: F.array_min(F.slice("grams", j, F.lit(window))))
    base = _computed(base, "id", "key", "at", "h", "n", "grams", least.alias("least"))
    # successive windows share their minima; those that are single lines are chosen anyway
    minima = F.filter("least", lambda s, j: (s["n"] != 1) & ((j == 0) | (s["i"] != F.get("least", j - 1)["i"])))
    chosen = F.concat(minima, F.filter("grams", lambda s: s["n"] == 1))
    each = base.select("id", "key", "at", "h", "n", F.size("grams").alias("m"), F.explode(chosen).alias("s"))
    i, n = -F.col("s.i"), F.col("s.n")
    start = F.greatest(i - (window - 1), F.lit(0))
    back = F.reverse(F.slice("h", start + 1, i - start))
    last = F.least(i + (window - 1), F.col("m") - 1)
    reach = last + F.get("n", last)  # exclusive end of the last gram within reach
    ahead = F.slice("h", i + n + 1, F.greatest(reach - i - n, F.lit(0)))
    return each.select("id", "key", i.alias("p"), n.alias("n"), F.col("s.g").alias("g"), back.alias("back"), ahead.alias("ahead"), "at")


def repeats(scratch: Scratch, docs: DataFrame, min_words: int, window: int) -> DataFrame:
    """(id, key, n_gone, flags): how many lines to delete, and for each line up to the last of them whether it goes."""
    prints = fingerprints(docs, min_words, window)  # those of equal rows share their place, so none deletes another
    lines = F.slice("at", F.greatest(F.col("p") - (window - 1), F.lit(0)) + 1, F.col("n") + F.size("back") + F.size("ahead"))
    prints = scratch.write(prints.select("id", "key", "p", "n", "g", "back", "ahead", lines.alias("lines")))
    place = F.struct("id", "key", "p")
    again = scratch.write(prints.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g"))
    before, n = F.size("back"), F.col("n")
    # side and length of each extension, and the lines that it has more than the one shorter by a line
    itself = F.array(F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("h"), F.slice("lines", before + 1, n).alias("own")))
    back = F.transform(_places(F.col("back")), lambda i: F.struct((-i - 1).alias("to"), F.xxhash64(F.slice("back", 1, i + 1)).alias("h"), F.slice("lines", before - i, F.lit(1)).alias("own")))
    ahead = F.transform(_places(F.col("ahead")), lambda i: F.struct((i + 1).alias("to"), F.xxhash64(F.slice("ahead", 1, i + 1)).alias("h"), F.slice("lines", before + n + i + 1, F.lit(1)).alias("own")))
    runs = prints.join(again, "g").select("id", "key", "p", "g", F.inline(F.concat(itself, back, ahead)))
    runs = scratch.write(runs)
    scratch.drop(prints)
    # tables, these two, so that Spark can split a frequent gram's or extension's side of the joins
    first = scratch.write(runs.groupBy("g", "to", "h").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("a")).filter("m > 1").drop("m"))
    later = runs.join(first, ["g", "to", "h"]).filter(~(F.col("id").eqNullSafe(F.col("a.id")) & (F.col("key") == F.col("a.key")) & (F.col("p") == F.col("a.p"))))
    gone = later.select("id", "key", F.explode("own").alias("line")).groupBy("id", "key").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    # built from the gaps between deleted lines, since a search for each line would take lines times deletions
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), "gone", lambda p, c: F.when(c.isNotNull(), F.concat(F.array_repeat(F.lit(False), c - p - 1), F.array(F.lit(True)))).otherwise(F.array().cast("array<boolean>")))
    return gone.select("id", "key", F.size("gone").alias("n_gone"), F.flatten(gaps).alias("flags"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, window: int = 4, counts: bool = True) -> DataFrame:
    """All columns of the documents, with repeated lines deleted from the text.

    With `counts`, n_lines and n_removed are added; columns of the documents with these names are replaced.
    """
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    given = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    found = repeats(Scratch(docs.sparkSession, "lines"), given.select(id_.alias("id"), text.alias("text")), min_words, window)
    found = found.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("n_gone").alias("__n"), F.col("flags").alias("__flags"))
    both = given.join(found, id_.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.get("__flags", i), F.lit(False)))
    left = F.when(F.col("__n").isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [(left if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]
    if counts:
        count = F.when(text.isNull(), 0).otherwise(F.size(lines))
        out += [count.cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_removed")]
    return both.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
