"""Tokens, keywords, hashes and previews as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword search ignores.
SEARCH_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare "
    "to of in for on with at by from as into through during before after above below between under again further then once here there "
    "when where why how all each few more most other some such no nor not only own same so than too very just and but if or "
    "because until while although though this that these those i me my myself we our ours you your yours he him his she her hers "
    "it its they them their what which who whom"
).split()

# Words that are never keywords of a result list.
KEYWORD_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under again further then once here there "
    "when where why how all each few more most other some such no nor not only own same so than too very just and but if or because "
    "until while this that these those what"
).split()

TOKEN = r"[a-z0-9_\-.]+"


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def search_tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits, `_`, `-`, `.`, without stopwords, single non-digits and bare punctuation."""
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(every, lambda t: ~F.array_contains(_words(SEARCH_STOPWORDS), t) & ((F.length(t) > 1) | t.rlike("^[0-9]$")) & ~t.rlike(r"^[._-]+$"))


def keywords(text: Column) -> Column:
    """Lower-case words of four letters, digits or `_` and more that start with no digit, without stopwords.

    Words end at any sign that is neither letter, number nor `_` in any script.
    """
    every = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(every, lambda w: w.rlike("^[a-z_][a-z0-9_]{3,}$") & ~F.array_contains(_words(KEYWORD_STOPWORDS), w))


def content_hash(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def base_path(path: Column) -> Column:
    """The path without its chunk suffix."""
    return F.substring_index(path, "#chunk", 1)


# Languages by file extension.
LANGUAGES = {".py": "python", ".ps1": "powershell", ".js": "javascript", ".ts": "typescript", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".txt": "text", ".sh": "shell", ".bat": "batch", ".css": "css", ".html": "html"}


def language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = None
    for name, value in LANGUAGES.items():
        out = F.when(extension == name, value) if out is None else out.when(extension == name, value)
    return out


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def contains_text(text: Column, needle: str) -> Column:
    """Case-insensitive, with every sign of the needle taken as itself."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def bloom_bits(key: Column, bits: int = 8192) -> Column:
    """Two bit numbers, from MD5 and SHA-1: the digests as numbers modulo a power of two up to 2**32."""
    last = lambda digest: F.conv(F.right(digest, F.lit(8)), 16, 10).cast("long")
    return F.array(last(F.md5(key)) % bits, last(F.sha1(key)) % bits)
