"""Operators on single texts: BPE, TIFF, toxicity, HTML."""

import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, html_extract, tiff, toxicity

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def merges():
    return byte_bpe.merges(VOCABULARY, P.PATTERN)


@pytest.fixture(scope="module")
def library(merges):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_equals_the_library(merges, library, text):
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = merges.encode([text])
    assert ids.tolist() == library.encode_ordinary(text) and merges.decode(ids.tolist()) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "é" * 300, "xy" * 4000 + "\n" * 50, "日本語" * 90, "  \t\n x", "it's we'll I'd"])
def test_bpe_long_words(merges, library, text):
    assert merges.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_bpe_table(spark, library):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "y"), (1, "hello world", "x"), (None, "né", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.digest(df, VOCABULARY, P.PATTERN).collect()
    sha = lambda t: (len(library.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, library.encode_ordinary(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert sorted((tuple(r) for r in out), key=repr) == sorted(((i, *sha(t or "")) for i, t, _ in rows), key=repr)
    back = byte_bpe.decode(byte_bpe.encode(df, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN)
    assert sorted((bytes(r["decoded"]) for r in back.collect())) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.digest(df.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_bpe_fold_in_higher_order_functions(spark, merges):
    words = ["hello", " world", "the", " ingness", "zq", ""]
    few = {p: r for p, r in merges.ranks.items() if len(p) == 1 or any(p in w.encode() for w in words)}
    out = byte_bpe.merge_words(spark.createDataFrame([(w,) for w in words], "word string"), few, buckets=64)
    assert {r["word"]: r["ids"] for r in out.collect()} == {w: merges.encode([w])[0].tolist() for w in words}


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 256, (150, 192), dtype=np.uint8), np.zeros((1, 5), np.uint8), np.repeat(rng.integers(0, 4, (40, 20), dtype=np.uint8), 9, 1)):
        pages = list(tiff.read_pages(tiff.write([image, image.T.copy()], compression, predictor, tile=tile)))
        assert [p.pixels for p in pages] == [image.tobytes(), image.T.tobytes()] and pages[0].width == image.shape[1]


def test_tiff_reads_big_endian_and_known_bytes():
    import struct

    data = b"\x80\xfe\x01\x02\xaa\xbb\xcc"  # PackBits: no-op, 3 times 1, 3 literals
    head = b"MM\0*" + struct.pack(">I", 8 + 8)
    tags = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 8 << 16), (259, 3, 1, 32773 << 16), (273, 4, 1, 8), (279, 4, 1, 7)]
    raw = head + data + b"\0" + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0" * 4
    (page,) = tiff.read_pages(raw)
    assert page.pixels == bytes([1, 1, 1, 0xAA, 0xBB, 0xCC])



def test_tiff_pages_of_a_column(spark):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    rows = [(1, tiff.write([image, image]), "a"), (2, None, "b"), (3, b"", "c"), (4, b"II*\0\x08\0\0\0\xff\xff", "d"), (1, tiff.write([image, image]), "a")]
    out = tiff.decode_tiff(spark.createDataFrame(rows, "doc_id long, media binary, page string"), "doc_id", "media").collect()
    assert sorted((r["doc_id"], r["page"]) for r in out) == [(1, 0), (1, 0), (1, 1), (1, 1), (2, -1), (3, -1), (4, -1)]
    assert all(bytes(r["pixels"]) == image.tobytes() for r in out if r["page"] >= 0) and all(r["error"] for r in out if r["page"] < 0)


@pytest.mark.parametrize("kind, one", [("double", 1.5), ("binary", b"k"), ("array<string>", ["a"]), ("timestamp", None), ("struct<a:int>", (1,))])
def test_tiff_ids_of_any_type(spark, kind, one):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    df = spark.createDataFrame([(one, tiff.write([image, image])), (None, None)], f"id {kind}, media binary")
    out = tiff.decode_tiff(df, "id", "media")
    assert dict(out.dtypes)["id"] == dict(df.dtypes)["id"] and sorted(r["page"] for r in out.collect()) == [-1, 0, 1]
    assert tiff.decode_tiff(df.limit(0), "id", "media").count() == 0


def test_text_media_long_repeated_and_empty(spark):
    long_ = "añ 12\n" * 400_000
    df = spark.createDataFrame([(1, long_), (2, long_), (1, long_), (3, "\x00" * 5000)], "doc_id long, text string")
    out = tiff.digest(df).collect()
    payload = lambda t: t.encode() + b" " * (-len(t.encode()) % 192)
    for r in out:
        own = payload(long_ if r["doc_id"] < 3 else "\x00" * 5000)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]))
    assert len(out) == 4 and len({tuple(r)[1:] for r in out}) == 2
    assert tiff.digest(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(text=st.text(max_size=500))
def test_text_media(text):
    text = text.encode("utf-8", "ignore").decode()
    n, media = tiff.text_media(text)
    payload = b"".join(p.pixels for p in tiff.read_pages(media))
    assert n == len(text.encode()) and payload[:n] == text.encode() and not payload[n:].strip(b" ") and len(payload) % 192 == 0 and len(payload) - n < 192 + (not n)


def test_text_media_table(spark):
    df = spark.createDataFrame([(1, "x" * 192), (2, None), (3, ""), (1, "x" * 192), (4, "y" * 60000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in tiff.digest(df).collect()}
    assert out[1]["payload_bytes"] == 192 and out[2]["payload_sha256"] == out[3]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()
    assert out[4]["n_pages"] == 2 and out[1]["tail_crc32"] == zlib.crc32(b"x" * 16)


@pytest.fixture(scope="module")
def model():
    clean = "the of and to in is for with on that report window garden river stone bread simple water letter number".split()
    bad = ["idiot", "moron", "pathetic", "worthless"]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        words = [clean[j] + "aeiou"[rng.integers(5)] * int(rng.integers(2)) for j in rng.integers(0, len(clean), 40)]
        if i % 3 == 0:
            for w in rng.choice(bad, 3):
                words.insert(int(rng.integers(len(words))), str(w))
        rows.append((" ".join(words), int(i % 3 == 0)))
    return toxicity.fit(rows)


@pytest.mark.parametrize("text", ["you 1d10t and m0r0n", "such an i.d.i.o.t you are p4th3t1c", "an idiooooot and w o r t h l e s s", "ID!OT MOR0N", "іdіоt mоrоn"])
def test_toxicity_restores(model, text):
    assert model.score("the garden of stone " + text) >= 0.7


def test_toxicity_clean(model):
    for text in ("the garden 10 of 300 stones, e.g. 3.5 at 7:00", None, "", "!!!", "1d 0 9 a b c", "x" * 100_000):
        assert model.score(text) < 0.5
    assert "idiot" in model.restore("an 1d10t here")


def test_toxicity_table(spark, model):
    df = spark.createDataFrame([(1, "idiot moron fool", "s"), (2, None, "s"), (1, "idiot moron fool", "s"), (3, "a river", "s")], "doc_id long, text string, score string")
    assert sorted((r["doc_id"], r["score"] >= 0.7) for r in toxicity.score(df, model).collect()) == [(1, True), (1, True), (2, False), (3, False)]
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_decodes_whole_tokens(model):
    """No prefix, and time in proportion: a word stretched over a long token, and long runs of single letters."""
    assert model.score("-".join("idiot") + " " + "." * 5000 + "m" + "o" * 5000 + "ron") >= 0.7
    start = time.perf_counter()
    assert model.score("w o r t h l e s s " * 50_000) >= 0.7
    for text in ("1d10t" * 100_000, "1d0!|" * 100_000, "i" * 1_000_000, "i d i " * 100_000):
        model.score(text)
    assert time.perf_counter() - start < 60


def _likeliest(channel, token):
    """All paths of the lattice, by recursion."""
    best = [(math.inf, "")]

    def go(at, a, b, paid, word):
        if at == len(token):
            best[0] = min(best[0], (paid + channel.cost.get(a + b + "\x03", channel.rare), word))
            return
        for letter, price in channel.options(token[at]):
            if letter:
                go(at + 1, b, letter, paid + price + channel.cost.get(a + b + letter, channel.rare), word + letter)
            if not letter or letter == b:
                go(at + 1, a, b, paid + price + (0.4 if letter else 0), word)

    go(0, "\x02", "\x02", 0.0, "")
    return best[0]


@settings(max_examples=80, deadline=None)
@given(token=st.text("1d0i!otmr|5$.", min_size=1, max_size=8))
def test_viterbi_is_exact(model, token):
    cost, word = _likeliest(model.channel, token)
    found = model.channel.restore(token)
    again = [c for c in [_cost(model.channel, token, found)] if c <= cost + 1e-9]
    assert found == word or again


def _cost(channel, token, word):
    """The least cost of a path that spells the word."""
    best = [math.inf]

    def go(at, n, paid):
        a, b = ("\x02\x02" + word[:n])[-2:]
        if at == len(token):
            best[0] = min(best[0], paid + channel.cost.get(a + b + "\x03", channel.rare)) if n == len(word) else best[0]
            return
        for letter, price in channel.options(token[at]):
            if letter and word[n : n + 1] == letter:
                go(at + 1, n + 1, paid + price + channel.cost.get(a + b + letter, channel.rare))
            if not letter or (n and letter == b):
                go(at + 1, n, paid + price + (0.4 if letter else 0))

    go(0, 0, 0.0)
    return best[0]


def test_trigrams_of_all_documents(spark):
    texts = ["Ab ab, a!", None, "", "né x1y", "жук " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            own = [0, 0, *(toxicity.ALPHABET.find(c) + 1 or 127 for c in w), 0]
            want.update((own[i] * 128 + own[i + 1]) * 128 + own[i + 2] for i in range(len(own) - 2))
    counts = toxicity.trigrams(df)
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == dict(want)
    assert toxicity.trigrams(df.limit(0)).sum() == 0


@pytest.mark.parametrize("size, recall, false_alarms", [("sf0.01", 0.7, 0.02), ("sf0.1", 0.88, 0.004)])
def test_toxicity_held_out(spark, sf, size, recall, false_alarms):
    folder = sf.replace("sf0.001", size)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.query(spark, folder)
    assert docs.count() == out.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([r["predicted"] for r in toxic]) >= recall and np.mean([r["predicted"] for r in clean]) <= false_alarms
    a, b = (np.array([r["score"] for r in own]) for own in (toxic, clean))
    auc = np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None]))  # most clean rows tie: they hold no feature
    assert auc >= 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this long site notice.</div>
<article><header><h2>Title &amp; more</h2></header><p>First   paragraph
 with <b>bold<br> text that is long enough to be found.<p>Be.<p>1 &lt; 2 &eacute;&#233;</p><aside>Aside</aside>
<div class="ad">Buy</div><form><p>Mail</p></form><ul><li>one<li>two</ul></article>
<section id="comments"><p>First! A reader's comment that goes on for a very long time and has more text than the article has, by far, really.</p></section><footer>&copy; me</footer></body></html>"""


def test_html():
    want = "Title & more\nFirst paragraph with bold text that is long enough to be found.\nBe.\n1 < 2 éé\none\ntwo"
    assert html_extract.main_text(PAGE) == want
    assert html_extract.main_text(PAGE[: PAGE.index("<p>1")]) == "\n".join(want.split("\n")[:3])


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<<<", "<<<"), ("<!-- never ends", ""), ("a &am", "a &am"), ("<script>x", "")])
def test_html_edges(page, want):
    assert html_extract.main_text(page) == want


def test_html_surge_and_dive():
    lengths = [0, 3, 0, 0, 0, 90, 80, 2, 100, 0, 0, 0, 0, 5, 0]
    assert html_extract.span(lengths) == (5, 9) and html_extract.span([]) == (0, 0)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "v", None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    out = html_extract.extract(df).collect()
    assert [r["n_chars"] for r in out] == [len(r["text"]) for r in out] and sorted(r["page_id"] for r in out) == [1, 1, 2]


BOTH = "<nav>menu</nav><article><p>" + "lead " * 7 + "</p><div class='post-content'><p>" + "rest " * 13 + "</p></div></article><p>stranger</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (BOTH, ["lead " * 7, "rest " * 13]),  # the outermost article, whatever share lies deeper
        (BOTH.replace("article", "div class=content").replace("/div class=content", "/div"), ["lead " * 7, "rest " * 13]),
        ("<main><p>" + "one " * 20 + "</p><section class=story><p>" + "two " * 12 + "</p></section></main><p>stranger</p>", ["one " * 20, "two " * 12]),
        ("<article><p>AT&am<b>p;T</b> x&amp;y &l<!-- -->t; a < b</p></article>", ["AT&amp;T x&y &lt; a < b"]),
        ("<article><p class='related work'>Related work is text here.</p><p class=ad>Buy</p><div class=related>More</div></article>", ["Related work is text here."]),
        ("<article><p>a<i><i><i><i><i>b<p>c</article>", ["ab", "c"]),
    ],
)
def test_html_content(page, want):
    assert html_extract.main_text(page) == "\n".join(x.strip() for x in want)


@pytest.mark.parametrize("page", ["<article>" + "<p>word word word</p>" * 60_000, "<main>" * 60_000 + "text", "<i>" * 60_000 + "<p>text" * 2000, "<div class=content><p>a" * 30_000, "</b>" * 100_000 + "<b>" * 50_000 + "</p>" * 50_000, "<p>a<" * 50_000, "&amp" * 100_000])
def test_html_long_and_deep_pages_take_time_in_proportion(page):
    start = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - start < 10


def test_html_long_page_is_whole():
    assert len(html_extract.main_text("<article>" + "<p>word word word</p>" * 20_000).split("\n")) == 20_000


def test_html_articles_of_the_tables(spark, sf):
    """Every article of the tables, cut out by its tags and stripped by a plain pattern."""
    rows = html_extract.query(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert rows
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        words = html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()
        assert r["text"].split() == words and r["n_chars"] == len(r["text"])
    empty = spark.read.parquet(f"{sf}/pages.parquet").limit(0)
    assert html_extract.extract(empty).count() == 0


def test_functions_module_is_used(spark):
    assert spark.range(1).select(toxicity.held_out(F.lit(5).cast("long"))).first()[0] == (zlib.crc32(b"5") % 3 == 1)
