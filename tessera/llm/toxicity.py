"""Operator 7: toxicity through noisy-channel deobfuscation.

A token that may hide a word (leetspeak, spaced or dotted letters, repetitions, look-alike letters) becomes a lattice of
the letters it may stand for; Viterbi decoding finds its likeliest word under a character trigram model, and the
restored text is scored. The trigrams are counted over all documents, in one pass whose result the alphabet bounds; the
words and word beginnings that are sought weigh as much again. Features and their weights are learned from labelled
rows: at most `max_rows` of them (a documented bound, the rows with the smallest hash of the id). A word or beginning
is a feature if at least a hundredth of the toxic rows hold it, significantly more often than others; weights come from
a ridge logistic regression on the logarithms of their counts; what counts as significant, the ridge's strength and
the final curve come from folds that the features and weights have not seen.

Decoding is exact: states dearer than the best one by all that the best one could pay more are dropped, no others.
Whole tokens are decoded, in time in proportion to their length; decoding ends early where all paths agree on what can
still matter. It is skipped for tokens whose outline (every letter replaced by the class of all letters it may be
confused with, repetitions and separators dropped) begins no outline of a feature: no path of their lattice can reach
one. A run of single signs is searched from each of its signs on, more than two equal signs counting as two.

Null and empty texts score as texts without any feature. Rows are scored one by one: repeated rows score alike, an
empty table gives an empty result, and only the id and text columns are read, whatever others there are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, pieces, table

# Usual leetspeak digits and signs, and letters of other scripts that look like Latin ones.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ѕ": "s", "ј": "j", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "τ": "t"}
# Letters that some sign may stand for alike share a class.
CLASSES = {"l": "i", "z": "s"}
SEPARATORS = ".-_*~'`^\"#/\\,;: ​‌‍﻿­"

PREFIXES = (4, 5, 6, 7, 8)
#: Tokens whose features a worker remembers; forgetting costs time only.
MEMORY = 100_000
#: Counters by hash of the features of toxic rows.
SIEVE = 1 << 21
#: Letters of a word's outline from which on it is sought within a run of single signs.
IN_RUN = 5

_SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]\S(?!\S)|[.\-_*]\S(?=[ .\-_*]|$)){2,}")
_EDGES = ".,;:!?\"'()[]{}<>«»“”‘’¿¡*#%&$@~-_…|/\\=+^`"

#: Letters that the language model tells apart: small Latin ones of the first three Unicode blocks; all others are one.
ALPHABET = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c.lower() == c)[:126]
_OTHER, _SIZE = 127, 128


@cache
def _letters() -> np.ndarray:
    """The number of each code point's letter: 0 for what is none."""
    out = np.zeros(0x110000, np.uint8)
    out[: 1 << 16] = [_OTHER if chr(c).isalpha() else 0 for c in range(1 << 16)]
    out[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
    return out


def count_trigrams(texts: list[str | None]) -> np.ndarray:
    """How often each trigram of letters occurs: _SIZE**3 counters, where 0 stands before and after a word."""
    raw = "\n\n".join(t for t in texts if t).lower().encode("utf-32-le", "surrogatepass")
    x = np.concatenate([np.zeros(2, np.uint8), _letters()[np.frombuffer(raw, np.uint32)], np.zeros(1, np.uint8)])
    a, b, c = (x[i : len(x) - 2 + i].astype(np.int32) for i in range(3))
    a[b == 0] = 0
    keys = (a * _SIZE + b) * _SIZE + c
    return np.bincount(keys[(b > 0) | (c > 0)], minlength=_SIZE**3)


def trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The counters over all documents, summed by Spark; what reaches the driver is bounded by the alphabet."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for b in pieces(batches, "t"):
            total += count_trigrams(b.column(0).to_pylist())
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(total[keys])], ["key", "n"])

    found = mapped(docs.select(F.col(text_col).alias("t")), run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_SIZE**3, np.int64)
    out[np.asarray(found["key"])] = np.asarray(found["n"])
    return out


def _fold(letter: str) -> str:
    letter = LOOK_ALIKE.get(letter, letter)
    return unicodedata.normalize("NFD", letter)[0] if letter > "\x7f" else letter


class Channel:
    """What an observed sign may stand for, and the language model that weighs it."""

    def __init__(self, counts: np.ndarray, sought: list[str] = ()):
        """Half of a trigram's weight comes from the counts, half from the sought words and beginnings (~)."""
        signs = np.array(["\x02", *ALPHABET, *[""] * (_SIZE - 1 - len(ALPHABET))])
        keys = np.flatnonzero(counts)
        a, b, c = keys // _SIZE**2, keys // _SIZE % _SIZE, keys % _SIZE
        known = (np.maximum(np.maximum(a, b), c) <= len(ALPHABET)) & ((b > 0) | (c > 0))
        keys, a, b, c = keys[known], a[known], b[known], c[known]
        before = np.bincount(a * _SIZE + b, counts[keys], _SIZE**2)[a * _SIZE + b]
        ends = np.where(c == 0, "\x03", signs[c])
        share = dict(zip((x + y + z for x, y, z in zip(signs[a].tolist(), signs[b].tolist(), ends.tolist())), ((counts[keys] + 0.05) / (before + 2.0)).tolist()))
        grams, first = Counter(), Counter()
        for f in sought:
            line = "\x02\x02" + (f[:-1] if f.endswith("~") else f + "\x03")
            for i in range(2, len(line)):
                grams[line[i - 2 : i + 1]] += 1
                first[line[i - 2 : i]] += 1
        self.rare = 8.0
        both = {g: share.get(g, 0.0) + (grams[g] / first[g[:2]] if g in grams else 0.0) for g in share.keys() | grams.keys()}
        self.cost = {g: min(self.rare, -math.log(p / 2 if g[:2] in first else p)) for g, p in both.items()}
        self.known: dict[str, list[tuple[str, float]]] = {}

    def options(self, sign: str) -> list[tuple[str, float]]:
        """(letter, cost); an empty letter is a separator that is dropped."""
        if (out := self.known.get(sign)) is None:
            self.known[sign] = out = self._options(sign)
        return out

    def _options(self, sign: str) -> list[tuple[str, float]]:
        if sign in SEPARATORS:
            return [("", 0.3)]
        if sign in LEET:
            return [(x, 1.0) for x in LEET[sign]] + [("", 6.0)]
        folded = _fold(sign)
        if folded == sign:
            return [(sign, 0.0)] if sign.isalpha() else [("", 2.0), (sign, 0.5)]
        return [(sign, 0.0), (folded, 0.7)]

    def decode(self, token: str, limit: int) -> tuple[str, str]:
        """The first `limit` letters of the likeliest word, and of the same without doubled letters."""
        cost, rare, get = self.cost, self.rare, self.cost.get
        states = {("\x02", "\x02"): (0.0, "", "")}
        for sign in token:
            after: dict[tuple[str, str], tuple[float, str, str]] = {}
            options = self.options(sign)
            for (a, b), (paid, head, shape) in states.items():
                for letter, price in options:
                    if letter:
                        total, state = paid + price + get(a + b + letter, rare), (b, letter)
                        if state not in after or total < after[state][0]:
                            after[state] = (total, head + letter if len(head) < limit else head, shape + letter if len(shape) < limit and letter != shape[-1:] else shape)
                    if not letter or letter == b:
                        total = paid + price + (0.4 if letter else 0.0)
                        if (a, b) not in after or total < after[a, b][0]:
                            after[a, b] = (total, head, shape)
            if len(after) > 1:
                # the best state can go on as any other does, and differs from it in three trigrams at most
                most = min(after.values())[0] + 3 * rare
                after = {s: v for s, v in after.items() if v[0] <= most}
                heads = {v[1:] for v in after.values()}
                if len(heads) == 1 and min(map(len, only := heads.pop())) >= limit:
                    return only
            states = after
        return min((paid + get(a + b + "\x03", rare), head, shape) for (a, b), (paid, head, shape) in states.items())[1:]

    def restore(self, token: str) -> str:
        """The whole likeliest word behind the token."""
        return self.decode(token, len(token) + 1)[0]


class _Outline(dict):
    """For str.translate: each sign's class, or nothing."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        letter = "" if sign in SEPARATORS else _fold(LEET.get(sign, sign)[0])
        self[code] = out = CLASSES.get(letter, letter) if letter.isalpha() else ""
        return out


_CLASS = _Outline()
_TWICE = re.compile(r"(.)\1+")
_PLAIN = re.compile(r"(?:([a-z])(?!\1))*\Z").match


def outline(token: str) -> str:
    return _TWICE.sub(r"\1", token.translate(_CLASS))


def features(word: str) -> list[str]:
    """The word, and its beginnings."""
    return [word, *[f"{word[:n]}~" for n in PREFIXES if len(word) > n]]


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, channel: Channel, curve: tuple[float, float]):
        self.number, self.weights, self.channel, self.curve = {f: i for i, f in enumerate(names)}, [float(w) for w in weights], channel, curve
        words = [f for f in names if not f.endswith("~")]
        self.words, self.undoubled = {outline(f) for f in words}, {_TWICE.sub(r"\1", f): self.number[f] for f in words}
        self.beginnings = {outline(f[:-1]) for f in names if f.endswith("~")}
        shapes = [*self.words, *self.beginnings]
        self.paths = {s[:n] for s in shapes for n in range(1, len(s) + 1)}
        self.shortest, self.longest = min(map(len, shapes), default=99), max(map(len, self.beginnings), default=0)
        self.limit = 2 + max(map(len, names), default=0)  # letters of a word that decide on its features
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def plain(self, word: str) -> tuple[int, ...]:
        get = self.number.get
        return tuple([i for f in features(word) if (i := get(f)) is not None])

    def reaches(self, token: str) -> bool:
        """Whether some path of the token's lattice may lead to a feature."""
        shape = outline(token)
        return len(shape) >= self.shortest and (shape in self.words or any(shape[:n] in self.beginnings for n in range(self.shortest, min(self.longest, len(shape)) + 1)))

    def found(self, token: str) -> tuple[int, ...]:
        """Numbers of the features that a token of small letters shows or hides."""
        word = token.strip(_EDGES)
        if out := self.plain(word):
            return out
        if _PLAIN(token):
            return ()
        for form in dict.fromkeys((token, word)):
            if self.reaches(form):  # decoding leaves open whether a letter was doubled
                head, shape = self.channel.decode(form, self.limit)
                if out := self.plain(head.strip(_EDGES)):
                    return out
                if (i := self.undoubled.get(shape)) is not None:
                    return (i,)
        return ()

    def counts(self, text: str) -> Counter:
        """How often each feature occurs in the restored text."""
        text, out, known = text.lower(), Counter(), self.known
        for token in text.split():
            own = known.get(token)
            if own is None:
                own = self.found(token)
                if len(known) >= MEMORY:
                    known.clear()
                if len(token) < 80:
                    known[token] = own
            if own:
                out.update(own)
        for m in _SPACED.finditer(text):
            for _, _, own in self.spaced(m[0]):
                out.update(own)
        return out

    def spaced(self, run: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, features) of the words and beginnings in a run of single signs; short words at its end alone."""
        signs = [(i, c) for i, c in enumerate(run) if c not in SEPARATORS]
        signs = [x for n, x in enumerate(signs) if n < 2 or not x[1] == signs[n - 1][1] == signs[n - 2][1]]
        joined, kinds, out, at, size = "".join(c for _, c in signs), [_CLASS[ord(c)] for _, c in signs], [], 0, 2 * self.limit
        while at < len(joined):
            shape, own, stop = "", (), at + 1
            for j in range(at, min(len(joined), at + size)):
                if not kinds[j] or kinds[j] == shape[-1:]:
                    continue
                shape += kinds[j]
                if shape not in self.paths:
                    break
                stop = j + 1
                while stop < len(joined) and kinds[stop] == kinds[j]:
                    stop += 1
                if shape in self.words and (len(shape) >= IN_RUN or stop == len(joined)):
                    own = self.found(joined[at:stop])
                if not own and shape in self.beginnings:
                    own = self.found(joined[at : at + size])
                if own:
                    out.append((signs[at][0], signs[stop - 1][0] + 1, own))
                    break
            at = stop if own else at + 1
        return out

    def restore(self, text: str) -> str:
        """The text with decoded words in the place of the tokens that hide them."""

        def run(m: re.Match) -> str:
            out, at = "", 0
            for start, end, _ in self.spaced(m[0].lower()):
                out, at = out + m[0][at:start] + self.channel.restore("".join(c for c in m[0][start:end].lower() if c not in SEPARATORS)), end
            return out + m[0][at:]

        def token(m: re.Match) -> str:
            low = m[0].lower()
            if self.plain(low.strip(_EDGES)) or not self.found(low):
                return m[0]
            return self.channel.restore(low if self.reaches(low) else low.strip(_EDGES))

        return re.sub(r"\S+", token, _SPACED.sub(run, text))

    def score(self, text: str | None) -> float:
        a, b = self.curve
        x = a + b * sum([self.weights[i] * math.log1p(n) for i, n in self.counts(text).items()]) if text else a
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, x))))


def _surprise(p: np.ndarray, q: np.ndarray, base: float) -> np.ndarray:
    """Twice the log likelihood ratio of p toxic and q other rows against their share in all rows."""
    n, share = p + q, p / np.maximum(p + q, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        other = np.where(q > 0, q * np.log((1 - share) / (1 - base)), 0.0)
        return np.where((n > 0) & (share > base), 2 * (p * np.log(share / base) + other), 0.0)


def _regress(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, weight: np.ndarray, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _picked(x: np.ndarray, y: np.ndarray, least: float, most: int) -> np.ndarray:
    """Numbers of the significant columns, `most` of them at most."""
    base = min(max(y.mean(), 1e-9), 1 - 1e-9)
    p, q = (x[y == 1] > 0).sum(0), (x[y == 0] > 0).sum(0)
    g = _surprise(p.astype(float), q.astype(float), base)
    picked = np.flatnonzero((g >= least) & (p > q))
    return np.sort(picked[np.argsort(-g[picked], kind="stable")[:most]])


def _weights(x: np.ndarray, y: np.ndarray, picked: np.ndarray, strength: float, steps: int = 40) -> np.ndarray:
    """Weights of the picked columns, and the constant."""
    rows = np.column_stack([x[:, picked], np.ones(len(x), np.float32), y.astype(np.float32)])
    rows, times = np.unique(rows, axis=0, return_counts=True)  # most rows hold no feature
    ridge = np.full(len(picked) + 1, strength)
    ridge[-1] = 1e-4
    return _regress(rows[:, :-1].astype(float), rows[:, -1].astype(float), ridge, times.astype(float), steps)


def _words(text: str) -> list[str]:
    return [w for t in text.lower().split() if (w := t.strip(_EDGES))]


def _columns(rows: list[tuple[str, int]], names: list[str]) -> Iterator[dict[int, int]]:
    """For each row, how often it holds each of the named features, by number."""
    number, known = {f: i for i, f in enumerate(names)}, {}
    heads = {f[: PREFIXES[0]] for f in names if f.endswith("~")}
    for text, _ in rows:
        out: dict[int, int] = {}
        for w, n in Counter(_words(text)).items():
            if (ids := known.get(w)) is None:
                if len(known) >= MEMORY:
                    known.clear()
                ids = [number[f] for f in features(w) if f in number] if w in number or w[: PREFIXES[0]] in heads else ()
                known[w] = ids = tuple(ids)
            for i in ids:
                out[i] = out.get(i, 0) + n
        yield out


def fit(rows: list[tuple[str, int]], counts: np.ndarray | None = None, least_docs: int = 3, least_share: float = 0.01, least_types: int = 4, surprises: tuple[float, ...] = (9.0, 15.0), most_features: int = 300, folds: int = 3, strengths: tuple[float, ...] = (0.05, 0.3)) -> Model:
    """Learns from (text, label) rows, equal ones counting once, and from the trigrams of all documents (or of the rows)."""
    rows = sorted({(t or "", int(y)) for t, y in rows})
    y = np.array([label for _, label in rows], float)
    if counts is None:
        counts = count_trigrams([t for t, _ in rows])
    toxic = [text for text, label in rows if label]
    least_docs = max(least_docs, math.ceil(least_share * len(toxic)))
    sieve = np.zeros(SIEVE, np.uint32)  # counts by hash, so that only features of enough rows are held by name
    for text in toxic:
        sieve[np.unique([hash(f) % SIEVE for w in set(_words(text)) for f in features(w)]).astype(np.int64)] += 1
    held, types = Counter(), Counter()
    for text in toxic:
        held.update({f for w in set(_words(text)) for f in features(w) if sieve[hash(f) % SIEVE] >= least_docs})
    for w in {w for text in toxic for w in _words(text)}:
        types.update([f for f in features(w)[1:] if f in held])
    # a beginning counts by itself where it leads to several words
    names = sorted(f for f, n in held.items() if n >= least_docs and len(f.rstrip("~")) > 2 and (not f.endswith("~") or types[f] >= least_types))
    docs_with = np.zeros((2, len(names)))
    for (_, label), own in zip(rows, _columns(rows, names)):
        docs_with[label, list(own)] += 1
    base = min(max(y.mean() if len(y) else 0.0, 1e-9), 1 - 1e-9)
    g = _surprise(docs_with[1], docs_with[0], base)
    keep = np.flatnonzero(g >= min(surprises) / 2)  # no column that a fold may pick is lost
    keep = np.sort(keep[np.argsort(-g[keep], kind="stable")[: 2 * most_features]])
    x = np.zeros((len(rows), len(keep)), np.float32)
    for r, own in enumerate(_columns(rows, [names[i] for i in keep])):
        x[r, list(own)] = np.log1p(list(own.values()))
    if not len(keep) or not 0 < y.sum() < len(y):
        prior = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return Model([], np.zeros(0), Channel(counts), (min(prior, 0.0), 1.0))
    fold = np.random.default_rng(7).permutation(len(y)) % folds
    outside = {(least, strength): np.zeros(len(y)) for least in surprises for strength in strengths}
    for k in range(folds):
        mine, done = fold != k, {}
        if not 0 < y[mine].sum() < mine.sum():
            continue
        for (least, strength), z in outside.items():
            picked = _picked(x[mine], y[mine], least * (folds - 1) / folds, most_features)
            if (same := (picked.tobytes(), strength)) not in done:
                beta = _weights(x[mine], y[mine], picked, strength, steps=15)
                done[same] = x[~mine][:, picked] @ beta[:-1] + beta[-1]
            z[~mine] = done[same]
    loss = lambda z: float(np.logaddexp(0, np.where(y == 1, -z, z)).sum())
    best = min(outside, key=lambda s: loss(outside[s]))
    picked = _picked(x, y, best[0], most_features)
    beta = _weights(x, y, picked, best[1])
    curve = _regress(np.column_stack([outside[best], np.ones(len(y))]), y, np.array([1e-3, 1e-4]), np.ones(len(y)))
    slope = max(0.0, float(curve[0]))
    chosen = [names[keep[i]] for i in picked]
    return Model(chosen, beta[:-1], Channel(counts, chosen), (float(curve[1] + slope * beta[-1]), slope))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> list[tuple[str, int]]:
    """Labelled rows outside the held-out third: the `max_rows` with the smallest hashes of the id."""
    mine = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    mine = mine.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").select("text", "toxic").collect()]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> Model:
    """Trigrams of all documents, features and weights of the labelled sample."""
    return fit(training_rows(docs, labels, max_rows), trigrams(docs))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])
        model.known.clear()

    kind = dict(docs.dtypes)[id_col]
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    names = docs.columns
    given = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            yield b.filter(pa.array([model.score(t) < threshold for t in texts], pa.bool_()))
        model.known.clear()  # a worker lives on after its task

    return mapped(given, run, given.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
