"""Language of each word by a linear-chain conditional random field, and of each document by its words.

Features of a word: its affixes, its character n-grams, and for each language
whether its lexicon has the word. Weights and transitions are learned on the
driver from a bounded sample of labelled documents, in sequences of ``PIECE``
words, and from sequences spliced from them in which the language changes, as
whole documents never show that. Documents are labelled where they lie, by
forward-backward over the whole text: pieces of ``PIECE`` words are worked on
together, each between the messages that the pieces before and after it send. A
document's score for a language is its words' mean posterior. A run of over 40
letters is taken as several words, so that all of it counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm.common import filter_arrow, hash_mod, map_arrow, own_columns, table

#: Different documents of each language that the model is fitted on, at most, and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 150, 20_000
HASH_BITS = 15
PIECE = 64
LEXICON = 300
ROUNDS, RATE, RIDGE = 40, 0.5, 1e-5
UNKNOWN = "und"
#: Score, the share of a text that is in its language, from which a text counts as one of that language.
MIN_SCORE = 0.5
#: Words whose emissions a task remembers.
_CACHE = 200_000
LETTERS = re.compile(r"[^\W\d_]{1,40}")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of hashed features and the word that each belongs to: affixes of one to three letters, n-grams of two and three, with the ends marked."""
    marked = [f"\2{w}\3" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    begin = np.cumsum(size) - size
    last = begin + size - 1
    left = np.repeat(last, size) - np.arange(len(c))  # letters that follow in the word

    def hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
        x = np.full(len(parts[0]), kind, np.uint64)
        for p in parts:
            x = (x ^ p) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
        return (x >> np.uint64(64 - HASH_BITS - 8) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)

    ids, owners = [], []
    for n in (2, 3):
        at = np.flatnonzero(left >= n - 1)
        ids.append(hashed(n, *(c[at + k] for k in range(n))))
        owners.append(owner[at])
    for n in (1, 2, 3):
        for kind, at in ((10, [np.minimum(begin + 1 + k, last) for k in range(n)]), (20, [np.maximum(last - 1 - k, begin) for k in range(n)])):
            ids.append(hashed(kind + n, *(c[x] for x in at)))
            owners.append(np.arange(len(words)))
    return np.concatenate(ids), np.concatenate(owners)


class Crf:
    def __init__(self, labels: list[str], lexicons: list[set[str]]):
        self.labels, self.lexicons = labels, lexicons
        self.w = np.zeros(((1 << HASH_BITS) + len(labels), len(labels)))  # the last rows are the lexicons'
        self.t = np.zeros((len(labels), len(labels)))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature ids, those of the lexicons included, and the word that each belongs to."""
        ids, owner = features(words)
        extra = [(i, (1 << HASH_BITS) + k) for k, lex in enumerate(self.lexicons) for i, w in enumerate(words) if w in lex]
        more = np.array(extra, np.int64).reshape(-1, 2)
        return np.concatenate([ids, more[:, 1]]), np.concatenate([owner, more[:, 0]])

    def emissions(self, words: list[str]) -> np.ndarray:
        return self.scores(*self.encode(words), len(words))

    def scores(self, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, self.w[ids, k], n) for k in range(len(self.labels))], axis=1)

    def posteriors(self, scores: np.ndarray, mask: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over (pieces, words, labels); the words' label posteriors and the summed pair posteriors inside pieces.

        ``first`` marks the pieces with which a sequence begins; the others go on
        with the one before them. Without it each piece is a sequence.
        """
        n, length, k = scores.shape
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        m = np.exp(self.t - self.t.max())
        enter, leave = (np.ones((n, k)), np.ones((n, k))) if first is None else self._messages(e, m, mask, first)
        a = np.empty_like(e)
        x = enter * e[:, 0]
        a[:, 0] = x / x.sum(axis=1, keepdims=True)
        for i in range(1, length):
            x = (a[:, i - 1] @ m) * e[:, i]
            a[:, i] = x / x.sum(axis=1, keepdims=True)
        b, pairs = leave, np.zeros((k, k))
        g = a.copy()
        for i in range(length - 1, -1, -1):
            if i < length - 1:
                ahead = e[:, i + 1] * b
                live = mask[:, i + 1, None]
                x = ahead @ m.T
                if first is None:
                    total = (a[:, i] * x).sum(axis=1, keepdims=True)
                    pairs += ((a[:, i] / total) * live).T @ ahead * m
                b = np.where(live, x / x.sum(axis=1, keepdims=True) * k, leave)
            y = a[:, i] * b
            g[:, i] = y / y.sum(axis=1, keepdims=True)
        return g, pairs

    @staticmethod
    def _messages(e: np.ndarray, m: np.ndarray, mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What enters each piece before its first word, and what comes back to its last word from the pieces after it."""
        n, length, k = e.shape
        enter, leave = np.ones((n, k)), np.ones((n, k))
        more = np.flatnonzero(~first)  # pieces with one before them
        if not more.size:
            return enter, leave
        through = np.broadcast_to(np.eye(k), (n, k, k)).copy()  # from a piece's first word to its last
        inner = np.flatnonzero(~first | np.append(~first[1:], False))
        part = through[inner]
        for i in range(1, length):
            x = (part.reshape(-1, k) @ m).reshape(-1, k, k) * e[inner, i, None]
            x /= x.sum(axis=(1, 2), keepdims=True)
            part = np.where(mask[inner, i, None, None], x, part)
        through[inner] = part
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        depth = np.arange(n) - begin  # of a piece in its sequence
        order = more[np.argsort(depth[more], kind="stable")]
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        for at in levels:
            x = ((enter[at - 1] * e[at - 1, 0])[:, None] @ through[at - 1])[:, 0] @ m
            enter[at] = x / x.sum(axis=1, keepdims=True)
        for at in reversed(levels):
            x = (e[at, 0] * (through[at] @ leave[at][:, :, None])[:, :, 0]) @ m.T
            leave[at - 1] = x / x.sum(axis=1, keepdims=True) * k
        return enter, leave

    def fit(self, sequences: list[list[tuple[str, int]]], rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> None:
        """Full-batch ascent of the log-likelihood with a step size for each weight (Adagrad)."""
        types = sorted({w for s in sequences for w, _ in s})
        place = {w: i for i, w in enumerate(types)}
        ids, owner = self.encode(types)
        which, mask = _pieces([[place[w] for w, _ in s] for s in sequences])
        gold, _ = _pieces([[y for _, y in s] for s in sequences])
        k, n = len(self.labels), mask.sum()
        truth = np.eye(k)[gold] * mask[:, :, None]
        both = (mask[:, 1:] & mask[:, :-1]).ravel()
        seen = np.bincount((gold[:, :-1] * k + gold[:, 1:]).ravel()[both], minlength=k * k).reshape(k, k)
        sums = [np.full_like(self.w, 1e-8), np.full_like(self.t, 1e-8)]
        for _ in range(rounds):
            post, pairs = self.posteriors(self.scores(ids, owner, len(types))[which], mask)
            off = (truth - post * mask[:, :, None]).reshape(-1, k)
            by_type = np.stack([np.bincount(which.ravel(), off[:, j], len(types)) for j in range(k)], axis=1)
            up = np.stack([np.bincount(ids, by_type[owner, j], len(self.w)) for j in range(k)], axis=1)
            for p, g, s in ((self.w, up / n - ridge * self.w, sums[0]), (self.t, (seen - pairs) / n - ridge * self.t, sums[1])):
                s += g * g
                p += rate * g / np.sqrt(s)


def _pieces(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows cut in pieces of ``PIECE`` and padded, and which places hold a word."""
    sizes = np.array([len(r) for r in rows], np.int64)
    count = -(-sizes // PIECE)
    flat = np.array([x for r in rows for x in r], np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) * PIECE
    at = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(flat))
    out, mask = np.zeros(count.sum() * PIECE, np.int64), np.zeros(count.sum() * PIECE, bool)
    out[at], mask[at] = flat, True
    return out.reshape(-1, PIECE), mask.reshape(-1, PIECE)


def splice(docs: list[tuple[list[str], int]], n: int, seed: int = 11) -> list[list[tuple[str, int]]]:
    """``n`` sequences of runs of words from documents of changing languages."""
    rng, out = np.random.default_rng(seed), []
    docs = [d for d in docs if d[0]]
    for _ in range(n if docs else 0):
        seq: list[tuple[str, int]] = []
        while len(seq) < PIECE:
            words, y = docs[rng.integers(len(docs))]
            run, at = int(rng.geometric(1 / 12)) + 2, int(rng.integers(len(words)))
            seq += [(w, y) for w in words[at : at + run]]
        out.append(seq[:PIECE])
    return out


def train(docs: list[tuple[str, str]]) -> Crf | None:
    """A model from (text, lang); None without labels."""
    labels = sorted({lang for _, lang in docs})
    split = [(LETTERS.findall(text.lower()), labels.index(lang)) for text, lang in docs]
    if not any(w for w, _ in split):
        return None
    counts = [Counter(w for words, y in split if y == k for w in words) for k in range(len(labels))]
    lexicons = [{w for w, n in c.most_common(LEXICON) if n > 1 and n / c.total() > 2 * max([0, *(d[w] / max(1, d.total()) for j, d in enumerate(counts) if j != k)])} for k, c in enumerate(counts)]
    model = Crf(labels, lexicons)
    whole = [[(w, y) for w in words] for words, y in split if words]
    model.fit(whole + splice(split, sum(map(len, whole)) // PIECE // 2))
    return model


def sample(docs: DataFrame, bound: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``bound`` different labelled rows of each language, those of least hash, and at most ``chars`` characters of each."""
    ready = docs.filter("lang is not null and text is not null").withColumn("u", F.xxhash64("doc_id", "text", "lang"))
    least = ready.groupBy("lang", "u").count().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).filter(F.col("k") <= bound)
    cuts = {r.lang: r.cut for r in least.groupBy("lang").agg(F.max("u").alias("cut")).collect()}
    if not cuts:
        return []
    spark = docs.sparkSession
    cut = F.broadcast(spark.createDataFrame(list(cuts.items()), "lang string, cut long"))  # a row for each language
    at = F.pmod("u", F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    few = ready.join(cut, "lang").filter("u <= cut").select("lang", "u", F.substring(F.col("text"), at, F.lit(chars)).alias("text"))
    rows = few.groupBy("lang", "u").agg(F.min("text").alias("text")).orderBy("lang", "u").collect()  # at most ``bound`` a language
    return [(r.text, r.lang) for r in rows]


def label_words(model: Crf, texts: list[list[str]], cache: dict[str, int] | None = None, known: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Posteriors (words, labels) for each list of words."""
    cache, known = ({}, []) if cache is None else (cache, known)
    if len(cache) > _CACHE:
        cache.clear()
        known.clear()
    if fresh := list({w for t in texts for w in t} - cache.keys()):
        base = len(cache)
        cache.update(zip(fresh, range(base, base + len(fresh))))
        known.append(np.concatenate([model.emissions(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]))
    table = np.concatenate(known) if known else np.zeros((0, len(model.labels)))
    known[:] = [table]
    out: list[np.ndarray] = [np.zeros((0, len(model.labels)))] * len(texts)
    group, size = [], 0
    for i in range(len(texts) + 1):
        if i < len(texts) and (size < 200_000):
            group.append(i)
            size += len(texts[i])
            if size < 200_000 and i + 1 < len(texts):
                continue
        live = [j for j in group if texts[j]]
        if live:
            which, mask = _pieces([[cache[w] for w in texts[j]] for j in live])
            first = np.zeros(len(which), bool)
            first[np.cumsum([0, *(-(-len(texts[j]) // PIECE) for j in live[:-1])])] = True
            post = model.posteriors(table[which], mask, first)[0][mask]
            for j, p in zip(live, np.split(post, np.cumsum([len(texts[j]) for j in live])[:-1])):
                out[j] = p
        group, size = [], 0
    return out


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, switched): a row for each row of ``docs``; switched is the share of words in other languages.

    ``und`` with score 0 for a null text, a text without a letter, or without a
    model. Ties go to the label that sorts first. Repeated rows and null ids
    get rows of their own; other columns are not read.
    """
    own = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    labelled = Labeller(model)

    def run(batch: pa.RecordBatch) -> dict:
        lang, score, other = labelled((t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "switched": pa.array(other, pa.float64())}

    return map_arrow(own, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, switched double")


class Labeller:
    """Languages, scores and shares of other languages for texts; keeps what it learned of words from batch to batch."""

    def __init__(self, model: Crf | None):
        self.model, self.cache, self.known = model, {}, []

    def __call__(self, texts: Iterable[str]) -> tuple[list[str], list[float], list[float]]:
        model = self.model
        words = [LETTERS.findall(t.lower()) if model and has_letter(t) else [] for t in texts]
        lang, score, other = [], [], []
        for p in label_words(model, words, self.cache, self.known) if model else [()] * len(words):
            if not len(p):
                lang.append(UNKNOWN)
                score.append(0.0)
                other.append(0.0)
                continue
            mean = p.mean(axis=0)
            best = int(mean.argmax())
            lang.append(model.labels[best])
            score.append(min(1.0, float(mean[best])))
            other.append(float((p.argmax(axis=1) != best).mean()))
        return lang, score, other


def keep_identified(docs: DataFrame, model: Crf | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with ``min_score`` or more, unchanged; a null text has none."""
    labelled = Labeller(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, _ = labelled(t or "" for t in batch.column(text_col).to_pylist())
        return batch.filter(pa.array([x != UNKNOWN and y >= min_score for x, y in zip(lang, score)], pa.bool_()))

    return filter_arrow(docs, run, text_col)


def fitted(docs: DataFrame) -> Crf | None:
    """A model from the rows that are not held out."""
    return train(sample(docs.filter(hash_mod("doc_id", 4) != 2).select("doc_id", "text", "lang")))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled ones with crc32(doc_id) mod 4 other than 2. Null texts and texts without a letter are ``und``; repeated rows get a row each, empty tables none."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fitted(docs))
    return found.withColumn("held_out", hash_mod("doc_id", 4) == 2)
