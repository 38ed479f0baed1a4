"""Log-probabilities of texts under a log-bilinear model over a tree of word classes, trained by noise-contrastive estimation.

A word is predicted in steps, so that the whole vocabulary has normalised
probabilities at a small cost: the group of its class from the classes of the
words before it (log-bilinear: the context's vectors, each weighted for its
place, add up to a predicted vector that meets the group's vector), the class
in its group alike, then the word in its class by its count. The most frequent
words and the end of a text are classes of their own; other words share the
class of their last two bytes. Each class of several words keeps a share for
unknown ones. The classes grow as the square root of the vocabulary, and their
groups as the square root of that.

Counts cover all training documents, and the model is trained on every position
of them. Documents are dealt by hash to pieces of ``PIECE_BYTES``, and a piece
is trained on in order by one task, so that the result does not depend on how
the table is split. Round k takes 2**k pieces that no other round takes; all
start from the mean of the round before (parameters and step sizes), summed by
Spark in whole numbers.
Counts of the ``FREQUENT`` most frequent words go to all tasks; those of other
words are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.common import chunks, hash_mod, materialise, table

FREQUENT = 200_000
#: Classes, as a multiple of the vocabulary's square root and at least, and the share of them that are words.
CLASSES, LEAST_CLASSES, SINGLES = 1.0, 256, 0.62
CONTEXT, DIM = 4, 16
#: Text of a piece, and positions that are shuffled before they are trained on.
PIECE_BYTES, MIXED = 4 << 20, 150_000
NOISE, BATCH, STEPS, RATE, SEED = 8, 2048, 64, 0.3, 29
#: Words that a task counts before it passes the counts on.
_HELD = 200_000
#: Parameters are summed in units of this.
_UNIT = 1 << 24
#: The bias of a class without words; weight of pieces that a task adds up in longs, at parameters under 2**15.
EMPTY, SUMMED = -1e4, 1 << 23
#: Tasks of a round for each core that the session has.
TASKS = 4


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts (column text, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in chunks(batches, "text"):
            for text in batch.column("text").to_pylist():
                held.update((text or b"").lower().split())
                if len(held) > _HELD:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})
                    held = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Classes of all words, and the counts that go to every task."""

    def __init__(self, counts: DataFrame, texts: int):
        total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.texts = texts
        self.tokens, self.types = total + texts, distinct + (texts > 0)
        level = F.floor(F.log2("n") * 8).cast("int")  # a few hundred levels at any size
        least, room = 1 << 30, FREQUENT
        for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
            if (room := room - r.words) < 0:
                break
            least = r.level
        common = counts.filter(level >= least).toArrow()  # at most FREQUENT words
        words = sorted(zip(common["n"].to_pylist(), common["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
        by_end = counts.groupBy(F.expr("substring(word, -2, 2)").alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()  # at most 65,792 rows
        mass = {e: [n, k] for e, n, k in zip(by_end["ending"].to_pylist(), by_end["n"].to_pylist(), by_end["words"].to_pylist())}
        size = min(FREQUENT, max(LEAST_CLASSES, int(CLASSES * self.types**0.5)))
        singles = words[: int(SINGLES * size)]
        for n, w in singles:
            mass[w[-2:]][0] -= n
            mass[w[-2:]][1] -= 1
        endings = sorted(mass, key=lambda e: (-mass[e][0], e))[: max(0, size - len(singles) - 2)]
        # classes in the order of their spelling from the end, so that a group has like endings; the end of a text and the rest come first
        order = sorted([(w[::-1], 0, w) for _, w in singles] + [(e[::-1], 1, e) for e in endings])
        self.groups = max(1, round((len(order) + 2) ** 0.5))
        self.width = -(-(len(order) + 2) // self.groups)
        self.size = self.groups * self.width  # the last classes of the last group are empty
        self.end, self.other = 0, 1
        word = {w: 2 + i for i, (_, kind, w) in enumerate(order) if not kind}
        self.ending = {e: 2 + i for i, (_, kind, e) in enumerate(order) if kind}
        group = np.zeros((self.size, 2), np.int64)
        for e, (n, k) in mass.items():
            group[self.ending.get(e, self.other)] += n, k
        weight = group[:, 0].astype(float)
        for n, w in singles:
            weight[word[w]] = n
        weight[self.end] = texts
        self.single = np.zeros(self.size, bool)
        self.single[[self.end, *word.values()]] = True
        self.group = group.sum(axis=1) + 1  # what the known words' counts plus one each, and an unknown word, share
        self.group[self.single] = 1
        self.place = {w: i for i, (_, w) in enumerate(words)}
        self.count = np.array([n for n, _ in words], np.int64)
        self.kind = np.dtype(np.uint16 if self.size < 1 << 16 else np.int32)
        self.of = np.array([word[w] if w in word else self.ending.get(w[-2:], self.other) for _, w in words], self.kind)
        weight += np.arange(self.size) < len(order) + 2
        self.share = weight / weight.sum()

    def encode(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places of a text's words among the frequent ones (-1: none), classes of its words and its end, and the words."""
        words = (text or b"").lower().split()
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        kind = np.full(len(words) + 1, self.end, self.kind)
        if len(words):
            kind[:-1] = self.of[place] if len(self.of) else self.other
            rare = np.flatnonzero(place < 0)
            kind[rare] = [self.ending.get(words[i][-2:], self.other) for i in rare.tolist()]
        return place, kind, words


class LogBilinear:
    """Parameters: r (vectors of context classes, the last for what is before a text), c (weights by place), g (groups) and q (classes in groups), both with the bias as last dimension; ``squares`` has Adagrad's sums for each."""

    NAMES = ("r", "c", "g", "q")

    def __init__(self, groups: int, width: int, share: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.groups, self.width, self.trained = groups, width, 0
        self.share = share.reshape(groups, width)
        of_group = self.share.sum(axis=1)
        inside = self.share / np.maximum(of_group, 1e-300)[:, None]
        self.of_group = of_group.astype(np.float32)
        self.r = rng.normal(0, 0.3, (groups * width + 1, DIM)).astype(np.float32)
        self.c = np.ones((CONTEXT, DIM), np.float32) / CONTEXT
        self.g = np.concatenate([rng.normal(0, 0.3, (groups, DIM)), np.log(of_group)[:, None]], axis=1).astype(np.float32)
        with np.errstate(divide="ignore"):
            bias = np.maximum(np.log(inside), EMPTY)  # empty classes have no chance
        self.q = np.concatenate([rng.normal(0, 0.3, (groups * width, DIM)) * (share > 0)[:, None], bias.reshape(-1, 1)], axis=1).astype(np.float32)
        self.squares = {n: np.full_like(getattr(self, n), 1e-6) for n in self.NAMES}
        self.of_class = np.where(inside > 0, inside, 1e-30).astype(np.float32)  # nothing is drawn from an empty class

    def flat(self) -> np.ndarray:
        """All parameters and squares; the biases of empty classes, which are far from all others and do not change, are left out as zeros."""
        out = np.concatenate([x.ravel() for n in self.NAMES for x in (getattr(self, n), self.squares[n])]).astype(float)
        out[self._biases()] = 0
        return out

    def _biases(self) -> np.ndarray:
        """Places of the biases of empty classes in ``flat``."""
        before = 2 * (self.r.size + self.c.size + self.g.size)
        return before + np.flatnonzero(self.share.ravel() == 0) * (DIM + 1) + DIM

    def load(self, flat: np.ndarray) -> None:
        flat = flat.copy()
        flat[self._biases()] = EMPTY
        at = 0
        for n in self.NAMES:
            for store in (self.__dict__, self.squares):
                x = store[n]
                store[n] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size

    def contexts(self, kinds: np.ndarray) -> np.ndarray:
        """(positions, CONTEXT) classes before each position of one text, the nearest first; of the same type."""
        padded = np.concatenate([np.full(CONTEXT, len(self.r) - 1, kinds.dtype), kinds])
        return np.stack([padded[CONTEXT - 1 - i : len(padded) - 1 - i] for i in range(CONTEXT)], axis=1)

    def _step(self, name: str, up: np.ndarray) -> None:
        s = self.squares[name]
        s += up * up
        now = getattr(self, name)
        now += RATE * up / np.sqrt(s)

    def train(self, ctx: np.ndarray, target: np.ndarray) -> None:
        """Noise-contrastive steps (Adagrad): each group, and each class in its group, against ``NOISE`` draws from the shares.

        As all scores of a product are there, the draws' mean is taken in place of draws.
        """
        w = self.width
        batch = min(BATCH, max(64, len(target) // STEPS))  # few positions make smaller steps
        for at in range(0, len(target), batch):
            y = target[at : at + batch]
            order = np.argsort(y, kind="stable")
            y, x = y[order].astype(np.int64), ctx[at : at + batch][order].astype(np.int64)
            n = len(y)
            top, low = np.divmod(y, w)
            met = self.r[x]
            hat = np.ones((n, DIM + 1), np.float32)
            hat[:, :-1] = np.einsum("nid,id->nd", met, self.c)
            off = _off(hat @ self.g.T, top, NOISE * self.of_group)
            back = off @ self.g
            up = off.T @ hat
            self._step("g", up / n)
            cuts = np.flatnonzero(np.diff(top)) + 1
            parts = list(zip([0, *cuts.tolist()], [*cuts.tolist(), n]))
            logit, up = np.empty((n, w), np.float32), np.zeros((self.groups, w, DIM + 1), np.float32)
            q = self.q.reshape(self.groups, w, DIM + 1)
            for i, j in parts:  # the places of one group
                np.matmul(hat[i:j], q[top[i]].T, out=logit[i:j])
            off = _off(logit, low, NOISE * self.of_class[top])
            for i, j in parts:
                back[i:j] += off[i:j] @ q[top[i]]
                np.matmul(off[i:j].T, hat[i:j], out=up[top[i]])
            self._step("q", up.reshape(self.q.shape) / n)
            back /= n
            up_c = np.einsum("nd,nid->id", back[:, :-1], met)
            up_r = _by_class(x, back[:, :-1], self.c, len(self.r))
            self._step("c", up_c)
            self._step("r", up_r)

    def log_probabilities(self, ctx: np.ndarray, target: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """Normalised natural log-probabilities of the target classes, by matrix products over blocks of positions."""
        out = np.empty(len(target))
        placed = [c * self.r for c in self.c]
        g, q = np.ascontiguousarray(self.g.T), np.ascontiguousarray(self.q.reshape(self.groups, self.width, -1).transpose(0, 2, 1))
        for at in range(0, len(target), block):
            y = target[at : at + block].astype(np.int64)
            top, low = np.divmod(y, self.width)
            order = np.argsort(top, kind="stable")
            top, low, x = top[order], low[order], ctx[at : at + block][order]
            hat = np.ones((len(y), DIM + 1), np.float32)
            np.sum([p[x[:, i]] for i, p in enumerate(placed)], axis=0, out=hat[:, :-1])
            found = np.empty(len(y))
            for a in range(0, len(y), 1024):
                found[a : a + 1024] = _log_softmax(hat[a : a + 1024] @ g, top[a : a + 1024])
            cuts = np.flatnonzero(np.diff(top)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(y)]):
                for i in range(a, b, 1024):
                    j = min(b, i + 1024)
                    found[i:j] += _log_softmax(hat[i:j] @ q[top[a]], low[i:j])
            out[at + order] = found
        return out


def _off(logit: np.ndarray, chosen: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Slope of the noise-contrastive objective by each score: ``chosen`` is data, against noise of these weights. ``logit`` is overwritten."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(logit, out=logit), out=logit)
    logit *= noise
    logit += 1
    np.reciprocal(logit, out=logit)  # the chance that it is data
    at = np.arange(len(logit)), chosen
    mine = logit[at]
    logit *= -noise
    logit[at] += 1 - mine
    return logit


def _by_class(x: np.ndarray, back: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """Sums of each position's slopes, weighted for their place, by the classes ``x`` of its context: a dimension at a time, so that the classes themselves are the bins."""
    at, out = x.ravel(), np.empty((back.shape[1], size), np.float32)
    weight = np.ascontiguousarray(back.T)[:, :, None] * c.T[:, None]
    for d, own in enumerate(weight.reshape(len(out), -1)):
        out[d] = np.bincount(at, own, size)
    return np.ascontiguousarray(out.T)


def _log_softmax(logit: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-probabilities of the chosen columns."""
    own = logit[np.arange(len(logit)), chosen]
    if logit.max() > 60:  # beyond that, sums of exponentials might leave the range
        high = logit.max(axis=1, keepdims=True)
        logit, own = logit - high, own - high[:, 0]
    return own - np.log(np.exp(logit).sum(axis=1))


def rounds(pieces: int) -> list[tuple[int, int]]:
    """Ranges of pieces: one, two, four and so on, the last with what is left."""
    out, at = [], 0
    while at < pieces:
        out.append((at, min(pieces, 2 * at + 1)))
        at = out[-1][1]
    return out


def encode(docs: DataFrame, classes: Classes) -> DataFrame:
    """(dk, dk2, doc_id, learns, n_tokens, known, known_log, inside, kinds, word, n, first): a row for each row of (doc_id, text, learns), and one for each of its words that is not frequent.

    ``kinds`` has the text's classes, as the model takes them; ``inside`` the
    words' shares of their classes, but for the counts of those of ``word``.
    ``dk`` and ``dk2`` are 128 bits that stand for id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_log = np.log10(classes.group)
        count_log = np.log10(classes.count + 1)
        of_single = classes.single[classes.of]
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            size, coded, known, known_log, inside = [], [], [], [], []
            rare_word, rare_n, rares = [], [], []
            for text in texts:
                place, kinds, words = classes.encode(text)
                size.append(len(kinds))
                coded.append(kinds.tobytes())
                found = place[place >= 0]
                log = count_log[found]
                known.append(len(found) + (classes.texts > 0))
                known_log.append(float(log.sum()) + np.log10(classes.texts + 1))
                inside.append(float(log[~of_single[found]].sum()) - float(group_log[kinds].sum()))  # words that are no class of their own
                rare = Counter(words[i] for i in np.flatnonzero(place < 0).tolist())
                rares.append(len(rare))
                rare_word += rare.keys()
                rare_n += rare.values()
            n, m = len(texts), len(rare_word)
            rares = np.array(rares, np.int64)
            first = np.zeros(m, np.int32)
            first[(np.cumsum(rares) - rares)[rares > 0]] = 1  # of a text's words
            doubled = lambda c: pa.array(np.concatenate([k := batch.column(c).to_numpy(), np.repeat(k, rares)]))  # noqa: E731  of the texts, and of their words
            none = lambda kind, k: pa.nulls(k, kind)
            both = lambda a, b: pa.concat_arrays([a, b])
            yield pa.RecordBatch.from_pydict(
                {
                    "dk": doubled("dk"),
                    "dk2": doubled("dk2"),
                    "doc_id": both(batch.column("doc_id"), none(batch.column("doc_id").type, m)),
                    "learns": both(batch.column("learns"), none(pa.bool_(), m)),
                    "n_tokens": both(pa.array(size, pa.int64()), none(pa.int64(), m)),
                    "known": both(pa.array(known, pa.int64()), none(pa.int64(), m)),
                    "known_log": both(pa.array(known_log, pa.float64()), none(pa.float64(), m)),
                    "inside": both(pa.array(inside, pa.float64()), none(pa.float64(), m)),
                    "kinds": both(pa.array(coded, pa.binary()), none(pa.binary(), m)),
                    "word": both(none(pa.binary(), n), pa.array(rare_word, pa.binary())),
                    "n": pa.array(np.concatenate([np.zeros(n, np.int64), np.array(rare_n, np.int64)])),
                    "first": pa.array(np.concatenate([np.zeros(n, np.int32), first])),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), F.xxhash64(F.lit(1), "doc_id", "text").alias("dk2"), "text", "learns")
    return keyed.mapInArrow(run, f"dk long, dk2 long, doc_id {kind}, learns boolean, n_tokens long, known long, known_log double, inside double, kinds binary, word binary, n long, first int")


def with_rounds(encoded: DataFrame, pieces: int) -> DataFrame:
    """Rows of ``encode`` with their ``piece`` and its ``round``, -1 for those that are not learned from."""
    piece = F.when(F.coalesce("learns", F.lit(False)) & F.col("kinds").isNotNull(), F.pmod("dk", F.lit(max(1, pieces)))).otherwise(-1)
    return encoded.withColumn("piece", piece.cast("long")).withColumn("round", F.floor(F.log2(F.greatest(F.col("piece"), F.lit(0)) + 1)).cast("int") + F.when(F.col("piece") < 0, -1).otherwise(0))


def pieces_of(size: int, classes: Classes, piece_bytes: int = PIECE_BYTES) -> int:
    return max(-(-size // piece_bytes), 1) if classes.texts else 0


def train(encoded: DataFrame, classes: Classes, pieces: int) -> LogBilinear:
    """A model from the rows of ``with_rounds`` that are learned from.

    Stored by round, a round's rows are all that it reads. Its tasks are bounded
    by the session's cores and take several pieces each, whose sums they give
    out; these are whole numbers, so that no split of the pieces changes a model,
    and added up as decimals, which no corpus makes overflow.
    """
    model = LogBilinear(classes.groups, classes.width, classes.share)
    most = TASKS * encoded.sparkSession.sparkContext.defaultParallelism
    for number, (low, high) in enumerate(rounds(pieces)):
        start = model.flat()

        def run(batches: Iterator[pa.RecordBatch], model: LogBilinear = model, start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(start) + 2, np.int64)  # the parameters, their weight, the examples
            now, texts, held, seen = None, [], 0, 0

            def learn() -> int:
                x, y = np.concatenate([model.contexts(k) for k in texts]), np.concatenate(texts)
                order = rng.permutation(len(y))
                model.train(x[order], y[order])
                texts.clear()
                return len(y)

            def close() -> None:
                weight = -(-seen // 4096)
                total[:-2] += np.rint(model.flat() * weight * _UNIT).astype(np.int64)
                total[-2:] += weight, seen

            def given() -> pa.RecordBatch:
                out = pa.RecordBatch.from_pydict({"entry": pa.array(np.arange(len(total), dtype=np.int32)), "value": pa.array(total.copy())})
                total[:] = 0
                return out

            for batch in batches:
                for piece, kinds in zip(batch.column("piece").to_pylist(), batch.column("kinds").to_pylist()):
                    if piece != now:
                        if now is not None:
                            seen += learn() if texts else 0
                            close()
                            if total[-2] >= SUMMED:
                                yield given()
                        now, held, seen, rng = piece, 0, 0, np.random.default_rng([SEED, piece])
                        model.load(start)
                    texts.append(np.frombuffer(kinds, classes.kind))
                    held += len(texts[-1])
                    if held > MIXED:
                        seen += learn()
                        held = 0
            if now is not None:
                seen += learn() if texts else 0
                close()
                yield given()

        part = encoded.filter(F.col("round") == number).select("piece", "dk", "dk2", "kinds")
        dealt = part.repartition(min(most, 2 * (high - low)), "piece").sortWithinPartitions("piece", "dk", "dk2").select("piece", "kinds")
        added = dealt.mapInArrow(run, "entry int, value long").groupBy("entry").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).toArrow().sort_by("entry")
        if added.num_rows:
            value = _mean(added["value"].to_pylist())
            model.load(value)
            model.trained += int(added["value"][-1].as_py())
    return model


def _mean(sums: list) -> np.ndarray:
    """The parameters' weighted mean from whole sums of any size (the last two are the weight and the examples)."""
    return np.array([float(x) for x in sums[:-2]]) / float(sums[-2]) / _UNIT


def score(encoded: DataFrame, counts: DataFrame, classes: Classes, model: LogBilinear) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each document of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "kinds"):
            texts = [np.frombuffer(k, classes.kind) for k in batch.column("kinds").to_pylist()]
            lp = model.log_probabilities(np.concatenate([model.contexts(k) for k in texts]), np.concatenate(texts)) / np.log(10.0)
            begin = np.concatenate([[0], np.cumsum([len(k) for k in texts])[:-1]])
            own = np.add.reduceat(lp, begin) + batch.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(own)], names=[*batch.schema.names[:-2], "own_score"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    documents = encoded.filter("word is null").select("dk", "dk2", "doc_id", "n_tokens", "known", "known_log", "inside", "kinds")
    found = documents.mapInArrow(run, f"dk long, dk2 long, doc_id {kind}, n_tokens long, known long, known_log double, own_score double")
    rare = encoded.filter("word is not null").select("dk", "dk2", "word", "n", "first")
    of = counts.withColumnRenamed("n", "c")
    sums = rare.join(of, "word", "left").groupBy("dk", "dk2").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n") * F.log10(F.col("c") + 1)).otherwise(0.0)).alias("log"), F.sum("first").alias("copies"))
    sums = sums.select("dk", "dk2", (F.col("more") / F.col("copies")).cast("long").alias("more"), (F.col("log") / F.col("copies")).alias("log"))  # of one of the rows that are copies
    rows = found.join(sums, ["dk", "dk2"], "left").fillna({"more": 0, "log": 0.0})
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(classes.tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.col("log") - F.col("n_tokens") * float(np.log10(classes.tokens + classes.types + 1))).alias("base_score"),
        (F.col("own_score") + F.col("log")).alias("score"),
    )


def fitted(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, Classes, LogBilinear]:
    """The encoded documents, the word counts, the classes and the model of the rows that ``learns`` holds for."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    seen = own.filter("learns")
    counts = materialise(word_counts(seen))
    texts, size = seen.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    classes = Classes(counts, texts)
    pieces = pieces_of(size, classes)
    encoded = materialise(with_rounds(encode(own, classes), pieces), "round")
    return encoded, counts, classes, train(encoded, classes, pieces)


def score_texts(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows of ``docs`` under a model of those rows that ``learns`` holds for.

    A null text is an empty one and has one token, its end. Rows with equal id
    and text are scored alike, in a row each; null ids stay null. Without rows
    to learn from all words are unknown and classes equally likely. Other
    columns are not read.
    """
    return score(*fitted(docs, learns, id_col, text_col))


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_texts`` of all documents, learning from those with crc32(doc_id) mod 7 other than 2; see there for nulls, ties, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, hash_mod("doc_id", 7) != 2).withColumn("held_out", hash_mod("doc_id", 7) == 2)
