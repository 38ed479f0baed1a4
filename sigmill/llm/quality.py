"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The features approximate a Gaussian kernel. Every task sums its rows' part of
the normal equations, Spark adds these up by entry, and the driver solves a
system whose size does not depend on the input. Calibration is on a fold that
the ridge has not seen, from counts by bins of its output.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.common import hash_mod, map_arrow, materialise, own_columns, table

FEATURES, BANDWIDTH, RIDGE, SEED = 160, 3.0, 1e-3, 23
#: Rows with hash 0 modulo this calibrate, the others fit.
FOLDS = 5
#: Bins of the ridge's output for each unit of it, and its range.
BINS, LOW, HIGH = 512, -1.0, 2.0
#: Standard deviations at which a statistic is cut off.
FAR = 5.0

STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "pipes", "shouts", "high_bytes", "entropy", "unique_words", "unique_pairs", "top_word", "repeats", "unique_lines", "log_words_a_line", "ended_lines", "short_words"]


def _classes() -> dict[str, np.ndarray]:
    of = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
    marks = bytes(c for c in range(33, 127) if not chr(c).isalnum())
    return {"upper": of(bytes(range(65, 91))), "digits": of(bytes(range(48, 58))), "marks": of(marks), "pipes": of(b"|{}[]<>=;"), "shouts": of(b"!?"), "high_bytes": np.arange(256) >= 128, "space": of(b" \t\n\r\x0b\x0c")}


_CLASS = _classes()


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a text, in the order of ``STATISTICS``; those of an empty text are zero."""
    text = text or b""
    words = text.lower().split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, k = len(text), len(words)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = n - int(count[_CLASS["space"]].sum())
    share = {c: float(count[m].sum()) / solid for c, m in _CLASS.items()}
    p = count[count > 0] / n
    lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
    words_seen = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / (k - 1) if k > 1 else 1.0
    return [
        float(np.log1p(n)), float(np.log1p(k)), solid / k, share["upper"], share["digits"], share["marks"], share["pipes"], share["shouts"], share["high_bytes"],
        float(-(p * np.log2(p)).sum()), len(words_seen) / k, pairs, max(words_seen.values()) / k, sum(map(bytes.__eq__, words, words[1:])) / k,
        len(set(lines)) / len(lines), float(np.log1p(k / len(lines))), sum(x[-1:] in b".!?" for x in lines) / len(lines), sum(c for w, c in words_seen.items() if len(w) <= 3) / k,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): one row for each row of ``docs``."""
    rows = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "x": pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))}

    return map_arrow(rows, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, x array<double>")


class Fourier:
    """Random features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(0, 1 / BANDWIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.deviation, -FAR, FAR)
        return np.concatenate([np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], axis=1)


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.array([v for v, _, n in pools for _ in range(int(n))])


class Model:
    def __init__(self, fourier: Fourier, weights: np.ndarray, at: np.ndarray, level: np.ndarray):
        self.fourier, self.weights, self.at, self.level = fourier, weights, at, level

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.interp(raw, self.at, self.level) if len(self.at) else np.clip(raw, 0, 1)


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """A model from (doc_id, x) and (doc_id, label 0 or 1); None without labelled rows. Labels that contradict count as 0."""
    one = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").cast("double").alias("y"))
    rows = materialise(stats.join(one, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS))))
    moments = rows.select(*(e for i in range(len(STATISTICS)) for e in (F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i]))), F.count("*")).first()
    if not moments[-1]:
        return None
    fourier = Fourier(np.array(moments[:-1:2]), np.array(moments[1:-1:2]))
    size = FEATURES + 1
    i, j = np.triu_indices(size + 1)  # of the features with the label as one more

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            z = np.concatenate([fourier(_x(batch)), batch.column("y").to_numpy()[:, None]], axis=1)
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"entry": pa.array(np.arange(len(i), dtype=np.int32)), "value": pa.array(total[i, j])})

    added = rows.filter("fold > 0").select("x", "y").mapInArrow(sums, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).toArrow()
    gram = np.zeros((size + 1, size + 1))
    entry, value = added["entry"].to_numpy(), added["value"].to_numpy()
    gram[i[entry], j[entry]] = gram[j[entry], i[entry]] = value
    n = max(1.0, gram[size - 1, size - 1])
    weights = np.linalg.solve(gram[:size, :size] / n + RIDGE * np.diag([1.0] * FEATURES + [1e-9]) + 1e-12 * np.eye(size), gram[:size, size] / n)
    model = Model(fourier, weights, np.array([]), np.array([]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor((np.clip(model.raw(_x(batch)), LOW, HIGH) - LOW) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(at), "y": batch.column("y")})

    bins = rows.filter("fold = 0").select("x", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).toArrow().sort_by("bin")
    if bins.num_rows:
        count, ones = bins["n"].to_numpy().astype(float), bins["ones"].to_numpy()
        model.at = LOW + (bins["bin"].to_numpy() + 0.5) / BINS
        model.level = np.clip(isotonic(ones / count, count), 0.001, 0.999)
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): 0.5 for all without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model(_x(batch)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(found)})

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with a score; empty and null texts are scored by their statistics, all zero."""
    stats = materialise(document_statistics(table(spark, sf_dir, "documents")))
    labels = own_columns(table(spark, sf_dir, "labels"), doc_id="doc_id", label="quality").filter(hash_mod("doc_id", 3) != 1)
    found = score(stats, fit(stats, labels))
    return found.select("doc_id", (hash_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
