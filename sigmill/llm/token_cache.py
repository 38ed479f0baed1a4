"""Token counts through a cache of digests.

A count is stored under the digest of the normalised text and the digest of the
tokenizer (its file, its library and that library's version). Texts whose digests are
stored are not encoded again; of the others each distinct text is encoded once
and its count appended. The cache is a Parquet table with a partition for each
tokenizer, in a folder that all executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.common import chunks, materialise, shared_dir, table

LIMIT = 512
#: Bytes of text that are encoded at once; longer texts are cut where a token must end, if their tokenizer has such places.
ENCODED = 1 << 20
#: So many missing digests, of 32 bytes each, may be broadcast to the scan of the texts.
BROADCAST = 200_000
CACHE = "tokenizer string, digest binary, n_tokens long"
#: A space between two letters, before which byte-level pre-tokenizers end a token whatever is around it.
CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer's file, small enough to be sent to every task, and the library that reads it."""

    library: str
    data: bytes

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Of a .json file (tokenizers) or a .model file (sentencepiece)."""
        kinds = {".json": "tokenizers", ".model": "sentencepiece"}
        if (suffix := Path(path).suffix) not in kinds:
            raise ValueError(f"no tokenizer is known for {path}")
        return cls(kinds[suffix], Path(path).read_bytes())

    @cached_property
    def version(self) -> str:
        release = __import__(self.library).__version__
        return hashlib.sha256(f"{self.library} {release}\n".encode() + self.data).hexdigest()

    @cached_property
    def cuts(self) -> bool:
        """Whether texts can be cut at ``CUT``: no normaliser, byte-level words, and special tokens that do not touch spaces."""
        if self.library != "tokenizers":
            return False
        spec = json.loads(self.data)
        words = spec.get("pre_tokenizer") or {}
        plain = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
        return plain and not spec.get("normalizer") and words.get("type") == "ByteLevel" and not words.get("add_prefix_space") and words.get("use_regex", True)

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Counts the tokens of texts, without begin, end or other added tokens, and never cut off or filled up."""
        if self.library == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_buffer(self.data)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: str, size: int = ENCODED) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters, each ending where a byte-level token must."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def _count(vocabulary: Vocabulary, texts: list[str]) -> list[int]:
    if vocabulary.version not in _COUNTERS:
        _COUNTERS[vocabulary.version] = vocabulary.counter()
    counter = _COUNTERS[vocabulary.version]
    cut = lambda text: pieces(text) if vocabulary.cuts else [text]
    return [sum(sum(counter([p])) for p in cut(t)) for t in texts] if any(len(t) > ENCODED for t in texts) else counter(texts)


def encode(distinct: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(tokenizer, digest, n_tokens) of a (digest, text) table."""
    held = distinct.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", ENCODED):
            n = _count(held.value, [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([held.value.version] * len(n), pa.string()), batch.column("digest"), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return distinct.select("digest", F.col("text").cast("binary").alias("text")).mapInArrow(run, CACHE)


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) that the cache has of a tokenizer, each digest once; None if it has nothing of it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    # runs at the same time may both have appended a text's count
    return spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/tokenizer={version}").dropDuplicates(["digest"])


def misses(texts: DataFrame, rows: DataFrame, known: DataFrame | None, broadcast: int = BROADCAST) -> DataFrame:
    """(digest, text): each text of the (digest, text) table ``texts`` once whose digest is not ``known``.

    What is missing is found among the digests alone. If it is little, it is
    broadcast to the scan of the texts, so only missing texts move; else the
    texts are made distinct, within tasks first, and meet it by a shuffle.
    """
    if known is None:
        return texts.dropDuplicates(["digest"])
    missing = materialise(rows.select("digest").distinct().join(known, "digest", "left_anti"))
    if missing.count() <= broadcast:
        return texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
    return texts.dropDuplicates(["digest"]).join(missing.hint("shuffle_hash"), "digest", "left_semi")


def token_counts(docs: DataFrame, vocabulary: Vocabulary, cache: str, normalise: Callable[[Column], Column] | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row for each of ``docs``, by way of the cache in the folder ``cache``.

    Null texts are empty ones. Rows that repeat, or have no id, are rows of
    their own; rows with one text share its count. Texts are encoded whole,
    special strings in them as the library does by default. No rows give no
    rows. Other columns are not looked at. ``normalise`` is for tokenizers that
    ignore a difference between texts (so that these share a digest) and must
    not change a count; ``n_bytes`` is that of the text itself.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = normalise(text) if normalise else text
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("text"))
    rows = materialise(keyed.drop("text"))
    new = encode(misses(keyed.select("digest", "text"), rows, cached(spark, cache, vocabulary.version)), vocabulary)
    new.write.partitionBy("tokenizer").mode("append").parquet(cache)
    known = cached(spark, cache, vocabulary.version)
    if known is None:  # nothing was there to be encoded
        known = spark.createDataFrame([], "digest binary, n_tokens long")
    # a table of its own: a text that a third of the rows have is then a side of a join that can be split
    known = materialise(known.join(rows.select("digest").distinct(), "digest", "left_semi"))
    lost = F.raise_error(F.lit("a text's count is not in the cache")).cast("long")
    n = F.coalesce("n_tokens", lost)
    return rows.join(known, "digest", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_counts`` of all documents by the byte-level vocabulary of 50,257, from an empty cache; see there for nulls, ties, repeated rows and empty tables."""
    import uuid

    import public_tokenizers

    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts(table(spark, sf_dir, "documents"), vocabulary, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
