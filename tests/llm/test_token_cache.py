import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sigmill.llm import token_cache
from sigmill.llm.token_cache import Vocabulary, cached, misses, pieces, token_counts

SPECIAL = "one <|endoftext|> two<|endoftext|>"
ROWS = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (4, "Hello world"), (None, "it's  9 o'clock\n\n\tnow "), (5, SPECIAL), (6, "naïve 漢字 🙂 \u0000 x"), (7, "word and " * 3000), (8, "a" * 5000), (9, " "), (10, "hello world")]


@pytest.fixture(scope="module")
def byte_level():
    return Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))


def brute(rows, vocabulary, limit=512):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if vocabulary.library == "tokenizers":
        model = Tokenizer.from_buffer(vocabulary.data)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    else:
        model = SentencePieceProcessor(model_proto=vocabulary.data)
        count = lambda t: len(model.encode(t))
    return sorted(((i, len((t or "").encode()), n := count(t or ""), n > limit) for i, t in rows), key=repr)


def result(df):
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_matches_the_library(docs_of, tmp_path, name):
    vocabulary = Vocabulary.read(public_tokenizers.path(name))
    docs = docs_of(ROWS).selectExpr("*", "1 AS digest", "2 AS tokenizer", "3 AS n_tokens", "4 AS n_bytes")
    assert result(token_counts(docs, vocabulary, f"file://{tmp_path}/cache")) == brute(ROWS, vocabulary)


def test_only_distinct_misses_are_encoded_and_appended(spark, docs_of, tmp_path, byte_level, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    stored = lambda: {bytes(r.digest): r.n_tokens for r in spark.read.schema(token_cache.CACHE).parquet(cache).collect()}
    files = lambda: spark.read.schema(token_cache.CACHE).parquet(cache).count()
    token_counts(docs_of(ROWS[:6]), byte_level, cache)
    assert files() == len(stored()) == 3  # "Hello world", "" and the clock
    for broadcast in (10, 0):  # both ways to the missing texts
        monkeypatch.setattr(token_cache, "BROADCAST", broadcast)
        n = files()
        more = [(20 + i, t) for i, (_, t) in enumerate(ROWS)] + [(90, f"new {broadcast}"), (91, f"new {broadcast}")]
        rows = spark.createDataFrame(more, "doc_id long, text string").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
        keyed = rows.select("doc_id", F.unhex("h").alias("digest"), "text")
        asked = misses(keyed.select("digest", "text"), keyed.select("digest"), cached(spark, cache, byte_level.version), broadcast).collect()
        new = {t or "" for _, t in more} - {t or "" for _, t in (ROWS[:6] if broadcast else ROWS)}
        if not broadcast:
            new -= {"new 10"}
        assert sorted(r.text for r in asked) == sorted(new)
        got = token_counts(docs_of(more), byte_level, cache)
        assert result(got) == brute(more, byte_level)
        assert files() == n + len(new)
    # all are known now: nothing is added, and the counts come from the cache
    n = files()
    assert result(token_counts(docs_of(ROWS), byte_level, cache)) == brute(ROWS, byte_level)
    assert files() == n


def test_counts_are_the_stored_ones_and_tokenizers_do_not_share(spark, docs_of, tmp_path, byte_level):
    cache = f"file://{tmp_path}/cache"
    token_counts(docs_of([(1, "one two")]), byte_level, cache).collect()
    other = Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    assert other.version != byte_level.version
    assert result(token_counts(docs_of([(1, "one two")]), other, cache)) == brute([(1, "one two")], other)
    # a run at the same time may have appended a text's count too
    spark.read.schema(token_cache.CACHE).parquet(cache).filter(F.col("tokenizer") == byte_level.version).write.partitionBy("tokenizer").mode("append").parquet(cache)
    assert result(token_counts(docs_of([(1, "one two"), (2, "one two")]), byte_level, cache)) == [(1, 7, 2, False), (2, 7, 2, False)]


def test_normalised_texts_share_a_count_and_keep_their_bytes(spark, docs_of, tmp_path):
    vocabulary = Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))  # ignores case and runs of white space
    rows = [(1, "Some  Words"), (2, "some words"), (3, "SOME\twords ")]
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    cache = f"file://{tmp_path}/cache"
    assert result(token_counts(docs_of(rows), vocabulary, cache, fold)) == brute(rows, vocabulary)
    assert spark.read.schema(token_cache.CACHE).parquet(cache).count() == 1


def test_empty_tables(spark, docs_of, tmp_path, byte_level):
    cache = f"file://{tmp_path}/cache"
    assert result(token_counts(docs_of([]), byte_level, cache)) == []
    token_counts(docs_of([(1, "x")]), byte_level, cache).collect()
    assert result(token_counts(docs_of([]), byte_level, cache)) == []


def test_long_texts_are_cut_where_a_token_ends(byte_level, monkeypatch):
    model = byte_level.counter()
    text = "".join(t or "" for _, t in ROWS) * 2 + "a b  c\nd e1 2f 's t'll go <|endoftext|> a" * 50
    assert byte_level.cuts and not Vocabulary.read(public_tokenizers.path("word_bpe_49k.json")).cuts
    for size in (1, 7, 100, 5000):
        cut = list(pieces(text, size))
        assert "".join(cut) == text and (size > 1000 or len(cut) > 50)
        assert sum(model(cut)) == model([text])[0]
    monkeypatch.setattr(token_cache, "ENCODED", 50)
    assert token_cache._count(byte_level, [text, "x", ""]) == [model([text])[0], 1, 0]


def test_unknown_files_are_an_error(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="no tokenizer"):
        Vocabulary.read(str(tmp_path / "a.txt"))


def test_query_on_a_whole_table(spark, tables, byte_level):
    path = tables(documents=([(i, t, "en", "s", 1) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long"))
    assert result(token_cache.op11_token_counts(spark, path)) == brute(ROWS, byte_level)
