"""Which codec and preprocessor serve a channel best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions.codecs import CODECS, PREPROCESSORS, compress, decompress, preprocess, restore


def codec_matrix(chunks: DataFrame, keys: list[str], codecs: list[str] = CODECS, preprocessors: list[str] = PREPROCESSORS) -> DataFrame:
    """(keys, codec, preprocessor, raw_bytes, encoded_bytes, stored_plain, round_trip) for every chunk (column ``samples``) and setting.

    A chunk that compression does not shorten is stored as it was transformed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, values in enumerate(batch.column("samples").to_pylist()):
                raw = np.asarray(values, "<f4").tobytes()
                for p in preprocessors:
                    changed = preprocess(raw, p)
                    for c in codecs:
                        packed = compress(changed, c)
                        plain = c == "None" or len(packed) >= len(raw)
                        back = restore(changed if plain else decompress(packed, c, len(changed)), p)
                        at.append(i)
                        rows.append((c, p, len(raw), len(changed) if plain else len(packed), plain, back == raw))
            cols = [pa.array(x) for x in zip(*rows)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())]
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *cols], names=[*keys, "codec", "preprocessor", "raw_bytes", "encoded_bytes", "stored_plain", "round_trip"])

    kinds = dict(chunks.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", codec string, preprocessor string, raw_bytes long, encoded_bytes long, stored_plain boolean, round_trip boolean"
    return chunks.select(*keys, "samples").mapInArrow(run, schema)


def recommend(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """The setting with the fewest bytes for each channel, ties by name, and its ratio."""
    total = matrix.groupBy(*keys, "codec", "preprocessor").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("encoded_bytes").alias("encoded_bytes"), F.min("round_trip").alias("round_trip"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("encoded_bytes", "codec", "preprocessor"))
    return total.withColumn("place", first).filter("place = 1").drop("place").withColumn("ratio", F.col("raw_bytes") / F.col("encoded_bytes"))
