"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.plans import shared

#: Longest run of documents that a Python task handles at once, in bytes of text.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; checkpoints go there too."""
    found = shared.shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, with a folder for each value of ``by``: computed once, safe when executors are lost, deleted when the application ends."""
    path = shared.scratch(df.sparkSession, "stage")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator works on, under its own names, so that others cannot clash."""
    return df.select(*(df[name].alias(alias) for alias, name in columns.items()))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no column that it could be taken for."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hash_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of the binary column ``text``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over batches of bounded text; ``fn`` returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            if out := fn(batch):
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def filter_arrow(df: DataFrame, keep: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> DataFrame:
    """The rows that ``keep`` leaves of each batch, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            yield keep(batch)

    return df.mapInArrow(run, df.schema)
