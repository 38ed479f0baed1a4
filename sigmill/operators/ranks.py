"""Dense positions within long series, without a series going to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order values that are ranked together by one task.
SPAN = 1 << 20


def with_positions(df: DataFrame, keys: list[str], order: str, position: str = "pos", total: str | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with the rank of each row (from 0) in its series by the whole number ``order``, and the series' length.

    Rows are ranked within spans of the order, and moved on by the counts of
    the spans before, so that no window holds more than a span of a series.
    """
    cut = df.withColumn("__span", F.floor(F.col(order) / span))
    counts = cut.groupBy(*keys, "__span").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("__n").over(Window.partitionBy(*keys)))
    own = Window.partitionBy(*keys, "__span").orderBy(order)
    ranked = cut.withColumn("__rank", F.row_number().over(own) - 1).join(counts.drop("__n"), [*keys, "__span"])
    return ranked.withColumn(position, (F.col("__before") + F.col("__rank")).cast("long")).drop("__span", "__rank", "__before")


def _is_small(df: DataFrame, limit: int, most_bytes: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows of at most ``most_bytes``; texts are measured, other columns that vary in size are not small."""
    kinds = dict(df.dtypes)
    if any(k.startswith(("array", "map", "struct", "binary")) for k in kinds.values()):
        return False
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, k in kinds.items() if k == "string"]
    size = sum(texts, F.lit(8 * len(kinds)))
    n, held = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= limit and held <= most_bytes


def small(df: DataFrame, limit: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it is small; larger ones are joined by a shuffle."""
    return F.broadcast(df) if _is_small(df, limit, most_bytes) else df


def each_with_all(rows: DataFrame, others: DataFrame, limit: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """Every row of ``rows`` with every one of ``others``.

    Small ``others`` are broadcast. Larger ones are dealt into bins of about
    ``limit``, which each row visits in turn, so that no task meets all of them.
    """
    if _is_small(others, limit, most_bytes):
        return rows.join(F.broadcast(others))
    bins = max(2, -(-others.count() // limit))
    dealt = others.withColumn("__bin", F.pmod(F.xxhash64(*others.columns), F.lit(bins)))
    return rows.withColumn("__bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(dealt, "__bin").drop("__bin")
