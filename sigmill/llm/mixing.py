"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmill.llm.common import free_names, materialise, table

SEED = 17
#: Bytes up to which the table of distributions is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
_DIGITS = 13
#: Copies that one array of them holds.
_RUN = 1000
#: ln k! by Stirling's series, good to a double for the k from 64 on that it is used for.
_LOG_FACTORIAL = "(k * ln(k) - k + 0.5 * ln(2 * pi() * k) + 1.0 / (12 * k) - 1.0 / (360 * k * k * k))"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``rates`` (source_key, rate) with ``low`` and ``steps``: the distribution function at low, low + 1, ... as far as it matters to a double.

    Below ``low`` it is zero to a double; the array grows as the square root of
    the rate.
    """
    wide = 12 * F.sqrt("rate") + 30
    low = F.floor(F.col("rate") - wide).cast("long")
    grid = rates.withColumn("low", F.when(low < 64, F.lit(0)).otherwise(low).cast("long"))
    grid = grid.withColumn("k", F.explode(F.sequence(F.col("low"), F.ceil(F.col("rate") + wide).cast("long"))))
    by = W.partitionBy("source_key").orderBy("k")
    base = F.when(F.col("low") > 0, F.expr(_LOG_FACTORIAL.replace("k", "cast(low as double)").replace("1.0", "1.0D").replace("0.5", "0.5D"))).otherwise(0.0)
    more = F.sum(F.when(F.col("k") > F.col("low"), F.log(F.greatest("k", F.lit(1)).cast("double"))).otherwise(0.0)).over(by)
    mass = F.exp(F.col("k") * F.log("rate") - F.col("rate") - base - more)
    cdf = grid.withColumn("mass", F.when(F.col("rate") > 0, mass).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))).withColumn("cdf", F.sum("mass").over(by))
    return cdf.groupBy("source_key").agg(F.first("rate").alias("rate"), F.first("low").alias("low"), F.array_sort(F.collect_list("cdf")).alias("steps"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, each row as often as a Poisson draw says, shuffled; with copy (from 1), rate and shuffle_key.

    A source gets ``weights[source]`` (all the same where no weights are given;
    0 for a source that they leave out) of ``budget`` times all characters, and
    its rate is that over its own characters. The draw inverts the Poisson
    distribution at the md5 of seed and id, so that a row repeated with its id
    is drawn alike, and so are all null ids. A null source counts as the empty
    one; null texts have no characters; a source without any gets rate 0.
    Columns named copy, rate or shuffle_key are replaced; all others pass.
    """
    source = F.coalesce(source_col, F.lit(""))
    sizes = materialise(docs.groupBy(source.alias("source_key")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("double").alias("size")))
    if weights is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "source_key string, weight double")
        weighted = sizes.join(given, "source_key", "left").fillna(0.0, ["weight"])
    all_size, all_weight = weighted.agg(F.sum("size"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(all_weight or 1.0) * F.lit(float(budget)) * F.lit(all_size or 0.0)
    steps = materialise(poisson_steps(weighted.select("source_key", F.when(F.col("size") > 0, share / F.col("size")).otherwise(0.0).alias("rate"))))
    held = steps.agg(F.sum(F.octet_length("source_key") + 8 * F.size("steps") + 64)).first()[0] or 0
    mixed, own, u, n, run = free_names(docs, "mix", "mix_key", "mix_u", "mix_n", "mix_run")
    rates = steps.select(F.struct("source_key", "rate", "low", "steps").alias(mixed))
    if held <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    keyed = docs.drop("copy", "rate", "shuffle_key").withColumn(own, source).withColumn(u, uniform(F.lit(str(seed)), key))
    below = F.size(F.filter(F.col(mixed)["steps"], lambda c: c <= F.col(u))).cast("long")
    drawn = keyed.join(rates, F.col(own) == F.col(mixed)["source_key"]).withColumn(n, F.when(below > 0, F.col(mixed)["low"]).otherwise(0) + below).filter(F.col(n) > 0)
    runs = drawn.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {_RUN}"))))
    first = F.col(run) * _RUN
    copies = runs.withColumn("copy", F.explode(F.sequence((first + 1).cast("int"), F.least(n, first + _RUN).cast("int"))))
    copies = copies.withColumns({"rate": F.col(mixed)["rate"], "shuffle_key": F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.col("copy").cast("string")))})
    return copies.drop(mixed, own, u, n, run).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all documents at equal weights; see there for nulls, ties, repeated rows and empty tables."""
    return mix(table(spark, sf_dir, "documents")).drop("rate")


OP8_SQL = f"""
WITH sizes AS (SELECT coalesce(source, '') AS source_key, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY 1),
rates AS (SELECT source_key, CASE WHEN size > 0 THEN 1.0::DOUBLE / (SELECT CAST(count(*) AS DOUBLE) FROM sizes) * 1.0::DOUBLE * (SELECT sum(size) FROM sizes) / size ELSE 0.0 END AS rate FROM sizes),
ends AS (SELECT source_key, rate, CASE WHEN floor(rate - (12 * sqrt(rate) + 30)) < 64 THEN 0 ELSE CAST(floor(rate - (12 * sqrt(rate) + 30)) AS BIGINT) END AS low FROM rates),
based AS (SELECT *, CASE WHEN low > 0 THEN {_LOG_FACTORIAL.replace("k", "greatest(CAST(low AS DOUBLE), 1)")} ELSE 0 END AS base FROM ends),
grid AS (SELECT *, unnest(range(low, CAST(ceil(rate + (12 * sqrt(rate) + 30)) AS BIGINT) + 1)) AS k FROM based),
mass AS (SELECT source_key, low, k, CASE WHEN rate > 0 THEN exp(k * ln(CASE WHEN rate > 0 THEN rate ELSE 1 END) - rate - base - sum(CASE WHEN k > low THEN ln(CAST(greatest(k, 1) AS DOUBLE)) ELSE 0 END) OVER (PARTITION BY source_key ORDER BY k))
                WHEN k = 0 THEN 1.0 ELSE 0.0 END AS mass FROM grid),
cdf AS (SELECT source_key, low, k, sum(mass) OVER (PARTITION BY source_key ORDER BY k) AS cdf FROM mass),
steps AS (SELECT source_key, min(low) AS low, list(cdf ORDER BY k) AS steps FROM cdf GROUP BY 1),
below AS (SELECT d.*, s.low, len(list_filter(s.steps, lambda c: c <= CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {_DIGITS}) AS BIGINT) AS DOUBLE) / {float(16**_DIGITS)})) AS n
          FROM documents d JOIN steps s ON s.source_key = coalesce(d.source, '')),
drawn AS (SELECT *, CASE WHEN below.n > 0 THEN below.low + below.n ELSE 0 END AS total FROM below),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, total + 1)) AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key FROM copies
"""
