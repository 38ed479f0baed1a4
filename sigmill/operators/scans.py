"""Running values and neighbours in long series: within spans first, then what the spans before carry in.

No window holds a whole series: rows are windowed by span of their order, and
a second window, over one row for each span, carries values across.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a span, about.
SPAN = 1 << 16

_MERGE: dict[str, Callable[[str], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}


def span_width(df: DataFrame, order: str, span: int = SPAN) -> int:
    """The width in ``order``, a whole number, of spans that have ``span`` rows on average, and at least ``span`` values."""
    n, low, high = df.agg(F.count(order), F.min(order), F.max(order)).first()
    return max(span, -(-(high - low + 1) * span // n)) if n else span


def _spans(df: DataFrame, order: str, width: int | None, span: int) -> DataFrame:
    width = width or span_width(df, order, span)
    return df.withColumn("__span", (F.col(order) - F.pmod(F.col(order), F.lit(width))).cast("long"))


def _carried(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``carry`` has for their series and span; a null key is a series too."""
    names = [*keys, "__span"]
    renamed = carry.withColumnsRenamed({c: f"__of_{c}" for c in names})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in names]
    return rows.join(renamed, same, "left").drop(*(f"__of_{c}" for c in names))


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], inclusive: bool = False, width: int | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with running values by name: ('sum' | 'max' | 'min', column) of the rows of the series before each row, or up to it.

    Null where there are none before. ``width``: of the spans, where it is known.
    """
    cut = _spans(df.withColumns({f"__in_{n}": c for n, (_, c) in values.items()}), order, width, span)
    totals = cut.groupBy(*keys, "__span").agg(*(_MERGE[how](f"__in_{n}").alias(f"__all_{n}") for n, (how, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "__span", *(_MERGE[how](f"__all_{n}").over(earlier).alias(f"__before_{n}") for n, (how, _) in values.items()))
    own = Window.partitionBy(*keys, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    both = _carried(cut.withColumns({f"__own_{n}": _MERGE[how](f"__in_{n}").over(own) for n, (how, _) in values.items()}), carry, keys)
    merge = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
    out = both.withColumns({n: merge[how](F.col(f"__before_{n}"), F.col(f"__own_{n}")) for n, (how, _) in values.items()})
    return out.drop("__span", *(f"__{part}_{n}" for part in ("in", "own", "before") for n in values))


def neighbour(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], after: bool = False, width: int | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with values by name of the row before, or after, in the series; null at its end."""
    cut = _spans(df.withColumn("__value", F.struct(*(c.alias(n) for n, c in values.items()))), order, width, span)
    edge = (F.min_by if after else F.max_by)("__value", order)
    edges = cut.groupBy(*keys, "__span").agg(edge.alias("__edge"))
    series, own = Window.partitionBy(*keys).orderBy("__span"), Window.partitionBy(*keys, "__span").orderBy(order)
    shift = F.lead if after else F.lag
    carry = edges.select(*keys, "__span", shift("__edge").over(series).alias("__beside"))
    both = _carried(cut.withColumn("__near", shift("__value").over(own)), carry, keys)
    found = F.coalesce("__near", "__beside")
    return both.withColumns({n: found[n] for n in values}).drop("__span", "__value", "__near", "__beside")
