"""Groups of consecutive rows that end where a total is reached, for all rows at once.

A group's end depends on where it begins, which a fold over the rows would
find one after the other. Here every row gets the row after the end that its
group would have if it began there, from prefix sums; groups are the chain of
these jumps from the first row. Chains are followed within spans of rows, all
beginnings at a time; across spans, jumps from span to span are doubled, so the
number of passes is the logarithm of the number of spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.operators import scans
from sigmill.plans.shared import materialise

#: Where no further group begins.
NEVER = 1 << 62
#: Rows that one call in Python takes, about, or one longer span: series can be many and short.
PACK = 1 << 14


def first_reaching(rows: DataFrame, keys: list[str], total: str, goal: Column, name: str, span: int = scans.SPAN) -> DataFrame:
    """``rows`` (pos, and ``total``, which never falls along pos) with the first position of the series whose total is at least the row's goal; null if none is.

    Totals and goals are sorted together, from the greatest: the least position
    seen by then is a goal's. This is a running minimum, in spans of the values.
    """
    at = lambda value, is_row: -(value * 2 + F.lit(is_row)).cast("long")  # noqa: E731  a row comes before the goals that it just reaches
    have = rows.select(*keys, at(F.col(total), 1).alias("__at"), F.col("pos").alias("__row"), F.lit(None).cast("long").alias("pos"))
    ask = rows.select(*keys, at(goal, 0).alias("__at"), F.lit(None).cast("long").alias("__row"), "pos")
    found = scans.running(have.unionByName(ask), keys, "__at", {name: ("min", F.col("__row"))}, inclusive=True, span=span)
    return rows.join(found.filter("pos IS NOT NULL").select(*keys, "pos", name), [*keys, "pos"], "left")


class _Spans:
    """The spans that a table holds, in order of their series: ``order`` sorts its rows, the rest is for the sorted rows."""

    def __init__(self, table: pa.Table, keys: list[str]):
        codes = [table.column(k).combine_chunks().dictionary_encode() for k in (*keys, "__span")]
        codes = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.fill_null(-1).to_numpy() for c in codes]
        pos = table.column("pos").to_numpy()
        self.order = np.lexsort((pos, *codes))
        self.pos, self.jump = pos[self.order], table.column("next").to_numpy()[self.order]
        change = np.zeros(len(pos), bool)
        change[:1] = True
        for code in codes:
            sorted_ = code[self.order]
            change[1:] |= sorted_[1:] != sorted_[:-1]
        self.heads = np.flatnonzero(change)  # the first row of each span
        self.size = np.diff(np.append(self.heads, len(pos)))
        each = lambda x: np.repeat(x, self.size)
        self.end = each(self.pos[self.heads] + self.size)
        self.shift = each(self.heads - self.pos[self.heads])  # from a position to its row

    def each(self, of_span: np.ndarray) -> np.ndarray:
        return np.repeat(of_span, self.size)


def _exits(table: pa.Table, keys: list[str]) -> pa.Table:
    """For rows of spans at which a chain can enter them: where the chain leaves the span, and the groups that begin in between."""
    s = _Spans(table, keys)
    to, n = s.jump.copy(), np.ones(len(s.jump), np.int64)
    while len(inside := np.flatnonzero(to < s.end)):
        via = to[inside] + s.shift[inside]
        to[inside], n[inside] = to[via], n[inside] + n[via]
    able = np.flatnonzero(s.pos <= s.each(np.minimum(s.jump, s.end)[s.heads]))  # jumps never fall along pos
    rows = table.select([*keys]).take(pa.array(s.order[able]))
    return rows.append_column("pos", pa.array(s.pos[able])).append_column("to", pa.array(to[able])).append_column("n", pa.array(n[able]))


def _numbered(table: pa.Table, keys: list[str]) -> pa.Table:
    """The rows of spans with their group, from the row at which the chain enters a span and the groups that began before."""
    s = _Spans(table, keys)
    size = len(s.jump)
    begins = np.zeros(size + 1, np.int64)
    entry = table.column("entry").combine_chunks().fill_null(-1).to_numpy()[s.order][s.heads]
    begins[(entry + s.shift[s.heads])[entry >= 0]] = 1
    ahead, seen = np.append(np.where(s.jump < s.end, s.jump + s.shift, size), size), 0
    while (count := int(begins[:size].sum())) > seen:  # each turn finds as many as there were
        seen = count
        begins[ahead[np.flatnonzero(begins)]] = 1
        ahead = ahead[ahead]
    total = np.concatenate([[0], np.cumsum(begins[:size])])
    begun = table.column("begun").to_numpy()[s.order]
    group = np.empty(size, np.int64)
    group[s.order] = begun - 1 + total[1:] - s.each(total[s.heads])
    return table.append_column("group", pa.array(group))


def groups(jumps: DataFrame, keys: list[str], span: int = scans.SPAN) -> DataFrame:
    """``jumps`` (keys, pos, next, ...) with ``group`` in place of ``next``.

    pos counts the rows of a series from 0; ``next`` is the row that begins the
    next group if one begins at pos, null if none does, and never falls along pos.
    """
    kinds = dict(jumps.dtypes)
    cut = materialise(jumps.withColumn("next", F.coalesce("next", F.lit(NEVER)).cast("long")).withColumn("__span", F.floor(F.col("pos") / span)))
    packs = max(1, -(-cut.count() // PACK))
    pack = F.pmod(F.xxhash64(*keys, "__span"), F.lit(packs)).alias("__pack")  # a span's rows are in one pack
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    step = materialise(cut.select(*keys, "__span", "pos", "next").groupBy(pack).applyInArrow(lambda t: _exits(t, keys), f"{schema}, pos long, to long, n long"))
    first = step
    reached = materialise(cut.filter("pos = 0").select(*keys, "pos", F.lit(0).cast("long").alias("begun")))
    while True:
        hop = reached.join(step.filter(F.col("to") < NEVER), [*keys, "pos"]).select(*keys, F.col("to").alias("pos"), (F.col("begun") + F.col("n")).alias("begun"))
        new = materialise(hop)
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        later = step.select(*keys, F.col("pos").alias("to"), F.col("to").alias("further"), F.col("n").alias("more"))
        step = materialise(step.join(later, [*keys, "to"]).select(*keys, "pos", F.col("further").alias("to"), (F.col("n") + F.col("more")).alias("n")))
    entered = reached.join(first, [*keys, "pos"]).select(*keys, F.floor(F.col("pos") / span).alias("__span"), F.col("pos").alias("entry"), "begun", (F.col("begun") + F.col("n")).alias("then"))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.select(*keys, "__span").distinct().join(entered, [*keys, "__span"], "left")  # a row for each span
    known = spans.select(*keys, "__span", "entry", F.coalesce("begun", F.max("then").over(earlier)).alias("begun"))
    left = [c for c in cut.columns if c not in ("__span", "next")]
    rows = cut.join(known, [*keys, "__span"])
    return rows.groupBy(pack).applyInArrow(lambda t: _numbered(t, keys).select([*left, "group"]), ", ".join([*(f"{c} {kinds[c]}" for c in left), "group long"]))
