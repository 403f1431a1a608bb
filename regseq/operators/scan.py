"""Running totals in two levels, for groups that no task can hold.

A window over a group puts the group into one task.  Here rows are dealt by ranges of
(keys, order), so that a group lies in one range or in several that follow each other.  Each
range is scanned by itself; one row a range then says what the range holds of the group it
ends with, and what comes into the group it begins with is carried on from range to range on
the driver, in a table as long as the ranges are many, whatever the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.operators.graph import _cut

_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min}
#: How what came before and the range's own total join; null is the total of nothing.
_JOIN = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}


def _place(x: object) -> tuple:
    """A key that orders values as Spark does: nulls first, NaN last, structs field by field."""
    if x is None:
        return (0,)
    if isinstance(x, tuple):
        return (1, tuple(_place(v) for v in x))
    return (1, True, 0) if isinstance(x, float) and math.isnan(x) else (1, False, x)


def _joined(kind: str, a: object, b: object) -> object:
    if a is None or b is None:
        return a if b is None else b
    return a + b if kind == "sum" else (max if kind == "max" else min)(a, b, key=_place)


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def dealt(df: DataFrame, keys: list[str], order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """df in ranges of (keys, order), numbered in `__range` from low to high.

    The order should tell rows apart: equal rows lie in one range.  Bounds come from a sample,
    so the rows are written once, and all later steps see the same ranges.
    """
    by = [F.col(k) for k in keys] + _columns(order)
    spread = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return _cut(spread.withColumn("__range", F.spark_partition_id()))


def _carried(rows: DataFrame, key: Column, kinds: dict[str, str], back: bool) -> DataFrame | None:
    """(__range, __first, __in): for ranges that continue a group, its key and what the ranges before (behind) hold
    of it; None if no group goes over a bound."""
    sums = rows.groupBy("__range", key.alias("__key")).agg(F.struct(*(_LOCAL[k](n).alias(n) for n, k in kinds.items())).alias("__sum"))
    low, high = F.min("__key"), F.max("__key")
    first, last, of_last = (high, low, F.min_by) if back else (low, high, F.max_by)
    ends = sums.groupBy("__range").agg(first.alias("first"), last.alias("last"), of_last("__sum", "__key").alias("sum"))
    out, at, held = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["__range"], reverse=back):
        if at is not None and _place(r["first"]) == _place(at):
            out.append((r["__range"], r["first"], held))
        if at is not None and _place(r["last"]) == _place(at):
            held = tuple(_joined(k, a, b) for k, a, b in zip(kinds.values(), held, r["sum"], strict=True))
        else:
            at, held = r["last"], tuple(r["sum"])
    if not out:
        return None
    types = [("__range", T.IntegerType()), ("__first", ends.schema["first"].dataType), ("__in", ends.schema["sum"].dataType)]
    return rows.sparkSession.createDataFrame(out, T.StructType([T.StructField(n, t) for n, t in types]))


def scanned(parts: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, tuple[str, Column]], before: bool = False, back: bool = False) -> DataFrame:
    """Dealt rows with a running total for each name in `totals`: (sum, max or min, expression).

    A total runs from its group's first row to the row itself, or with `before` to the row
    before it; with `back` it runs from the group's end, and order is the reverse of that dealt
    by.  Nulls add nothing, and the total of nothing is null.  Keys may be null; without keys all
    rows are one group.  The largest struct of (order, value) is the last value.
    """
    names = {n: f"__t{i}" for i, n in enumerate(totals)}
    kinds = {names[n]: k for n, (k, _) in totals.items()}
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.lit(0).alias("k"))
    rows = parts.withColumns({names[n]: e for n, (_, e) in totals.items()})
    carried = _carried(rows, key, kinds, back)
    w = Window.partitionBy("__range", *keys).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = rows.withColumns({t: _LOCAL[k](t).over(w) for t, k in kinds.items()})
    if carried is None:
        return local.withColumns({n: F.col(t) for n, t in names.items()}).drop(*kinds)
    both = local.join(F.broadcast(carried), "__range", "left")
    on = F.coalesce(key.eqNullSafe(F.col("__first")) & F.col("__in").isNotNull(), F.lit(False))
    full = {n: F.when(on, _JOIN[kinds[t]](F.col("__in")[t], F.col(t))).otherwise(F.col(t)) for n, t in names.items()}
    return both.withColumns(full).drop("__first", "__in", *kinds)


def prefix_scan(df: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """df with running totals by group and order; no task holds a whole group.  See `scanned`."""
    return scanned(dealt(df, keys, order), keys, order, totals, before).drop("__range")


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with each row's place in its group, from 1 (int, as row_number gives it)."""
    return prefix_scan(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name).cast("int"))
