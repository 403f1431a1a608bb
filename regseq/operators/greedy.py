"""Greedy choice without overlaps, by rounds of local dominance.

Taking the best element, dropping all that overlap it, and so on, looks like one walk through a
group.  But an element's fate hangs on its better neighbours only: it is taken if all better
ones that overlap it are dropped, and dropped if one of them is taken.  So groups are cut into
blocks of positions, each with copies of the elements around it, and a task decides in one walk
over a block, best first, all that does not hang on an undecided element beyond its bounds.
What is left goes into the next round; the best undecided element always settles, and a
second round is needed only where a chain of overlaps crosses a block's bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.operators import scan
from regseq.operators.graph import _cut

#: Positions of a block at least.
BLOCK = 1 << 16


def _breaks(b: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows that begin a group, and the batch's last key."""
    new = np.zeros(b.num_rows, bool)
    for k in keys:
        column = b.column(k)
        new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    first, end = (tuple(b.column(k)[i].as_py() for k in keys) for i in (0, b.num_rows - 1))
    new[0] = first != last
    return new, end


def _decide(batches: Iterator[pa.RecordBatch], keys: int, widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Own rows that are taken (true) or still open (null); rows come by group and block, best first.

    Columns: __k0 ... for group and block, __p0 ... for the starts of the parts, __own, __taken.
    """
    tile = max(widths)
    last: tuple | None = None
    met: dict[int, list[tuple[int, int, bool]]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        new, last = _breaks(b, [f"__k{i}" for i in range(keys)], last)
        parts = list(zip(*(b.column(f"__p{i}").to_pylist() for i in range(len(widths))), strict=True))
        keep, state = [], []
        for i, (begins, places, own, taken) in enumerate(zip(new.tolist(), parts, b.column("__own").to_pylist(), b.column("__taken").to_pylist(), strict=True)):
            if begins:
                met = {}
            open_ = gone = False
            if taken is None:
                for lo, w in zip(places, widths, strict=True):
                    hi = lo + w
                    for t in range(lo // tile, (hi - 1) // tile + 1):
                        for a, z, sure in met.get(t, ()):
                            if a < hi and lo < z:
                                open_ = True
                                gone |= sure
                if gone:
                    continue
                # A copy may meet better elements that this block does not see.
                taken = True if own and not open_ else None
            for lo, w in zip(places, widths, strict=True):
                for t in range(lo // tile, (lo + w - 1) // tile + 1):
                    met.setdefault(t, []).append((lo, lo + w, taken is True))
            if own:
                keep.append(i)
                state.append(taken)
        kept = b.take(pa.array(keep, pa.int64()))
        yield kept.set_column(kept.schema.get_field_index("__taken"), "__taken", pa.array(state, pa.bool_()))


def greedy(df: DataFrame, by: list[str], order: list[Column], parts: list[tuple[str, int]], most: int | None = None, rank: str | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of each group that are taken, best first, if none may overlap one taken before.

    order: the best row is the least by these; parts: a row covers `width` positions from each
    named column on, and two rows overlap if any of their parts do.  At most `most` of a group
    are taken; rank names a column for their place, from 1.  Of rows that order and parts do not
    tell apart one is taken.  Rows with an unknown part or group are left out.
    """
    widths = [w for _, w in parts]
    keys, places = [f"__k{i}" for i in range(len(by))], [f"__p{i}" for i in range(len(parts))]
    known = df.dropna(subset=[c for c, _ in parts] + by)
    orders = [f"__o{i}" for i in range(len(order))] + places
    rows = known.select(
        *(F.col(k).alias(n) for k, n in zip(by, keys, strict=True)), *(F.col(c).cast("long").alias(n) for (c, _), n in zip(parts, places, strict=True)),
        *(o.alias(n) for o, n in zip(order, orders[: len(order)], strict=True)), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(df.columns)),
    )
    lo = F.least(*places) if len(parts) > 1 else F.col("__p0")
    ends = [F.col(p) + w for p, w in zip(places, widths, strict=True)]
    hi = F.greatest(*ends) if len(parts) > 1 else ends[0]
    hull = widths[0] if len(parts) == 1 else rows.agg(F.max(hi - lo)).first()[0] or 1
    size = max(block, hull)
    at = lambda x: F.floor(x / size).cast("long")
    state = rows.withColumn("__taken", F.lit(None).cast("boolean"))
    schema = T.StructType([*state.schema.fields, T.StructField("__block", T.LongType()), T.StructField("__own", T.BooleanType())])
    schema = T.StructType([T.StructField(f"__k{len(by)}" if f.name == "__block" else f.name, f.dataType) for f in schema])
    walk = partial(_decide, keys=len(keys) + 1, widths=widths)
    while True:
        copies = state.withColumn(f"__k{len(by)}", F.explode(F.sequence(at(lo - hull), at(hi - 1)))).withColumn("__own", F.col(f"__k{len(by)}") == at(lo))
        group = [*keys, f"__k{len(by)}"]
        state = _cut(copies.repartition(*group).sortWithinPartitions(*group, *orders).mapInArrow(walk, schema).drop(f"__k{len(by)}", "__own"))
        if state.filter("__taken is null").isEmpty():
            break
    columns = [F.col(f"__c{i}").alias(c) for i, c in enumerate(df.columns)]
    if rank is None and most is None:
        return state.select(*columns)
    name = rank or "__rank"
    if most is None:
        ranked = scan.ranked(state, keys, orders, name)
    else:
        # A task hands on no more than `most` rows of a group.
        ranked = state.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))).filter(F.col(name) <= most)
    return ranked.select(*columns, *([name] if rank else []))
