"""Running values along an order within keys of any size.

Rows are dealt by range of (key, order), so a key with a third of all rows spreads over many parts. Windows run inside a
part; what a key's earlier parts come to is carried into the next from a table of totals, of which only the keys that
cross a border are needed: one row for each part at most, which is why it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import cut

#: (aggregate over a window in order, its value, a part's result in any order, how two results make one)
Spec = tuple[Callable[[Column], Column], Column, Column, Callable[[Column, Column], Column]]


def dealt(rows: DataFrame, keys: tuple[str, ...], order: tuple, parts: int | None = None) -> DataFrame:
    """rows, written, with the number of the range that they lie in as _part. Rows that are equal in keys and order share a part."""
    ranged = rows.repartitionByRange(*([parts] if parts else []), *keys, *order)
    return cut(ranged.withColumn("_part", F.spark_partition_id()), "dealt")


def last_of(value: Column, order: Column) -> Spec:
    """The last value that is not null."""
    return lambda c: F.last(c, ignorenulls=True), value, F.max_by(value, F.when(value.isNotNull(), order)), lambda before, own: F.coalesce(own, before)


def sum_of(value: Column) -> Spec:
    return F.sum, value, F.sum(value), lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))


def max_of(value: Column) -> Spec:
    return F.max, value, F.max(value), lambda before, own: F.greatest(before, own)


def running(rows: DataFrame, keys: tuple[str, ...], order: tuple, specs: dict[str, Spec], inclusive: bool = True) -> DataFrame:
    """The rows of dealt() with a running value for each spec, with or without the row itself. Null keys are one key."""
    last = Window.currentRow if inclusive else -1
    line = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    out = rows.withColumns({n: f(v).over(line) for n, (f, v, _, _) in specs.items()})
    # a key that goes on behind a border is the largest one of its part, so totals are made of these alone
    ends = rows.groupBy("_part").agg(F.max(F.struct(*(F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)))).alias("_end")).select("_end.*").distinct()
    ended = F.lit(True)
    for i, k in enumerate(keys):
        ended = ended & F.col(k).eqNullSafe(F.col(f"_e{i}"))
    totals = rows.join(F.broadcast(ends), ended, "left_semi").groupBy(*keys, "_part").agg(*(t.alias(n) for n, (_, _, t, _) in specs.items()))
    by = Window.partitionBy(*keys)
    totals = totals.withColumn("_parts", F.count("*").over(by)).where("_parts > 1")
    step = by.orderBy("_part")
    before = step.rowsBetween(Window.unboundedPreceding, -1)
    names = (*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), (F.row_number().over(step) > 1).alias("_late"))
    carried = totals.select(*names, *(f(F.col(n)).over(before).alias(f"_{n}") for n, (f, _, _, _) in specs.items())).where("_late")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = out.join(F.broadcast(carried), same, "left")
    both = both.withColumns({n: F.when(F.col("_late"), join(F.col(f"_{n}"), F.col(n))).otherwise(F.col(n)) for n, (_, _, _, join) in specs.items()})
    return both.drop("_p", "_late", *(f"_k{i}" for i in range(len(keys))), *(f"_{n}" for n in specs))
