"""Joins that Spark has no operator for: range, unique-candidate, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.scan import dealt, last_of, running


def range_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, width: int, keys: tuple[tuple[str, str], ...] = (), low: int | None = None) -> DataFrame:
    """Pairs with -width <= right_at - left_at <= width (or low <= right_at - left_at <= width), and equal keys.

    A right row lies in one bucket of `width`; a left row looks into those its range touches, so the join is a hash or
    sort-merge join on (bucket, keys) instead of a nested loop. Columns of the two sides must differ in name. Null
    places and null keys match nothing.
    """
    low = -width if low is None else low
    step = max(1, width - min(low, 0)) if low <= 0 else max(1, width - low)
    buckets = F.sequence(F.floor((F.col(left_at) + low) / step), F.floor((F.col(left_at) + width) / step))
    a = left.where(F.col(left_at).isNotNull()).withColumn("_bucket", F.explode(buckets))
    b = right.withColumn("_bucket2", F.floor(F.col(right_at) / step))
    on = F.col("_bucket") == F.col("_bucket2")
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    gap = F.col(right_at) - F.col(left_at)
    return a.join(b, on).where(gap.between(low, width)).drop("_bucket", "_bucket2")


def unique_only(pairs: DataFrame, *by: str) -> DataFrame:
    """Pairs whose `by` has exactly one candidate."""
    return pairs.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, left_id: str, left_at: str, right_at: str, keys: tuple[tuple[str, str], ...], tie: str, slack: int = 0, parts: int | None = None) -> DataFrame:
    """For each left row the right row with the latest right_at <= left_at + slack, then the largest tie; left rows without one stay.

    Both sides are merged and dealt by range of (keys, time), and a running last value finds the match, so no pairs are
    made; a key that fills several of the ranges (`parts` of them, else as the session has it) takes its last right row from
    one into the next. Null keys match nothing. left_id names the left rows and only breaks ties of the order.
    """
    names = [x for x, _ in keys]
    found = F.struct(*(F.col(c).alias(c) for c in right.columns))
    zero = F.lit(None).cast(right.select(found.alias("r")).schema["r"].dataType)
    one = left.select(*(F.col(x).alias(f"k{i}") for i, x in enumerate(names)), (F.col(left_at) + slack).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"), F.struct(*left.columns).alias("l"), zero.alias("r"))
    none = F.lit(None).cast(one.schema["l"].dataType)
    two = right.select(*(F.col(y).alias(f"k{i}") for i, (_, y) in enumerate(keys)), F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(tie).alias("tie"), none.alias("l"), found.alias("r"))
    by, order = tuple(f"k{i}" for i in range(len(keys))), ("at", "side", "tie")
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    merged = dealt(one.where(known).unionByName(two.where(known)), by, order, parts)
    m = running(merged, by, order, {"m": last_of(F.col("r"), F.struct("at", "side", "tie"))})
    hit = m.where("side = 1").select("l.*", *(F.col(f"m.{c}").alias(c) for c in right.columns))
    return hit.unionByName(one.where(~known).select("l.*", *(F.col(f"r.{c}").alias(c) for c in right.columns)))


def followed(left: DataFrame, right: DataFrame, left_at: str, right_at: str, width: int, keys: tuple[tuple[str, str], ...] = (), left_id: str = "id") -> DataFrame:
    """Ids of left rows that some right row follows within 0..width."""
    return range_join(left, right, left_at, right_at, width, keys, low=0).select(left_id).distinct()


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone, under a UTC session."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
