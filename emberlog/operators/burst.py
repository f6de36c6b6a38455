"""Bursts of hits and their seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def burst_rows(hits: DataFrame, keys: tuple[str, ...], at: str, order: str, width: int, least: int) -> DataFrame:
    """Hits that some forward window of `width` (inclusive) with at least `least` hits covers, numbered by burst.

    `at` is a whole number. A window may start at any hit; overlapping windows make one burst; a gap above width or a
    hit outside all windows ends it. Ties count each by itself, in `order`. Built from window functions only.
    """
    by = Window.partitionBy(*keys)
    line = by.orderBy(at, order)
    upto = by.orderBy(at).rangeBetween(Window.unboundedPreceding, width)
    ahead = F.count("*").over(upto) - F.row_number().over(line) + 1
    h = hits.withColumn("_ahead", ahead)
    start = F.last(F.when(F.col("_ahead") >= least, F.col(at)), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = h.withColumn("_covered", F.coalesce(F.col(at) - start <= width, F.lit(False)))
    new = ~F.coalesce(F.lag("_covered").over(line), F.lit(False)) | (F.col(at) - F.lag(at).over(line) > width)
    h = h.withColumn("_new", F.when(F.col("_covered") & new, 1).otherwise(0))
    return h.withColumn("burst", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_covered").drop("_ahead", "_covered", "_new")


def bursts(hits: DataFrame, keys: tuple[str, ...], at: str, order: str, width: int, least: int) -> DataFrame:
    """(keys, burst, first_at, last_at, n_hits, refs): merged seeds; refs in time order."""
    rows = burst_rows(hits, keys, at, order, width, least)
    return merge_seeds(rows, (*keys, "burst"), at, order)


def merge_seeds(rows: DataFrame, keys: tuple[str, ...], at: str, order: str) -> DataFrame:
    refs = F.transform(F.array_sort(F.collect_list(F.struct(at, order))), lambda x: x[order])
    return rows.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_hits"), F.array_distinct(refs).alias("refs"))


def sessions(hits: DataFrame, keys: tuple[str, ...], at: str, order: str, gap: int) -> DataFrame:
    """Bursts with a threshold of one: runs with gaps of at most `gap`."""
    return bursts(hits, keys, at, order, gap, 1)


def over_threshold(seeds: DataFrame, level: str = "level", count: str = "n_hits", least: int = 5) -> DataFrame:
    """Low and medium seeds need `least` hits; any other level, null too, always stays."""
    return seeds.where(~F.coalesce(F.col(level).isin("low", "medium"), F.lit(False)) | (F.col(count) >= least))


def alert_severity(number: Column, signature: Column) -> Column:
    """1 high, 2 medium, else low; policy signatures are always low."""
    n = number.try_cast("int")
    return F.when(F.startswith(signature, F.lit("ET POLICY")), "low").when(n == 1, "high").when(n == 2, "medium").otherwise("low")


def clean_signature(text: Column, default: Column | None = None) -> Column:
    """Control characters to spaces, runs of white space to one, at most 256 characters, never empty."""
    short = F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Cntrl}", " "), r"\s+", " ")), 1, 256)
    return F.coalesce(F.nullif(short, F.lit("")), default if default is not None else F.lit("unknown signature"))
