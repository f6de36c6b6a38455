"""Interval joins of two streams with watermarks on both sides.

Spark keeps a row only for as long as the other side can still bring a partner: the watermarks and the interval bound
the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.links import WEB_UID

LATE = "60 minutes"


def interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, low_ms: int, high_ms: int, on: Column | None = None, late: str = LATE) -> DataFrame:
    """Pairs with low_ms <= right_ts - left_ts <= high_ms that `on` holds for. Columns of the two sides must differ in name.

    Without `on` the sides are joined by slots of the interval's width: a left row goes to those that its interval touches.
    """
    a, b = left.withWatermark(left_ts, late), right.withWatermark(right_ts, late)
    near = F.expr(f"{right_ts} >= {left_ts} + make_dt_interval(0, 0, 0, {low_ms / 1000}) AND {right_ts} <= {left_ts} + make_dt_interval(0, 0, 0, {high_ms / 1000})")
    if on is not None:
        return a.join(b, near & on)
    slot = lambda c, ms=0: F.floor((F.unix_millis(F.col(c)) + ms) / max(1, high_ms - low_ms))
    a = a.withColumn("_slot_a", F.explode(F.sequence(slot(left_ts, low_ms), slot(left_ts, high_ms))))
    return a.join(b.withColumn("_slot_b", slot(right_ts)), near & (F.col("_slot_a") == F.col("_slot_b"))).drop("_slot_a", "_slot_b")


def _layer(events: DataFrame, layer: str, suffix: str, *fields: str) -> DataFrame:
    named = (F.col(c).alias(f"{c.split('.')[-1]}_{suffix}") for c in ("raw_ref", *fields))
    return events.where(F.col("layer") == layer).select(F.col("ts").alias(f"ts_{suffix}"), *named)


def _same(*fields: str) -> Column:
    on = F.lit(True)
    for c in fields:
        on = on & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    return on


def web_network(web: DataFrame, network: DataFrame, late: str = LATE) -> DataFrame:
    """(a, b, kind): sensor requests b with a valid forwarded client and the only web request a of the same client, method,
    path and status within a second. A request comes out when no further candidate can come."""
    fields = ("src_ip", "ld.method", "ld.path", "ld.status")
    one = _layer(web, "web", "a", *fields)
    two = _layer(network.where("ld.xff_status = 'valid'"), "network", "b", *fields)
    pairs = interval_join(one, two, "ts_a", "ts_b", -1000, 1000, _same("src_ip", "method", "path", "status"), late)
    found = pairs.groupBy("ts_b", "raw_ref_b").agg(F.min("raw_ref_a").alias("a"), F.max("raw_ref_a").alias("z"))
    return found.where("a = z").select("a", F.col("raw_ref_b").alias("b"), F.lit("web_network").alias("kind"))


def web_system(web: DataFrame, system: DataFrame, late: str = LATE) -> DataFrame:
    """(a, b, kind): audit events of the web server's user within five seconds of a request; streams with `machine` match on it."""
    has = "machine" in web.columns and "machine" in system.columns
    cols = ("machine",) if has else ()
    two = _layer(system.where(F.col("ld.uid") == WEB_UID), "system", "b", *cols)
    pairs = interval_join(_layer(web, "web", "a", *cols), two, "ts_a", "ts_b", -5000, 5000, late=late)
    if has:
        pairs = pairs.where(F.coalesce(F.col("machine_a") == F.col("machine_b"), F.lit(True)))
    return pairs.select(F.col("raw_ref_a").alias("a"), F.col("raw_ref_b").alias("b"), F.lit("web_system").alias("kind"))


def followed(requests: DataFrame, commands: DataFrame, request_ts: str, command_ts: str, width_seconds: int = 120, on: Column | None = None, late: str = LATE) -> DataFrame:
    """Pairs of requests and the commands that follow them within 0 to width_seconds (a one-sided interval)."""
    return interval_join(requests, commands, request_ts, command_ts, 0, width_seconds * 1000, on, late)
