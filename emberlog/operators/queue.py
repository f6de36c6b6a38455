"""Incident state from run to run and the investigation queue (J16, K3 to K7, A16, O4). Snapshots in, snapshots out; one writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 24 * 3600


def state_diff(now: DataFrame, state: DataFrame, at: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Compare incidents (incident_key, window_end, member_count) with state (incident_key, window_end, max_member_count, last_seen).

    emit is new, update (a later end or more members) or silent; ends and counts only grow; states older than the
    time to live count as gone, so their incidents are new again. Rows of state without incident stay as they are, emit null.
    """
    live = state.where(F.col("last_seen") >= at - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    s = live.select("incident_key", F.col("window_end").alias("_end"), F.col("max_member_count").alias("_count"), F.col("last_seen").alias("_seen"))
    j = now.select("incident_key", "window_end", "member_count").join(s, "incident_key", "full")
    grown = (F.col("window_end") > F.col("_end")) | (F.col("member_count") > F.col("_count"))
    emit = F.when(F.col("member_count").isNull(), F.lit(None)).when(F.col("_count").isNull(), "new").when(grown, "update").otherwise("silent")
    return j.select(
        "incident_key", emit.alias("emit"), F.greatest("window_end", "_end").alias("window_end"), F.greatest("member_count", "_count").alias("max_member_count"),
        F.when(F.col("member_count").isNull(), F.col("_seen")).otherwise(at).alias("last_seen"),
    )


def upsert(queue: DataFrame, changed: DataFrame, at: Column) -> DataFrame:
    """Next snapshot of queue (incident_key, status, has_update, triage_score, route, updated_at) after changed (incident_key, triage_score, route).

    Absent rows enter as pending; done rows open again; rows under investigation are marked as having news.
    """
    c = changed.select("incident_key", F.col("triage_score").alias("_score"), F.col("route").alias("_route"), F.lit(True).alias("_new"))
    j = queue.join(c, "incident_key", "full")
    hit = F.coalesce("_new", F.lit(False))
    status = F.when(F.col("status").isNull() | (hit & (F.col("status") == "done")), "pending").otherwise(F.col("status"))
    return j.select(
        "incident_key", status.alias("status"), F.when(hit & (F.col("status") == "investigating"), True).otherwise(F.coalesce("has_update", F.lit(False))).alias("has_update"),
        F.coalesce("_score", "triage_score").alias("triage_score"), F.coalesce("_route", "route").alias("route"), F.when(hit, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def transition(queue: DataFrame, keys: DataFrame, before: str, after: str, at: Column) -> DataFrame:
    """Claim (pending to investigating), finish (investigating to done) or release the given keys; news on finish opens again."""
    j = queue.join(keys.select("incident_key").distinct().withColumn("_hit", F.lit(True)), "incident_key", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == before)
    to = F.when(F.lit(after == "done") & F.col("has_update"), "pending").otherwise(after)
    return j.select("incident_key", F.when(hit, to).otherwise(F.col("status")).alias("status"), (F.col("has_update") & ~(hit & F.lit(after == "done"))).alias("has_update"), "triage_score", "route", F.when(hit, at).otherwise(F.col("updated_at")).alias("updated_at"))


def reclaim(queue: DataFrame, at: Column, stale_seconds: int = 1800) -> DataFrame:
    """Investigations without news for half an hour become pending again."""
    stale = (F.col("status") == "investigating") & (F.col("updated_at") < at - F.make_dt_interval(secs=F.lit(stale_seconds)))
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("updated_at", F.when(stale, at).otherwise(F.col("updated_at")))


def waiting(queue: DataFrame, k: int = 20) -> DataFrame:
    """The k most urgent: score, then the longest wait, then key."""
    return queue.where("route = 'investigate' and status = 'pending'").orderBy(F.desc("triage_score"), "updated_at", "incident_key").limit(k)


def queue_stats(queue: DataFrame) -> DataFrame:
    """Counts by status, route and in all, from one pass."""
    return queue.groupingSets([["status"], ["route"], []], "status", "route").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))
