"""Sensor alerts and requests: graded correlation with web requests, alert groups and their seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.net import is_global_ip
from emberlog.operators.burst import clean_signature
from emberlog.operators.links import SECOND, _side, flow_groups, missing_client_context
from emberlog.operators.range_join import range_join

#: Seconds of the three rings around a request (fixed values).
STRONG, FALLBACK, LONG = 1, 2, 900
FIELDS = ("method", "path", "status")
_REQUEST = tuple((f"{c}_b", f"{c}_a") for c in FIELDS)


def _found(pairs: DataFrame, ring: Column, status: Column, reason: Column) -> DataFrame:
    """(raw_ref, status, reason, candidates) of pairs that share a record's best ring."""
    best = pairs.withColumn("_ring", ring).groupBy("raw_ref_b").agg(F.min("_ring").alias("ring"), F.collect_list(F.struct("_ring", "raw_ref_a")).alias("all"))
    near = F.array_sort(F.array_distinct(F.transform(F.filter("all", lambda x: x["_ring"] == F.col("ring")), lambda x: x["raw_ref_a"])))
    return best.select(F.col("raw_ref_b").alias("raw_ref"), "ring", near.alias("candidates")).select("raw_ref", status.alias("status"), reason.alias("reason"), "candidates")


def _close(net: DataFrame, web: DataFrame) -> DataFrame:
    """(raw_ref, status, reason, candidates) of the records (b) that a web request (a) of the same client is within two seconds of."""
    one, gap = F.size("candidates") == 1, F.abs(F.col("at_a") - F.col("at_b"))
    near = range_join(net, web, "at_b", "at_a", FALLBACK * SECOND, (("src_ip_b", "src_ip_a"),))
    same = F.lit(True)
    for b, a in _REQUEST:
        same = same & F.coalesce(F.col(b) == F.col(a), F.lit(False))
    ring = F.when(same & (gap <= STRONG * SECOND), 1).when(same, 2).when(gap <= STRONG * SECOND, 3).otherwise(4)
    return _found(
        near, ring, F.when((F.col("ring") == 1) & one, "strong").when(F.col("ring") == 1, "ambiguous_cluster").otherwise("context_only"),
        F.when(F.col("ring") == 1, F.when(one, "exact_unique_within_strong_window").otherwise("exact_multiple_within_strong_window"))
        .when(F.col("ring") == 2, F.when(one, "fallback_candidate").otherwise("fallback_ambiguous")).otherwise("ip_time_only_or_request_mismatch"),
    )


def _strong(net: DataFrame, web: DataFrame) -> DataFrame:
    """(raw_ref, candidates) of the records that are strong in _close(), asked of the narrow window and the same request alone."""
    near = range_join(net, web, "at_b", "at_a", STRONG * SECOND, (("src_ip_b", "src_ip_a"), *_REQUEST))
    best = near.groupBy("raw_ref_b").agg(F.collect_set(F.struct("raw_ref_a")).alias("all")).where(F.size("all") == 1)
    return best.select(F.col("raw_ref_b").alias("raw_ref"), F.transform("all", lambda x: x["raw_ref_a"]).alias("candidates"))


def _sides(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sensor's http records, those with a client as side b, and web requests as side a."""
    cols = ("src_ip", *(f"ld.{c}" for c in FIELDS))
    http = events.where("layer = 'network' and ld.event_type = 'http'")
    return http, _side(http.where("src_ip is not null"), "network", "b", *cols), _side(events, "web", "a", *cols)


def correlations(events: DataFrame) -> DataFrame:
    """(raw_ref, status, reason, candidates) for each http record of the sensor.

    With a client: web requests of the same client, method, path and status within a second are strong (one) or an
    ambiguous_cluster (several); within two seconds, of the client alone within two seconds, or the same request within
    900 seconds they are context_only. Each step looks only at records that the one before left without a candidate, so
    that the wide window is joined for few. Without a client, by a missing forwarded address, the address is ignored and
    nothing is more than context; an invalid or conflicting one matches nothing.
    """
    http, net, web = _sides(events)
    close = _close(net, web)
    left = net.join(close.select(F.col("raw_ref").alias("raw_ref_b")), "raw_ref_b", "left_anti")
    late = _found(range_join(left, web, "at_b", "at_a", LONG * SECOND, (("src_ip_b", "src_ip_a"), *_REQUEST)), F.lit(5), F.lit("context_only"), F.lit("long_delay_exact"))
    missing = missing_client_context(events.where("layer <> 'network' or src_ip is null")).select("raw_ref", F.col("grade").alias("status"), "reason", "candidates")
    known = close.unionByName(late).unionByName(missing)
    rest = http.join(known.select("raw_ref"), "raw_ref", "left_anti")
    why = F.when(F.col("src_ip").isNotNull(), "no_candidate").otherwise("xff_invalid_or_conflict")
    return known.unionByName(rest.select("raw_ref", F.lit("unmatched").alias("status"), why.alias("reason"), F.array().cast("array<string>").alias("candidates")))


def alerts(events: DataFrame) -> DataFrame:
    """Alert records with entity (the trusted client, else the outer sender; world-wide addresses only), signature, the
    group key and reject_reason (null for those that make seeds)."""
    outer = F.col("ld.transport_src_ip")
    entity = F.coalesce(F.when(is_global_ip(F.col("src_ip")), F.col("src_ip")), F.when(is_global_ip(outer), outer))
    a = events.where("layer = 'network' and ld.event_type = 'alert'").select("raw_ref", "ts", entity.alias("entity"), "ld")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flow = F.concat_ws("\x1f", F.lit("flow"), text("ld.sensor_id"), text("ld.flow_id"), text("ld.signature_id"))
    other = F.concat_ws("\x1f", F.lit("minute"), text("ld.signature_id"), F.coalesce("entity", F.lit("")), text("ld.dest_ip"), text("ld.dest_port"), text("ld.proto"), F.date_trunc("minute", "ts").cast("string"))
    reason = F.when(text("raw_ref") == "", "missing_raw_ref").when(text("ld.signature_id") == "", "missing_signature_id").when(F.col("ts").isNull(), "invalid_timestamp").when(F.col("entity").isNull(), "missing_trusted_entity")
    return a.withColumns({"group_key": F.when(F.col("ld.flow_id").isNotNull(), flow).otherwise(other), "reject_reason": reason})


def ids_seeds(events: DataFrame, window_seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Seeds of alert groups, and the alerts that make none with their reason.

    Alerts of one flow and signature are one group; without a flow, those of one signature, entity, target and minute.
    The earliest one (time, then line) stands for it: its entity, signature and the window around it. The group's
    gravest number gives the severity; policy signatures are low. Evidence: the alerts, the sensor's http records of
    their flows, and the web requests that these are strongly tied to. Seeds: seed_id, entity_type, entity, reason,
    severity, rule_id, source, layer, window_start, window_end, refs, n_alerts, n_correlated, evident (see all_seeds()).
    """
    a = alerts(events)
    good = a.where("reject_reason is null")
    number = F.col("ld.severity").cast("string").try_cast("int")
    who = F.struct("ts", "raw_ref", "entity", F.col("ld.signature").alias("signature"), F.col("ld.signature_id").cast("string").alias("signature_id"))
    member = good.groupBy("group_key").agg(F.min(who).alias("first"), F.min(number).alias("number"), F.count("*").alias("n_alerts"), F.collect_list("raw_ref").alias("own"))
    # each record of a flow once, with all its groups
    http = flow_groups(events, good.select("raw_ref", "group_key")).join(_strong(*_sides(events)[1:]), "raw_ref", "left")
    http = http.select(F.explode("groups").alias("group_key"), F.concat(F.array("raw_ref"), F.coalesce("candidates", F.array().cast("array<string>"))).alias("refs"))
    # joined by a key of which there is one, so that Spark leaves out the records where neither refs nor n_correlated are asked for
    met = http.groupBy("group_key").agg(F.flatten(F.collect_list("refs")).alias("met"), F.count("*").alias("n_met"))
    g = member.join(met, "group_key", "left").withColumn("n_correlated", F.coalesce("n_met", F.lit(0).cast("long")))
    g = g.withColumn("refs", F.array_sort(F.array_distinct(F.concat("own", F.coalesce("met", F.array().cast("array<string>"))))))
    named = clean_signature(F.col("first.signature"), F.concat(F.lit("signature_id="), F.col("first.signature_id")))
    g = g.withColumn("signature", named)
    width = F.make_dt_interval(secs=F.lit(window_seconds))
    severity = F.when(F.startswith("signature", F.lit("ET POLICY")), "low").when(F.col("number") == 1, "high").when(F.col("number") == 2, "medium").otherwise("low")
    seeds = g.select(
        F.sha1("group_key").alias("seed_id"), F.lit("src_ip").alias("entity_type"), F.col("first.entity").alias("entity"), F.concat(F.lit("IDS alert: "), "signature").alias("reason"), severity.alias("severity"),
        F.col("first.signature_id").alias("rule_id"), F.array(F.lit("ids")).alias("source"), F.lit("network").alias("layer"), (F.col("first.ts") - width).alias("window_start"), (F.col("first.ts") + width).alias("window_end"),
        "refs", "n_alerts", "n_correlated", F.lit(True).alias("evident"),
    )
    return seeds, a.where("reject_reason is not null").select("raw_ref", "reject_reason")
