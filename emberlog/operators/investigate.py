"""Checks over windows of events and the ordering of what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes before and after an incident that its layers are searched (fixed values).
PADS = {"web": (60, 60), "system": (30, 60), "network": (30, 30), "auth": (1440, 60)}
SUSPICIOUS = r"(?i)\b(curl|wget|nc|ncat|bash -i|python[0-9.]* -c|base64|chmod \+x|whoami|id|uname)\b"


def scan_verdict(rows: DataFrame, by: str, failed: Column, path: str, posts: int = 10, paths: int = 20, factor: int = 2) -> DataFrame:
    """(by, n_failed, n_paths, verdict): brute force, scan of many paths with many failures, or none, per entity in one pass."""
    n = rows.groupBy(by).agg(F.count_if(failed).alias("n_failed"), F.count_distinct(path).alias("n_paths"), F.count("*").alias("_n"))
    verdict = F.when(F.col("n_failed") >= posts, "brute_force").when((F.col("n_paths") >= paths) & (factor * F.col("n_failed") > F.col("_n")), "scan").otherwise("none")
    return n.withColumn("verdict", verdict).drop("_n")


def login_verdict(auth: DataFrame, by: str, least: int = 5, accounts: int = 2) -> DataFrame:
    """(by, failures, successes, n_accounts, verdict) of auth rows (result, user): without any success, many failures or accounts mean brute force."""
    n = auth.groupBy(by).agg(F.count_if(F.col("result") == "failure").alias("failures"), F.count_if(F.col("result") == "success").alias("successes"), F.count_distinct(F.when(F.col("result") == "failure", F.coalesce("user", F.lit("")))).alias("n_accounts"))
    hard = (F.col("successes") == 0) & ((F.col("failures") >= least) | (F.col("n_accounts") >= accounts))
    return n.withColumn("verdict", F.when(hard, "brute_force").when(F.col("failures") > 0, "sporadic").otherwise("none"))


def command_counts(audit: DataFrame, by: str, text: str = "exec_args") -> DataFrame:
    """Suspicious commands of each entity, with at most three examples."""
    hit = F.coalesce(F.col(text).rlike(SUSPICIOUS), F.lit(False))
    return audit.groupBy(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_suspicious"), F.slice(F.array_sort(F.collect_set(F.when(hit, F.substring(text, 1, 160)))), 1, 3).alias("examples"))


def window_events(incidents: DataFrame, events: DataFrame, layer: str) -> DataFrame:
    """Events of one layer and the incident's address in its padded window, all incidents at once."""
    before, after = PADS[layer]
    i = incidents.select("incident_id", F.col("entity").alias("_ip"), (F.col("first_ts") - F.make_dt_interval(mins=F.lit(before))).alias("_from"), (F.col("last_ts") + F.make_dt_interval(mins=F.lit(after))).alias("_to"))
    return events.where(F.col("layer") == layer).join(i, (F.col("src_ip") == F.col("_ip")) & F.col("ts").between(F.col("_from"), F.col("_to"))).drop("_ip", "_from", "_to")


def kill_chain(steps: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    return steps.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def capped(actions: DataFrame, keys: tuple[str, ...], kind: str, caps: dict[str, int], *order: Column) -> DataFrame:
    """At most caps[kind] actions of each kind for each key, the first ones in order; other kinds have no cap."""
    nth = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    most = F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col(kind))
    return actions.withColumn("_nth", nth).where(most.isNull() | (F.col("_nth") <= most)).drop("_nth")


def provenance(evidence: DataFrame, observed: DataFrame) -> DataFrame:
    """(incident_id, n_cited, n_unseen, status): cited refs (incident_id, ref) against those that tool calls returned."""
    c = evidence.select("incident_id", "ref").distinct()
    seen = c.join(observed.select("incident_id", "ref").distinct().withColumn("_seen", F.lit(True)), ["incident_id", "ref"], "left")
    n = seen.groupBy("incident_id").agg(F.count("*").alias("n_cited"), F.count_if(F.col("_seen").isNull()).alias("n_unseen"))
    return n.withColumn("status", F.when(F.col("n_unseen") == 0, "passed").when(F.col("n_unseen") < F.col("n_cited"), "incomplete").otherwise("unavailable"))
