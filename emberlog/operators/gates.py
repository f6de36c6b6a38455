"""Whether an investigation may end (R16): what speaks against it, as codes, for all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tools that read logs, those that show what ran, and the confidence that suffices.
LOG_TOOLS = ("fetch_web_log", "fetch_auth_log", "fetch_audit_log", "fetch_network_log", "fetch_event_logs")
AUDIT_TOOLS = ("fetch_audit_log", "get_process_tree", "fetch_event_logs")
THRESHOLD = 0.85


def _has(rows: DataFrame, name: str) -> DataFrame:
    """(incident_id, name = true) of the cases with a row."""
    return rows.select("incident_id").distinct().withColumn(name, F.lit(True))


def violations(cases: DataFrame, calls: DataFrame, command_ips: DataFrame, cited: DataFrame, observed: DataFrame, rules: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(incident_id, codes): nothing speaks against ending a case whose codes are empty.

    cases: (incident_id, reason, confidence, verdict, rule_verdict, src_ip, login_success), one row each; reason is
    confidence_sufficient or no_more_evidence, rule_verdict what the checks alone say, or null. calls: (incident_id,
    tool, layer, success, by_system, ip). command_ips: (incident_id, ip) found in commands. cited: (incident_id, ref,
    layer) from the seed; observed: (incident_id, ref) that tools returned; rules: (incident_id, rule, ref, mentioned), a
    row for each ref of each detection rule.

    Codes, in this order: VERDICT_CONFLICT, LOGIN_WITHOUT_AUDIT, COMMAND_IP_UNCHECKED, SEED_REF_UNOBSERVED (of a layer that
    no call asked), RULE_UNCHECKED (no ref seen and not named as unknown), LOW_CONFIDENCE (unless the checks say the same),
    ONE_TOOL, NETWORK_UNCHECKED, STOPPED_EARLY. Calls by the system count as attempts, not as the investigator's tools.
    """
    own = ~F.coalesce(F.col("by_system"), F.lit(False))
    # sets of a case's few tools and layers: distinct counts of several columns would copy each call for each of them
    distinct = lambda test, c: F.size(F.collect_set(F.when(test, F.col(c))))
    did = calls.groupBy("incident_id").agg(
        distinct(own, "tool").alias("tools"), distinct(own & F.col("success"), "tool").alias("good_tools"), distinct(own, "layer").alias("layers"), distinct(F.col("tool").isin(*LOG_TOOLS), "tool").alias("log_tools"),
        F.max(F.col("tool").isin(*AUDIT_TOOLS) | F.coalesce(F.col("layer") == "audit", F.lit(False))).alias("audit"), F.max((F.col("tool") == "fetch_network_log") | F.coalesce(F.col("layer") == "network", F.lit(False))).alias("network"),
    )
    asked = calls.where(F.col("ip").isNotNull() & ((F.col("tool") == "fetch_network_log") | (F.col("layer") == "network"))).select("incident_id", "ip").distinct()
    open_ip = _has(command_ips.join(asked, ["incident_id", "ip"], "left_anti"), "open_ip")
    seen = observed.select("incident_id", "ref").distinct()
    open_ref = _has(cited.join(seen, ["incident_id", "ref"], "left_anti").join(calls.select("incident_id", "layer").distinct(), ["incident_id", "layer"], "left_anti"), "open_ref")
    checked = rules.join(seen.withColumn("_seen", F.lit(True)), ["incident_id", "ref"], "left").groupBy("incident_id", "rule").agg(F.max(F.coalesce("_seen", F.lit(False)) | F.coalesce("mentioned", F.lit(False))).alias("ok"))
    open_rule = _has(checked.where("not ok"), "open_rule")
    c = cases
    for more in (did, open_ip, open_ref, open_rule):
        c = c.join(more, "incident_id", "left")
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    enough, no_more = F.col("reason") == "confidence_sufficient", F.col("reason") == "no_more_evidence"
    same = F.coalesce(F.col("rule_verdict") == F.col("verdict"), F.lit(False))
    tests: tuple[tuple[str, Column], ...] = (
        ("VERDICT_CONFLICT", F.col("rule_verdict").isNotNull() & ~same), ("LOGIN_WITHOUT_AUDIT", yes("login_success") & ~yes("audit")), ("COMMAND_IP_UNCHECKED", yes("open_ip")), ("SEED_REF_UNOBSERVED", yes("open_ref")), ("RULE_UNCHECKED", yes("open_rule")),
        ("LOW_CONFIDENCE", enough & (F.coalesce("confidence", F.lit(0.0)) < threshold) & ~same), ("ONE_TOOL", enough & (F.greatest(n("good_tools"), n("layers")) <= 1)), ("NETWORK_UNCHECKED", enough & F.col("src_ip").isNotNull() & ~yes("network")),
        ("STOPPED_EARLY", no_more & (F.greatest(n("tools"), n("layers")) <= 1) & (n("log_tools") < len(LOG_TOOLS))),
    )
    return c.select("incident_id", F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests))).alias("codes"))
