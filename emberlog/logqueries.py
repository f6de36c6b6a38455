"""Queries of the log operators over the driver's events, seen as log events of four layers, by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import ids, incidents, links, mapping, reports, seeds
from emberlog.plans import keywords
from emberlog.plans.rules import detect, load_rules
from emberlog.session import table
from emberlog.sources.logs import FIELDS
from emberlog.workload import query

LAYERS = {"view": "web", "click": "network", "error": "network", "signup": "auth", "purchase": "system"}
#: Fields of ld by SQL that Spark and DuckDB both read; w, n, a, s stand for an event's layer.
LD = {
    "method": "CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END", "path": "CASE WHEN k % 4 = 0 THEN '/login' ELSE concat('/p', k % 4) END", "status": "CASE WHEN k % 5 = 0 THEN 404 ELSE 200 END",
    "user_agent": "concat('agent ', user_id % 3)", "event": "CASE WHEN k % 3 = 0 THEN 'ssh_failed' ELSE 'ssh_accepted' END", "result": "CASE WHEN k % 3 = 0 THEN 'failure' ELSE 'success' END",
    "user": "concat('u', user_id % 30)", "uid": "CASE WHEN event_id % 2 = 0 THEN 33 ELSE 0 END", "comm": "concat('c', k % 6)", "exec_args": "CASE WHEN k % 4 = 0 THEN concat('curl x', k) ELSE 'ls' END", "session_type": "CASE WHEN event_id % 2 = 0 THEN 'non_interactive' ELSE 'interactive' END", "key": "concat('key', k % 2)",
    "event_type": "CASE event_type WHEN 'click' THEN 'http' WHEN 'error' THEN 'alert' END", "flow_id": "CASE WHEN k % 9 = 0 THEN NULL ELSE cast(user_id % 40 AS VARCHAR(9)) END", "tx_id": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(k % 3 AS VARCHAR(9)) END", "sensor_id": "concat('eth', user_id % 2)",
    "transport_src_ip": "concat('10.0.0.', user_id % 3)", "src_port": "40000 + user_id % 2", "dest_ip": "concat('10.1.0.', user_id % 2)", "dest_port": "443", "proto": "'TCP'",
    "xff_status": "CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' ELSE 'valid' END", "signature": "CASE WHEN k % 7 = 0 THEN 'ET POLICY login' ELSE concat('SIG ', k % 7) END", "signature_id": "CASE WHEN k % 11 = 0 THEN NULL ELSE cast(k % 7 AS VARCHAR(9)) END", "severity": "cast(k % 4 AS VARCHAR(9))",
}
#: Events are 0.4 seconds apart in order of their ids.
BASE, STEP = 1704067200000000, 400000
SRC = "CASE WHEN event_type IN ('click', 'error') AND event_id % 5 IN (0, 1) THEN NULL ELSE concat('8.8.4.', user_id % 4) END"
LAYER = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYERS.items()) + " END"
#: The same view in DuckDB: log(raw_ref, layer, us, src_ip, pid, ppid, fields).
LOG = f"""e AS (SELECT event_id, user_id, event_type, CAST(props->>'k' AS BIGINT) AS k FROM events),
log AS (SELECT concat({LAYER}, ':', event_id) AS raw_ref, {LAYER} AS layer, {BASE} + event_id * {STEP} AS us, {SRC} AS src_ip, k AS pid, (k * 7) % 100 AS ppid, {', '.join(f'{v} AS "{k}"' for k, v in LD.items() if k != 'event_type')}, {LD['event_type']} AS kind FROM e)"""


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", k.alias("k"))
    ld = F.struct(*((F.expr(LD[c]) if c in LD else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()))
    layer = F.expr(LAYER)
    return e.select(
        F.concat_ws(":", layer, F.col("event_id").cast("string")).alias("raw_ref"), layer.alias("layer"), F.timestamp_micros(F.col("event_id") * STEP + BASE).alias("ts"), F.expr(SRC).alias("src_ip"),
        F.col("k").alias("pid"), ((F.col("k") * 7) % 100).alias("ppid"), ld.alias("ld"),
    )


WITHIN = "abs(a.us - b.us) <= {}"


@query(f"""WITH {LOG}, p AS (SELECT a.raw_ref AS a, b.raw_ref AS b, count(*) OVER (PARTITION BY b.raw_ref) AS n FROM log a JOIN log b ON {WITHIN.format(1000000)} AND a.src_ip = b.src_ip AND a.method = b.method AND a.path = b.path AND a.status = b.status
WHERE a.layer = 'web' AND b.layer = 'network' AND b.xff_status = 'valid') SELECT a, b FROM p WHERE n = 1""")
def linker_web_network(spark, sf_dir):
    return links.web_network(log_events(spark, sf_dir)).select("a", "b")


@query(f"WITH {LOG} SELECT a.raw_ref AS a, b.raw_ref AS b FROM log a JOIN log b ON {WITHIN.format(5000000)} WHERE a.layer = 'web' AND b.layer = 'system' AND b.uid = 33")
def linker_web_system(spark, sf_dir):
    return links.web_system(log_events(spark, sf_dir)).select("a", "b")


@query(f"WITH {LOG} SELECT a.raw_ref AS a, b.raw_ref AS b FROM log a JOIN log b ON {WITHIN.format(3600000000)} AND a.pid = b.pid WHERE a.layer = 'system' AND b.layer = 'auth'")
def linker_system_auth(spark, sf_dir):
    return links.system_auth(log_events(spark, sf_dir)).select("a", "b")


@query(f"WITH {LOG}, w AS (SELECT raw_ref AS b, lag(raw_ref) OVER v AS a, us - lag(us) OVER v AS gap FROM log WHERE layer = 'web' WINDOW v AS (PARTITION BY src_ip, path ORDER BY us, raw_ref)) SELECT a, b FROM w WHERE gap <= 120000000")
def linker_web_session(spark, sf_dir):
    return links.web_session(log_events(spark, sf_dir)).select("a", "b")


FLOW = """x AS (SELECT a.raw_ref AS a, b.raw_ref AS b FROM log a JOIN log b ON a.sensor_id = b.sensor_id AND a.flow_id = b.flow_id AND a.tx_id = b.tx_id WHERE a.kind = 'alert' AND b.kind = 'http'),
y AS (SELECT a.raw_ref AS a, b.raw_ref AS b, count(*) OVER (PARTITION BY a.raw_ref) AS n FROM log a JOIN log b ON a.sensor_id = b.sensor_id AND a.flow_id = b.flow_id AND a.transport_src_ip = b.transport_src_ip AND a.src_port = b.src_port AND a.dest_ip = b.dest_ip AND abs(a.us - b.us) <= 5000000 WHERE a.kind = 'alert' AND b.kind = 'http' AND a.tx_id IS NULL),
flows AS (SELECT a, b FROM x UNION SELECT a, b FROM y WHERE n = 1)"""


@query(f"WITH {LOG}, {FLOW} SELECT a, b FROM flows")
def linker_sensor_flow(spark, sf_dir):
    return links.sensor_flow(log_events(spark, sf_dir)).select("a", "b")


GRADES = """h AS (SELECT * FROM log WHERE kind = 'http'), w AS (SELECT * FROM log WHERE layer = 'web'),
near AS (SELECT h.raw_ref, w.raw_ref AS ref, abs(h.us - w.us) AS gap, h.src_ip = w.src_ip AS ip, h.method = w.method AND h.path = w.path AND h.status = w.status AS same, h.src_ip IS NULL AS missing, h.xff_status FROM h JOIN w ON abs(h.us - w.us) <= 900000000 AND ((h.src_ip = w.src_ip) OR (h.src_ip IS NULL AND h.xff_status = 'missing' AND h.method = w.method AND h.path = w.path AND h.status = w.status))),
r AS (SELECT *, CASE WHEN NOT missing THEN CASE WHEN same AND gap <= 1000000 THEN 1 WHEN same AND gap <= 2000000 THEN 2 WHEN gap <= 1000000 THEN 3 WHEN gap <= 2000000 THEN 4 WHEN same THEN 5 END ELSE CASE WHEN gap <= 1000000 THEN 11 WHEN gap <= 2000000 THEN 12 ELSE 13 END END AS ring FROM near),
m AS (SELECT raw_ref, min(ring) AS best FROM r GROUP BY raw_ref),
g AS (SELECT m.raw_ref, best, count(*) AS n, string_agg(ref, ',' ORDER BY ref) AS candidates FROM m JOIN r ON m.raw_ref = r.raw_ref AND r.ring = m.best GROUP BY ALL),
graded AS (SELECT h.raw_ref, CASE WHEN best = 1 AND n = 1 THEN 'strong' WHEN best = 1 THEN 'ambiguous_cluster' WHEN best IS NULL THEN 'unmatched' ELSE 'context_only' END AS status,
 CASE WHEN best IS NULL AND h.src_ip IS NOT NULL THEN 'no_candidate' WHEN best IS NULL AND h.xff_status = 'missing' THEN 'xff_missing_no_candidate' WHEN best IS NULL THEN 'xff_invalid_or_conflict'
 WHEN best = 1 THEN CASE WHEN n = 1 THEN 'exact_unique_within_strong_window' ELSE 'exact_multiple_within_strong_window' END WHEN best = 2 THEN CASE WHEN n = 1 THEN 'fallback_candidate' ELSE 'fallback_ambiguous' END WHEN best IN (3, 4) THEN 'ip_time_only_or_request_mismatch' WHEN best = 5 THEN 'long_delay_exact'
 ELSE concat('xff_missing_exact_', CASE WHEN n = 1 THEN 'unique' ELSE 'multiple' END, '_within_', CASE best WHEN 11 THEN 'strong' WHEN 12 THEN 'fallback' ELSE 'long_delay' END, '_window') END AS reason, coalesce(candidates, '') AS candidates FROM h LEFT JOIN g ON g.raw_ref = h.raw_ref)"""


@query(f"WITH {LOG}, {GRADES} SELECT * FROM graded")
def sensor_correlations(spark, sf_dir):
    return ids.correlations(log_events(spark, sf_dir)).withColumn("candidates", F.array_join("candidates", ","))


IDS = f"""al AS (SELECT *, CASE WHEN signature_id IS NULL THEN 'missing_signature_id' WHEN src_ip IS NULL THEN 'missing_trusted_entity' END AS reject_reason,
 CASE WHEN flow_id IS NOT NULL THEN concat('flow', sensor_id, '|', flow_id, '|', signature_id) ELSE concat('minute', signature_id, '|', src_ip, '|', dest_ip, '|', us // 60000000) END AS gk FROM log WHERE kind = 'alert'),
good AS (SELECT * FROM al WHERE reject_reason IS NULL),
mem AS (SELECT gk, raw_ref FROM good), hr AS (SELECT DISTINCT gk, b AS raw_ref FROM mem JOIN flows ON a = raw_ref), gr AS (SELECT hr.gk, graded.* FROM hr JOIN graded USING (raw_ref)),
rf AS (SELECT gk, string_agg(DISTINCT raw_ref, ',' ORDER BY raw_ref) AS refs FROM (SELECT * FROM mem UNION SELECT * FROM hr UNION SELECT gk, candidates FROM gr WHERE status = 'strong') GROUP BY gk),
sd AS (SELECT gk, arg_min(src_ip, (us, raw_ref)) AS entity, arg_min(signature, (us, raw_ref)) AS sig, arg_min(signature_id, (us, raw_ref)) AS rule_id, min(us) AS us, min(CAST(severity AS INT)) AS number, count(*) AS n_alerts FROM good GROUP BY gk)
"""


@query(f"WITH {LOG}, {FLOW}, {GRADES}, {IDS} SELECT entity, concat('IDS alert: ', sig) AS reason, CASE WHEN sig LIKE 'ET POLICY%' THEN 'low' WHEN number = 1 THEN 'high' WHEN number = 2 THEN 'medium' ELSE 'low' END AS severity, rule_id, us - 60000000 AS start_us, us + 60000000 AS end_us, refs, n_alerts, coalesce((SELECT count(*) FROM gr WHERE gr.gk = sd.gk), 0) AS n_correlated FROM sd JOIN rf USING (gk)")
def ids_alert_seeds(spark, sf_dir):
    s, _ = ids.ids_seeds(log_events(spark, sf_dir))
    return s.select("entity", "reason", "severity", "rule_id", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), F.array_join("refs", ",").alias("refs"), "n_alerts", "n_correlated")


@query(f"WITH {LOG}, {FLOW}, {GRADES}, {IDS} SELECT raw_ref, reject_reason FROM al WHERE reject_reason IS NOT NULL")
def ids_alert_rejects(spark, sf_dir):
    return ids.ids_seeds(log_events(spark, sf_dir))[1]


SEED_RULES = [
    {"id": "fetch", "title": "a fetch", "level": "high", "layer": "system", "entity": ["user", "ppid"], "detection": {"c": {"exec_args|startswith": "curl"}, "condition": "c"}},
    {"id": "failed", "title": "failed logins", "level": "medium", "layer": "auth", "detection": {"f": {"result": "failure"}, "condition": "f"}, "aggregation": {"seconds": 300, "min_count": 3}},
]
RULED = """f AS (SELECT * FROM log WHERE layer = 'auth' AND result = 'failure'),
n1 AS (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 300000000 FOLLOWING) - row_number() OVER (PARTITION BY src_ip ORDER BY us, raw_ref) + 1 AS ahead FROM f),
c1 AS (SELECT *, coalesce(us - last_value(CASE WHEN ahead >= 3 THEN us END IGNORE NULLS) OVER (PARTITION BY src_ip ORDER BY us, raw_ref ROWS UNBOUNDED PRECEDING) <= 300000000, FALSE) AS cov FROM n1),
g1 AS (SELECT *, CASE WHEN cov AND (NOT coalesce(lag(cov) OVER w, FALSE) OR us - lag(us) OVER w > 300000000) THEN 1 ELSE 0 END AS fresh FROM c1 WINDOW w AS (PARTITION BY src_ip ORDER BY us, raw_ref)),
b1 AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip ORDER BY us, raw_ref ROWS UNBOUNDED PRECEDING) AS burst FROM g1),
rs AS (SELECT 'fetch' AS rule_id, 'a fetch' AS reason, 'high' AS severity, 'system' AS layer, 'ppid' AS entity_type, CAST(ppid AS VARCHAR) AS entity, us - 60000000 AS start_us, us + 60000000 AS end_us, raw_ref AS refs FROM log WHERE layer = 'system' AND exec_args LIKE 'curl%'
 UNION ALL SELECT 'failed', 'failed logins', 'medium', 'auth', 'src_ip', src_ip, min(us) - 60000000, max(us) + 60000000, string_agg(raw_ref, ',' ORDER BY us, raw_ref) FROM b1 WHERE cov GROUP BY src_ip, burst)"""


@query(f"WITH {LOG}, {RULED} SELECT * FROM rs")
def seeds_of_rules(spark, sf_dir):
    s, _ = seeds.all_seeds(seeds.rule_seeds(log_events(spark, sf_dir), SEED_RULES))
    return s.select("rule_id", "reason", "severity", "layer", "entity_type", "entity", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), F.array_join("refs", ",").alias("refs"))


@query(f"WITH {LOG}, {RULED}, {FLOW}, {GRADES}, {IDS} SELECT source, severity, count(*) AS n FROM (SELECT 'sigma' AS source, severity FROM rs UNION ALL SELECT 'ids', CASE WHEN sig LIKE 'ET POLICY%' THEN 'low' WHEN number = 1 THEN 'high' WHEN number = 2 THEN 'medium' ELSE 'low' END FROM sd) GROUP BY ALL")
def seeds_of_both(spark, sf_dir):
    e = log_events(spark, sf_dir)
    s, _ = seeds.all_seeds(seeds.rule_seeds(e, SEED_RULES), ids.ids_seeds(e)[0])
    return s.groupBy(F.col("source")[0].alias("source"), "severity").agg(F.count("*").alias("n"))


MERGE = """e AS (SELECT event_id, user_id, event_type, CAST(props->>'k' AS BIGINT) AS k FROM events),
inc AS (SELECT concat(user_id, '-', k % 4) AS i, CASE WHEN user_id % 20 = 0 THEN NULL ELSE concat('u', user_id % 20) END AS entity, concat('r', k % 2) AS reason, event_type, event_id, CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'critical' ELSE 'medium' END AS severity, user_id FROM e),
keyed AS (SELECT *, coalesce(entity || '|' || reason, i) AS g FROM inc), one AS (SELECT i, g, min(entity) AS entity, count(DISTINCT event_id // 3) AS c FROM keyed GROUP BY i, g)"""


@query(f"""WITH {MERGE}, refs AS (SELECT DISTINCT g, concat('x', event_id // 3) AS ref FROM keyed), counts AS (SELECT g, count(*) AS n FROM refs GROUP BY g),
d AS (SELECT g, substr(sha1(string_agg(ref, '|' ORDER BY ref)), 1, 8) AS incident_id FROM refs GROUP BY g)
SELECT incident_id, min(o.entity) AS entity, sum(o.c)::BIGINT AS member_count, n > 500 AS oversized, (SELECT count(DISTINCT user_id // 2) FROM keyed k WHERE k.g = o.g) AS n_seeds, count(*) AS merged_from,
 (SELECT CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END FROM keyed k WHERE k.g = o.g) AS severity,
 (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM keyed k WHERE k.g = o.g) AS layers FROM one o JOIN d USING (g) JOIN counts USING (g) GROUP BY g, n, incident_id""")
def incident_dedup(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", k.alias("k")).withColumn("incident_id", F.concat_ws("-", "user_id", F.col("k") % 4))
    entity = F.when(F.col("user_id") % 20 != 0, F.concat(F.lit("u"), F.col("user_id") % 20))
    severity = F.element_at(F.array(*map(F.lit, ("low", "high", "critical", "medium"))), (F.col("k") % 4 + 1).cast("int"))
    ref = F.concat(F.lit("x"), F.floor(F.col("event_id") / 3))
    i = e.groupBy("incident_id").agg(
        F.first(entity).alias("entity"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_set("event_type")).alias("layers"), F.count_distinct(ref).alias("member_count"), F.array().cast("array<string>").alias("kinds"),
        F.array(F.concat(F.lit("r"), F.first(F.col("k") % 2))).alias("reasons"), F.first(severity).alias("severity"),
    )
    m = incidents.merged(i, e.select("incident_id", ref.alias("ref")).distinct(), e.select("incident_id", F.floor(F.col("user_id") / 2).alias("seed_id")).distinct())
    return m.select("incident_id", "entity", "member_count", "oversized", "n_seeds", "merged_from", "severity", F.array_join("layers", ",").alias("layers"))


@query("WITH l AS (SELECT doc_id, CASE quality WHEN 1 THEN 'THREAT_CONFIRMED' ELSE CASE WHEN doc_id % 3 = 0 THEN 'INCONCLUSIVE' WHEN doc_id % 3 = 1 THEN 'FALSE_POSITIVE' END END AS verdict, CASE doc_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'odd' END AS provenance FROM labels) SELECT doc_id, CASE WHEN verdict IS NULL OR provenance = 'odd' THEN 'error' WHEN verdict = 'FALSE_POSITIVE' THEN 'not_applicable' WHEN verdict = 'INCONCLUSIVE' OR provenance IS NULL THEN 'deferred' ELSE 'proceed' END AS gate FROM l")
def case_gate(spark, sf_dir):
    verdict = F.expr("CASE quality WHEN 1 THEN 'THREAT_CONFIRMED' ELSE CASE WHEN doc_id % 3 = 0 THEN 'INCONCLUSIVE' WHEN doc_id % 3 = 1 THEN 'FALSE_POSITIVE' END END")
    traced = F.expr("CASE doc_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'odd' END")
    return table(spark, sf_dir, "labels").select("doc_id", keywords.case_gate(verdict, traced).alias("gate"))


@query(f"WITH {LOG}, f AS (SELECT * FROM log WHERE layer = 'web' AND src_ip <> '8.8.4.1' AND upper(method) = 'POST' AND contains(path, 'p') AND status = 200) SELECT raw_ref, us, (SELECT count(*) FROM f) AS total FROM f ORDER BY us, raw_ref LIMIT 50 OFFSET 20")
def web_page(spark, sf_dir):
    rows, about = reports.query(log_events(spark, sf_dir), "web", limit=50, offset=20, not_ip="8.8.4.1", method="post", path="p", status=200)
    return rows.join(F.broadcast(about)).select("raw_ref", F.unix_micros("ts").alias("us"), "total")


@query(f"WITH {LOG}, f AS (SELECT * FROM log WHERE layer = 'network' AND (coalesce(src_ip = '10.0.0.1', FALSE) OR transport_src_ip = '10.0.0.1' OR dest_ip = '10.0.0.1') AND contains(signature, 'SIG')) SELECT raw_ref FROM f")
def network_of_an_address(spark, sf_dir):
    return reports.filtered(log_events(spark, sf_dir), "network", any_ip="10.0.0.1", signature="SIG").select("raw_ref")


@query(f"WITH {LOG}, f AS (SELECT * FROM log WHERE layer = 'system' AND key = 'key1' AND session_type = 'non_interactive') SELECT raw_ref FROM f")
def audit_records(spark, sf_dir):
    return reports.filtered(log_events(spark, sf_dir), "system", record="KEY1", interactive=False).select("raw_ref")


@query(f"WITH {LOG}, f AS (SELECT raw_ref, layer, us FROM log WHERE layer IN ('web', 'auth')), t AS (SELECT count(*) AS n FROM f) SELECT raw_ref, t.n AS total, t.n > 130 AS has_more FROM f, t ORDER BY us, layer, raw_ref LIMIT 100 OFFSET 30")
def event_log_page(spark, sf_dir):
    rows, about = reports.event_logs(log_events(spark, sf_dir), ("web", "auth"), limit=100, offset=30)
    return rows.join(F.broadcast(about)).select("raw_ref", "total", "has_more")


@query(f"""WITH {LOG}, s AS (SELECT src_ip, floor(us / 60000000)::BIGINT AS minute, count(*) AS n, count(DISTINCT src_ip) AS n_ips, count(DISTINCT coalesce(path, '-')) AS n_paths, count(*) FILTER (method = 'POST' AND contains(path, '/login')) AS auth_posts, count(*) FILTER (status // 100 = 4) AS n_4xx FROM log WHERE layer = 'web' GROUP BY src_ip, minute)
SELECT src_ip, minute, n, n_ips, n_paths, auth_posts, n_4xx, auth_posts >= 10 AS brute_force, n_paths >= 20 AND n_4xx * 2 > n AS path_scan FROM s""")
def web_statistics(spark, sf_dir):
    rows = log_events(spark, sf_dir).where("layer = 'web'").withColumn("minute", F.floor(F.unix_micros("ts") / 60_000_000))
    return reports.web_stats(rows, "src_ip", "minute").drop("first_ts", "last_ts")


def _top(parts: list[tuple[str, str, str]], by: str, k: int = 5) -> str:
    each = " UNION ALL ".join(f"SELECT {by}, '{name}' AS counter, coalesce(CAST({value} AS VARCHAR), '-') AS value FROM log WHERE {where}" for name, value, where in parts)
    return f"c AS (SELECT {by}, counter, value, count(*) AS n FROM ({each}) GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY {by}, counter ORDER BY n DESC, value) AS rank FROM c) SELECT {by}, counter, value, n, rank FROM q WHERE rank <= {k}"


CLASS = "CASE WHEN status IS NULL THEN 'unknown' ELSE concat(status // 100, 'xx') END"


@query(f"WITH {LOG}, " + _top([("method", "method", "layer = 'web'"), ("status", CLASS, "layer = 'web'"), ("path", "path", "layer = 'web'"), ("agent", "substr(user_agent, 1, 80)", "layer = 'web'")], "src_ip"))
def web_top_values(spark, sf_dir):
    return reports.web_counters(log_events(spark, sf_dir).where("layer = 'web'"), "src_ip")


@query(f"WITH {LOG}, " + _top([("event_type", "kind", "layer = 'network'"), ("signature", "signature", "kind = 'alert'"), ("status", CLASS, "kind = 'http'"), ("path", "path", "kind = 'http'"), ("peer", "concat(dest_ip, ':', dest_port)", "layer = 'network'")], "sensor_id"))
def network_top_values(spark, sf_dir):
    rows = log_events(spark, sf_dir).where("layer = 'network'").withColumn("sensor_id", F.col("ld.sensor_id"))
    return reports.network_counters(rows, "sensor_id")


@query(f"WITH {LOG}, " + _top([("user", '"user"', "layer = 'system'"), ("comm", "comm", "layer = 'system'")], "pid"))
def audit_top_values(spark, sf_dir):
    return reports.audit_counters(log_events(spark, sf_dir).where("layer = 'system'"), "pid")


@query(f"""WITH {LOG}, a AS (SELECT * FROM log WHERE layer = 'auth'), u AS (SELECT DISTINCT src_ip, "user" AS u FROM a WHERE result = 'failure'), r AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY u) AS nth FROM u)
SELECT src_ip, count(*) AS n, count(*) FILTER (result = 'failure') AS failures, count(*) FILTER (result = 'success') AS successes, (SELECT count(*) FROM u WHERE u.src_ip = a.src_ip) AS n_failed_accounts, (SELECT string_agg(u, ',' ORDER BY u) FROM r WHERE r.src_ip = a.src_ip AND nth <= 20) AS failed_accounts FROM a GROUP BY src_ip""")
def login_statistics(spark, sf_dir):
    return reports.login_stats(log_events(spark, sf_dir).where("layer = 'auth'"), "src_ip").withColumn("failed_accounts", F.array_join("failed_accounts", ","))


EV = """ev AS (SELECT o_custkey % 50 AS incident_id, o_orderkey AS evidence_id, o_orderkey % 11 = 0 AS contradicting, o_orderkey % 13 = 0 AS empty_result, o_orderkey % 17 = 0 AS issue FROM orders),
rf AS (SELECT DISTINCT l_orderkey AS evidence_id, l_suppkey AS ref FROM lineitem WHERE l_orderkey % 7 <> 0), ob AS (SELECT o_custkey % 50 AS incident_id, l_suppkey AS ref, count(DISTINCT l_linenumber % 2) AS places FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey % 10 <> 0 GROUP BY ALL)"""


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    refs = l.where("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("evidence_id")).agg(F.collect_list("l_suppkey").alias("refs"))
    ev = o.select((F.col("o_custkey") % 50).alias("incident_id"), F.col("o_orderkey").alias("evidence_id"), *((F.col("o_orderkey") % k == 0).alias(c) for k, c in ((11, "contradicting"), (13, "empty_result"), (17, "issue"))))
    seen = l.where("l_suppkey % 10 <> 0").join(o, l.l_orderkey == o.o_orderkey).select((F.col("o_custkey") % 50).alias("incident_id"), F.col("l_suppkey").alias("ref"), (F.col("l_linenumber") % 2).alias("location"))
    return ev.join(refs, "evidence_id", "left"), seen


ELIGIBLE = EV + """, el AS (SELECT ev.incident_id, ev.evidence_id, bool_or(contradicting) AS c, bool_or(empty_result) AS x, bool_or(issue) AS i, count(rf.ref) AS n, count(*) FILTER (places > 1) AS amb, count(*) FILTER (rf.ref IS NOT NULL AND places IS NULL) AS uno FROM ev LEFT JOIN rf USING (evidence_id) LEFT JOIN ob ON ob.incident_id = ev.incident_id AND ob.ref = rf.ref GROUP BY ALL),
st AS (SELECT incident_id, evidence_id, CASE WHEN (NOT x AND n = 0) OR i OR amb > 0 OR uno > 0 THEN 'excluded' WHEN c OR x THEN 'context' ELSE 'target' END AS status, concat_ws(',', CASE WHEN c THEN 'CONTRADICTING' END, CASE WHEN x THEN 'EMPTY_RESULT' END, CASE WHEN NOT x AND n = 0 THEN 'NO_RAW_REFS' END, CASE WHEN i THEN 'PROVENANCE_ISSUE' END, CASE WHEN amb > 0 THEN 'AMBIGUOUS_RAW_REF' END, CASE WHEN uno > 0 THEN 'UNOBSERVED_RAW_REF' END) AS reasons FROM el)"""


@query(f"WITH {ELIGIBLE} SELECT * FROM st")
def evidence_eligibility(spark, sf_dir):
    return mapping.eligibility(*_evidence(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


PICKS = """cat AS (SELECT concat('T', 1000 + p_partkey % 40) AS technique_id, NULL AS parent, bool_or(p_partkey % 40 = 7) AS gone FROM part GROUP BY 1 UNION ALL SELECT DISTINCT concat('T', 1000 + p_partkey % 40, '.001'), concat('T', 1000 + p_partkey % 40), FALSE FROM part),
sel AS (SELECT o_custkey % 50 AS incident_id, o_orderkey AS unit_id, l_linenumber AS nth, CASE WHEN l_partkey % 23 = 0 THEN 'nonsense' WHEN l_linenumber % 3 = 0 THEN concat('t', 1000 + l_partkey % 5, '.001 ') ELSE concat('T', 1000 + l_partkey % 10) END AS technique_id, o_orderkey AS evidence_id, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'why' END AS reason, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(f"""WITH {EV.replace("o_custkey % 50 AS incident_id, o_orderkey AS evidence_id", "o_custkey % 50 AS incident_id, o_orderkey AS evidence_id")}, {PICKS}, t AS (SELECT *, upper(trim(technique_id)) AS technique FROM sel),
c AS (SELECT t.*, concat_ws(',', CASE WHEN unit_id % 11 = 0 THEN 'UNIT_NOT_TARGET' END, CASE WHEN cat.technique_id IS NULL THEN 'INVALID_TECHNIQUE_ID' END, CASE WHEN gone THEN 'REVOKED_OR_DEPRECATED' END, CASE WHEN NOT regexp_matches(technique, '^T100[0-8]') THEN 'NOT_IN_CANDIDATES' END, CASE WHEN l_suppkey % 12 = 0 THEN 'UNIT_EVIDENCE_NOT_CITED' END, CASE WHEN reason = '' THEN 'EMPTY_REASON' END) AS fatal FROM t LEFT JOIN cat ON cat.technique_id = technique),
d AS (SELECT *, row_number() OVER (PARTITION BY unit_id, technique, fatal = '' ORDER BY nth) AS again FROM c)
SELECT unit_id, nth, technique, concat_ws(',', nullif(fatal, ''), CASE WHEN fatal = '' AND again > 1 THEN 'DUPLICATE_SELECTION' END) AS errors, fatal = '' AND again = 1 AS accepted FROM d""")
def technique_selections(spark, sf_dir):
    return _checked(spark, sf_dir)[0].select("unit_id", "nth", "technique", F.array_join("errors", ",").alias("errors"), "accepted")


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, l, p = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "part"))
    number = F.concat(F.lit("T"), (F.col("p_partkey") % 40 + 1000).cast("string"))
    catalog = p.groupBy(number.alias("technique_id")).agg(F.lit(None).cast("string").alias("parent"), F.max(F.col("p_partkey") % 40 == 7).alias("revoked"), F.lit(False).alias("deprecated"))
    catalog = catalog.unionByName(catalog.select(F.concat("technique_id", F.lit(".001")).alias("technique_id"), F.col("technique_id").alias("parent"), F.lit(False).alias("revoked"), F.lit(False).alias("deprecated")))
    name = F.when(F.col("l_partkey") % 23 == 0, "nonsense").when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("t"), F.col("l_partkey") % 5 + 1000, F.lit(".001 "))).otherwise(F.concat(F.lit("T"), F.col("l_partkey") % 10 + 1000))
    s = l.join(o, l.l_orderkey == o.o_orderkey).select(
        (F.col("o_custkey") % 50).alias("incident_id"), F.col("o_orderkey").alias("unit_id"), F.col("l_linenumber").alias("nth"), name.alias("technique_id"), F.col("o_orderkey").alias("evidence_id"),
        F.when(F.col("l_suppkey") % 12 != 0, F.array("o_orderkey")).otherwise(F.array().cast("array<bigint>")).alias("cited"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise("why").alias("reason"),
    )
    few = catalog.where(F.col("technique_id").rlike("^T100[0-8]")).select("technique_id")
    offered = s.select("unit_id", F.upper(F.trim("technique_id")).alias("technique_id")).distinct().join(F.broadcast(few), "technique_id")
    status = o.select((F.col("o_custkey") % 50).alias("incident_id"), F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderkey") % 11 == 0, "context").otherwise("target").alias("status"))
    return mapping.checked_selections(s, offered, catalog, status), catalog


@query(f"""WITH {PICKS}, t AS (SELECT *, upper(trim(technique_id)) AS technique FROM sel),
ok AS (SELECT DISTINCT t.incident_id, unit_id, technique, evidence_id, parent FROM t JOIN cat ON cat.technique_id = technique WHERE unit_id % 11 <> 0 AND NOT gone AND regexp_matches(technique, '^T100[0-8]') AND l_suppkey % 12 <> 0 AND reason <> ''),
kept AS (SELECT * FROM ok WHERE NOT EXISTS (SELECT 1 FROM ok s WHERE s.unit_id = ok.unit_id AND s.parent = ok.technique))
SELECT incident_id, technique, count(DISTINCT unit_id) AS n_units, string_agg(DISTINCT evidence_id::VARCHAR, ',' ORDER BY evidence_id::VARCHAR) AS evidence_ids FROM kept GROUP BY ALL""")
def technique_merge(spark, sf_dir):
    checked, catalog = _checked(spark, sf_dir)
    m = mapping.merged_selections(checked.where("accepted"), catalog)
    return m.withColumn("evidence_ids", F.array_join(F.array_sort(F.col("evidence_ids").cast("array<string>")), ","))


@query("""WITH r AS (SELECT DISTINCT o_custkey AS incident_id, o_orderkey AS seq, l_suppkey % 5 AS ref FROM orders JOIN lineitem ON l_orderkey = o_orderkey), f AS (SELECT *, min(seq) OVER (PARTITION BY incident_id, ref) AS since FROM r),
g AS (SELECT incident_id, seq, max(since) < seq AS repeated FROM f GROUP BY incident_id, seq) SELECT incident_id, seq, repeated, CASE WHEN repeated THEN 0.0 ELSE (seq % 7)::DOUBLE / 10 END AS contribution FROM g""")
def repeated_citations(spark, sf_dir):
    return mapping.without_repeats(_cited(spark, sf_dir)).select("incident_id", "seq", "repeated", "contribution")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    e = l.join(o, l.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("incident_id"), F.col("o_orderkey").alias("seq")).agg(F.collect_list(F.col("l_suppkey") % 5).alias("refs"))
    return e.withColumn("contribution", (F.col("seq") % 7).cast("double") / 10)


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, (o_orderkey % 11 - 4)::DOUBLE / 10 AS c FROM orders), f AS (SELECT i, n, round(greatest(0.0, least(1.0, c)), 6) AS total FROM e WHERE n = 1
UNION ALL SELECT e.i, e.n, round(greatest(0.0, least(1.0, total + c)), 6) FROM f JOIN e ON e.i = f.i AND e.n = f.n + 1) SELECT i AS incident_id, arg_max(total, n) AS confidence FROM f GROUP BY i""")
def confidence_sums(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident_id"), F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") % 11 - 4).cast("double") / 10).alias("contribution"))
    return mapping.confidence(e)


@query("SELECT l_orderkey AS incident_id, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'A', l_suppkey, l_linenumber) AS number FROM lineitem WHERE l_returnflag <> 'R'")
def action_numbers(spark, sf_dir):
    category = F.when(F.col("l_returnflag") == "A", "immediate").when(F.col("l_returnflag") == "N", "verify_needed")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("incident_id"), F.col("l_linenumber").alias("line"), category.alias("category"), F.col("l_suppkey").alias("priority"))
    return mapping.renumbered(a, "line").select("incident_id", "line", "number")


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS incident_id, l_linenumber::BIGINT AS action_id, min(l_suppkey) AS priority FROM lineitem GROUP BY ALL),
c AS (SELECT incident_id, list({'id': action_id, 'half': action_id // 2} ORDER BY priority, action_id) AS a, list(action_id) AS ids FROM l GROUP BY ALL),
r AS (SELECT incident_id, a, ids, []::BIGINT[] AS done FROM c UNION ALL SELECT incident_id, a, ids, list_append(done, list_filter(a, lambda x: NOT list_contains(done, x.id) AND (x.half = 0 OR list_contains(done, x.half) OR NOT list_contains(ids, x.half)))[1].id) FROM r WHERE len(done) < len(a))
SELECT l.incident_id, l.action_id, l.priority, list_position(r.done, l.action_id)::BIGINT AS place FROM r JOIN l ON l.incident_id = r.incident_id AND len(r.done) = len(r.a)""")
def action_order(spark, sf_dir):
    """Lines of an order, each after the one of half its number."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("incident_id"), F.col("l_linenumber").cast("long").alias("action_id"), F.col("l_suppkey").alias("priority"))
    # dealt by order, lines need no other shuffle
    l = l.repartition("incident_id").groupBy("incident_id", "action_id").agg(F.min("priority").alias("priority"))
    after = F.when(F.col("action_id") > 1, F.array(F.floor(F.col("action_id") / 2)))
    return mapping.in_order(l.withColumn("after", after), needs="after").select("incident_id", "action_id", "priority", "place")


@query()
def shipped_rules(spark, sf_dir):
    """All rules that come with the library over the log events; tested against plain Python on small events."""
    from pathlib import Path

    import emberlog.plans as plans

    return detect(log_events(spark, sf_dir), load_rules(str(Path(plans.__file__).parent / "rules"))).select("raw_ref", "rule_id", "level")


@query(f"WITH {LOG} SELECT raw_ref, CASE layer WHEN 'web' THEN concat_ws(' ', method, path, status, user_agent) WHEN 'system' THEN concat_ws(' ', \"user\", comm, exec_args, path) WHEN 'auth' THEN concat_ws(' ', event, result, \"user\") ELSE concat_ws(' ', kind, signature, method, path, status, dest_ip) END AS line FROM log")
def evidence_lines(spark, sf_dir):
    from emberlog.sources.sinks import evidence_line

    return log_events(spark, sf_dir).select("raw_ref", evidence_line(F.col("layer")).alias("line"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS incident_id, l_suppkey % 7 AS technique_id FROM lineitem), f AS (SELECT l_orderkey AS incident_id, CASE l_linenumber % 3 WHEN 0 THEN 'ip' WHEN 1 THEN 'file' ELSE 'user' END AS kind, min(l_partkey::VARCHAR) AS target FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY ALL),
c AS (SELECT * FROM (VALUES ('0', 'block', 'ip'), ('0', 'isolate', 'file'), ('1', 'report', NULL), ('2', 'reset', 'user'), ('*', 'look', NULL), ('*', 'watch', 'ip')) AS v(technique_id, template_id, kind)),
e AS (SELECT incident_id, template_id, t.technique_id::VARCHAR AS technique_id, FALSE AS fallback, kind FROM t JOIN c ON c.technique_id = t.technique_id::VARCHAR UNION ALL SELECT incident_id, template_id, t.technique_id::VARCHAR, TRUE, kind FROM t, c WHERE c.technique_id = '*' AND t.technique_id > 2)
SELECT e.incident_id, template_id, technique_id, fallback, target FROM e LEFT JOIN f USING (incident_id, kind) WHERE kind IS NULL OR target IS NOT NULL""")
def action_templates(spark, sf_dir):
    from emberlog.operators.decisions import entities, templates_of

    l = table(spark, sf_dir, "lineitem")
    t = l.select(F.col("l_orderkey").alias("incident_id"), (F.col("l_suppkey") % 7).cast("string").alias("technique_id")).distinct()
    catalog = spark.createDataFrame([("0", "block", "ip"), ("0", "isolate", "file"), ("1", "report", None), ("2", "reset", "user"), ("*", "look", None), ("*", "watch", "ip")], "technique_id string, template_id string, kind string")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "ip").when(F.col("l_linenumber") % 3 == 1, "file")
    found = l.where("l_linenumber % 3 < 2").select(F.col("l_orderkey").alias("incident_id"), kind.alias("kind"), F.col("l_partkey").cast("string").alias("value"), F.lit("tool_input").alias("source"), F.lit(0).alias("nth"))
    return templates_of(t, catalog, entities(found))


@query(f"WITH {LOG}, {GRADES} SELECT status, reason, count(*) AS n FROM graded GROUP BY ALL")
def sensor_correlation_counts(spark, sf_dir):
    return ids.correlations(log_events(spark, sf_dir)).groupBy("status", "reason").agg(F.count("*").alias("n"))


TOOL = "CASE l_suppkey % 6 WHEN 0 THEN 'fetch_web_log' WHEN 1 THEN 'fetch_auth_log' WHEN 2 THEN 'fetch_audit_log' WHEN 3 THEN 'fetch_network_log' WHEN 4 THEN 'fetch_event_logs' ELSE 'get_process_tree' END"
ASKED = "CASE l_suppkey % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'auth' WHEN 2 THEN 'audit' WHEN 3 THEN 'network' END"
CASE = {
    "reason": "CASE WHEN o_orderkey % 3 = 0 THEN 'no_more_evidence' ELSE 'confidence_sufficient' END", "confidence": "cast(o_custkey % 100 AS double) / 100", "verdict": "CASE WHEN o_orderkey % 2 = 0 THEN 'THREAT_CONFIRMED' ELSE 'FALSE_POSITIVE' END",
    "rule_verdict": "CASE o_custkey % 5 WHEN 0 THEN 'THREAT_CONFIRMED' WHEN 1 THEN 'FALSE_POSITIVE' END", "src_ip": "CASE WHEN o_orderkey % 4 > 0 THEN 'x' END", "login_success": "o_custkey % 7 = 0",
}


@query(f"""WITH cs AS (SELECT o_orderkey AS i, {', '.join(f'{v} AS {k}' for k, v in CASE.items())} FROM orders), cl AS (SELECT l_orderkey AS i, {TOOL} AS tool, {ASKED} AS layer, l_linenumber % 3 > 0 AS success, l_linenumber = 2 AS by_system, l_partkey % 4 AS ip, l_partkey, l_suppkey, l_linenumber FROM lineitem),
d AS (SELECT i, count(DISTINCT tool) FILTER (NOT by_system) AS tools, count(DISTINCT tool) FILTER (NOT by_system AND success) AS good, count(DISTINCT layer) FILTER (NOT by_system) AS layers, count(DISTINCT tool) FILTER (tool <> 'get_process_tree') AS logs, bool_or(tool IN ('fetch_audit_log', 'get_process_tree', 'fetch_event_logs')) AS audit, bool_or(tool = 'fetch_network_log') AS network FROM cl GROUP BY i),
oi AS (SELECT DISTINCT i FROM cl c WHERE l_linenumber = 1 AND NOT EXISTS (SELECT 1 FROM cl k WHERE k.i = c.i AND k.tool = 'fetch_network_log' AND k.ip = c.l_suppkey % 4)),
refs AS (SELECT DISTINCT i, l_partkey % 10 AS ref FROM cl WHERE l_linenumber <> 3),
orf AS (SELECT DISTINCT i FROM cl c WHERE l_linenumber = 3 AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.i = c.i AND r.ref = c.l_suppkey % 10) AND NOT EXISTS (SELECT 1 FROM cl k WHERE k.i = c.i AND k.layer = 'auth')),
oru AS (SELECT DISTINCT i FROM (SELECT i, l_linenumber % 2 AS rule, bool_or(EXISTS (SELECT 1 FROM refs r WHERE r.i = c.i AND r.ref = c.l_suppkey % 10) OR l_suppkey % 5 = 0) AS ok FROM cl c GROUP BY ALL) WHERE NOT ok)
SELECT cs.i AS incident_id, concat_ws(',', CASE WHEN rule_verdict IS NOT NULL AND rule_verdict <> verdict THEN 'VERDICT_CONFLICT' END, CASE WHEN login_success AND NOT coalesce(audit, FALSE) THEN 'LOGIN_WITHOUT_AUDIT' END, CASE WHEN oi.i IS NOT NULL THEN 'COMMAND_IP_UNCHECKED' END, CASE WHEN orf.i IS NOT NULL THEN 'SEED_REF_UNOBSERVED' END, CASE WHEN oru.i IS NOT NULL THEN 'RULE_UNCHECKED' END,
CASE WHEN reason = 'confidence_sufficient' AND confidence < 0.85 AND NOT coalesce(rule_verdict = verdict, FALSE) THEN 'LOW_CONFIDENCE' END, CASE WHEN reason = 'confidence_sufficient' AND greatest(coalesce(good, 0), coalesce(layers, 0)) <= 1 THEN 'ONE_TOOL' END, CASE WHEN reason = 'confidence_sufficient' AND src_ip IS NOT NULL AND NOT coalesce(network, FALSE) THEN 'NETWORK_UNCHECKED' END,
CASE WHEN reason = 'no_more_evidence' AND greatest(coalesce(tools, 0), coalesce(layers, 0)) <= 1 AND coalesce(logs, 0) < 5 THEN 'STOPPED_EARLY' END) AS codes FROM cs LEFT JOIN d ON d.i = cs.i LEFT JOIN oi ON oi.i = cs.i LEFT JOIN orf ON orf.i = cs.i LEFT JOIN oru ON oru.i = cs.i""")
def termination_gates(spark, sf_dir):
    from emberlog.operators.gates import violations

    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "incident_id")
    cases = o.select(F.col("o_orderkey").alias("incident_id"), *(F.expr(v).alias(k) for k, v in CASE.items()))
    calls = l.select("incident_id", F.expr(TOOL).alias("tool"), F.expr(ASKED).alias("layer"), (F.col("l_linenumber") % 3 > 0).alias("success"), (F.col("l_linenumber") == 2).alias("by_system"), (F.col("l_partkey") % 4).alias("ip"))
    ref = (F.col("l_suppkey") % 10).alias("ref")
    return violations(
        cases, calls, l.where("l_linenumber = 1").select("incident_id", (F.col("l_suppkey") % 4).alias("ip")), l.where("l_linenumber = 3").select("incident_id", ref, F.lit("auth").alias("layer")),
        l.where("l_linenumber <> 3").select("incident_id", (F.col("l_partkey") % 10).alias("ref")), l.select("incident_id", (F.col("l_linenumber") % 2).alias("rule"), ref, (F.col("l_suppkey") % 5 == 0).alias("mentioned")),
    ).withColumn("codes", F.array_join("codes", ","))
