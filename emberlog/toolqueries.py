"""Queries of the investigation tools over the driver's events, seen as log events of three machines, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.logqueries import LOG, log_events
from emberlog.operators import tools
from emberlog.workload import query

MACHINE = "concat('m', cast(split_part(raw_ref, ':', 2) AS BIGINT) % 3)"
ON = f"{LOG}, m AS (SELECT *, {MACHINE} AS machine FROM log), one AS (SELECT * FROM m WHERE machine = 'm1')"
#: All times of the view, as SQL and as text.
FROM, TO = "2024-01-01T00:00:00Z", "2034-01-01T00:00:00Z"
WHEN = f"host => 'm1', start_time => TIMESTAMP '{FROM}', end_time => TIMESTAMP '{TO}'"


def registered(spark: SparkSession, sf_dir: str) -> str:
    """The view over sf_dir, with the tools' functions on it."""
    log_events(spark, sf_dir).withColumn("machine", F.expr(MACHINE)).createOrReplaceTempView("tool_events")
    tools.register(spark, "tool_events", own_ip="8.8.4.1")
    return "tool_events"


def by_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    registered(spark, sf_dir)
    return spark.sql(text)


@query(f"WITH {ON} SELECT raw_ref, us FROM one WHERE layer = 'web' AND method = 'GET' AND contains(path, 'log') AND src_ip IS DISTINCT FROM '8.8.4.1' AND status = 200")
def tool_web_log(spark, sf_dir):
    return by_sql(spark, sf_dir, f"SELECT raw_ref, unix_micros(ts) AS us FROM fetch_web_log({WHEN}, method => 'get', path => 'log', exclude_self => TRUE, status_code => 200)")


@query(f"WITH {ON} SELECT src_ip, user, count(*) AS n FROM one WHERE layer = 'auth' AND event = 'ssh_failed' AND result = 'failure' GROUP BY ALL")
def tool_auth_log(spark, sf_dir):
    return by_sql(spark, sf_dir, f"SELECT src_ip, ld.user, count(*) AS n FROM fetch_auth_log({WHEN}, event_type => 'ssh_failed', result => 'failure') GROUP BY src_ip, ld.user")


@query(f"WITH {ON} SELECT raw_ref, pid, comm FROM one WHERE layer = 'system' AND lower(key) = 'key1' AND session_type = 'non_interactive' AND ppid = 7")
def tool_audit_log(spark, sf_dir):
    return by_sql(spark, sf_dir, f"SELECT raw_ref, pid, ld.comm FROM fetch_audit_log({WHEN}, event_type => 'KEY1', exclude_interactive => TRUE, include_user_cmd => FALSE, ppid => 7)")


@query(f"WITH {ON} SELECT raw_ref, signature FROM one WHERE layer = 'network' AND kind = 'alert' AND (coalesce(src_ip = '10.1.0.1', FALSE) OR transport_src_ip = '10.1.0.1' OR dest_ip = '10.1.0.1') AND dest_port = 443")
def tool_network_log(spark, sf_dir):
    return by_sql(spark, sf_dir, f"SELECT raw_ref, ld.signature FROM fetch_network_log({WHEN}, ip => '10.1.0.1', alert_only => TRUE, dst_port => 443, protocol => 'tcp')")


@query(f"""WITH {ON}, f AS (SELECT layer, us, raw_ref FROM one WHERE layer = 'web' AND path = '/login' OR layer = 'system' AND pid % 100 = 8 OR layer = 'auth')
SELECT raw_ref, us, (SELECT count(*) FROM f) AS total FROM f ORDER BY us, layer, raw_ref LIMIT 300 OFFSET 10""")
def tool_event_logs(spark, sf_dir):
    """A page over three layers; the filters of each are its own."""
    view = registered(spark, sf_dir)
    args = {"host": "m1", "window": [FROM, TO], "layers": ["web", "system", "auth"], "filters": {"web": {"path": "/login"}, "system": {"pid": 8}}, "limit": 300, "offset": 10}
    rows, about = tools.call(spark, "fetch_event_logs", args, view)
    return rows.join(F.broadcast(about)).select("raw_ref", F.unix_micros("ts").alias("us"), "total")


@query(f"""WITH RECURSIVE {ON}, v AS (SELECT raw_ref, us, pid, ppid, comm FROM one WHERE layer = 'system' AND pid IS NOT NULL),
c AS (SELECT 0 AS depth, x.*, [x.pid] AS pids FROM (SELECT * FROM v WHERE pid = 8 ORDER BY us DESC, raw_ref DESC LIMIT 1) x UNION ALL
 SELECT c.depth + 1, p.raw_ref, p.us, p.pid, p.ppid, p.comm, list_append(c.pids, p.pid) FROM c JOIN v p ON p.pid = c.ppid WHERE c.ppid <> 0 AND NOT list_contains(c.pids, c.ppid) AND c.depth < 31
 AND p.raw_ref = coalesce((SELECT max_by(o.raw_ref, (o.us, o.raw_ref)) FROM v o WHERE o.pid = c.ppid AND o.us <= c.us), (SELECT min_by(o.raw_ref, (o.us, o.raw_ref)) FROM v o WHERE o.pid = c.ppid)))
SELECT depth, raw_ref, pid, ppid, comm FROM c""")
def tool_process_tree(spark, sf_dir):
    rows, _ = tools.call(spark, "get_process_tree", {"host": "m1", "pid": 8, "start_time": FROM, "end_time": TO}, registered(spark, sf_dir))
    return rows.select("depth", "raw_ref", "pid", "ppid", "comm")
