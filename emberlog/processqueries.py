"""Queries of process lineage over the driver's events, seen as audit records of three machines, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import lineage
from emberlog.session import cut, table
from emberlog.workload import query

#: An audit record of each event; serials fall by almost 5,000 now and then, and by up to 1,500 in between.
COLUMNS = {
    "host": "concat('m', user_id % 3)", "at": "event_id * 700000", "serial": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 37) % 5000 + (event_id % 6) * 300 END",
    "raw_ref": "concat('audit:', lpad(cast(event_id AS VARCHAR(12)), 8, '0'))", "pid": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 2 + k % 25 END", "ppid": "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 8 = 0 THEN 1 WHEN event_id % 50 = 3 THEN 0 ELSE 1 + (k * 7 + event_id // 4000) % 27 END",
}
AUDIT = f"e AS (SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k FROM events), a AS (SELECT {', '.join(f'{v} AS {c}' for c, v in (COLUMNS | {'us': COLUMNS['at']}).items() if c != 'at')} FROM e)"
#: Boot epochs by a recursive fold over the rows of each machine.
EPOCHS = f"""{AUDIT}, n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, coalesce(serial, -1), raw_ref) AS i FROM a),
f AS (SELECT host, i, raw_ref, serial AS top, 0 AS epoch FROM n WHERE i = 1 UNION ALL
 SELECT n.host, n.i, n.raw_ref, CASE WHEN n.serial IS NULL THEN f.top WHEN f.top IS NULL OR f.top - n.serial > 1000 THEN n.serial ELSE greatest(f.top, n.serial) END, f.epoch + CASE WHEN f.top - n.serial > 1000 THEN 1 ELSE 0 END FROM f JOIN n ON n.host = f.host AND n.i = f.i + 1)"""
#: Instances by a recursive fold over the rows of each process id; records without one count for neither epochs nor instances.
INSTANCES = f"""{EPOCHS.replace("AS i FROM a)", "AS i FROM a WHERE pid IS NOT NULL)")}, p AS (SELECT n.*, f.epoch FROM n JOIN f USING (host, i)), q AS (SELECT *, row_number() OVER (PARTITION BY host, epoch, pid ORDER BY us, coalesce(serial, -1), raw_ref) AS j FROM p),
g AS (SELECT host, epoch, pid, j, raw_ref, 0 AS seq, ppid AS up FROM q WHERE j = 1 UNION ALL
 SELECT q.host, q.epoch, q.pid, q.j, q.raw_ref, g.seq + CASE WHEN q.ppid <> g.up AND q.ppid <> 1 THEN 1 ELSE 0 END, CASE WHEN q.ppid IS NULL OR (g.up IS NOT NULL AND q.ppid = 1) THEN g.up ELSE q.ppid END FROM g JOIN q ON q.host = g.host AND q.epoch = g.epoch AND q.pid = g.pid AND q.j = g.j + 1),
inst AS (SELECT host, epoch, pid, seq, max_by(g.up, g.j) AS ppid, min(q.us) AS first_at, max(q.us) AS last_at, arg_min(raw_ref, j) AS first_ref, count(*) AS n_events FROM g JOIN q USING (host, epoch, pid, j, raw_ref) GROUP BY host, epoch, pid, seq),
par AS (SELECT c.*, (SELECT max_by(o.seq, (o.first_at, o.seq)) FROM inst o WHERE o.host = c.host AND o.epoch = c.epoch AND o.pid = c.ppid AND c.ppid NOT IN (0, 1) AND c.ppid <> c.pid AND o.first_at <= c.first_at + 2000000) AS parent_seq FROM inst c)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, at, serial, raw_ref, pid, ppid)"""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    kinds = {"host": "string", "raw_ref": "string"}
    return e.select(*(F.expr(v.replace("//", "DIV")).cast(kinds.get(c, "long")).alias(c) for c, v in COLUMNS.items()))


@query(f"WITH RECURSIVE {EPOCHS} SELECT raw_ref, epoch FROM f")
def boot_epochs(spark, sf_dir):
    return lineage.boot_epochs(audit(spark, sf_dir)).select("raw_ref", "epoch")


@query(f"WITH RECURSIVE {INSTANCES} SELECT host, epoch, pid, seq, ppid, first_at, last_at, first_ref, n_events, parent_seq FROM par")
def process_instances(spark, sf_dir):
    return lineage.parents(cut(lineage.instances(lineage.instance_events(audit(spark, sf_dir))), "instances"))


@query(f"""WITH RECURSIVE {INSTANCES}, w AS (SELECT g.host, g.epoch, g.pid, g.seq, q.us, g.raw_ref, coalesce(q.serial, -1) AS s FROM g JOIN q USING (host, epoch, pid, j))
SELECT coalesce((SELECT max_by(w.raw_ref, (w.us, w.s, w.raw_ref)) FROM w WHERE w.host = par.host AND w.epoch = par.epoch AND w.pid = par.ppid AND w.seq = par.parent_seq AND w.us <= par.first_at),
 (SELECT o.first_ref FROM inst o WHERE o.host = par.host AND o.epoch = par.epoch AND o.pid = par.ppid AND o.seq = par.parent_seq)) AS a, first_ref AS b FROM par WHERE parent_seq IS NOT NULL""")
def lineage_edges(spark, sf_dir):
    return lineage.lineage_edges(audit(spark, sf_dir))


@query(f"""WITH RECURSIVE {AUDIT}, v AS (SELECT * FROM a WHERE pid IS NOT NULL), u AS (SELECT * FROM v WHERE ppid <> 0), first AS (SELECT host, pid, arg_min(raw_ref, (us, raw_ref)) AS ref FROM v GROUP BY host, pid),
up AS (SELECT v.raw_ref, v.pid, v.ppid, coalesce(n.ref, first.ref) AS parent FROM v LEFT JOIN (SELECT u.raw_ref, x.raw_ref AS ref FROM u ASOF JOIN v x ON u.host = x.host AND u.ppid = x.pid AND u.us >= x.us) n ON n.raw_ref = v.raw_ref LEFT JOIN first ON first.host = v.host AND first.pid = v.ppid AND v.ppid <> 0),
c AS (SELECT raw_ref, raw_ref AS here, ppid, [raw_ref] AS chain, [pid] AS pids FROM up UNION ALL
 SELECT c.raw_ref, n.raw_ref, n.ppid, list_append(c.chain, n.raw_ref), list_append(c.pids, n.pid) FROM c JOIN up h ON h.raw_ref = c.here JOIN up n ON n.raw_ref = h.parent WHERE c.ppid <> 0 AND NOT list_contains(c.pids, c.ppid) AND len(c.chain) < 32)
SELECT raw_ref, array_to_string(chain, '<') AS chain, len(chain) AS n, CASE WHEN ppid IS NULL OR ppid = 0 THEN 'parent_pid_zero' WHEN list_contains(pids, ppid) THEN 'cycle_detected' WHEN len(chain) >= 32 THEN 'depth_limit' ELSE 'parent_not_observed' END AS stop_reason
FROM c QUALIFY row_number() OVER (PARTITION BY raw_ref ORDER BY len(chain) DESC) = 1""")
def process_chains(spark, sf_dir):
    found = lineage.process_chains(audit(spark, sf_dir))
    return found.select("raw_ref", F.array_join("chain", "<").alias("chain"), F.size("chain").cast("long").alias("n"), "stop_reason")
