"""Queries of the log readers: every event of the driver's table is written as a log line by SQL, and the reader takes it apart again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.plans.chain import detect_incidents
from emberlog.logqueries import log_events
from emberlog.functions.loosejson import json_items, json_object
from emberlog.session import table
from emberlog.sources import logs
from emberlog.workload import query

E = "e AS (SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k FROM events)"
TWO = "lpad(cast({} AS VARCHAR(20)), 2, '0')"
STAMP = f"concat('2024-05-', {TWO.format('1 + event_id // 86400 % 28')}, 'T', {TWO.format('event_id // 3600 % 24')}, ':', {TWO.format('event_id // 60 % 60')}, ':', {TWO.format('event_id % 60')}, 'Z')"
MICROS = "(1714521600 + event_id // 86400 % 28 * 86400 + event_id % 86400) * 1000000"
IP = "concat('9.', k, '.', user_id % 200, '.7')"
#: Program, message, and what it tells: event, result, user, source user, address, port, repeat, new value.
NULL = "CAST(NULL AS BIGINT)"
NONE = "CAST(NULL AS VARCHAR(20))"
AUTH = (
    ("sshd", f"concat('Failed password for invalid user a b', k, ' from ', {IP}, ' port ', 1000 + k, ' ssh2')", "'ssh_failed'", "'failure'", "concat('a b', k)", NONE, IP, "1000 + k", NULL, NONE),
    ("sshd", f"concat('Accepted publickey for b', k, ' from ', {IP}, ' port ', 2000 + k, ' ssh2: ED25519 SHA256:f', k)", "'ssh_accepted'", "'success'", "concat('b', k)", NONE, IP, "2000 + k", NULL, NONE),
    ("sshd", f"concat('PAM ', 2 + k % 5, ' more authentication failures; logname= uid=0 euid=0 tty=ssh ruser= rhost=', {IP}, '  user=root')", "'pam_auth_failure'", "'failure'", "'root'", NONE, IP, NULL, "2 + k % 5", NONE),
    ("sshd", f"concat('Connection closed by authenticating user c', k, ' ', {IP}, ' port ', k + 1, ' [preauth]')", "'ssh_auth_fail_close'", "'failure'", "concat('c', k)", NONE, IP, "k + 1", NULL, NONE),
    ("sudo", "concat('d', k, ' : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls -l ', k)", "'sudo_command'", "'success'", "'root'", "concat('d', k)", NONE, NULL, NULL, NONE),
    ("useradd", "concat('new user: name=e', k, ', UID=', k, ', GID=', k, ', home=/home/e, shell=/bin/sh, from=none')", "'user_created'", "'success'", "concat('e', k)", NONE, NONE, NULL, NULL, NONE),
    ("systemd-logind", "concat('New session ', k, ' of user f', k, '.')", "'session_new'", "'info'", "concat('f', k)", NONE, NONE, NULL, NULL, NONE),
    ("usermod", "concat('change user ''g', k, ''' shell from ''/bin/sh'' to ''/bin/z', k, '''')", "'user_modified'", "'success'", "concat('g', k)", NONE, NONE, NULL, NULL, "concat('/bin/z', k)"),
    ("sudo", "concat('pam_unix(sudo:session): session opened for user root(uid=0) by h', k, '(uid=', k, ')')", "'pam_session_opened'", "'success'", "'root'", "concat('h', k)", NONE, NULL, NULL, NONE),
)
FIELDS = ("event", "result", "user", "src_user", "src_ip", "port", "repeat", "new_value")


def _case(n: int) -> str:
    return f"CASE event_id % {len(AUTH)} " + " ".join(f"WHEN {k} THEN {row[n]}" for k, row in enumerate(AUTH)) + " END"


PROGRAM = f"CASE event_id % {len(AUTH)} " + " ".join(f"WHEN {k} THEN '{row[0]}'" for k, row in enumerate(AUTH)) + " END"


def _lines(spark: SparkSession, sf_dir: str, name: str, line: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    sql = lambda x: F.expr(x.replace("//", " DIV "))
    return e.select(F.lit(name).alias("file"), F.col("event_id").alias("line_no"), sql(line).alias("line"))


@query(f"WITH {E} SELECT concat('auth.log:', event_id) AS raw_ref, {MICROS} AS us, concat('h', user_id % 3) AS machine, k + 1 AS pid, {', '.join(f'{_case(n)} AS "{c}"' for n, c in enumerate(FIELDS, 2))} FROM e")
def auth_lines(spark, sf_dir):
    line = f"concat({STAMP}, ' h', user_id % 3, ' ', {PROGRAM}, '[', k + 1, ']: ', {_case(1)})"
    rows = logs.auth_events(_lines(spark, sf_dir, "auth.log", line), 2024, 5)
    return rows.select("raw_ref", F.unix_micros("ts").alias("us"), "machine", "pid", *(F.col(c if c == "src_ip" else f"ld.{c}") for c in FIELDS))


@query(f"""WITH {E} SELECT concat('web.log:', event_id) AS raw_ref, {MICROS} AS us, {IP} AS src_ip, CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('/p', k, '?q=', user_id) AS path,
CASE WHEN k % 5 > 0 THEN 200 + k END AS status, CASE WHEN k % 3 > 0 THEN concat('agent \\"', k, '\\"') END AS user_agent, 'shop' AS host FROM e WHERE k % 7 > 0""".replace("\\\\", "\\").replace('\\"', '"'))
def web_lines(spark, sf_dir):
    quoted = "concat('agent ', char(92), '\"', k, char(92), '\"')"
    line = f"""concat({STAMP}, ' r', event_id, ' ', {IP}, CASE WHEN k % 7 = 0 THEN ' broken ' ELSE '' END, ' 10.0.0.1 https shop "', CASE WHEN k % 2 = 0 THEN 'get' ELSE 'POST' END, ' /p', k, '?q=', user_id, ' HTTP/1.1" ',
 CASE WHEN k % 5 > 0 THEN cast(200 + k AS STRING) ELSE '-' END, ' 12 345 99 "-" "', CASE WHEN k % 3 > 0 THEN {quoted} ELSE '-' END, '" xff="-"')"""
    rows = logs.web_events(_lines(spark, sf_dir, "web.log", line))
    return rows.select("raw_ref", F.unix_micros("ts").alias("us"), "src_ip", *(F.col(f"ld.{c}") for c in ("method", "path", "status", "user_agent", "host")))


@query()  # the chain is held against its parts and the attack scenario by the tests
def detected_incidents(spark, sf_dir):
    found = detect_incidents(log_events(spark, sf_dir), least=5)
    return found.select("incident_key", "entity", "severity", "priority", "triage_score", "route", "member_count", F.array_join("layers", ",").alias("layers"))


#: An object of each event in four broken forms; n small objects in an array that is cut off behind every second event's.
OBJECT = "concat('\"id\": ', event_id, ', \"kind\": \"', event_type, '\"')"
NL = "chr(10)"
BROKEN = f"""CASE event_id % 4 WHEN 0 THEN concat('```json', {NL}, '{{', {OBJECT}, '}}', {NL}, '```') WHEN 1 THEN concat('Answer: {{', {OBJECT}, ', }} as asked') WHEN 2 THEN concat('{{', {OBJECT}, ',', {NL}, '- more: [1, ]', {NL}, '}}') ELSE concat('{{', {OBJECT}) END"""
ARRAY = """concat('Verdicts: [', array_join(transform(sequence(0, event_id % 5), i -> concat('{"id": "', event_id, '] ', i, '"}')), ', '), CASE WHEN event_id % 2 = 0 THEN ', {"id": "' ELSE '] [1]' END)"""


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id END AS id, CASE WHEN event_id % 4 < 3 THEN event_type END AS kind FROM events")
def loose_json_objects(spark, sf_dir):
    """Each event's object in a broken form, read again."""
    o = table(spark, sf_dir, "events").select("event_id", json_object(F.expr(BROKEN)).alias("o"))
    return o.select("event_id", F.try_variant_get("o", "$.id", "bigint").alias("id"), F.try_variant_get("o", "$.kind", "string").alias("kind"))


@query("""SELECT event_id, i, concat(event_id, '] ', i) AS id FROM (SELECT event_id, unnest(range(0, event_id % 5 + 1)) AS i FROM events)""")
def cut_json_items(spark, sf_dir):
    """Each event's array, cut off or not, read again by items."""
    items = table(spark, sf_dir, "events").select("event_id", F.posexplode(json_items(F.expr(ARRAY))).alias("i", "item"))
    return items.select("event_id", F.col("i").cast("long").alias("i"), F.get_json_object("item", "$.id").alias("id"))
