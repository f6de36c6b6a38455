"""Readers, rules, incidents of any size and the new log operators on small cases."""

from __future__ import annotations

import gzip
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlog import logqueries
from emberlog.operators import components, incidents, mapping, reports
from emberlog.plans import rules
from emberlog.sources import logs

LINES = "file string, line_no long, line string"


def test_line_numbers_over_splits(spark, tmp_path):
    want = [(f"access.log{x}", k + 1, f"line {k} of {x}") for x in ("", ".1", "-20240501") for k in range(4000)]
    for x in ("", ".1", "-20240501"):
        (tmp_path / f"access.log{x}").write_text("\n".join(f"line {k} of {x}" for k in range(4000)) + "\n")
    with gzip.open(tmp_path / "access.log.2.gz", "wt") as f:
        f.write("one\r\n\nthree\n")
    (tmp_path / "access.log_other").write_text("not a sibling\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    try:
        got = logs.lines(spark, str(tmp_path / "access.log"))
        assert got.rdd.getNumPartitions() >= 1
        found = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(found) == sorted([*want, ("access.log.2", 1, "one"), ("access.log.2", 3, "three")])


def test_long_quoted_fields(spark):
    agent = '\\"a' * 300_000
    line = f'2024-05-01T10:00:00Z r1 9.9.9.9 9.9.9.9 https h.io "GET /x HTTP/1.1" 200 5 7 1 "-" "{agent}" xff="-"'
    got = logs.web_events(spark.createDataFrame([("web.log", 1, line), ("web.log", 2, line[:-8])], LINES)).collect()
    assert [(r.raw_ref, r.ld.path, len(r.ld.user_agent)) for r in got if r.raw_ref == "web.log:1"] == [("web.log:1", "/x", 600_000)]


AUTH = [
    ("sudo", "  bob : TTY=pts/0 ; PWD=/home/bob ; USER=root ; COMMAND=/usr/sbin/visudo", dict(event="sudo_command", src_user="bob", user="root", command="/usr/sbin/visudo", session_type="interactive")),
    ("sudo", "www-data : command not allowed ; TTY=unknown ; PWD=/ ; USER=root ; COMMAND=/bin/sh", dict(event="sudo_denied", src_user="www-data", user="root")),
    ("su", "Successful su for root by bob", dict(event="su_success", user="root", src_user="bob")), ("su", "(to root) bob on pts/0", dict(event="su_other", user=None)),
    ("useradd", "new user: name=eve, UID=0, GID=27, home=/home/eve, shell=/bin/bash, from=/dev/pts/1", dict(event="user_created", user="eve", uid=0, gid=27, shell="/bin/bash")),
    ("usermod", "change user 'eve' UID from '1001' to '0'", dict(event="user_modified", user="eve", changed_attr="UID", uid=0)), ("usermod", "change user 'eve' shell from '/bin/sh' to '/bin/bash'", dict(event="user_modified", changed_attr="shell", shell="/bin/bash")),
    ("gpasswd", "user eve added by root to group sudo", dict(event="group_member_added", user="eve", src_user="root", group="sudo")), ("usermod", "add 'eve' to group 'docker'", dict(event="group_member_added", group="docker")),
    ("pkexec", "bob: Executing command [USER=root] [TTY=/dev/pts/0] [CWD=/] [COMMAND=/bin/ls]", dict(event="pkexec_command", src_user="bob", command="/bin/ls")),
    ("sshd", "message repeated 3 times: [ Failed password for root from 9.9.9.9 port 22 ssh2]", dict(event="ssh_failed", user="root", repeat=3, auth_method="password")),
]


#: Every kind of message, with all the fields that it tells.
MESSAGES = [
    ("sshd", "Accepted publickey for root from 9.9.9.9 port 22 ssh2: RSA SHA256:abc", dict(event="ssh_accepted", result="success", user="root", port=22, auth_method="publickey", key_type="RSA", key_fingerprint="SHA256:abc")),
    ("sshd", "Failed password for invalid user a b from 1.1.1.1 port 9 from 9.9.9.9 port 22 ssh2", dict(event="ssh_failed", user="a b from 1.1.1.1 port 9", port=22, auth_method="password")),
    ("sshd", "Invalid user bob from 9.9.9.9 port 22", dict(event="ssh_invalid_user", user="bob", port=22)),
    ("sshd", "Invalid user bob from 9.9.9.9", dict(event="ssh_invalid_user", user="bob", port=None)),
    ("sshd", "Connection closed by authenticating user root 9.9.9.9 port 22 [preauth]", dict(event="ssh_auth_fail_close", result="failure", user="root", port=22)),
    ("sshd", "Connection reset by invalid user x y 9.9.9.9 port 22 [preauth]", dict(event="ssh_auth_fail_close", user="x y")),
    ("sshd", "Disconnecting invalid user x 9.9.9.9 port 22: Too many authentication failures [preauth]", dict(event="ssh_auth_fail_close", user="x")),
    ("sshd", "error: maximum authentication attempts exceeded for root from 9.9.9.9 port 22 ssh2 [preauth]", dict(event="ssh_max_auth", result="failure", user="root")),
    ("sshd", "Connection closed by 9.9.9.9 port 22 [preauth]", dict(event="ssh_probe", result="failure", user=None, port=22)),
    ("sshd", "banner exchange: Connection from 9.9.9.9 port 22: invalid format", dict(event="ssh_probe", port=22)),
    ("sshd", "Unable to negotiate with 9.9.9.9 port 22: no matching host key type found. Their offer: x [preauth]", dict(event="ssh_probe", port=22)),
    ("sshd", "Did not receive identification string from 9.9.9.9 port 22", dict(event="ssh_probe", port=22)),
    ("sshd", "Received disconnect from 9.9.9.9 port 22:11: disconnected by user", dict(event="ssh_disconnect", result="info", port=22)),
    ("sshd", "Disconnected from user root 9.9.9.9 port 22", dict(event="ssh_disconnect", result="info", user="root", port=22)),
    ("sshd", "PAM 2 more authentication failures; logname= uid=0 euid=0 tty=ssh ruser= rhost=9.9.9.9  user=root", dict(event="pam_auth_failure", result="failure", user="root", repeat=2, src_uid=0)),
    ("sshd", "pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=9.9.9.9  user=root", dict(event="pam_auth_failure", user="root", pam_service="sshd", tty="ssh", src_user=None)),
    ("sshd", "kex_exchange_identification: Connection closed by remote host", dict(event="ssh_probe", user=None, port=None)),
    ("sshd", "Server listening on 0.0.0.0 port 22.", dict(event="sshd_service", result="info", port=None)),
    ("sudo", "pam_unix(sudo:auth): auth could not identify password for [bob]", dict(event="pam_auth_failure", user="bob", src_user="bob", pam_service="sudo", reason="could not identify password")),
    ("sudo", "pam_unix(sudo:session): session opened for user root(uid=0) by bob(uid=1000)", dict(event="pam_session_opened", result="success", user="root", uid=0, src_user="bob", src_uid=1000, pam_service="sudo")),
    ("cron", "pam_unix(cron:session): session opened for user root(uid=0) by (uid=0)", dict(event="pam_session_opened", user="root", src_user=None, src_uid=0)),
    ("su", "pam_systemd(su-l:session): session closed for user root", dict(event="pam_session_closed", result="info", user="root", pam_service="su-l")),
    ("passwd", "pam_unix(passwd:chauthtok): password changed for bob", dict(event="password_changed", result="success", user="bob")),
    ("login", "pam_faillock(login:auth): Consecutive login failures for user bob account temporarily locked", dict(event="pam_other", result="info", pam_service="login")),
    ("systemd-logind", "New session 12 of user bob.", dict(event="session_new", result="info", user="bob", reason="session 12")),
    ("systemd-logind", "Removed session 12.", dict(event="session_removed", result="info", user=None, reason="session 12")),
    ("systemd-logind", "Watching system buttons", dict(event="logind_other", result="info")),
    ("su", "(to root) bob on pts/0", dict(event="su_other", result="info", user=None)),
    ("usermod", "change user 'bob' home from '/home/bob' to '/root'", dict(event="user_modified", user="bob", changed_attr="home", old_value="/home/bob", new_value="/root", shell=None, uid=None)),
    ("chsh", "changed user 'bob' shell to '/bin/sh'", dict(event="user_modified", user="bob", changed_attr="shell", old_value=None, new_value="/bin/sh", shell="/bin/sh")),
    ("gpasswd", "user bob removed by root from group sudo", dict(event="group_member_removed", user="bob", src_user="root", group="sudo")),
    ("userdel", "removed group 'bob' owned by 'bob'", dict(event="account_other", group=None)),
    ("groupdel", "removed group 'bob'", dict(event="group_deleted", result="success", group="bob", user=None)),
    ("chage", "changed password expiry for bob", dict(event="account_other", result="info")),
    ("pkexec", "bob: Executing command [USER=root] [TTY=/dev/pts/1] [CWD=/] [COMMAND=/bin/sh -c id]", dict(event="pkexec_command", src_user="bob", user="root", tty="/dev/pts/1", command="/bin/sh -c id", session_type="interactive")),
    ("kernel", "anything", dict(event="other", result="info", user=None)),
]


def _auth(spark, rows):
    return logs.auth_events(spark.createDataFrame([("auth.log", k + 1, f"2024-05-01T10:00:05Z h {p}[7]: {m}") for k, (p, m) in enumerate(rows)], LINES), 2024, 5)


def test_auth_fields(spark):
    got = {r.raw_ref: r.ld.asDict() for r in _auth(spark, [(p, m) for p, m, _ in AUTH]).collect()}
    for k, (_, m, want) in enumerate(AUTH):
        assert {c: got[f"auth.log:{k + 1}"][c] for c in want} == want, m


def test_every_auth_message(spark):
    got = {r.raw_ref: r for r in _auth(spark, [(p, m) for p, m, _ in MESSAGES]).collect()}
    for k, (_, m, want) in enumerate(MESSAGES):
        r = got[f"auth.log:{k + 1}"]
        assert {c: r.ld[c] for c in want} == want, m
        assert r.src_ip == ("9.9.9.9" if "9.9.9.9" in m else None), m
        assert r.machine == "h"


def test_shipped_rules_by_example(spark):
    found = rules.load_rules(str(Path(rules.__file__).parent / "rules"))
    hits = {(int(r.raw_ref.split(":")[1]), r.rule_id) for r in rules.detect(_auth(spark, [(p, m) for p, m, _ in AUTH]), found).collect()}
    assert hits == {(1, "auth_sudo_config"), (2, "auth_service_privilege"), (5, "auth_account_created"), (5, "auth_uid_zero"), (6, "auth_uid_zero"), (7, "auth_account_created"), (8, "auth_privileged_group"), (9, "auth_privileged_group")}
    audit = [
        "type=SYSCALL msg=audit(1714557600.100:1): arch=c000003e syscall=59 success=yes pid=10 ppid=9 uid=33 euid=33 tty=(none) comm=\"curl\" exe=\"/usr/bin/curl\" key=\"exec\"\x1dARCH=x86_64 SYSCALL=execve UID=\"www-data\"",
        "type=EXECVE msg=audit(1714557600.100:1): argc=2 a0=\"curl\" a1=\"http://9.9.9.9/x\"", "type=PROCTITLE msg=audit(1714557600.100:1): proctitle=6375726C00687474703A2F2F78",
        "type=SYSCALL msg=audit(1714557601.100:2): arch=c000003e syscall=257 success=yes pid=11 ppid=9 uid=33 euid=33 tty=pts0 comm=\"php\" exe=\"/usr/bin/php\" key=\"webroot\"",
        "type=PATH msg=audit(1714557601.100:2): item=0 name=\"/var/www/\" nametype=PARENT", "type=PATH msg=audit(1714557601.100:2): item=1 name=\"/var/www/a.php\" nametype=CREATE",
    ]
    e = logs.audit_events(spark.createDataFrame([("audit.log", k + 1, x) for k, x in enumerate(audit)], LINES))
    rows = {r.raw_ref: r.ld for r in e.collect()}
    assert (rows["audit.log:1"].user, rows["audit.log:1"].syscall, rows["audit.log:1"].proctitle, rows["audit.log:4"].path, len(rows["audit.log:4"].paths)) == ("www-data", "execve", "curl http://x", "/var/www/a.php", 2)
    assert {(r.raw_ref, r.rule_id) for r in rules.detect(e, found).collect()} == {("audit.log:1", "audit_tool_transfer"), ("audit.log:1", "audit_web_recon")}


def test_shipped_rules_against_python(spark, sf_dir):
    """The rules that the log events can meet, by plain Python over the same rows."""
    got = {(r.raw_ref, r.rule_id) for r in logqueries.shipped_rules(spark, sf_dir).collect()}
    want = set()
    for r in logqueries.log_events(spark, sf_dir).collect():
        ld = r.ld
        if r.layer == "auth" and ld.event == "ssh_accepted":
            want.add((r.raw_ref, "auth_ssh_odd_account"))
        if r.layer == "web" and ld.method == "POST" and "/login" in ld.path:
            want.add((r.raw_ref, "web_login_bursts"))
    assert got == want


def test_merge_by_all_members(spark):
    """Severities, shared seeds and more members than are shown."""
    i = [("a", "x", 1, 2, ["web"], 700, ["k1"], ["r"], "low"), ("b", "x", 0, 3, ["auth"], 700, [], ["r"], "critical"), ("c", "x", 0, 3, ["web"], 1, [], ["other"], "low"), ("d", None, 0, 1, [], 1, [], ["r"], "low"), ("e", None, 0, 1, [], 1, [], ["r"], "low")]
    rows = spark.createDataFrame(i, "incident_id string, entity string, first_ts long, last_ts long, layers array<string>, member_count long, kinds array<string>, reasons array<string>, severity string")
    members = [("a", f"m{k}") for k in range(700)] + [("b", f"m{k}") for k in range(400, 1100)] + [(x, x) for x in "cde"]
    seeds = [("a", 1), ("b", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 4)]
    got = incidents.merged(rows, spark.createDataFrame(members, "incident_id string, ref string"), spark.createDataFrame(seeds, "incident_id string, seed_id long")).collect()
    assert len(got) == 4
    big = next(r for r in got if r.merged_from == 2)
    assert (big.member_count, big.oversized, len(big.members), big.severity, big.n_seeds, big.layers, big.first_ts, big.last_ts) == (1400, True, 500, "critical", 2, ["auth", "web"], 0, 3)
    assert big.members == sorted(f"m{k}" for k in range(1100))[:500]


def test_components_of_paths(spark):
    for n, label in ((2000, list(range(2000))), (2000, random.Random(1).sample(range(2000), 2000))):
        edges = spark.createDataFrame([(label[k], label[k + 1]) for k in range(n - 1)], "x long, y long")
        both = edges.union(edges.select("y", "x"))
        assert len(components.hooking_rounds(both)) <= 11
        assert components.connected_components(edges, "x", "y").where("component <> 0").count() == 0


def test_action_order(spark, sf_dir):
    got = {}
    for r in logqueries.action_order(spark, sf_dir).collect():
        got.setdefault(r.incident_id, []).append((r.place, r.priority, r.action_id))
    for rows in got.values():
        left, done = {a: p for _, p, a in rows}, []
        while left:
            p, a = min((p, a) for a, p in left.items() if a == 1 or a // 2 not in left)
            done.append(a)
            del left[a]
        assert [a for _, _, a in sorted(rows)] == done
    a = spark.createDataFrame([("i", k, 1) for k in (1, 2, 3)], "incident_id string, action_id long, priority long")
    cycle = mapping.in_order(a, spark.createDataFrame([("i", 1, 2), ("i", 2, 1), ("i", 3, 9)], "incident_id string, action_id long, needs long"))
    assert [r.action_id for r in cycle.orderBy("place").collect()] == [3, 1, 2]


def test_action_order_of_odd_cases(spark):
    kinds = "incident_id string, action_id string, priority long, _row int", "incident_id string, action_id string, needs string"
    # two cycles: what they leave over stands by priority, also what only waits for one of them
    a = [("i", "a", 1, 0), ("i", "b", 3, 0), ("i", "e", 2, 0), ("i", "f", 5, 0), ("i", "d", 4, 0), ("i", "x", 9, 0), ("j", "b", 1, 1), ("j", "b", 7, 2), ("j", "a", 2, 0), ("j", None, 0, 0), (None, "z", 1, 0)]
    n = [("i", "a", "b"), ("i", "b", "a"), ("i", "e", "f"), ("i", "f", "e"), ("i", "d", "a"), ("j", "b", "a"), ("j", "b", "a"), ("j", "a", None), ("j", "a", "a"), ("k", "a", "b")]
    a, n = spark.createDataFrame(a, kinds[0]), spark.createDataFrame(n, kinds[1])
    out = mapping.in_order(a, n)
    got = sorted((r["incident_id"] or "", r["place"] or 0, r["action_id"] or "", r["priority"]) for r in out.collect())
    assert out.columns == [*a.columns, "place"]
    assert got == [("", 1, "z", 1), ("i", 1, "x", 9), ("i", 2, "a", 1), ("i", 3, "e", 2), ("i", 4, "b", 3), ("i", 5, "d", 4), ("i", 6, "f", 5), ("j", 0, "", 0), ("j", 1, "a", 2), ("j", 2, "b", 1), ("j", 2, "b", 7)]
    assert mapping.in_order(a.where("action_id = 'none'"), n).count() == 0


def test_filters_and_pages(spark, sf_dir):
    e = logqueries.log_events(spark, sf_dir)
    with pytest.raises(ValueError):
        reports.filtered(e, "web", src_ip="nonsense")
    with pytest.raises(ValueError):
        reports.page(e, "ts", limit=0)
    rows, about = reports.query(e, "web", limit=10_000, offset=5, path_regex="^/p[12]$")
    total = e.where("layer = 'web' and ld.path rlike '^/p[12]$'").count()
    assert about.first().asDict() == {"total": total, "returned": total - 5, "has_more": False, "next_offset": None} and rows.count() == total - 5
    hint = spark.range(1).select(*(reports.zero_hint(F.lit(a), F.lit(b), ip).alias(f"c{k}") for k, (a, b, ip) in enumerate(((5, 1, True), (0, 0, True), (5, 0, True), (5, 0, False))))).first()
    assert tuple(hint) == (None, "no_log", "ip_absent", "too_narrow")
    kinds = reports.kind_counts(spark.createDataFrame([("i", "x"), ("i", "x"), ("i", "y")], "incident_id string, kind string"), "incident_id").first()
    assert kinds.kinds == {"x": 2, "y": 1}


def test_linkers_and_sinks(spark, sf_dir, tmp_path):
    from emberlog.operators import links
    from emberlog.sources import sinks

    assert links.all_edges(spark.createDataFrame([], "raw_ref string, layer string")).count() == 0
    assert logs.lines(spark, str(tmp_path / "none.log")).count() == 0
    rows = spark.createDataFrame([("i1", 3), ("i2", 4)], "incident_id string, n long")
    for _ in range(2):
        sinks.write_incidents(rows, str(tmp_path / "out"), "2024-05-01-001")
    assert sinks.read_incidents(spark, str(tmp_path / "out/run=2024-05-01-001")).count() == 2
    (tmp_path / "one.json").write_text('{\n "incident_id": "i1",\n "n": 3\n}\n')
    (tmp_path / "many.json").write_text('[\n {"incident_id": "i1"},\n {"incident_id": "i2"}\n]\n')
    assert [sinks.read_incidents(spark, str(tmp_path / f)).count() for f in ("one.json", "many.json")] == [1, 2]
    assert sinks.append_metrics(spark, str(tmp_path / "metrics"), rows) and not sinks.append_metrics(spark, "nosuch://x/y", rows)
    sinks.write_events(logqueries.log_events(spark, sf_dir), str(tmp_path / "layers"))
    assert spark.read.json(str(tmp_path / "layers")).select("layer").distinct().count() == 4


def test_names_of_files_are_stable():
    assert all(re.fullmatch("[a-z_]+", r["id"]) for r in rules.load_rules(str(Path(rules.__file__).parent / "rules")))
