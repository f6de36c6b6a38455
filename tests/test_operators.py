"""Joins, bursts, rules, readers and state against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import burst, incidents, investigate, links, queue
from emberlog.operators.components import connected_components
from emberlog.operators.range_join import as_of, range_join, unique_only
from emberlog.plans import rules
from emberlog.sources import logs


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    a = [(k, rng.choice("xyz"), rng.randrange(400)) for k in range(150)]
    b = [(k, rng.choice(["x", "y", None]), rng.randrange(400)) for k in range(150)]
    return a, b, spark.createDataFrame(a, "a long, ka string, ta long"), spark.createDataFrame(b, "b long, kb string, tb long")


@pytest.mark.parametrize("width,low", [(5, None), (0, None), (7, 0), (20, 11)])
def test_range_join(points, width, low):
    a, b, da, db = points
    lo = -width if low is None else low
    want = sorted((x[0], y[0]) for x in a for y in b if lo <= y[2] - x[2] <= width)
    assert sorted(map(tuple, range_join(da, db, "ta", "tb", width, low=low).select("a", "b").collect())) == want
    keyed = sorted((x[0], y[0]) for x in a for y in b if lo <= y[2] - x[2] <= width and x[1] == y[1])
    found = range_join(da, db, "ta", "tb", width, (("ka", "kb"),), low)
    assert sorted(map(tuple, found.select("a", "b").collect())) == keyed
    one = [p for p in keyed if sum(q[1] == p[1] for q in keyed) == 1]
    assert sorted(map(tuple, unique_only(found, "b").select("a", "b").collect())) == one


def test_as_of(points):
    a, b, da, db = points
    want = {}
    for x in a:
        found = [(y[2], y[0]) for y in b if y[1] == x[1] and y[2] <= x[2] + 3]
        want[x[0]] = max(found)[1] if found else None
    got = as_of(da, db, "a", "ta", "tb", (("ka", "kb"),), "b", slack=3)
    assert {r.a: r.b for r in got.collect()} == want


def naive_bursts(times, width, least):
    covered = [False] * len(times)
    for i in range(len(times)):
        last = max(j for j in range(i, len(times)) if times[j] - times[i] <= width)
        if last - i + 1 >= least:
            covered[i : last + 1] = [True] * (last - i + 1)
    runs, prev = [], None
    for i, c in enumerate(covered):
        if c and prev == i - 1 and prev is not None and times[i] - times[i - 1] <= width:
            runs[-1].append(i)
        elif c:
            runs.append([i])
        prev = i if c else prev
    return [(times[r[0]], times[r[-1]], len(r)) for r in runs]


def test_bursts(spark):
    rng = random.Random(2)
    rows, want = [], []
    for g in range(25):
        times = sorted(rng.randrange(120) for _ in range(rng.randrange(1, 25)))
        rows += [(g, t, f"{g}:{k:02d}") for k, t in enumerate(times)]
        want += [(g, *x) for x in naive_bursts(times, 10, 4)]
    got = burst.bursts(spark.createDataFrame(rows, "g long, at long, ref string"), ("g",), "at", "ref", 10, 4)
    assert sorted(map(tuple, got.select("g", "first_at", "last_at", "n_hits").collect())) == sorted(want)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5, None), (9000, 9000)]
    label = {v: v for e in edges if None not in e for v in e}
    for _ in label:
        old = dict(label)
        for a, b in edges:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == label


def test_rules(spark):
    rows = [("web", "/login.php?cmd=id", "Nikto/2", 404, ["a", "Bee"]), ("web", "/x", None, 200, []), ("auth", "/login.php", "curl", 200, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "layer string, path string, agent string, status long, tags array<string>")
    cases = {
        "a and not b": ({"a": {"status": [404, 500]}, "b": {"agent": None}}, [0]), "not a": ({"a": {"agent|contains": "NIKTO"}}, [1, 2, 3]), "1 of s*": ({"s_one": {"path|endswith": ".php"}, "s_two": {"status": "200"}}, [1, 2]),
        "all of them": ({"x": {"path|re": r"cmd=\w+"}, "y": {"tags|contains": "bee"}}, [0]), "a or (b and c)": ({"a": {"path": "/?"}, "b": {"path": "*login*"}, "c": [{"status": 200}, {"agent": "none"}]}, [1, 2]), "k": ({"k": ["nikto", "zzz"]}, [0]), "m": ({"m": {"path|contains|all": ["login", "cmd"]}}, [0]),
    }
    for said, (parts, want) in cases.items():
        hit = [r.hit for r in rules.with_predicate(df, {"detection": parts | {"condition": said}}, "hit").collect()]
        assert [k for k, h in enumerate(hit) if h] == want, said
    with pytest.raises(ValueError):
        rules.selection(df, {"path|odd": "x"})
    assert rules.detect(df, [{"id": "r", "level": "low", "layer": "web", "detection": {"a": {"status": 404}, "condition": "a"}}]).count() == 1


def test_shipped_rules_load(spark):
    from pathlib import Path

    found = rules.load_rules(str(Path(rules.__file__).parent / "rules"))
    assert len({r["id"] for r in found}) == len(found) >= 28
    empty = spark.createDataFrame([], "ts timestamp, layer string, raw_ref string, src_ip string, pid bigint, ppid bigint, ld struct<%s>" % ",".join(f"{k}:{t}" for k, t in logs.FIELDS.items()))
    assert rules.detect(empty, found).count() == 0


WEB = '2024-05-01T10:00:0{n}Z r{n} {ip} 10.0.0.1 https shop "POST {path} HTTP/1.1" 200 12 345 99 "-" "agent \\"q\\"" xff="-"'


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "web.log").write_text("\n".join([WEB.format(n=1, ip="9.9.9.9", path="/up.php?a=1"), WEB.format(n=2, ip="9.9.9.9", path="/up.php"), "bad line", WEB.format(n=3, ip="8.8.8.8", path="/")]) + "\n")
    (d / "auth.log").write_text("May  1 10:00:04 h sshd[77]: Failed password for invalid user bob from 9.9.9.9 port 22 ssh2\nDec 31 23:00:00 h su[5]: (to root) bob on pts/0\n2024-05-01T10:00:05+0900 h sudo[8]: www-data : user NOT in sudoers ; COMMAND=/bin/sh\n")
    audit = 'type=SYSCALL msg=audit(1714557602.500:{s}): arch=c000003e syscall=59 success=yes exit=0 ppid={pp} pid={p} auid=4294967295 uid=33 euid=33 tty=(none) ses=4294967295 comm="sh" exe="/bin/sh" key=(null)\ntype=EXECVE msg=audit(1714557602.500:{s}): argc=2 a0="sh" a1=2D63\n'
    (d / "audit.log").write_text(audit.format(s=1, pp=1, p=70) + audit.format(s=2, pp=70, p=77))
    (d / "eve.json").write_text('{"timestamp":"2024-05-01T10:00:01.500000+0000","event_type":"http","flow_id":5,"in_iface":"e","src_ip":"10.0.0.2","src_port":1,"dest_ip":"10.0.0.1","dest_port":80,"proto":"TCP","xff":"9.9.9.9","http":{"url":"/up.php?a=1","http_method":"POST","status":200}}\n{broken\n{"timestamp":"2024-05-01T10:00:02.000000+0000","event_type":"alert","flow_id":5,"in_iface":"e","src_ip":"10.0.0.1","src_port":80,"dest_ip":"10.0.0.2","dest_port":1,"proto":"TCP","alert":{"signature":"x","severity":1}}\n')
    read = lambda n: logs.lines(spark, str(d / n))
    return logs.all_events(logs.web_events(read("web.log")), logs.auth_events(read("auth.log"), 2024, 5), logs.audit_events(read("audit.log")), logs.network_events(read("eve.json"))).cache()


def test_readers(events):
    assert {r.layer: r["count"] for r in events.groupBy("layer").count().collect()} == {"web": 3, "auth": 3, "system": 2, "network": 2}
    web = events.where("layer = 'web'").orderBy("raw_ref").first()
    assert (web.raw_ref, web.src_ip, web.ld.path, web.ld.status, web.ld.user_agent, web.ld.referer) == ("web.log:1", "9.9.9.9", "/up.php?a=1", 200, 'agent "q"', None)
    auth = {r.ld.event: r for r in events.where("layer = 'auth'").collect()}
    assert auth["ssh_failed"].src_ip == "9.9.9.9" and auth["ssh_failed"].ld.user == "bob" and auth["ssh_failed"].pid == 77
    assert auth["su_other"].ts.year == 2023 and "sudo_denied" in auth
    system = events.where("layer = 'system'").orderBy("raw_ref").collect()
    assert [(r.raw_ref, r.pid, r.ppid, r.ld.exec_args, r.ld.auid, r.ld.session_type) for r in system] == [("audit.log:1", 70, 1, "sh -c", None, "non_interactive"), ("audit.log:3", 77, 70, "sh -c", None, "non_interactive")]
    http = events.where("ld.event_type = 'http'").first()
    assert (http.src_ip, http.ld.xff_status, http.ld.flow_id) == ("9.9.9.9", "valid", "5")


def test_links_and_incidents(spark, events):
    edges = links.all_edges(events).cache()
    kinds = {(r.a, r.b, r.kind) for r in edges.collect()}
    assert ("eve.json:1", "web.log:1", "web_network") in kinds and ("web.log:1", "web.log:2", "web_session") in kinds
    assert ("audit.log:3", "auth.log:1", "system_auth") in kinds and ("audit.log:1", "audit.log:3", "audit_lineage") in kinds
    assert ("eve.json:1", "eve.json:3", "sensor_flow") in kinds and sum(k == "web_system" for *_, k in kinds) == 6
    seeds = spark.createDataFrame([(1, "9.9.9.9", "shell", "critical", ["web.log:1"]), (2, "1.1.1.1", "other", "low", ["auth.log:3"])], "seed_id long, entity string, reason string, severity string, refs array<string>")
    found = {r.entity: r for r in incidents.triaged(incidents.merged(*incidents.build_all(edges, events, seeds))).collect()}
    assert found["9.9.9.9"].priority == "P1" and found["9.9.9.9"].layers == ["auth", "network", "system", "web"]
    assert found["1.1.1.1"].priority == "P4" and found["1.1.1.1"].member_count == 1
    assert investigate.window_events(incidents.build(edges, events, seeds), events, "web").count() == 2


def test_queue_moves(spark):
    at = lambda h: F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "incident_key string, status string, has_update boolean, triage_score long, route string, updated_at timestamp")
    changed = spark.createDataFrame([("a", 50, "investigate"), ("b", 12, "dashboard")], "incident_key string, triage_score long, route string")
    q = queue.upsert(empty, changed, at(1))
    assert [r.incident_key for r in queue.waiting(q).collect()] == ["a"]
    q = queue.upsert(queue.transition(q, changed.where("incident_key = 'a'"), "pending", "investigating", at(2)), changed, at(3))
    assert {r.incident_key: (r.status, r.has_update) for r in q.collect()} == {"a": ("investigating", True), "b": ("pending", False)}
    q = queue.transition(q, changed, "investigating", "done", at(4))
    assert {r.incident_key: (r.status, r.has_update) for r in q.collect()}["a"] == ("pending", False)
    assert queue.reclaim(queue.transition(q, changed, "pending", "investigating", at(4)), at(9)).where("status = 'pending'").count() == 2


def test_stream(spark, tmp_path):
    from emberlog.streaming.incremental import Snapshots, run_bursts

    rows = [(k, 1, f"2024-01-01 00:00:0{k}") for k in range(5)]
    src = tmp_path / "in"
    write = lambda rs: spark.createDataFrame(rs, "event_id long, user_id long, at string").select("event_id", "user_id", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))
    write(rows[:3])
    stream = lambda: spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(src))
    store = Snapshots(spark, str(tmp_path / "state"))
    run_bursts(stream(), store, str(tmp_path / "cp"), width_seconds=60, least=3)
    assert [(r.emit, r.max_member_count) for r in store.latest().collect()] == [("new", 3)]
    write(rows[3:])
    run_bursts(stream(), store, str(tmp_path / "cp"), width_seconds=60, least=3)
    assert [(r.emit, r.max_member_count) for r in store.latest().collect()] == [("update", 5)]


def test_auth_messages(spark):
    told = {
        ("sshd", "error: maximum authentication attempts exceeded for invalid user bob from 9.9.9.9 port 22 ssh2 [preauth]"): ("ssh_max_auth", "failure", "bob", "9.9.9.9"),
        ("sshd", "Connection closed by 9.9.9.9 port 22 [preauth]"): ("ssh_probe", "failure", None, "9.9.9.9"), ("sshd", "banner exchange: Connection from 9.9.9.9 port 22: invalid format"): ("ssh_probe", "failure", None, "9.9.9.9"),
        ("sshd", "Unable to negotiate with 9.9.9.9 port 22: no match"): ("ssh_probe", "failure", None, "9.9.9.9"), ("sshd", "Disconnecting invalid user bob 9.9.9.9 port 22: Too many [preauth]"): ("ssh_auth_fail_close", "failure", "bob", "9.9.9.9"),
        ("sshd", "Disconnected from user bob 9.9.9.9 port 22"): ("ssh_disconnect", "info", "bob", "9.9.9.9"), ("sshd", "Server listening on 0.0.0.0 port 22."): ("sshd_service", "info", None, None),
        ("groupadd", "new group: name=g, GID=5"): ("group_created", "success", None, None), ("groupdel", "removed group 'g' owned by 'g'"): ("account_other", "info", None, None), ("groupdel", "group 'g' removed from /etc/group"): ("group_deleted", "success", None, None),
        ("gpasswd", "delete 'bob' from group 'g'"): ("group_member_removed", "success", "bob", None), ("usermod", "add 'bob' to group 'g'"): ("group_member_added", "success", "bob", None),
    }
    rows = [("auth.log", k + 1, f"2024-05-01T10:00:05Z h {p}[7]: {m}") for k, (p, m) in enumerate(told)]
    got = logs.auth_events(spark.createDataFrame(rows, "file string, line_no long, line string"), 2024, 5)
    assert {r.raw_ref: (r.ld.event, r.ld.result, r.ld.user, r.src_ip) for r in got.collect()} == {f"auth.log:{k + 1}": x for k, x in enumerate(told.values())}


def test_forwarded_clients(spark):
    cases = [
        (None, None, "missing", None), ("-", "", "missing", None), (None, "1.1.1.1, 2.2.2.2", "valid", "2.2.2.2"), ("1.1.1.1", "1.1.1.1, 2.2.2.2", "valid", "1.1.1.1"), ("2.2.2.2", "1.1.1.1, 2.2.2.2", "valid", "2.2.2.2"),
        ("3.3.3.3", "1.1.1.1, 2.2.2.2", "conflict", None), ("1.1.1.1, 2.2.2.2", None, "invalid", None), ("1.1.1.1", "unknown, 1.1.1.1", "invalid", None), (None, "1.1.1.1,", "invalid", None), ("::ffff:1.1.1.1", "1.1.1.1", "valid", "1.1.1.1"),
    ]
    import json

    http = {"url": "/a", "http_method": "GET", "status": 200}
    rows = [("eve", k, json.dumps({"timestamp": "2024-05-01T10:00:01+0000", "event_type": "http", "xff": top, "http": http | {"xff": nested}})) for k, (top, nested, *_) in enumerate(cases)]
    net = logs.network_events(spark.createDataFrame(rows, "file string, line_no long, line string"))
    assert {r.raw_ref: (r.ld.xff_status, r.src_ip) for r in net.collect()} == {f"eve:{k}": (s, ip) for k, (*_, s, ip) in enumerate(cases)}
    web = [("web", k, WEB.format(n=n, ip="9.9.9.9", path=path).replace("POST", "GET")) for k, (n, path) in enumerate([(2, "/a"), (3, "/a"), (3, "/b")])]
    both = net.unionByName(logs.web_events(spark.createDataFrame(web, "file string, line_no long, line string")))
    got = {r.raw_ref: (r.grade, r.reason, r.candidates) for r in links.missing_client_context(both).collect()}
    want = ("context_only", "xff_missing_exact_unique_within_strong_window", ["web:0"])
    assert got == {"eve:0": want, "eve:1": want}
