"""Lineage against plain folds: boot epochs, instances, parents, edges and chains; running values over parts."""

from __future__ import annotations

import random
from collections import defaultdict
from functools import reduce

import pytest
from pyspark.sql import functions as F

from emberlog.operators import lineage, scan
from emberlog.operators.range_join import as_of

SCHEMA = "host string, at long, serial long, raw_ref string, pid long, ppid long"


def fold_epochs(rows):
    by, out = defaultdict(list), {}
    for r in rows:
        by[r[0]].append(r)
    for own in by.values():
        epoch, top = 0, None
        for r in sorted(own, key=lambda r: (r[1], -1 if r[2] is None else r[2], r[3])):
            s = r[2]
            if s is not None:
                if top is not None and top - s > lineage.RESET:
                    epoch, top = epoch + 1, s
                else:
                    top = s if top is None else max(top, s)
            out[r[3]] = epoch
    return out


def fold_instances(rows):
    epochs, by, found = fold_epochs(rows), defaultdict(list), {}
    for r in rows:
        if r[4] is not None:
            by[(r[0], epochs[r[3]], r[4])].append(r)
    for key, own in by.items():
        seq, parent = 0, None
        for r in sorted(own, key=lambda r: (r[1], -1 if r[2] is None else r[2], r[3])):
            p = r[5]
            if p is not None:
                if parent is not None and p != parent and p != 1:
                    seq, parent = seq + 1, p
                elif parent is None:
                    parent = p
            one = found.setdefault((*key, seq), {"ppid": None, "events": []})
            one["ppid"] = parent
            one["events"].append(r)
    return found


def fold_edges(found):
    edges = set()
    for (host, epoch, pid, _), x in found.items():
        p, first = x["ppid"], x["events"][0]
        if p is None or p in (0, 1) or p == pid:
            continue
        near = [(y["events"][0][1], k[3], y) for k, y in found.items() if k[:3] == (host, epoch, p) and y["events"][0][1] <= first[1] + lineage.SLACK]
        if near:
            events = max(near, key=lambda n: n[:2])[2]["events"]
            before = [e for e in events if e[1] <= first[1]]
            edges.add(((before[-1] if before else events[0])[3], first[3]))
    return edges


def made(n, seed, hosts="ab"):
    rng, rows, serial = random.Random(seed), [], dict.fromkeys(hosts, 500)
    for k in range(n):
        h = rng.choice(hosts)
        serial[h] = max(0, serial[h] + rng.choice([1, 1, 2, 40, -30, 900]) - (4000 if rng.random() < 0.03 else 0))
        rows.append((h, k * 900_000 + rng.randrange(3), rng.choice([serial[h], serial[h], None]), f"r{k:05}", rng.choice([None, *range(2, 9)]), rng.choice([None, 0, 1, *range(2, 9)])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_step_functions(seed):
    """A run's step function gives what the fold gives from any start, and runs compose."""
    rng = random.Random(seed)
    runs = [[float(rng.randrange(0, 6000, 1 + 99 * (seed % 2))) for _ in range(rng.randrange(0, 40))] for _ in range(6)]
    pieces = [reduce(lineage.after, r, [(lineage.END, 0, None)]) for r in runs]
    assert pieces == [lineage.summed(r) for r in runs]
    whole = reduce(lineage.composed, pieces)
    for start in [-lineage.END, *(rng.uniform(-100, 8000) for _ in range(200)), *(s + d for r in runs for s in r[:5] for d in (0, 1000, 1001))]:
        epoch, top = 0, start
        one = (0, start)
        for run, p in zip(runs, pieces, strict=True):
            for s in run:
                epoch, top = (epoch + 1, s) if top - s > lineage.RESET else (epoch, max(top, s))
            one = lineage.through(p, *one)
            assert one == (epoch, top)
        assert lineage.through(whole, 0, start) == (epoch, top)


@pytest.mark.parametrize("chunk", [4, 8192])
def test_lineage(spark, monkeypatch, chunk):
    """Small chunks make several levels of runs."""
    monkeypatch.setattr(lineage, "CHUNK", chunk)
    rows = made(300, chunk)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r.raw_ref: r.epoch for r in lineage.boot_epochs(df).collect()} == fold_epochs(rows)
    want = fold_instances(rows)
    events = lineage.instance_events(df)
    assert {r.raw_ref: (r.host, r.epoch, r.pid, r.seq) for r in events.collect()} == {e[3]: k for k, x in want.items() for e in x["events"]}
    got = lineage.instances(events).collect()
    assert {(r.host, r.epoch, r.pid, r.seq): (r.ppid, r.first_at, r.last_at, r.first_ref, r.n_events) for r in got} == {k: (x["ppid"], x["events"][0][1], x["events"][-1][1], x["events"][0][3], len(x["events"])) for k, x in want.items()}
    assert {tuple(r) for r in lineage.lineage_edges(df).collect()} == fold_edges(want)


@pytest.mark.parametrize(("falls", "seed"), [(True, 1), (False, 2), (False, 3)])
def test_instances_over_parts(spark, falls, seed):
    """Twelve parts of the order, with epochs that end often and one that never ends, so that process ids lie in many parts."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(ref):
        asked.add(1)
        return ref

    rows = [r if falls else (*r[:2], None if r[2] is None else k, *r[3:]) for k, r in enumerate(made(400, seed))]
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        want, df = fold_instances(rows), spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("raw_ref", costly("raw_ref"))
        assert {r.raw_ref: (r.host, r.epoch, r.pid, r.seq) for r in lineage.instance_events(df).collect()} == {e[3]: k for k, x in want.items() for e in x["events"]}
        assert asked.value == len(rows)  # before: events were worked out twice, for the ranges and for the rows
        assert {tuple(r) for r in lineage.lineage_edges(df).collect()} == fold_edges(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lineage.boot_epochs(none).count() == lineage.instance_events(none).count() == lineage.lineage_edges(none).count() == 0
    assert lineage.process_chains(none.withColumn("host", F.lit("h"))).count() == 0


def test_instances_by_hand(spark):
    rows = [("h", 1, 498738, "a", 10, 1), ("h", 2, 498739, "b", 10, 5), ("h", 3, 75, "c", 10, 5), ("h", 4, 76, "d", 10, 1), ("h", 5, 77, "e", 10, None), ("h", 6, 78, "f", 10, 9)]
    got = lineage.instances(lineage.instance_events(spark.createDataFrame(rows, SCHEMA))).orderBy("epoch", "seq").collect()
    assert [(r.epoch, r.seq, r.ppid, r.first_ref, r.n_events) for r in got] == [(0, 0, 1, "a", 1), (0, 1, 5, "b", 1), (1, 0, 5, "c", 3), (1, 1, 9, "f", 1)]


def test_one_key_spreads(spark):
    """All rows of one key: several parts, the right values across their borders, and no part with all rows."""
    rng = random.Random(9)
    rows = [(k, rng.randrange(5000), rng.choice([None, rng.randrange(100)])) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, at long, v long").withColumn("key", F.lit(None).cast("string"))
    parts = scan.dealt(df, ("key",), ("at", "id"), 8)
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1000
    specs = {"total": scan.sum_of(F.col("v")), "top": scan.max_of(F.col("v")), "latest": scan.last_of(F.col("v"), F.struct("at", "id"))}
    for inclusive in (True, False):
        got = {r.id: (r.total, r.top, r.latest) for r in scan.running(parts, ("key",), ("at", "id"), specs, inclusive).collect()}
        seen, last = [], None
        for k, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
            if inclusive and v is not None:
                seen.append(v)
                last = v
            assert (got[k][0] or 0, got[k][1], got[k][2]) == (sum(seen), max(seen, default=None), last)
            if not inclusive and v is not None:
                seen.append(v)
                last = v


def test_as_of_over_parts(spark):
    rng = random.Random(3)
    a, b = [(k, "x", rng.randrange(3000)) for k in range(600)], [(k, "x", rng.randrange(3000)) for k in range(200)]
    got = as_of(spark.createDataFrame(a, "a long, ka string, ta long"), spark.createDataFrame(b, "b long, kb string, tb long"), "a", "ta", "tb", (("ka", "kb"),), "b", 2, parts=6)
    want = {x[0]: max(((y[2], y[0]) for y in b if y[2] <= x[2] + 2), default=(None, None))[1] for x in a}
    assert {r.a: r.b for r in got.collect()} == want


def plain_chain(rows, leaf, most):
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[3])):
        if r[4] is not None:
            by[(r[0], r[4])].append(r)
    chain, seen = [leaf], {leaf[4]}
    while True:
        here = chain[-1]
        p = here[5]
        if p is None or p == 0:
            return [r[3] for r in chain], "parent_pid_zero"
        if p in seen:
            return [r[3] for r in chain], "cycle_detected"
        if len(chain) >= most:
            return [r[3] for r in chain], "depth_limit"
        own = by.get((here[0], p))
        if not own:
            return [r[3] for r in chain], "parent_not_observed"
        before = [r for r in own if (r[1], r[3]) <= (here[1], "~")]
        chain.append(before[-1] if before else own[0])
        seen.add(p)


@pytest.mark.parametrize("most", [3, 32])
def test_process_chains(spark, most):
    rng = random.Random(most)
    rows = [("h", k * 10, k, f"r{k:04}", rng.randrange(1, 60), rng.choice([0, None, *range(1, 70)])) for k in range(300)]
    got = {r.raw_ref: (r.chain, r.stop_reason) for r in lineage.process_chains(spark.createDataFrame(rows, SCHEMA), most).collect()}
    assert got == {r[3]: plain_chain(rows, r, most) for r in rows}
    assert {x[1] for x in got.values()} >= {"parent_pid_zero", "cycle_detected", "parent_not_observed"}


def test_ancestors(spark):
    up = lineage.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, None), (6, 1)], "id long, parent long"))
    assert sorted(map(tuple, up.collect())) == [(1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 3, 1), (3, 1, 1), (3, 2, 2), (6, 1, 1), (6, 2, 2), (6, 3, 3)]
    line = lineage.ancestors(spark.range(50).selectExpr("id", "id - 1 AS parent").where("id > 0"))
    assert {(r.id, r.ancestor, r.depth) for r in line.collect()} == {(k, k - d, d) for k in range(1, 50) for d in range(1, min(32, k) + 1)}
