"""Steps whose work must not grow faster than their input, and results over borders of their chunks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from emberlog import session
from emberlog.operators import ids, incidents, links
from emberlog.sources.logs import FIELDS


@pytest.fixture(scope="module")
def flows(spark):
    """Alerts and http records: two transactions, one without a partner, references with several rows, and no transaction at all."""
    rows = [("a1", 1, "alert", "5", "0"), ("a2", 2, "alert", "5", "0"), ("a2", 2, "alert", "5", "1"), ("a3", 3, "alert", "6", "0"), ("a4", 4, "alert", "7", None), ("a4", 5, "alert", "7", "2"), ("a5", 900, "alert", "7", None)]
    rows += [("h1", 1, "http", "5", "0"), ("h2", 2, "http", "5", "0"), ("h2", 2, "http", "5", "1"), ("h3", 3, "http", "5", "1"), ("h4", 4, "http", "7", "2"), ("h5", 902, "http", "7", None)]
    ld = F.struct(*((F.col(c) if c in ("event_type", "flow_id", "tx_id") else {"sensor_id": F.lit("s"), "transport_src_ip": F.lit("8.8.8.8"), "signature": F.lit("S"), "signature_id": F.lit("1")}.get(c, F.lit(None))).cast(t).alias(c) for c, t in FIELDS.items()))
    e = spark.createDataFrame(rows, "raw_ref string, s long, event_type string, flow_id string, tx_id string")
    return e.select("raw_ref", F.lit("network").alias("layer"), F.timestamp_seconds("s").alias("ts"), F.lit("8.8.8.8").alias("src_ip"), F.lit(None).cast("long").alias("pid"), F.lit(None).cast("long").alias("ppid"), ld.alias("ld"))


PAIRS = {("a1", "h1"), ("a1", "h2"), ("a2", "h1"), ("a2", "h2"), ("a2", "h3"), ("a4", "h4"), ("a5", "h5")}


def test_flow_pairs_once_and_not_shuffled(flows):
    found = links.sensor_flow(flows)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(PAIRS)
    top = found._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Union"
    node = top.children().apply(0)
    while node.nodeName() != "Join":
        assert node.nodeName() in ("Project", "Filter")
        node = node.children().apply(0)


def test_alert_groups_without_pairs(flows):
    groups = ids.alerts(flows).select("raw_ref", "group_key").distinct()
    of = {}
    for r in groups.collect():
        of.setdefault(r.raw_ref, set()).add(r.group_key)
    want = {}
    for a, b in PAIRS:
        want.setdefault(b, set()).update(of[a])
    assert {r.raw_ref: set(r.groups) for r in links.flow_groups(flows, groups).collect()} == want
    seeds, _ = ids.ids_seeds(flows)
    assert sorted((r.n_alerts, r.n_correlated, r.refs) for r in seeds.collect()) == [(1, 0, ["a3"]), (3, 2, ["a4", "a5", "h4", "h5"]), (3, 3, ["a1", "a2", "h1", "h2", "h3"])]


def test_seeds_are_counted_without_their_evidence(spark, flows, sf_dir):
    from emberlog import logqueries
    from emberlog.operators import seeds

    plan = logqueries.seeds_of_both(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_" not in plan  # before: all records of a flow met its groups, and refs were gathered to be counted
    some, _ = ids.ids_seeds(flows)
    none = some.where("n_alerts = 1").withColumn("refs", F.array().cast("array<string>")).drop("evident")
    kept, odd = seeds.all_seeds(some, none)
    assert sorted(r.refs for r in kept.collect()) == sorted(r.refs for r in some.collect()) and [r.reject_reason for r in odd.collect()] == ["missing_evidence"]


def test_strong_ties_are_those_of_all_rings(spark):
    import random

    rng, none = random.Random(5), lambda x: None if rng.random() < 0.1 else x
    half = lambda x, n: spark.createDataFrame([(none(f"{x}{rng.randrange(n)}"), none(rng.choice("ij")), none(rng.choice("mn")), "p", none(200), rng.randrange(120) * 250_000) for _ in range(n)], ", ".join(f"{c}_{x} {t}" for c, t in (("raw_ref", "string"), ("src_ip", "string"), ("method", "string"), ("path", "string"), ("status", "int"), ("at", "long"))))
    net, web = half("b", 90).cache(), half("a", 60).cache()
    want = sorted((r.raw_ref, r.candidates) for r in ids._close(net, web).where("status = 'strong' and raw_ref is not null").collect())
    assert want and sorted((r.raw_ref, r.candidates) for r in ids._strong(net, web).where("raw_ref is not null").collect()) == want


def test_spanning_edges_connect_the_same(spark, flows):
    few = {(r.a, r.b) for r in links.spanning_flow(flows).collect()}
    assert few <= PAIRS
    parts = lambda e: sorted((r.component, r.ref) for r in incidents.members_of(spark.createDataFrame(sorted(e), "a string, b string")).collect())
    assert parts(few) == parts(PAIRS)
    n = 40
    many = flows.where("raw_ref in ('a1', 'h1')").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("raw_ref", F.concat("raw_ref", F.lit("."), "i")).drop("i")
    assert links.all_edges(many, ("sensor_flow",)).count() == n * n and links.all_edges(many, ("sensor_flow",), spanning=True).count() == 2 * n - 1


def test_digest_of_many_members(spark):
    sizes = {"one": 1, "edge": incidents.CHUNK, "many": incidents.CHUNK + 1, "more": 3 * incidents.CHUNK + 7}
    rows = [(k, f"{k}:{i}") for k, n in sizes.items() for i in range(n)]
    got = {r.k: (r.incident_id, r.member_count, len(r.members)) for r in incidents.digests(spark.createDataFrame(rows, "k string, ref string").repartition(5), "k").collect()}
    name = lambda k: hashlib.sha1("|".join(sorted(x for y, x in rows if y == k)).encode()).hexdigest()[:8]
    assert got == {k: (name(k), n, min(n, incidents.SHOWN)) for k, n in sizes.items()}


def test_nearest_by_blocks_equals_pairs(spark, monkeypatch):
    import random

    from emberlog.operators import retrieval

    rng = random.Random(7)
    rows = [(i, [rng.choice((-1.0, 0.5, 2.0)) for _ in range(3)]) for i in range(300)]  # many equal scores
    e = spark.createDataFrame(rows, "doc_id long, v array<float>").repartition(3)
    asked = e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    odd = e.unionByName(spark.createDataFrame([(1000, [1.0, 2.0])], "doc_id long, v array<float>"))
    assert retrieval._plain(e, asked) and not retrieval._plain(odd, asked)
    got = [(r.query_id, r.rank, r.doc_id, r.score) for r in retrieval.nearest(e, asked).collect()]
    monkeypatch.setattr(retrieval, "_plain", lambda *_: False)
    assert sorted(got) == sorted((r.query_id, r.rank, r.doc_id, r.score) for r in retrieval.nearest(e, asked).collect()) and len(got) == 150


@pytest.fixture
def parts_of(spark, monkeypatch):
    """Rows of the largest Parquet file of each table that is cut while partitions hold 1000 rows; all rows by table name."""
    monkeypatch.setattr(session, "PART_ROWS", 1000)
    seen, write = {}, session.cut_to

    def kept(df, path, rows=0):
        write(df, path, rows)
        sizes = spark.read.schema(df.schema).parquet(path).groupBy(F.input_file_name()).count().select("count").collect()
        seen.setdefault(path.rsplit("/emberlog-", 1)[-1].rsplit("-", 1)[0], []).append(max((r[0] for r in sizes), default=0))

    monkeypatch.setattr(session, "cut_to", kept)
    return seen


def test_components_spread_with_the_edges(spark, parts_of):
    from emberlog.operators.components import connected_components

    e = spark.range(20_000).select((F.col("id") % 9_000).alias("a"), (-F.col("id") - 1).alias("b"))
    got = connected_components(e)
    assert got.count() == 29_000 and got.select("component").distinct().count() == 9_000
    assert max(parts_of["pairs"] + parts_of["hooks"]) < 2_000  # four partitions, of 5000 and more, before
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_chains_spread_with_the_events(spark, parts_of):
    from emberlog.operators.lineage import process_chains

    # one line of 8000 processes, the first one a root
    e = spark.range(8_000).select(F.col("id").cast("string").alias("raw_ref"), F.lit("h").alias("host"), (F.col("id") + 2).alias("pid"), F.when(F.col("id") > 0, F.col("id") + 1).otherwise(0).alias("ppid"), F.col("id").alias("at"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = process_chains(e)
        sizes = {(r.n, r.stop_reason): r["count"] for r in got.groupBy(F.size("chain").alias("n"), "stop_reason").count().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes == {(n, "parent_pid_zero"): 1 for n in range(1, 32)} | {(32, "depth_limit"): 7_968, (32, "parent_pid_zero"): 1}
    assert max(parts_of["chains"]) < 1_000  # four partitions of 2000 before


def test_selections_checked_once_by_unit(spark, parts_of):
    from emberlog.operators import mapping

    kind = "incident_id long, unit_id long, nth int, technique_id string, evidence_id long, cited array<long>, reason string"
    odd = [(1, -1, 1, "t1001 ", 7, [7, 8, 9], "r"), (1, -1, 2, "T1001", 7, [7, 5], "r"), (1, -1, None, "T1002", 7, [7, 5], "r"), (1, None, 1, "T1001", 7, [7], "r"), (2, -2, 1, "T1003", 7, [7], "")]
    many = spark.range(6_000).selectExpr("1L AS incident_id", "id DIV 3 AS unit_id", "CAST(id % 3 AS INT) AS nth", "'T1001' AS technique_id", "7L AS evidence_id", "array(7L) AS cited", "'r' AS reason")
    chosen = spark.createDataFrame(odd, kind).unionByName(many)
    catalog = spark.createDataFrame([("T1001", None, False, False), ("T1002", None, True, False), ("T1003", None, False, False)], "technique_id string, parent string, revoked boolean, deprecated boolean")
    offered = spark.createDataFrame([(-1, " t1001"), (-1, None), (-1, "T1001"), (None, "T1001"), (-2, "T1002")], "unit_id long, technique_id string").unionByName(many.select("unit_id", "technique_id"))
    status = spark.createDataFrame([(1, 7, "target"), (1, 8, "context"), (1, 9, "target"), (2, 7, "target")], "incident_id long, evidence_id long, status string")
    got = mapping.checked_selections(chosen, offered, catalog, status)
    assert {(r.unit_id, r.nth): (tuple(r.errors), r.accepted) for r in got.where("unit_id < 0 or unit_id is null").collect()} == {
        (-1, 1): (("EVIDENCE_NOT_MAPPABLE", "EVIDENCE_OUTSIDE_UNIT"), True), (-1, 2): (("UNKNOWN_EVIDENCE_ID", "DUPLICATE_SELECTION"), False), (-1, None): (("REVOKED_OR_DEPRECATED", "NOT_IN_CANDIDATES"), False),
        (None, 1): (("NOT_IN_CANDIDATES",), False), (-2, 1): (("NOT_IN_CANDIDATES", "EMPTY_REASON"), False),
    }
    assert got.where("accepted and unit_id >= 0").count() == 2_000
    assert len(parts_of["checked"]) == 1 and parts_of["checked"][0] < 1_000


def test_web_pattern_is_asked_once_for_all_groups(spark):
    from emberlog.sources import logs

    head = "2024-05-01T00:00:00Z r1 [2001:DB8::1]:443 p https shop"
    rows = [f'{head} "get /a?q=\\"b HTTP/1.1" 200 12 - 99 "-" "agent \\\\" xff="1.1.1.1"', f'{head} "POST /c" - - - - "" "x\\"y" ', f'{head} "unclosed 200 1 1 1 "-" "-"', f'- {head[21:]} "GET /" 200 1 1 1 "-" "-"']
    e = logs.web_events(spark.createDataFrame([("w", i, x) for i, x in enumerate(rows)], "file string, line_no long, line string"))
    assert sorted((r.raw_ref, r.src_ip, r.ld.method, r.ld.path, r.ld.status, r.ld.bytes, r.ld.duration_us, r.ld.host, r.ld.user_agent) for r in e.collect()) == [
        ("w:0", "2001:db8::1", "GET", '/a?q="b', 200, 12, None, "shop", "agent \\"), ("w:1", "2001:db8::1", "POST", "/c", None, None, None, "shop", 'x"y'),
    ]
    assert e._jdf.queryExecution().optimizedPlan().toString().count("xff=") <= 3


def test_auth_headers_and_pairs_are_read_once(spark):
    from emberlog.sources import logs

    rows = ["2024-05-01T00:00:00Z h sshd[7]: pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser=r rhost=9.9.9.9  user=u\u2028", "May  2 03:04:05 h su: a  b ", "May 2 h su: x", "2024-05-01T00:00:00Z h x[1]:y"]
    e = logs.auth_events(spark.createDataFrame([("a", i, x) for i, x in enumerate(rows)], "file string, line_no long, line string"), 2024, 5)
    assert sorted((r.raw_ref, r.pid, r.machine, r.ld.program, r.ld.event, r.ld.user, r.ld.src_user, r.src_ip) for r in e.collect()) == [
        ("a:0", 7, "h", "sshd", "pam_auth_failure", "u", "r", "9.9.9.9"), ("a:1", None, "h", "su", "su_other", None, None, None),
    ]
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(regexp_replace(") <= 3  # 36 before: the pairs of a message were made for each field


def test_gates_copy_no_call(spark, sf_dir):
    from emberlog import logqueries

    assert "Expand" not in logqueries.termination_gates(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()  # each call five times before


def test_action_order_is_made_once_for_a_case(spark, sf_dir):
    from emberlog import logqueries
    from emberlog.operators import mapping

    plan = logqueries.action_order(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # before: above the Generate, so again for each row of a case, and lines were grouped twice and joined by a union
    assert "aggregate(" not in plan.split("Generate")[0] and plan.count("Relation [") == 1 and "Union" not in plan
    # cases of more actions than a number has bits, and of as many; needs as a column and as a table; two cycles and what waits for one
    import random

    rng, rows = random.Random(3), []
    for case, n in (("a", 63), ("b", 64), ("c", 90), ("d", 5), ("e", 1)):
        rows += [(case, i, rng.randrange(9), [rng.randrange(n + 3) for _ in range(rng.randrange(3))] if n > 1 else None) for i in range(n)]
    rows += [("f", 1, 1, [2]), ("f", 2, 2, [1]), ("f", 3, 9, [3, None]), ("f", 4, 0, [2])]
    want = {}
    for case in "abcdef":
        left, done = {i: (p, i, set(x or []) - {i, None}) for c, i, p, x in rows if c == case}, []
        known = set(left)
        while left:
            free = [v for v in left.values() if (v[2] & known) <= set(done)]
            for _, i, _ in [min(free, key=lambda v: v[:2])] if free else sorted(left.values(), key=lambda v: v[:2]):
                done.append(i)
                del left[i]
        want |= {(case, i): k + 1 for k, i in enumerate(done)}
    e = spark.createDataFrame(rows, "incident_id string, action_id long, priority long, needs array<long>")
    for out in (mapping.in_order(e, needs="needs"), mapping.in_order(e.drop("needs"), e.select("incident_id", "action_id", F.explode("needs").alias("needs")))):
        assert out.columns == ["incident_id", "action_id", "priority", "place"] and {(r.incident_id, r.action_id): r.place for r in out.collect()} == want


def test_texts_without_words_are_not_cut_into_clauses(spark):
    from emberlog.plans import keywords

    # before: trim() took a clause's index for what to trim, so that clause 0 lost a zero at its end
    text = "no euid=0\tBut yet a.. b.c. ... x\r\n SUID  find ran however .. euid=0"
    assert [r[0] for r in spark.createDataFrame([(text,), ("euid=0",), (None,)], "t string").select(keywords.clauses(F.col("t"))).collect()] == [["no euid=0", "a", "b.c", "x", "SUID find ran", "euid=0"], ["euid=0"], []]
    rules = [{"id": "u", "words": ["euid=0", "suid find", "Key"], "commands": ["tar -czf"], "subject": ["ROOT"]}]
    rows = [("a", text, ""), ("b", "euid=0", None), ("c", "a TAR -czf", "tar   -czf"), ("d", None, "KEY"), ("e", "key. no root", ""), ("f", "key", ""), ("f", "no root", ""), ("g", "suid x, find", ""), ("h", "nothing", "no")]
    e = spark.createDataFrame([("i", *r) for r in rows], "incident_id string, evidence_id string, description string, event_type string")
    found = keywords.evidence_hits(e, rules)
    assert {r.evidence_id: r.keywords for r in found.collect()} == {"a": ["euid=0", "suid find"], "b": ["euid=0"], "c": ["tar -czf"], "d": ["key"]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    cut, scan = plan.rindex("regexp_replace(replace("), plan.index("RepartitionByExpression")
    assert cut < scan < plan.index("Filter exists(")  # texts are left out and dealt to all tasks first


def test_index_cuts_texts_once_and_in_all_tasks(spark, parts_of, tmp_path):
    from emberlog.operators import textindex
    from emberlog.operators.retrieval import tokens

    asked = []

    def words(text):
        asked.append(text)
        return tokens(text)

    docs = spark.range(400).coalesce(1).select((F.col("id") % 399).alias("doc_id"), F.when(F.col("id") != 7, F.concat(F.lit("a b a "), F.col("id").cast("string"))).alias("text"))
    index = textindex.build(docs, str(tmp_path), {"t": 1}, words)
    assert len(asked) == 1  # twice before, for the average and for the counts
    assert sorted(parts_of["counted"]) < [400] and index.blocks.select(F.sum(F.size("postings"))).first()[0] == 3 * 399 - 2  # one file of all rows before
    e = spark.createDataFrame([("A-b1 \u00dc c..9",), ("",), (None,), (" \n-",)], "t string").select(tokens(F.col("t")).alias("w"))
    assert [r.w for r in e.collect()] == [["a", "b1", "c", "9"], [], None, []]
    assert index.terms.select("average").distinct().collect() == [(399 * 4 / 400,)]


def test_spanning_pairs_of_a_window_connect_the_same(spark):
    import random

    rng = random.Random(11)
    rows = []
    for layer in ("web", "system", "auth"):
        for i in range(70):
            at = rng.choice((rng.randrange(0, 5 * 3600), 5 * rng.randrange(720), 3600 * rng.randrange(5))) * 1_000_000 + rng.choice((0, 0, 1, 999_999))
            rows.append((None if rng.random() < 0.03 else f"{layer}:{rng.randrange(60)}", layer, None if rng.random() < 0.05 else at, rng.choice((None, 1, 2, 3, 4, 5, 6)), rng.choice((None, "m1", "m2")), rng.choice((33, 33, 0, None))))
    e = spark.createDataFrame(rows, "raw_ref string, layer string, us long, pid long, machine string, uid long").select("raw_ref", "layer", F.timestamp_micros("us").alias("ts"), "pid", "machine", F.struct("uid").alias("ld")).cache()

    def told(edges):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return {x: root(x) for x in up}

    for events in (e, e.drop("machine"), e.where("machine is null"), e.where("pid = 1 or layer = 'web'")):
        for name in ("web_system", "system_auth"):
            every, few = ({(r.a, r.b) for r in links.all_edges(events, (name,), spanning=s).collect()} for s in (False, True))
            assert few <= every and told(few) == told(every), name
    n = 60
    many = spark.range(2 * n).select(F.concat(F.lit("r"), "id").alias("raw_ref"), F.when(F.col("id") < n, "system").otherwise("auth").alias("layer"), F.timestamp_seconds(F.col("id") % n).alias("ts"), F.lit(7).alias("pid"))
    assert links.all_edges(many, ("system_auth",)).count() == n * n and links.all_edges(many, ("system_auth",), spanning=True).count() == 2 * n - 1


def test_the_chain_broadcasts_by_measured_sizes(spark, sf_dir, monkeypatch):
    from emberlog.logqueries import log_events
    from emberlog.plans import chain

    seen, write, guessed = [], session.cut_to, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def kept(df, path, rows=0):
        seen.append((spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")))
        write(df, path, rows)

    monkeypatch.setattr(session, "cut_to", kept)
    found = chain.detect_incidents(log_events(spark, sf_dir).limit(50), rules=chain.shipped_rules()[:2])
    assert seen and set(seen) == {("-1", guessed)}
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == guessed and not spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # all its joins are done within


def test_a_rule_is_asked_once(spark, sf_dir):
    from emberlog.logqueries import log_events
    from emberlog.operators import seeds

    rule = lambda x, **more: {"id": x, "level": "low", "layer": "system", "detection": {"s": {"exec_args|contains": f"word{x}"}, "condition": "s"}, **more}
    own = [rule("a"), rule("b"), rule("c", aggregation={"seconds": 5, "min_count": 2}), rule("d", aggregation={"seconds": 6, "min_count": 2})]
    plan = seeds.rule_seeds(log_events(spark, sf_dir), own)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"word{x}") for x in "abcd"] == [1] * 4
