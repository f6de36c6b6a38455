"""Keyword techniques, citations, actions, gates and the catalogue against small cases."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from emberlog.operators import decisions
from emberlog.plans import keywords
from emberlog.sources.catalog import plain_description, read_catalog


def test_evidence_hits(spark):
    rows = [
        ("i", 1, "auth", "Failed password for root. No reverse shell was seen"),
        ("i", 2, "reverse shell", "there was no reverse shell"),
        ("i", 3, "reverse shell", "traffic to a host"),
        ("i", 4, None, "ran useradd --help"),
        ("i", 5, None, "useradd를 실행, then myuseradd"),
        ("i", 6, None, "Large Outbound Data Transfer over C2"),
        ("i", 7, None, "Large Outbound Data Transfer over C2; C2 attribution unconfirmed"),
        ("i", 8, None, "Large Outbound Data Transfer"),
        ("i", 9, None, None),
        ("i", 10, None, "ran  bash   -i but not wget http"),
    ]
    ev = spark.createDataFrame(rows, "incident_id string, evidence_id long, event_type string, description string")
    got = {(r.evidence_id, r.technique_id): r.keywords for r in keywords.evidence_hits(ev, keywords.shipped()).collect()}
    assert got == {
        (1, "T1110"): ["failed password"], (3, "T1059.004"): ["reverse shell"], (5, "T1136.001"): ["useradd"],
        (6, "T1041"): ["large outbound data transfer"], (10, "T1059.004"): ["bash -i"],
    }


def test_mapped(spark):
    cases = spark.createDataFrame(
        [("a", "THREAT_CONFIRMED", "passed", "Brute force of SSH"), ("b", "THREAT_CONFIRMED", "incomplete", "brute force"), ("c", "FALSE_POSITIVE", "passed", ""), ("d", "INCONCLUSIVE", "passed", ""), ("e", "THREAT_CONFIRMED", None, ""), ("f", None, "passed", ""), ("g", "THREAT_CONFIRMED", "passed", None)],
        "incident_id string, verdict string, provenance string, attack_type string",
    )
    ev = spark.createDataFrame([(k, n, None, "failed password", n == 1) for k in "abcdef" for n in (1, 2)], "incident_id string, evidence_id long, event_type string, description string, eligible boolean")
    techniques, status = keywords.mapped(cases, ev, keywords.shipped())
    assert dict(map(tuple, status.collect())) == {"a": "mapped", "b": "partial", "c": "not_applicable", "d": "deferred", "e": "deferred", "f": "error", "g": "no_techniques_matched"}
    got = {r.incident_id: (r.technique_id, r.matched_by, r.keywords, r.evidence_ids) for r in techniques.collect()}
    assert got == {"a": ("T1110", ["verdict", "evidence"], ["brute force", "failed password"], [1, 2]), "b": ("T1110", ["evidence"], ["failed password"], [1])}


def test_citations(spark):
    ev = spark.createDataFrame([("i", 1, ["a", "a"], 0.5), ("i", 2, ["a", "z"], 0.5), ("i", 3, [], 0.4), ("i", 4, ["b"], 0.3), ("j", 1, ["a"], 0.2), ("i", 5, None, 0.1)], "incident_id string, evidence_id long, refs array<string>, contribution double")
    seen = spark.createDataFrame([("i", "a", "f:1"), ("i", "a", "f:1"), ("i", "b", "f:2"), ("i", "b", "g:2")], "incident_id string, ref string, location string")
    got = {(r.incident_id, r.evidence_id): (r.n_known, r.n_unknown, r.n_ambiguous, r.contribution) for r in decisions.citations(ev, seen).collect()}
    assert got == {("i", 1): (1, 0, 0, 0.5), ("i", 2): (1, 1, 0, 0.0), ("i", 3): (0, 0, 0, 0.4), ("i", 4): (1, 0, 1, 0.0), ("j", 1): (0, 1, 0, 0.0), ("i", 5): (0, 0, 0, 0.1)}


def test_chosen_actions(spark):
    rng = random.Random(4)
    cand = [(i, f"t{k:02}", rng.randrange(1, 4), rng.choice(["HIGH", "LOW"]), rng.random() < 0.7, rng.random() < 0.1) for i in range(12) for k in range(16) if rng.random() < 0.8]
    sel = [(i, t) for i, t, *_ in cand if rng.random() < 0.6]
    req = [(f"t{rng.randrange(16):02}", f"t{rng.randrange(16):02}") for _ in range(6)]
    want = set()
    for i in range(12):
        own = {c[1]: c for c in cand if c[0] == i}
        ids = {t for j, t in sel if j == i}
        safe = {t for t in own if own[t][5]}
        ids |= safe
        while more := {r for t, r in req if t in ids and r in own} - ids:
            ids |= more
            safe |= more
        for test, most in ((lambda t: own[t][3] == "HIGH", 1), (lambda t: not own[t][4], 2), (lambda t: True, 8)):
            over = sum(map(test, ids)) - most
            ids -= set(sorted((t for t in ids if test(t) and t not in safe), key=lambda t: (-own[t][2], t))[: max(0, over)])
        want |= {(i, t) for t in ids}
    d = decisions.chosen_actions(
        spark.createDataFrame(cand, "incident_id long, template_id string, priority int, risk string, reversible boolean, mandatory boolean"),
        spark.createDataFrame(sel, "incident_id long, template_id string"), spark.createDataFrame(req, "template_id string, required string"),
    )
    assert {(r.incident_id, r.template_id) for r in d.collect()} == want


def test_verdicts_and_gate(spark):
    checks = spark.createDataFrame([("a", "principle_7", False), ("b", "principle_7", True), ("c", "principle_9", None), ("d", "principle_9", True)], "incident_id string, rule string, brute_force boolean")
    windows = spark.createDataFrame([("a", 4), ("d", 0), ("e", 3), ("f", None)], "incident_id string, n_rows long")
    assert dict(map(tuple, decisions.rule_verdict(checks, windows).collect())) == {"a": "FALSE_POSITIVE", "b": "THREAT_CONFIRMED", "c": "THREAT_CONFIRMED", "d": "INCONCLUSIVE", "f": "INCONCLUSIVE"}
    rows = [("INCOMPLETE", None, None, None), ("DONE", "THREAT_CONFIRMED", "passed", "mapped"), ("DONE", "THREAT_CONFIRMED", "passed", "error"), ("DONE", "THREAT_CONFIRMED", "unavailable", "mapped"), ("DONE", None, "passed", "mapped"), ("DONE", "THREAT_CONFIRMED", "passed", None)]
    d = spark.createDataFrame(rows, "s string, v string, p string, m string").select(decisions.response_gate(*map(F.col, "svpm")))
    assert [r[0] for r in d.collect()] == ["skipped", "recommended", "recommended_generic", "deferred", "error", "error"]


def test_entities(spark):
    rows = [("i", "ip", "1.1.1.1", "tool_input", 1), ("i", "ip", "1.1.1.1", "seed_src_ip", 1), ("i", "ip", "2.2.2.2", "seed_detail", 2), ("i", "file_path", "/bin/sh", "seed_detail", 1), ("i", "file_path", "/tmp/x", "tool_input", 3), ("i", "user", "", "seed_detail", 1), ("i", "user", None, "seed_detail", 1)]
    d = decisions.entities(spark.createDataFrame(rows, "incident_id string, kind string, value string, source string, nth long"))
    assert {tuple(r) for r in d.collect()} == {("i", "ip", "2.2.2.2", "seed_detail", 1), ("i", "ip", "1.1.1.1", "seed_src_ip", 2), ("i", "file_path", "/tmp/x", "tool_input", 1)}


def test_catalog(spark, tmp_path):
    ext = lambda x: [{"source_name": "other", "external_id": "no"}, {"source_name": "mitre-attack", "external_id": x, "url": f"u/{x}"}]
    phase = lambda *names: [{"kill_chain_name": "mitre-attack", "phase_name": n} for n in names]
    objects = [
        {"type": "x-mitre-matrix", "id": "m", "tactic_refs": ["ta2", "ta1"]},
        {"type": "x-mitre-tactic", "id": "ta1", "name": "One", "x_mitre_shortname": "one", "external_references": ext("TA1")},
        {"type": "x-mitre-tactic", "id": "ta2", "name": "Two", "x_mitre_shortname": "two", "external_references": ext("TA2")},
        {"type": "attack-pattern", "id": "p", "name": "P", "description": "a  [b](https://x.y) (Citation: z)<code>c</code>", "external_references": ext("T1000"), "kill_chain_phases": phase("one", "two")},
        {"type": "attack-pattern", "id": "q", "name": "Q", "x_mitre_is_subtechnique": True, "external_references": ext("T1000.001"), "kill_chain_phases": phase("one")},
        {"type": "attack-pattern", "id": "r", "name": "R", "revoked": True, "external_references": ext("T1001")},
        {"type": "relationship", "id": "x", "relationship_type": "subtechnique-of", "source_ref": "q", "target_ref": "p"},
        {"type": "relationship", "id": "y", "relationship_type": "revoked-by", "source_ref": "r", "target_ref": "p"},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "objects": objects}, indent=1))
    tactics, techniques = read_catalog(spark, str(tmp_path / "b.json"))
    assert sorted(map(tuple, tactics.collect())) == [("TA1", "One", "one", 1), ("TA2", "Two", "two", 0)]
    got = {r.technique_id: (r.tactics, r.parent, r.revoked, r.revoked_by) for r in techniques.collect()}
    assert got == {"T1000": (["two", "one"], None, False, None), "T1000.001": (["one"], "T1000", False, None), "T1001": ([], None, True, "T1000")}
    assert techniques.where("technique_id = 'T1000'").first().description == "a b c"
    assert spark.range(1).select(plain_description(F.lit("a\n\n\n\nb "))).first()[0] == "a\n\nb"
