"""Techniques named by words in evidence and verdicts.

A text is cut into clauses; each clause is reduced to its small letters, its English words and its command words, and
every rule is asked on those. All word lists are data (language.yml, techniques.yml).
"""

from __future__ import annotations

import re
from functools import cache, reduce
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import spread

#: What a word of a rule is for: words and commands name the technique, context must stand beside them, and a denied
#: subject takes the technique back.
ROLES = ("words", "commands", "context", "subject")


@cache
def _shipped(name: str):
    return yaml.safe_load(Path(__file__).with_name(name).read_text(encoding="utf-8"))


def shipped() -> list[dict]:
    """The technique rules of techniques.yml; attack, words, commands, context and subject are optional lists."""
    return _shipped("techniques.yml")


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def clauses(text: Column) -> Column:
    """The clauses of a text: up to line ends, end signs, full stops before a blank, end words and end suffixes."""
    own = _shipped("language.yml")
    t = F.coalesce(text, F.lit(""))
    for sign in own["end_signs"]:
        t = F.replace(t, F.lit(sign), F.lit("\n"))
    for suffix in own["end_suffixes"]:
        t = F.replace(t, F.lit(suffix), F.lit(suffix + "\n"))
    # blank-separated words have one blank between them, line ends are words; an end word is a cut, full stops behind a word end a clause
    t = F.regexp_replace(F.replace(t, F.lit("\n"), F.lit(" \n ")), r"[ \t\r\f]++", " ")
    t = F.regexp_replace(t, rf"(?i)(?<![^ ])(?:{'|'.join(map(re.escape, own['end_words']))})(?![^ ])", "\n")
    t = F.regexp_replace(t, r"(?<![.])[.]++(?![^ ])", " \n")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")  # trim alone would take the index as what to trim


def denied(clause: Column) -> Column:
    """Whether a clause denies or doubts: by an English word of it (not, too, but in "not only"), or by a Korean stem."""
    own = _shipped("language.yml")
    low = F.replace(F.lower(clause), F.lit("’"), F.lit("'"))
    words = F.split(low, r"[^\p{L}\p{N}_']+")
    nots = F.exists(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b")), lambda p: (p["a"] == "not") & (F.coalesce(p["b"], F.lit("")) != "only"))
    bare = F.regexp_replace(clause, r"\s+", "")
    return F.arrays_overlap(words, F.array(*map(F.lit, own["denying_words"]))) | nots | bare.rlike("|".join(map(re.escape, own["denying_stems"])))


def command_words(clause: Column) -> Column:
    """A clause's words of a command line, one blank around each: a path's parts are words, dots and hyphens belong to them."""
    words = F.transform(F.regexp_extract_all(clause, F.lit("[A-Za-z0-9_.-]+"), F.lit(0)), lambda w: F.rtrim(w, F.lit(".")))
    return F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w != ""), " "), F.lit(" "))


def _asks_help(line: Column, command: str) -> Column:
    after = F.concat(F.lit(" "), F.substring_index(line, f" {command} ", -1))
    return _any([F.contains(after, F.lit(f" {h} ")) for h in _shipped("language.yml")["help_options"]])


def _shell(word: str) -> str:
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c in "_.-") else " " for c in word).split())


def _words(rule: dict, role: str) -> list[str]:
    return list(dict.fromkeys(" ".join(str(x).split()) for x in rule.get(role) or []))


def _may_name(rules: list[dict], *texts: str) -> Column:
    """Whether some rule's word could stand in a clause of the texts: their small letters hold all of its blank-separated parts. Clauses
    are cut from the text and only lose blanks, so what this leaves out has no findings; a sigma's small letter depends on its place."""
    wanted = dict.fromkeys(frozenset(p for p in (_shell(w) if role == "commands" else w).lower().split() if not set(p) & set("σς")) for r in rules for role in ROLES for w in _words(r, role))
    low = F.lower(F.concat_ws("\n", *texts))
    said = lambda t: _any([reduce(Column.__and__, (F.contains(t, F.lit(p)) for p in sorted(parts)), F.lit(True)) for parts in wanted])
    return F.exists(F.array(low), said)


def _findings(rules: list[dict], low: Column, line: Column) -> Column:
    """One array of (technique_id, role, word, help) for all rules' words that stand in a clause."""
    tests = []
    for r in rules:
        for role in ROLES:
            for word in _words(r, role):
                shell = _shell(word)
                test, helped = (F.contains(line, F.lit(f" {shell} ")), _asks_help(line, shell)) if role == "commands" else (F.contains(low, F.lit(word.lower())), F.lit(False))
                said = F.struct(F.lit(r["id"]).alias("technique_id"), F.lit(role).alias("role"), F.lit(word if role == "commands" else word.lower()).alias("word"), helped.alias("help"))
                tests.append(F.when(test, said))
    return F.array_compact(F.array(*tests))


def evidence_hits(evidence: DataFrame, rules: list[dict]) -> DataFrame:
    """(incident_id, evidence_id, technique_id, keywords) of evidence (incident_id, evidence_id, event_type, description).

    A denied clause names nothing, nor does a command whose options ask for help. What the description denies is not
    taken from the event type either; a denied subject takes the technique back for that evidence. Rules are columns of
    one scan, so nothing is crossed; two sums follow, by clause and by evidence. Texts that hold no word of any rule are left out
    before they are cut into clauses, the others are dealt to all tasks; only clauses that name something are asked for denials.
    """
    key = ["incident_id", "evidence_id"]
    both = F.array(*(F.struct(F.lit(k).alias("typed"), clauses(F.col(c)).alias("list")) for k, c in ((False, "description"), (True, "event_type"))))
    able = spread(evidence.select(*key, "description", "event_type").where(_may_name(rules, "description", "event_type")), *key)
    each = able.select(*key, F.inline(both)).select(*key, "typed", F.posexplode_outer("list").alias("nth", "clause")).where("clause is not null")  # of posexplode() Spark makes a filter that cuts the texts before they are dealt, too
    each = each.withColumns({"low": F.lower("clause"), "line": command_words(F.col("clause")) if any(r.get("commands") for r in rules) else F.lit(" ")})
    found = each.select(*key, "typed", "nth", "clause", F.inline_outer(_findings(rules, F.col("low"), F.col("line")))).where("technique_id is not null").withColumn("denied", denied(F.col("clause")))
    names = F.col("role").isin("words", "commands")
    by_clause = found.groupBy(*key, "typed", "nth", "denied", "technique_id").agg(
        F.collect_set(F.when(names & ~F.col("help"), F.col("word"))).alias("named"), F.max(names & F.col("help")).alias("helped"),
        F.max(F.col("role") == "context").alias("beside"), F.max(F.col("role") == "subject").alias("subject"), F.max(names).alias("mentioned"),
    )
    needs_context = [r["id"] for r in rules if r.get("context")]
    fits = F.col("beside") | ~F.col("technique_id").isin(needs_context)
    told, typed = ~F.col("typed"), F.col("typed")
    taken = lambda where: F.flatten(F.collect_list(F.when(where & ~F.col("denied") & fits, F.col("named"))))
    rejects = told & F.col("mentioned") & (F.col("denied") | F.col("helped"))
    out = by_clause.groupBy(*key, "technique_id").agg(taken(told).alias("told"), taken(typed).alias("typed"), F.max(rejects).alias("rejected"), F.max(told & F.col("denied") & F.col("subject")).alias("gone"))
    words = F.array_sort(F.array_distinct(F.concat("told", F.when(F.col("rejected"), F.array().cast("array<string>")).otherwise(F.col("typed")))))
    return out.where("not gone").select(*key, "technique_id", words.alias("keywords")).where("size(keywords) > 0")


def verdict_hits(cases: DataFrame, rules: list[dict]) -> DataFrame:
    """(incident_id, technique_id, keywords) that the attack type of a case names in clauses that deny nothing."""
    said = cases.select("incident_id", F.explode(clauses(F.col("attack_type"))).alias("clause"))
    said = said.where(~denied(F.col("clause"))).select("incident_id", F.lower("clause").alias("low"))
    found = said.select("incident_id", F.inline(_findings([{"id": r["id"], "words": r.get("attack")} for r in rules], F.col("low"), F.lit(" "))))
    return found.groupBy("incident_id", "technique_id").agg(F.array_sort(F.collect_set("word")).alias("keywords"))


def mapped(cases: DataFrame, evidence: DataFrame, rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Techniques of each case, and each case's mapping status.

    cases: (incident_id, verdict, provenance, attack_type); evidence: as in evidence_hits, and eligible boolean. Only
    cases that pass the gate are mapped; with an incomplete provenance only eligible evidence counts and the verdict's
    words do not. Returns (incident_id, technique_id, matched_by, keywords, evidence_ids) and (incident_id, mapping_status).
    """
    gated = cases.withColumn("_gate", case_gate(F.col("verdict"), F.col("provenance")))
    open_cases = gated.where("_gate = 'proceed'")
    usable = evidence.join(open_cases.select("incident_id", "provenance"), "incident_id").where("provenance = 'passed' or eligible")
    hits = evidence_hits(usable, rules).select("*", F.lit("evidence").alias("by"))
    said = verdict_hits(open_cases.where("provenance = 'passed'"), rules).select("incident_id", F.lit(None).cast(evidence.schema["evidence_id"].dataType).alias("evidence_id"), "technique_id", "keywords", F.lit("verdict").alias("by"))
    sets = lambda c: F.array_sort(F.collect_set(c))
    techniques = hits.unionByName(said).groupBy("incident_id", "technique_id").agg(
        F.reverse(sets("by")).alias("matched_by"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"), sets("evidence_id").alias("evidence_ids")
    )
    some = techniques.select("incident_id").distinct().withColumn("_some", F.lit(True))
    reached = F.when(F.col("_some").isNull(), "no_techniques_matched").when(F.col("provenance") == "incomplete", "partial").otherwise("mapped")
    return techniques, gated.join(some, "incident_id", "left").select("incident_id", F.when(F.col("_gate") == "proceed", reached).otherwise(F.col("_gate")).alias("mapping_status"))


def case_gate(verdict: Column, provenance: Column) -> Column:
    """proceed, not_applicable, deferred or error (R12); a missing provenance counts as unavailable."""
    traced = F.coalesce(provenance, F.lit("unavailable"))
    known = F.coalesce(verdict.isin("THREAT_CONFIRMED", "FALSE_POSITIVE", "INCONCLUSIVE"), F.lit(False)) & traced.isin("passed", "incomplete", "unavailable")
    return F.when(~known, "error").when(verdict == "FALSE_POSITIVE", "not_applicable").when((verdict == "INCONCLUSIVE") | (traced == "unavailable"), "deferred").otherwise("proceed")
