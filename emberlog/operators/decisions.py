"""What follows from an investigation: verdicts by rule, citations, the response gate, entities and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import cut

#: Folders of system programs (no file to isolate), and the limits of freely chosen actions.
SYSTEM_FOLDERS = ("/bin/", "/usr/bin/", "/sbin/", "/usr/sbin/", "/lib/", "/lib64/", "/usr/lib/", "/usr/libexec/")
MOST_HIGH, MOST_IRREVERSIBLE, MOST_ACTIONS = 1, 2, 8


def rule_verdict(checks: DataFrame, windows: DataFrame) -> DataFrame:
    """(incident_id, verdict) where the checks alone decide. checks: (incident_id, rule, brute_force); windows: (incident_id, n_rows).

    No rows in any window: INCONCLUSIVE. A check other than the login one: THREAT_CONFIRMED. Login checks only: by
    whether one of them saw brute force. Incidents without either get no row.
    """
    seen = windows.groupBy("incident_id").agg(F.max(F.coalesce("n_rows", F.lit(0)) > 0).alias("any_rows"))
    found = checks.groupBy("incident_id").agg(F.max(F.coalesce(F.col("rule"), F.lit("")) != "principle_7").alias("other"), F.max(F.coalesce("brute_force", F.lit(False))).alias("hard"))
    verdict = F.when(~F.col("any_rows"), "INCONCLUSIVE").when(F.col("other") | F.col("hard"), "THREAT_CONFIRMED").when(F.col("other").isNotNull(), "FALSE_POSITIVE")
    return seen.join(found, "incident_id", "full").select("incident_id", verdict.alias("verdict")).where("verdict is not null")


def fallback_verdict(confidence: Column, n_for: Column, n_against: Column, threshold: float) -> tuple[Column, Column]:
    """(verdict, severity) by numbers only, for an investigation that gave none."""
    verdict = F.when(confidence >= threshold, "THREAT_CONFIRMED").when((n_against > 0) & (n_for == 0), "FALSE_POSITIVE").otherwise("INCONCLUSIVE")
    return verdict, F.when(confidence >= 0.7, "HIGH").when(confidence >= 0.4, "MEDIUM").otherwise("LOW")


def citations(evidence: DataFrame, observed: DataFrame) -> DataFrame:
    """(incident_id, evidence_id, n_known, n_unknown, n_ambiguous, contribution) of evidence (incident_id, evidence_id, refs, contribution).

    observed: (incident_id, ref, location). A ref that no tool returned, or one with several locations, takes the
    contribution; evidence without refs keeps it. Repeated refs count once.
    """
    places = observed.groupBy("incident_id", "ref").agg(F.count_distinct("location").alias("_places"))
    cited = evidence.select("incident_id", "evidence_id", "contribution", F.explode_outer(F.array_distinct("refs")).alias("ref"))
    met = cited.join(places, ["incident_id", "ref"], "left")
    n = lambda test: F.count_if(F.col("ref").isNotNull() & test)
    out = met.groupBy("incident_id", "evidence_id").agg(
        n(F.col("_places").isNotNull()).alias("n_known"), n(F.col("_places").isNull()).alias("n_unknown"), n(F.col("_places") > 1).alias("n_ambiguous"), F.max("contribution").alias("contribution")
    )
    return out.withColumn("contribution", F.when((F.col("n_unknown") > 0) | (F.col("n_ambiguous") > 0), F.lit(0.0)).otherwise(F.col("contribution")))


def response_gate(status: Column, verdict: Column, provenance: Column, mapping: Column) -> Column:
    """skipped, not_applicable, deferred, recommended, recommended_generic or error."""
    return (
        F.when(status == "INCOMPLETE", "skipped").when(verdict == "FALSE_POSITIVE", "not_applicable").when(verdict == "INCONCLUSIVE", "deferred")
        .when(verdict.isNull() | (verdict != "THREAT_CONFIRMED"), "error").when(provenance == "unavailable", "deferred")
        .when(mapping.isin("mapped", "partial"), "recommended").when(mapping.isin("no_techniques_matched", "deferred", "error"), "recommended_generic").otherwise("error")
    )


def entities(found: DataFrame) -> DataFrame:
    """Each entity (incident_id, kind, value) once, with its best source: of found (incident_id, kind, value, source, nth).

    Order of sources: seed_detail, seed_src_ip, seed_host, tool_input, then nth. Paths of system programs are no files to
    act on. Adds rank, the entity's place among those of its kind; the first one is a template's target.
    """
    system = (F.col("kind") == "file_path") & F.concat(*(F.when(F.startswith("value", F.lit(p)), "x").otherwise("") for p in SYSTEM_FOLDERS)).contains("x")
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("seed_detail", "seed_src_ip", "seed_host", "tool_input"))), F.col("source")), F.lit(0)), F.lit(9))
    best = found.where("value is not null and value <> ''").where(~system).groupBy("incident_id", "kind", "value").agg(F.min(F.struct(order.alias("o"), "nth", "source")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("incident_id", "kind").orderBy("best.o", "best.nth", "value"))
    return best.select("incident_id", "kind", "value", F.col("best.source").alias("source"), rank.cast("long").alias("rank"))


def templates_of(techniques: DataFrame, catalog: DataFrame, found: DataFrame) -> DataFrame:
    """(incident_id, template_id, technique_id, fallback, target) of the techniques of each incident.

    catalog: (technique_id, template_id, kind), with the templates of the technique "*" for those that have none of
    their own; found: of entities(). A template that needs an entity of some kind takes the first one of it, and goes
    where there is none; one without a kind has no target.
    """
    own = techniques.join(catalog, "technique_id").withColumn("fallback", F.lit(False))
    none = techniques.join(catalog.select("technique_id").distinct(), "technique_id", "left_anti")
    general = catalog.where("technique_id = '*'").select(F.col("technique_id").alias("_any"), "template_id", "kind")  # those of one name
    rest = none.withColumn("_any", F.lit("*")).join(F.broadcast(general), "_any").withColumn("fallback", F.lit(True))
    each = own.select("incident_id", "template_id", "technique_id", "fallback", "kind").unionByName(rest.select("incident_id", "template_id", "technique_id", "fallback", "kind"))
    first = found.where("rank = 1").select("incident_id", "kind", F.col("value").alias("target"))
    return each.join(first, ["incident_id", "kind"], "left").where("kind is null or target is not null").select("incident_id", "template_id", "technique_id", "fallback", "target")


def _trim(chosen: DataFrame, group: Column, most: int) -> DataFrame:
    """Of each incident's actions in group, as many free ones go as are over the limit: lowest priority first, then by id."""
    over_by = Window.partitionBy("incident_id")
    free = group & ~F.col("protected")
    nth = F.row_number().over(over_by.orderBy(free.desc(), F.desc("priority"), "template_id"))
    return chosen.withColumns({"_over": F.count_if(group).over(over_by) - most, "_nth": nth}).where(~(free & (F.col("_nth") <= F.col("_over")))).drop("_over", "_nth")


def chosen_actions(candidates: DataFrame, selected: DataFrame, requires: DataFrame) -> DataFrame:
    """The actions of each incident: selected ones, mandatory ones and all that these require, within the limits.

    candidates: (incident_id, template_id, priority, risk, reversible, mandatory), each template once an incident;
    selected: (incident_id, template_id); requires: (template_id, required). Requirements that are no candidates are
    ignored. Mandatory and required actions are protected: they never go, and count towards the limits. Limits, in this
    order: one of HIGH risk, two irreversible ones, eight in all. Adds why: mandatory, required or selected.
    """
    keys = ["incident_id", "template_id"]
    known = cut(candidates, "candidates")
    picked = known.join(selected.select(*keys).distinct(), keys, "left_semi").select(*keys)
    have = picked.union(known.where("mandatory").select(*keys)).distinct()
    have = new = cut(have.withColumn("required", F.lit(False)), "have")
    pool = known.select(*keys)
    while not new.isEmpty():  # as often as the longest chain of requirements
        next_ids = new.select(*keys).join(requires, "template_id").select("incident_id", F.col("required").alias("template_id")).distinct()
        new = cut(next_ids.join(pool, keys, "left_semi").join(have, keys, "left_anti").withColumn("required", F.lit(True)), "new")
        have = have.unionByName(new)
    why = F.when(F.col("mandatory"), "mandatory").when(F.col("required"), "required").otherwise("selected")
    chosen = known.join(have, keys).withColumn("why", why).withColumn("protected", F.col("why") != "selected")
    chosen = _trim(chosen, F.coalesce(F.col("risk") == "HIGH", F.lit(False)), MOST_HIGH)
    chosen = _trim(chosen, ~F.coalesce(F.col("reversible"), F.lit(True)), MOST_IRREVERSIBLE)
    return _trim(chosen, F.lit(True), MOST_ACTIONS).select(*candidates.columns, "why")


def autonomy(level: Column, warned: Column, provenance: Column) -> Column:
    """L2 falls to L1 after a warning about the mapping or with an incomplete provenance."""
    return F.when((level == "L2") & (F.coalesce(warned, F.lit(False)) | F.coalesce(provenance == "incomplete", F.lit(False))), "L1").otherwise(level)
