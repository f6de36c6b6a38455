"""The whole way from events to incidents: rules and sensor to seeds, seeds and links to incidents, merged, scored and named."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.ids import ids_seeds
from emberlog.operators.incidents import build_all, incident_key, merged, triaged
from emberlog.operators.links import all_edges
from emberlog.operators.seeds import all_seeds, rule_seeds
from emberlog.plans.rules import load_rules
from emberlog.session import cut, measured

#: Seeds of a low or medium level need so many hits (fixed value).
LEAST = 5
WINDOW_SECONDS = 60


def shipped_rules() -> list[dict]:
    return load_rules(str(Path(__file__).parent / "rules"))


def aggregated(seeds: DataFrame, least: int = LEAST) -> DataFrame:
    """Seeds of one rule (without one, one reason) and entity as one: the widest window, all refs, the hits' number; low
    and medium ones need `least` hits, others always stay (A1 to A3). Sensor groups count once each."""
    group = [F.coalesce("rule_id", "reason").alias("rule"), "entity_type", "entity", "severity"]
    first = F.min(F.struct("window_start", "seed_id", "reason", "rule_id", "source", "layer")).alias("f")
    hits = F.sum(F.when(F.col("source")[0] == "ids", 1).otherwise(F.size("refs"))).alias("n_hits")
    a = seeds.groupBy(*group).agg(first, F.max("window_end").alias("window_end"), hits)
    refs = seeds.select(*group, F.explode("refs").alias("ref")).groupBy("rule", "entity_type", "entity", "severity").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    same = F.lit(True)
    for c in ("rule", "entity_type", "entity", "severity"):
        same = same & a[c].eqNullSafe(refs[c])
    out = a.join(refs, same).select("f.seed_id", a["entity_type"], a["entity"], "f.reason", a["severity"], "f.rule_id", "f.source", "f.layer", "f.window_start", "window_end", "refs", "n_hits")
    return out.where(~F.coalesce(F.col("severity").isin("low", "medium"), F.lit(False)) | (F.col("n_hits") >= least))


def detect_incidents(events: DataFrame, rules: list[dict] | None = None, least: int = LEAST, min_priority: str | None = None) -> DataFrame:
    """Scored incidents of a table of events: those of merged(), with incident_key, triage_score, priority and route.

    The key stays the same from run to run while entity and reasons do. With min_priority, less urgent ones are left out.
    """
    with measured(events.sparkSession):
        events = cut(events, "events")  # rules, sensor and linkers all read it
        seeds, _ = all_seeds(rule_seeds(events, rules if rules is not None else shipped_rules(), WINDOW_SECONDS), ids_seeds(events, WINDOW_SECONDS)[0])
        seeds = cut(aggregated(cut(seeds, "seeds"), least), "seeds")
        found = cut(triaged(merged(*build_all(cut(all_edges(events, spanning=True), "edges"), events, seeds))), "found")
    found = found.withColumn("incident_key", incident_key(F.col("entity"), F.col("reasons"), F.col("incident_id")))
    return found.where(F.col("priority") <= min_priority) if min_priority else found

