"""From rule hits to seeds, and the contract that all seeds keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.burst import bursts
from emberlog.operators.range_join import micros
from emberlog.plans.rules import detect

#: Fixed values of the seed contract.
ENTITY_TYPES, LAYERS, SOURCES = ("src_ip", "pid", "ppid"), ("web", "network", "system", "auth"), ("sigma", "anomaly", "ids")
#: Rules of a layer that are asked in one scan; the time that more of them take grows faster than their number.
ASKED = 3
SCHEMA = "seed_id string, entity_type string, entity string, reason string, severity string, rule_id string, source array<string>, layer string, window_start timestamp, window_end timestamp, refs array<string>"


def entity_of(layer: Column, wanted: Column) -> Column:
    """Struct (type, value): the first key of the rule's, then of the layer's default order, that the event has."""
    value = F.create_map(*(x for k in ENTITY_TYPES for x in (F.lit(k), F.col(k).cast("string"))))
    default = F.when(layer == "system", F.array(*map(F.lit, ("pid", "src_ip", "ppid")))).otherwise(F.array(*map(F.lit, ENTITY_TYPES)))
    order = F.concat(F.filter(F.coalesce(wanted, F.array().cast("array<string>")), lambda k: k.isin(*ENTITY_TYPES)), default)
    best = F.coalesce(F.get(F.filter(order, lambda k: value[k].isNotNull()), F.lit(0)), F.get(default, F.lit(0)))
    return F.struct(best.alias("type"), value[best].alias("value"))


def rule_seeds(events: DataFrame, rules: list[dict], window_seconds: int = 60) -> DataFrame:
    """Seeds of all rules' hits: one for each hit, and one for each burst of a rule with an aggregation.

    A hit's window is window_seconds around it, a burst's from its first to its last hit, as much wider. The id is
    made of the rule, the entity and the first line.
    """
    kinds = {r["id"]: (r.get("title", r["id"]), (r.get("aggregation") or {}).get("seconds"), (r.get("aggregation") or {}).get("min_count", 5)) for r in rules}
    titles = F.create_map(*(F.lit(x) for k, (title, _, _) in kinds.items() for x in (k, title)))
    wanted = F.create_map(*(x for r in rules for x in (F.lit(r["id"]), F.array(*map(F.lit, r.get("entity") or [])).cast("array<string>"))))
    keys = ("rule_id", "level", "layer", "entity_type", "entity")

    def hits(own: list[dict]) -> DataFrame:
        """Hits of some rules: those of a kind are asked together, so that no rule is asked again for another kind's seeds."""
        layers = [[r for r in own if r["layer"] == x] for x in dict.fromkeys(r["layer"] for r in own)]
        found = reduce(DataFrame.unionByName, (detect(events, x[k : k + ASKED]) for x in layers for k in range(0, len(x), ASKED)))
        found = found.withColumn("e", entity_of(F.col("layer"), wanted[F.col("rule_id")]))
        return found.select("rule_id", "level", "layer", F.col("e.type").alias("entity_type"), F.col("e.value").alias("entity"), "raw_ref", micros("ts").alias("at"))

    of = lambda *kind: [r for r in rules if kinds[r["id"]][1:] in kind]
    single = of(*{k[1:] for k in kinds.values() if not k[1]})
    parts = [hits(single).select(*keys, F.col("at").alias("first_at"), F.col("at").alias("last_at"), F.array("raw_ref").alias("refs"))] if single else []
    for seconds, least in sorted({(s, m) for _, s, m in kinds.values() if s}):
        parts.append(bursts(hits(of((seconds, least))), keys, "at", "raw_ref", seconds * 1_000_000, least).select(*keys, "first_at", "last_at", "refs"))
    s = reduce(DataFrame.unionByName, parts)
    width = window_seconds * 1_000_000
    return s.select(
        F.sha1(F.concat_ws("\x1f", "rule_id", "entity_type", F.coalesce("entity", F.lit("")), F.get("refs", F.lit(0)))).alias("seed_id"), "entity_type", "entity", titles[F.col("rule_id")].alias("reason"), F.col("level").alias("severity"),
        "rule_id", F.array(F.lit("sigma")).alias("source"), "layer", F.timestamp_micros(F.col("first_at") - width).alias("window_start"), F.timestamp_micros(F.col("last_at") + width).alias("window_end"), "refs", F.lit(True).alias("evident"),
    )


def reject_reason(evident: Column | None = None) -> Column:
    """Why a seed breaks the contract; null if it keeps it. evident: whether it has evidence, where that is known without its refs."""
    bad = lambda test: ~F.coalesce(test, F.lit(False))
    return (
        F.when(bad(F.col("entity_type").isin(*ENTITY_TYPES)), "invalid_entity").when(bad(F.col("window_start") <= F.col("window_end")), "invalid_window").when(bad(F.col("layer").isin(*LAYERS)), "invalid_layer")
        .when(bad((F.size("source") > 0) & (F.size(F.array_except("source", F.array(*map(F.lit, SOURCES)))) == 0)), "invalid_source").when(bad(F.size("refs") > 0 if evident is None else evident), "missing_evidence")
    )


def all_seeds(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of seeds from rules and sensors, split in those that keep the contract and the others with their reason.

    A part may tell by a column evident that its seeds have refs, as those of rule_seeds() and ids_seeds() always do; these
    are then gathered only where something asks for them.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    checked = (p.withColumn("reject_reason", reject_reason(F.col("evident") if "evident" in p.columns else None)) for p in parts)
    s = reduce(DataFrame.unionByName, (p.select(*names, "reject_reason") for p in checked))
    return s.where("reject_reason is null").drop("reject_reason"), s.where("reject_reason is not null")
