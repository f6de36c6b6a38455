"""From edges and seeds to scored incidents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.components import connected_components
from emberlog.session import cut

SHOWN = 500
#: Points by severity, then bands of the total (fixed values).
POINTS = {"critical": 50, "high": 30, "medium": 12, "low": 4}
BANDS = ((50, "P1", "investigate"), (30, "P2", "investigate"), (12, "P3", "dashboard"), (0, "P4", "hold"))


def incident_id(members: Column) -> Column:
    return F.substring(F.sha1(F.array_join(F.array_sort(members), "|")), 1, 8)


def members_of(edges: DataFrame) -> DataFrame:
    """(component, ref) of all linked refs."""
    return connected_components(edges).select("component", F.col("vertex").alias("ref"))


def attach_seeds(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """(seed_id, component): a seed belongs to each component that holds one of its refs; a seed without one makes its own."""
    refs = seeds.select("seed_id", F.explode("refs").alias("ref"))
    hit = refs.join(members, "ref").select("seed_id", "component").distinct()
    alone = seeds.join(hit, "seed_id", "left_anti").select("seed_id", F.concat(F.lit("seed:"), F.col("seed_id").cast("string")).alias("component"))
    return hit.select("seed_id", F.col("component").cast("string").alias("component")).unionByName(alone)


def mode_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value, of equals the smallest."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias(value)))[value].alias(value))


#: Members that one row may hold, and characters of a string on its way to a digest.
CHUNK, PIECE = 1000, 1 << 20


def _streamed(members: DataFrame, key: str, ref: str) -> DataFrame:
    """(key, incident_id) of keys with any number of members: sorted over all tasks and joined to strings there, which then
    pass through one hash in their order, a batch at a time, as SHA-1 can't be split."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k, r in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not rows or rows[-1][0] != k or size > PIECE:
                    rows.append((k, []))
                    size = 0
                rows[-1][1].append(r)
                size += len(r) + 1
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_pydict({key: pa.array([k for k, _ in rows], kind), "first": pa.array([r[0] for _, r in rows], pa.string()), "refs": pa.array(["|".join(r) for _, r in rows], pa.string())})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, kind = None, None, None
        for batch in batches:
            out, kind = [], batch.schema.field(0).type
            for k, _, refs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state and k == last:
                    state.update(b"|" + refs.encode())
                    continue
                if state:
                    out.append((last, state.hexdigest()[:8]))
                last, state = k, hashlib.sha1(refs.encode())
            yield _named(out, key, kind)
        if state:
            yield _named([(last, state.hexdigest()[:8])], key, kind)

    kind = members.schema[key].dataType.simpleString()
    own = members.select(key, F.col(ref).alias("first")).where("first is not null")
    parts = own.repartitionByRange(key, "first").sortWithinPartitions(key, "first").mapInArrow(strings, f"{key} {kind}, first string, refs string")
    return parts.repartition(key).sortWithinPartitions(key, "first").mapInArrow(hashed, f"{key} {kind}, incident_id string")


def _named(rows: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({key: pa.array([k for k, _ in rows], kind), "incident_id": pa.array([x for _, x in rows], pa.string())})


def digests(members: DataFrame, key: str, ref: str = "ref", shown: int = SHOWN) -> DataFrame:
    """(key, incident_id, member_count, members, oversized) of distinct (key, ref) rows.

    The id is that of incident_id() over all members, however many; the list shows the first `shown`. The members of a
    key with more than CHUNK are streamed through the hash, so no row holds them all.
    """
    m = members.join(members.groupBy(key).agg(F.count("*").alias("member_count")), key)
    few = m.where(F.col("member_count") <= CHUNK).groupBy(key, "member_count").agg(incident_id(F.collect_list(ref)).alias("incident_id"))
    many = m.where(F.col("member_count") > CHUNK)
    many = many.select(key, "member_count").distinct().join(_streamed(many, key, ref), key)
    ids = few.unionByName(many)
    first = top_per(members, (key,), F.col(ref), k=shown).groupBy(key).agg(F.array_sort(F.collect_list(ref)).alias("members"))
    return ids.join(first, key).withColumn("oversized", F.col("member_count") > shown)


def points(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in POINTS.items() for x in kv)), severity), F.lit(0))


def build_all(edges: DataFrame, events: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incidents from edges (a, b, kind), events (raw_ref, ts, layer, src_ip) and seeds (seed_id, entity, reason, severity,
    refs); their members (incident_id, ref), and their seeds (incident_id, seed_id).

    Incidents: incident_id, entity, first_ts, last_ts, layers, member_count, members (the first 500), oversized, kinds,
    reasons, severity, n_seeds. The entity is the first seed's, else the members' most frequent address, else process id. Components without seeds are dropped; seeds without component are incidents alone.
    """
    members = members_of(edges).withColumn("component", F.col("component").cast("string"))
    links = attach_seeds(seeds, members)
    own = links.where(F.startswith("component", F.lit("seed:"))).join(seeds.select("seed_id", F.explode("refs").alias("ref")), "seed_id").select("component", "ref")
    every = cut(members.join(links.select("component").distinct(), "component", "left_semi").unionByName(own).distinct(), "members")
    links = cut(links, "seeds")
    own = [c for c in ("src_ip", "pid") if c in events.columns]
    shown = cut(every.join(events.select(F.col("raw_ref").alias("ref"), "ts", "layer", *own), "ref", "left"), "facts")
    facts = shown.groupBy("component").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_set("layer")).alias("layers"))
    for c in own:
        facts = facts.join(mode_of(shown, "component", c).withColumnRenamed(c, f"_{c}"), "component", "left")
    common = F.coalesce(*(F.col(f"_{c}").cast("string") for c in own), F.lit(None).cast("string"))
    kinds = edges.join(members, edges.a == members.ref).groupBy("component").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    told = links.join(seeds, "seed_id").groupBy("component").agg(
        F.min(F.struct("seed_id", "entity"))["entity"].alias("entity"), F.array_sort(F.collect_set("reason")).alias("reasons"),
        F.max(F.struct(points(F.col("severity")).alias("points"), "severity"))["severity"].alias("severity"), F.count_distinct("seed_id").alias("n_seeds"),
    )
    ids = cut(digests(every, "component"), "incidents")
    found = ids.join(facts, "component").join(told, "component").join(kinds, "component", "left").select(
        "incident_id", F.coalesce("entity", common).alias("entity"), "first_ts", "last_ts", "layers", "member_count", "members", "oversized", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), "reasons", "severity", "n_seeds",
    )
    name = ids.select("component", "incident_id")
    return found, every.join(name, "component").select("incident_id", "ref"), links.join(name, "component").select("incident_id", "seed_id")


def build(edges: DataFrame, events: DataFrame, seeds: DataFrame) -> DataFrame:
    """The incidents of build_all()."""
    return build_all(edges, events, seeds)[0]


def incident_key(entity: Column, reasons: Column, own_id: Column) -> Column:
    """A key that stays the same from run to run; incidents without entity use their id."""
    return F.coalesce(F.substring(F.sha1(F.concat(entity, F.lit("|"), F.array_join(F.array_sort(reasons), "\x1f"))), 1, 16), F.concat(F.lit("id:"), own_id))


def merged(incidents: DataFrame, members: DataFrame, seeds: DataFrame) -> DataFrame:
    """Incidents of the same entity and set of reasons become one; a null entity never merges.

    members: (incident_id, ref) and seeds: (incident_id, seed_id), all of them, not the first 500: the id and the
    list are made of the union of all members, a seed of two incidents counts once, and the gravest severity stays.
    member_count adds up, as overlapping members count for each incident. merged_from is the number of incidents.
    """
    reasons = F.array_join(F.array_sort(F.array_distinct("reasons")), "\x1e")
    key = F.when(F.col("entity").isNull(), F.concat(F.lit("id:"), "incident_id")).otherwise(F.concat_ws("\x1f", F.lit("of:"), "entity", reasons))
    i = incidents.withColumn("_key", key)
    name = i.select("_key", "incident_id").distinct()
    set_of = lambda c: i.select("_key", F.explode(c).alias("_x")).groupBy("_key").agg(F.array_sort(F.collect_set("_x")).alias(c))
    facts = i.groupBy("_key").agg(
        F.min("entity").alias("entity"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("member_count").alias("_sum"),
        F.max(F.struct(points(F.col("severity")).alias("points"), "severity"))["severity"].alias("severity"), F.count("*").alias("merged_from"),
    )
    ids = digests(members.join(name, "incident_id").select("_key", "ref").distinct(), "_key").drop("member_count")
    n = seeds.join(name, "incident_id").groupBy("_key").agg(F.count_distinct("seed_id").alias("n_seeds"))
    out = facts.join(ids, "_key").join(n, "_key", "left")
    for c in ("layers", "kinds", "reasons"):
        out = out.join(set_of(c), "_key", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.select("incident_id", "entity", "first_ts", "last_ts", "layers", F.col("_sum").alias("member_count"), "members", "oversized", "kinds", "reasons", "severity", F.coalesce("n_seeds", F.lit(0).cast("long")).alias("n_seeds"), "merged_from")


def triage_score(severity: Column, n_layers: Column, n_kinds: Column, n_seeds: Column) -> Column:
    points = F.lit(0)
    for name, p in POINTS.items():
        points = F.when(severity == name, p).otherwise(points)
    return points + 6 * F.greatest(n_layers - 1, F.lit(0)) + 3 * n_kinds + F.least(2 * F.greatest(n_seeds - 1, F.lit(0)), F.lit(8))


def priority(score: Column) -> Column:
    p = F.lit("P4")
    for least, name, _ in reversed(BANDS):
        p = F.when(score >= least, name).otherwise(p)
    return p


def route(score: Column) -> Column:
    r = F.lit("hold")
    for least, _, where in reversed(BANDS):
        r = F.when(score >= least, where).otherwise(r)
    return r


def at_least(level: Column, least: str) -> Column:
    """Whether a priority is `least` or a more urgent one."""
    return level <= least


def triaged(incidents: DataFrame) -> DataFrame:
    score = triage_score(F.col("severity"), F.size("layers"), F.size("kinds"), F.col("n_seeds"))
    return incidents.withColumn("triage_score", score).withColumn("priority", priority(F.col("triage_score"))).withColumn("route", route(F.col("triage_score")))


def top_per(rows: DataFrame, keys: tuple[str, ...], *order: Column, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)
