"""Links between events of different layers, and the guards on them (J1 to J7, J9 to J12, U3, U4). Edges are (a, b, kind)."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.lineage import lineage_edges
from emberlog.operators.range_join import micros, range_join, unique_only

log = logging.getLogger(__name__)
SECOND = 1_000_000
WEB_UID = 33
#: Registered linkers: name -> function of the events table.
LINKERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def linker(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    LINKERS[f.__name__] = f
    return f


def _machine(events: DataFrame) -> Column:
    """The machine that logged an event; null where the events don't tell."""
    return F.col("machine") if "machine" in events.columns else F.lit(None).cast("string")


def _side(events: DataFrame, layer: str, suffix: str, *cols: str) -> DataFrame:
    named = (F.col(c).alias(f"{c.split('.')[-1]}_{suffix}") for c in ("raw_ref", *cols))
    return events.where(F.col("layer") == layer).select(*named, micros("ts").alias(f"at_{suffix}"), _machine(events).alias(f"machine_{suffix}"))


def _one_machine(pairs: DataFrame) -> DataFrame:
    """Pairs that no two known, different machines logged."""
    return pairs.where(F.coalesce(F.col("machine_a") == F.col("machine_b"), F.lit(True)))


def _edge(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select(F.col("raw_ref_a").alias("a"), F.col("raw_ref_b").alias("b"), F.lit(kind).alias("kind")).distinct()


@linker
def web_network(events: DataFrame) -> DataFrame:
    """Sensor requests with a valid forwarded client and exactly one web request of the same client, method, path and status within a second."""
    cols = ("src_ip", "ld.method", "ld.path", "ld.status")
    net = _side(events.where("ld.xff_status = 'valid'"), "network", "b", *cols)
    keys = tuple((f"{c}_b", f"{c}_a") for c in ("src_ip", "method", "path", "status"))
    return _edge(unique_only(range_join(net, _side(events, "web", "a", *cols), "at_b", "at_a", SECOND, keys), "raw_ref_b"), "web_network")


@linker
def web_system(events: DataFrame) -> DataFrame:
    """Audit events of the web server's user within five seconds of a request of the same machine."""
    system = _side(events.where(F.col("ld.uid") == WEB_UID), "system", "b")
    return _edge(_one_machine(range_join(_side(events, "web", "a"), system, "at_a", "at_b", 5 * SECOND)), "web_system")


@linker
def system_auth(events: DataFrame) -> DataFrame:
    """The same process id in audit and auth events of a machine, at most an hour apart (the guard of this kind)."""
    pairs = range_join(_side(events, "system", "a", "pid"), _side(events, "auth", "b", "pid"), "at_a", "at_b", 3600 * SECOND, (("pid_a", "pid_b"),))
    return _edge(_one_machine(pairs), "system_auth")


@linker
def web_session(events: DataFrame) -> DataFrame:
    """Each request and the one before it of the same client and path (without query), at most two minutes apart."""
    web = events.where("layer = 'web' and src_ip is not null").select("raw_ref", "src_ip", F.substring_index("ld.path", "?", 1).alias("path"), micros("ts").alias("at"))
    return session_chain(web.where("path is not null"), ("src_ip", "path"), "at", "raw_ref", 120 * SECOND).withColumn("kind", F.lit("web_session"))


def session_chain(rows: DataFrame, keys: tuple[str, ...], at: str, ref: str, gap: int) -> DataFrame:
    line = Window.partitionBy(*keys).orderBy(at, ref)
    pairs = rows.withColumns({"_a": F.lag(ref).over(line), "_gap": F.col(at) - F.lag(at).over(line)})
    return pairs.where(F.col("_gap") <= gap).select(F.col("_a").alias("a"), F.col(ref).alias("b"))


def _flow_sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts (a) and http records (b) of the sensor, with the flow, the transaction and both ends."""
    net = events.where("layer = 'network'").select("raw_ref", micros("ts").alias("at"), "ld.*")
    sensor = F.coalesce("sensor_id", F.lit(""))
    ends = F.array_join(F.array_sort(F.array(F.concat_ws("|", "transport_src_ip", "src_port"), F.concat_ws("|", "dest_ip", "dest_port"))), ";")
    keyed = net.select("raw_ref", "at", "event_type", sensor.alias("sensor"), F.col("flow_id").cast("string").alias("flow"), F.col("tx_id").cast("string").alias("tx"), F.concat_ws("!", ends, F.lower("proto")).alias("ends"))
    side = lambda kind, x: keyed.where(F.col("event_type") == kind).select(*(F.col(c).alias(f"{c}_{x}") for c in ("raw_ref", "at", "sensor", "flow", "tx", "ends")))
    return side("alert", "a"), side("http", "b")


def _loose_flow(alert: DataFrame, http: DataFrame) -> DataFrame:
    """Distinct (a, b) of alerts without a transaction and the only record near them; one row for each alert at most."""
    loose = range_join(alert.where("tx_a is null"), http, "at_a", "at_b", 5 * SECOND, (("sensor_a", "sensor_b"), ("flow_a", "flow_b"), ("ends_a", "ends_b")))
    return _edge(unique_only(loose, "raw_ref_a"), "sensor_flow")


def _transactions(rows: DataFrame, x: str) -> DataFrame:
    """Each reference of a side with the set of (sensor, flow, transaction) that its rows tell."""
    known = rows.where(f"flow_{x} is not null and tx_{x} is not null")
    return known.groupBy(f"raw_ref_{x}").agg(F.collect_set(F.struct(*(F.col(f"{c}_{x}").alias(c) for c in ("sensor", "flow", "tx")))).alias(f"all_{x}"))


@linker
def sensor_flow(events: DataFrame) -> DataFrame:
    """Alerts and http records of one sensor flow: by transaction, or, for alerts without one, the only record of the same or reversed ends within five seconds.

    All pairs of a transaction are links, so their number grows with the square of a flow's records. Pairs are made once
    and never shuffled: a reference with several transactions meets another one only in the smallest that both have.
    """
    alert, http = _flow_sides(events)
    told = {x: _transactions(rows, x) for x, rows in (("a", alert), ("b", http))}
    more = lambda x: F.when(F.size(f"all_{x}") > 1, F.col(f"all_{x}")).alias(f"more_{x}")
    one, two = (told[x].select(f"raw_ref_{x}", more(x), F.inline(f"all_{x}")) for x in "ab")
    first = F.array_min(F.array_intersect("more_a", "more_b")) == F.struct("sensor", "flow", "tx")
    exact = one.join(two, ["sensor", "flow", "tx"]).where(F.col("more_a").isNull() | F.col("more_b").isNull() | first)
    exact = exact.select(F.col("raw_ref_a").alias("a"), F.col("raw_ref_b").alias("b"), F.lit("sensor_flow").alias("kind"))
    # a reference with rows of both sorts may find a record either way
    loose = _loose_flow(alert, http)
    odd = alert.where("tx_a is null").select(F.col("raw_ref_a").alias("x")).distinct().join(told["a"], F.col("x").eqNullSafe(F.col("raw_ref_a"))).select("x", "all_a")
    twice = loose.join(odd, F.col("a").eqNullSafe(F.col("x"))).join(told["b"], F.col("b").eqNullSafe(F.col("raw_ref_b"))).where(F.arrays_overlap("all_a", "all_b")).select(F.col("a").alias("a2"), F.col("b").alias("b2"))
    return exact.unionByName(loose.join(twice, F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2")), "left_anti"))


def spanning_flow(events: DataFrame) -> DataFrame:
    """Some of sensor_flow()'s links, at most one for each record and transaction, that connect the same references: each
    alert and the transaction's first http record, each http record and its first alert."""
    alert, http = _flow_sides(events)
    key = lambda rows, x: rows.select("sensor_" + x, "flow_" + x, "tx_" + x, F.col(f"raw_ref_{x}").alias("ref")).toDF("sensor", "flow", "tx", "ref").where("flow is not null and tx is not null")
    both = {x: key(rows, x) for x, rows in (("a", alert), ("b", http))}
    tops = both["a"].select("*", F.lit(True).alias("alert")).unionByName(both["b"].select("*", F.lit(False).alias("alert"))).groupBy("sensor", "flow", "tx").agg(F.min(F.when(F.col("alert"), F.col("ref"))).alias("top_a"), F.min(F.when(~F.col("alert"), F.col("ref"))).alias("top_b"))
    tops = tops.where("top_a is not null and top_b is not null")
    by = ["sensor", "flow", "tx"]
    from_alerts = both["a"].join(tops, by).select(F.col("ref").alias("a"), F.col("top_b").alias("b"))
    from_http = both["b"].join(tops, by).select(F.col("top_a").alias("a"), F.col("ref").alias("b"))
    return from_alerts.unionByName(from_http).withColumn("kind", F.lit("sensor_flow")).unionByName(_loose_flow(alert, http)).distinct()


def flow_groups(events: DataFrame, groups: DataFrame) -> DataFrame:
    """(raw_ref, groups): the http records that sensor_flow() links to a group's alerts, and the distinct groups.

    groups: (raw_ref, group_key) of alerts. A transaction's groups are found first and then met by its http records, so
    the alerts' number does not multiply that of the records.
    """
    alert, http = _flow_sides(events)
    own = alert.join(groups.withColumnRenamed("raw_ref", "raw_ref_a"), "raw_ref_a")
    of = own.where("flow_a is not null and tx_a is not null").groupBy("sensor_a", "flow_a", "tx_a").agg(F.collect_set("group_key").alias("groups"))
    exact = http.join(of, (F.col("sensor_a") == F.col("sensor_b")) & (F.col("flow_a") == F.col("flow_b")) & (F.col("tx_a") == F.col("tx_b"))).select(F.col("raw_ref_b").alias("raw_ref"), "groups")
    loose = _loose_flow(alert, http).join(groups, F.col("a") == F.col("raw_ref")).select(F.col("b").alias("raw_ref"), F.array("group_key").alias("groups"))
    return exact.unionByName(loose).where("raw_ref is not null").groupBy("raw_ref").agg(F.array_distinct(F.flatten(F.collect_set("groups"))).alias("groups"))


@linker
def audit_lineage(events: DataFrame) -> DataFrame:
    """Each process instance's first event and the last one of its parent's instance before it, on one machine and in one boot
    epoch (see operators.lineage)."""
    audit = events.where("layer = 'system' and pid is not null").select(
        F.coalesce(_machine(events), F.lit("")).alias("host"), micros("ts").alias("at"), F.col("ld.serial").cast("long").alias("serial"), "raw_ref", F.col("pid").cast("long").alias("pid"), F.col("ppid").cast("long").alias("ppid"))
    return lineage_edges(audit).select("a", "b", F.lit("audit_lineage").alias("kind"))


def _spanning(events: DataFrame, left: DataFrame, right: DataFrame, width: int, kind: str, *keys: str) -> DataFrame:
    """Some of the pairs (a of left, b of right) with equal keys, of no two known, different machines, at most `width` apart, that
    connect the same references: about one for each row, where all pairs grow with the rows of a window.

    In a stretch of `width` all rows of both sides are linked, so each meets the other side's first one there. Links into the next
    stretch start at a side's last row and end at the other's first, as these are nearest; a row whose own stretch has no other side meets
    the nearest one of the next and of the one before, too.
    """
    alone = lambda x: F.struct(F.lit(x).alias("sort"), F.lit("").alias("host"))

    def side(rows: DataFrame, x: str, one: int, every: int) -> DataFrame:
        # machines that are known meet their own, rows without one meet all
        machine = F.col(f"machine_{x}")
        hosts = F.array_compact(F.array(F.when(machine.isNotNull(), F.struct(F.lit(0).alias("sort"), machine.alias("host"))), F.when(machine.isNull(), alone(one)), alone(every))) if "machine" in events.columns else F.array(alone(0))
        rows = rows.where(F.col(f"at_{x}").isNotNull() & F.col(f"raw_ref_{x}").isNotNull()).select(*(F.col(f"{k}_{x}").alias(k) for k in keys), F.col(f"at_{x}").alias("at"), F.col(f"raw_ref_{x}").alias("ref"), F.lit(x).alias("side"), F.inline(hosts))
        return rows.dropna(subset=list(keys)) if keys else rows

    rows = side(left, "a", 1, 2).unionByName(side(right, "b", 2, 1)).withColumns({"stretch": F.floor(F.col("at") / width), "own": F.struct("at", "ref")})
    by = [*keys, "sort", "host", "stretch"]
    of = lambda f, x: f(F.when(F.col("side") == x, F.col("own")))
    tops = rows.groupBy(*by).agg(*(of(f, x).alias(f"{n}_{x}") for x in "ab" for n, f in (("first", F.min), ("last", F.max))))
    beside = lambda step, n, name: tops.select(*by[:-1], (F.col("stretch") - step).alias("stretch"), *(F.col(f"{n}_{x}").alias(f"{name}_{x}") for x in "ab"))
    tops = tops.join(beside(1, "first", "next"), by, "left").join(beside(-1, "last", "before"), by, "left")
    other = lambda n: F.when(F.col("side") == "a", F.col(f"{n}_b")).otherwise(F.col(f"{n}_a"))
    mine = lambda n: F.when(F.col("side") == "a", F.col(f"{n}_a")).otherwise(F.col(f"{n}_b"))
    met = rows.join(tops, by).select("at", "ref", "side", "own", *(other(n).alias(n) for n in ("first", "next", "before")), mine("first").alias("own_first"), mine("last").alias("own_last"))
    no_other = F.col("first").isNull()
    after = F.when((no_other | (F.col("own") == F.col("own_last"))) & (F.col("next.at") - F.col("at") <= width), F.col("next"))
    ahead = F.when((no_other | (F.col("own") == F.col("own_first"))) & (F.col("at") - F.col("before.at") <= width), F.col("before"))
    found = met.select("ref", "side", F.explode_outer(F.array_compact(F.array(F.col("first"), after, ahead))).alias("x")).where("x is not null")
    a = F.col("side") == "a"
    return found.select(F.when(a, F.col("ref")).otherwise(F.col("x.ref")).alias("a"), F.when(a, F.col("x.ref")).otherwise(F.col("ref")).alias("b"), F.lit(kind).alias("kind"))


def spanning_web_system(events: DataFrame) -> DataFrame:
    """Some of web_system()'s links that connect the same references."""
    return _spanning(events, _side(events, "web", "a"), _side(events.where(F.col("ld.uid") == WEB_UID), "system", "b"), 5 * SECOND, "web_system")


def spanning_system_auth(events: DataFrame) -> DataFrame:
    """Some of system_auth()'s links, of which there are all pairs of an hour, that connect the same references."""
    return _spanning(events, _side(events, "system", "a", "pid"), _side(events, "auth", "b", "pid"), 3600 * SECOND, "system_auth", "pid")


#: Linkers that may be replaced where only what hangs together and the kinds of a component count.
SPANNING: dict[str, Callable[[DataFrame], DataFrame]] = {"sensor_flow": spanning_flow, "web_system": spanning_web_system, "system_auth": spanning_system_auth}


def all_edges(events: DataFrame, names: tuple[str, ...] | None = None, spanning: bool = False) -> DataFrame:
    """Guarded edges of all linkers; with `spanning`, fewer that make the same components with the same kinds. One that can't be planned on these events (a column that they lack) is logged and left out."""
    found = []
    for n in names or tuple(LINKERS):
        try:
            found.append(((spanning and SPANNING.get(n)) or LINKERS[n])(events).select("a", "b", "kind"))
        except AnalysisException:
            log.warning("linker %s was left out", n, exc_info=True)
    if not found:
        return events.sparkSession.createDataFrame([], "a string, b string, kind string")
    return guarded(reduce(DataFrame.unionByName, found))


def guarded(edges: DataFrame, weak: tuple[str, ...] = ()) -> DataFrame:
    """Undirected distinct edges without self loops and weak kinds; the smaller end comes first."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind")
    return (e.where(~F.col("kind").isin(*weak)) if weak else e).distinct()


def graded(pairs: DataFrame, by: str, gap: Column) -> DataFrame:
    """(by, grade, n_1s, n_2s, n_900s): strong with one candidate within a second, ambiguous with more, context beyond, per left id."""
    n = {k: F.count_if(F.abs(gap) <= k * SECOND) for k in (1, 2, 900)}
    g = pairs.groupBy(by).agg(n[1].alias("n_1s"), n[2].alias("n_2s"), n[900].alias("n_900s"))
    grade = F.when(F.col("n_1s") == 1, "strong").when(F.col("n_1s") > 1, "ambiguous").when(F.col("n_2s") > 0, "fallback").when(F.col("n_900s") > 0, "context").otherwise("unmatched")
    return g.withColumn("grade", grade)


def missing_client_context(events: DataFrame) -> DataFrame:
    """(raw_ref, grade, reason, candidates) for each http record without a forwarded client.

    Web requests of the same method, path and status, whatever their address, in the narrowest of 1, 2 and 900 seconds
    that has any: context_only, never more. Without one, unmatched.
    """
    cols = ("ld.method", "ld.path", "ld.status")
    net = _side(events.where("ld.xff_status = 'missing' and ld.event_type = 'http'"), "network", "b", *cols)
    pairs = range_join(net, _side(events, "web", "a", *cols), "at_b", "at_a", 900 * SECOND, tuple((f"{c}_b", f"{c}_a") for c in ("method", "path", "status")))
    gap = F.abs(F.col("at_a") - F.col("at_b"))
    step = F.when(gap <= SECOND, 1).when(gap <= 2 * SECOND, 2).otherwise(900)
    near = pairs.groupBy(F.col("raw_ref_b").alias("raw_ref")).agg(F.min(step).alias("step"), F.collect_list(F.struct(step.alias("step"), F.col("raw_ref_a").alias("ref"))).alias("found"))
    near = near.select("raw_ref", "step", F.array_sort(F.transform(F.filter("found", lambda x: x["step"] <= F.col("step")), lambda x: x["ref"])).alias("candidates"))
    j = net.select(F.col("raw_ref_b").alias("raw_ref")).join(near, "raw_ref", "left")
    label = F.when(F.col("step") == 1, "strong").when(F.col("step") == 2, "fallback").otherwise("long_delay")
    many = F.when(F.size("candidates") == 1, "unique").otherwise("multiple")
    reason = F.when(F.col("step").isNull(), "xff_missing_no_candidate").otherwise(F.concat(F.lit("xff_missing_exact_"), many, F.lit("_within_"), label, F.lit("_window")))
    grade = F.when(F.col("step").isNull(), "unmatched").otherwise("context_only")
    return j.select("raw_ref", grade.alias("grade"), reason.alias("reason"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def link_id(refs: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(refs)), "\0"), 256)
