"""Process lineage: boot epochs, process instances, their parents, and chains of ancestors."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators.range_join import as_of
from emberlog.session import cut, free

#: A serial that falls this far below the largest one so far means a reboot.
RESET = 1000
#: Rows whose effect is summed up at once (a power of two).
CHUNK = 8192
#: A parent may be seen so many microseconds after its child; processes 0 and 1 end a chain; orphans go to 1 (fixed values).
SLACK, ROOTS, ORPHAN = 2_000_000, (0, 1), 1
MAX_NODES = 32
#: What an instance's number counts within, and a known parent other than the one of orphans.
INSTANCE = ("host", "epoch", "pid")
REAL = lambda: F.when(F.col("ppid") != ORPHAN, F.col("ppid"))

#: The effect of a run of serials on (epochs so far, largest serial): pieces (upper end of the largest serial before,
#: epochs added, largest serial after, null where it stays as it was), by upper end.
Pieces = list[tuple[float, int, float | None]]
END = float("inf")
PIECES = "host string, chunk long, upto array<double>, added array<long>, top array<double>"


def after(pieces: Pieces, serial: float) -> Pieces:
    """The effect of a run and one more serial."""
    out: Pieces = []

    def put(upto: float, added: int, top: float | None) -> None:
        if out and top is not None and out[-1][1:] == (added, top):
            out[-1] = (upto, added, top)
        else:
            out.append((upto, added, top))

    low = -END
    for upto, added, top in pieces:
        if top is not None:
            put(upto, *((added + 1, serial) if top - serial > RESET else (added, max(top, serial))))
        else:
            if low < serial:
                put(min(upto, serial), added, serial)
            if max(low, serial) < (stays := min(upto, serial + RESET)):
                put(stays, added, None)
            if upto > serial + RESET:
                put(upto, added + 1, serial)
        low = upto
    return out


def summed(serials: Iterable[float]) -> Pieces:
    """The effect of a run. Once it leaves one largest serial, whatever was before, the rest of it is the same for all pieces."""
    left, pieces = iter(serials), [(END, 0, None)]
    for s in left:
        pieces = after(pieces, s)
        if all(p[2] is not None and p[2] == pieces[0][2] for p in pieces):
            break
    else:
        return pieces
    more, top = 0, pieces[0][2]
    for s in left:
        more, top = (more + 1, s) if top - s > RESET else (more, max(top, s))
    return [(upto, added + more, top) for upto, added, _ in pieces]


def through(pieces: Pieces, epoch: int, top: float) -> tuple[int, float]:
    """(epoch, largest serial) after a run; no serial so far is minus infinity."""
    _, added, to = pieces[bisect_left([p[0] for p in pieces], top)]
    return epoch + added, top if to is None else to


def composed(first: Pieces, then: Pieces) -> Pieces:
    """The effect of two runs, one after the other."""
    out: Pieces = []
    low = -END
    for upto, added, top in first:
        if top is not None:
            e, t = through(then, added, top)
            found = [(upto, e, t)]
        else:  # the largest serial stays: cut where the second run's pieces end
            found = [(min(u, upto), added + a, t) for k, (u, a, t) in enumerate(then) if u > low and (k == 0 or then[k - 1][0] < upto)]
        for p in found:
            if out and p[2] is not None and out[-1][1:] == p[1:]:
                out[-1] = p
            else:
                out.append(p)
        low = upto
    return out


def _pieces(upto, added, top) -> Pieces:
    return [(float(u), int(a), None if t is None or t != t else float(t)) for u, a, t in zip(upto, added, top, strict=True)]


def _row(host, chunk: int, p: Pieces) -> pd.DataFrame:
    return pd.DataFrame({"host": [host], "chunk": [chunk], "upto": [[x[0] for x in p]], "added": [[x[1] for x in p]], "top": [[x[2] for x in p]]})


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    serials = pdf.sort_values("_id")["serial"].dropna()
    return _row(pdf["host"].iloc[0], pdf["chunk"].iloc[0], summed(map(float, serials)))


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    runs = (_pieces(*x) for x in zip(pdf["upto"], pdf["added"], pdf["top"], strict=True))
    return _row(pdf["host"].iloc[0], pdf["group"].iloc[0], reduce(composed, runs))


def _incoming(pdf: pd.DataFrame, epoch: int = 0, top: float = -END) -> pd.DataFrame:
    pdf, out = pdf.sort_values("chunk"), []
    for upto, added, to in zip(pdf["upto"], pdf["added"], pdf["top"], strict=True):
        out.append((epoch, top))
        epoch, top = through(_pieces(upto, added, to), epoch, top)
    return pd.DataFrame({"host": pdf["host"], "chunk": pdf["chunk"], "epoch": [x[0] for x in out], "top": [x[1] for x in out]})


def _incoming_after(parts: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    return _incoming(parts, int(before["epoch"].iloc[0]), float(before["top"].iloc[0])) if len(parts) else parts.reindex(columns=["host", "chunk", "epoch", "top"])


def states(runs: DataFrame) -> DataFrame:
    """(host, chunk, epoch, top) before each run. More than CHUNK runs of a host are composed in groups first, so no group is larger."""
    schema = "host string, chunk long, epoch long, top double"
    numbered = runs.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("chunk")) - 1)
    most = numbered.agg(F.max("nth")).first()[0]
    if most is None or most < CHUNK:
        return runs.groupBy("host").applyInPandas(lambda p: _incoming(p), schema)
    grouped = cut(numbered.select("host", "chunk", F.floor(F.col("nth") / CHUNK).alias("group"), "upto", "added", "top"), "groups")
    above = states(cut(grouped.groupBy("host", "group").applyInPandas(lambda p: _composed(p), PIECES), "runs"))
    before = above.withColumnRenamed("chunk", "group")
    return grouped.groupBy("host", "group").cogroup(before.groupBy("host", "group")).applyInPandas(_incoming_after, schema)


def numbered_epochs(events: DataFrame, counting: str = "true") -> tuple[DataFrame, DataFrame]:
    """boot_epochs() of the counting rows with _id, the place of a row in the order by host, time, serial and reference, and the table that it is made of.

    Chunks of CHUNK rows are summed up side by side: what a chunk does is a step function of the largest serial before
    it, with at most RESET + 2 steps for whole serials. These are composed in order, which gives the state before each
    chunk, and the chunks are gone through once more from there.
    """
    order = ("at", F.coalesce("serial", F.lit(-1)), "raw_ref")
    read = cut(events, "read")  # ranges are found by a pass of its own over what is dealt, and filters would work out columns again
    rows = read.where(counting).repartitionByRange("host", *order).sortWithinPartitions("host", *order).withColumn("_id", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("chunk", F.floor(F.col("_id") / CHUNK)), "sorted")
    free(read)
    serials = rows.select("host", "chunk", "_id", F.col("serial").cast("double").alias("serial"))
    before = states(cut(serials.groupBy("host", "chunk").applyInPandas(_summary, PIECES), "runs"))

    def numbered(part: pa.Table, state: pa.Table) -> pa.Table:
        part, out = part.sort_by("_id"), []
        epoch, top = state["epoch"][0].as_py(), state["top"][0].as_py()
        for s in part["serial"].cast(pa.float64(), safe=False).to_pylist():
            if s is not None and s == s:
                epoch, top = (epoch + 1, s) if top - s > RESET else (epoch, max(top, s))
            out.append(epoch)
        return part.drop_columns(["chunk"]).append_column("epoch", pa.array(out, pa.int64()))

    schema = T.StructType([*(f for f in rows.schema if f.name != "chunk"), T.StructField("epoch", T.LongType())])
    return rows.groupBy("host", "chunk").cogroup(before.groupBy("host", "chunk")).applyInArrow(numbered, schema), rows


def boot_epochs(events: DataFrame) -> DataFrame:
    """events (host, at, serial, raw_ref and more) with epoch: how often the serial has fallen more than RESET below the
    largest one since the last such fall. Rows count in the order (at, serial, raw_ref); those without serial change nothing.
    """
    return numbered_epochs(events)[0].drop("_id")


def instance_events(events: DataFrame) -> DataFrame:
    """boot_epochs() of the events with a process id, with seq: the process id's instance.

    A process id whose parent changes is a new instance, but not when it goes to 1 (an orphan). Unknown parents never
    split. Instances are counted within parts of the order by host and time, so a busy process id spreads over several
    tasks; what its earlier parts come to is added from carried().
    """
    numbered, before = numbered_epochs(events, "pid is not null")
    rows = cut(numbered.withColumn("_part", F.shiftrightunsigned("_id", 33)), "epochs")  # the range that a row was dealt to
    free(before)
    line = Window.partitionBy(*INSTANCE, "_part").orderBy("_id")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumns({"_real": F.last(REAL(), ignorenulls=True).over(past), "_orphan": F.max(F.when(F.col("ppid") == ORPHAN, 1)).over(past)})
    new = REAL().isNotNull() & ((F.col("_real") != REAL()) | (F.col("_real").isNull() & F.col("_orphan").isNotNull()))
    seq = F.sum(F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0).cast("long")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = seen.withColumns({"seq": seq, "_begun": F.coalesce(REAL(), F.col("_real")).isNotNull()}).drop("_real", "_orphan")
    seen = cut(seen, "split")
    free(rows)
    more = cut(carried(seen), "carried")
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*INSTANCE, "_part")))
    late = F.coalesce("_before", F.lit(0)) + F.when(F.col("_begun"), F.coalesce("_shift", F.lit(0))).otherwise(0)
    return seen.join(more, same, "left").withColumn("seq", F.col("seq") + late).drop("_id", "_part", "_begun", *more.columns)


def carried(seen: DataFrame) -> DataFrame:
    """(_of_host, _of_epoch, _of_pid, _of__part, _before, _shift) for parts of process ids that began in an earlier part: the
    instances before the part, and by how much its first known parent adds to them other than it seems from the part alone.

    Only epochs that cross a border are looked at: one for each border at most, which is why they may be broadcast.
    """
    over = seen.groupBy(F.col("host").alias("_host"), F.col("epoch").alias("_epoch")).agg(F.min("_part").alias("_low"), F.max("_part").alias("_high")).where("_low < _high")
    known, orphan = F.when(REAL().isNotNull(), F.col("_id")), F.when(F.col("ppid") == ORPHAN, F.col("_id"))
    parts = seen.join(F.broadcast(over), F.col("host").eqNullSafe(F.col("_host")) & (F.col("epoch") == F.col("_epoch")), "left_semi").groupBy(*INSTANCE, "_part").agg(
        F.min(known).alias("_first_at"), F.min(orphan).alias("_orphan_at"), F.min_by(REAL(), known).alias("_first"), F.max_by(REAL(), known).alias("_last"), F.max("seq").alias("_own"))
    past = Window.partitionBy(*INSTANCE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_parent": F.last("_last", ignorenulls=True).over(past), "_adopted": F.max(F.col("_orphan_at").isNotNull()).over(past)})
    seems = F.coalesce(F.col("_orphan_at") < F.col("_first_at"), F.lit(False))
    new = F.when(F.col("_parent").isNotNull(), F.col("_parent") != F.col("_first")).otherwise(F.coalesce("_adopted", F.lit(False)) | seems)
    parts = parts.withColumn("_shift", F.when(F.col("_first").isNotNull(), new.cast("long") - seems.cast("long")).otherwise(0))
    parts = parts.withColumn("_before", F.coalesce(F.sum(F.col("_own") + F.col("_shift")).over(past), F.lit(0)))
    return parts.where("_shift <> 0 or _before <> 0").select(*(F.col(k).alias(f"_of_{k}") for k in (*INSTANCE, "_part")), "_before", "_shift")


def instances(rows: DataFrame) -> DataFrame:
    """(host, epoch, pid, seq, ppid, first_at, last_at, first_ref, n_events) of instance_events()."""
    real = F.max(REAL())
    return rows.groupBy("host", "epoch", "pid", "seq").agg(
        F.coalesce(real, F.max("ppid")).alias("ppid"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.min(F.struct("at", F.coalesce("serial", F.lit(-1)).alias("s"), "raw_ref"))["raw_ref"].alias("first_ref"), F.count("*").alias("n_events"),
    )


def _has_parent() -> Column:
    return F.col("ppid").isNotNull() & ~F.col("ppid").isin(*ROOTS) & (F.col("ppid") != F.col("pid"))


def parents(found: DataFrame) -> DataFrame:
    """instances() with parent_seq: of the instances of the parent's process id on the same machine and in the same epoch, the
    latest that began at most SLACK after the child. Roots and processes that are their own parent have none."""
    sides = found.select(F.struct("host", "epoch", "pid", "seq").alias("_me"), *found.columns, F.when(_has_parent(), F.col("ppid")).alias("_up"))
    right = found.select(F.col("host").alias("p_host"), F.col("epoch").alias("p_epoch"), F.col("pid").alias("p_pid"), F.col("seq").alias("parent_seq"), F.col("first_at").alias("p_at"))
    keys = (("host", "p_host"), ("epoch", "p_epoch"), ("_up", "p_pid"))
    return as_of(sides, right, "_me", "first_at", "p_at", keys, "parent_seq", SLACK).select(*found.columns, "parent_seq")


def lineage_edges(events: DataFrame) -> DataFrame:
    """(a, b): for each instance with a known parent its first event b, and the parent's last event a at or before it, else the parent's first one."""
    rows = instance_events(events)
    found = cut(instances(rows), "instances")
    child = found.where(_has_parent()).select("host", "epoch", "ppid", "first_at", "first_ref")
    right = found.select(F.col("host").alias("p_host"), F.col("epoch").alias("p_epoch"), F.col("pid").alias("p_pid"), F.col("seq").alias("parent_seq"), F.col("first_at").alias("p_at"), F.col("first_ref").alias("parent_first"), F.col("n_events").alias("parent_events"))
    linked = as_of(child, right, "first_ref", "first_at", "p_at", (("host", "p_host"), ("epoch", "p_epoch"), ("ppid", "p_pid")), "parent_seq", SLACK)
    linked = cut(linked.where("parent_seq is not null").select(*child.columns, "parent_seq", "parent_first", "parent_events"), "linked")
    free(found)
    # a parent of one event needs no search, and only the others' events are searched
    many = linked.where("parent_events > 1").drop("parent_events")
    sought = cut(many.select(F.col("host").alias("s_host"), F.col("epoch").alias("s_epoch"), F.col("ppid").alias("s_pid"), F.col("parent_seq").alias("s_seq")).distinct(), "sought")
    own = rows.join(sought, (F.col("host") == F.col("s_host")) & (F.col("epoch") == F.col("s_epoch")) & (F.col("pid") == F.col("s_pid")) & (F.col("seq") == F.col("s_seq")), "left_semi")
    right = own.select(F.col("host").alias("r_host"), F.col("epoch").alias("r_epoch"), F.col("pid").alias("r_pid"), F.col("seq").alias("r_seq"), F.col("at").alias("r_at"), F.struct(F.coalesce("serial", F.lit(-1)).alias("s"), "raw_ref").alias("r_ref"))
    keys = (("host", "r_host"), ("epoch", "r_epoch"), ("ppid", "r_pid"), ("parent_seq", "r_seq"))
    hit = as_of(many, cut(right, "sought"), "first_ref", "first_at", "r_at", keys, "r_ref")
    pair = lambda a: (a.alias("a"), F.col("first_ref").alias("b"))
    return hit.select(*pair(F.coalesce("r_ref.raw_ref", "parent_first"))).unionByName(linked.where("parent_events <= 1").select(*pair(F.col("parent_first"))))


def _parent_events(events: DataFrame) -> DataFrame:
    """events with parent: the last event of the parent's process id at or before it, else that one's first event."""
    left = events.select("raw_ref", "host", "pid", "ppid", "at", F.when(F.col("ppid") != 0, F.col("ppid")).alias("_up"))
    right = events.select(F.col("host").alias("p_host"), F.col("pid").alias("p_pid"), F.col("at").alias("p_at"), F.col("raw_ref").alias("p_ref"))
    hit = as_of(left, right, "raw_ref", "at", "p_at", (("host", "p_host"), ("_up", "p_pid")), "p_ref")
    first = events.groupBy(F.col("host").alias("f_host"), F.col("pid").alias("f_pid")).agg(F.min(F.struct("at", "raw_ref"))["raw_ref"].alias("first"))
    return hit.join(first, (F.col("host").eqNullSafe(F.col("f_host"))) & (F.col("_up") == F.col("f_pid")), "left").select("raw_ref", "pid", "ppid", F.coalesce("p_ref", "first").alias("parent"))


def process_chains(events: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """(raw_ref, chain, pids, stop_reason): each event's line of parent events, itself first, at most `most` long.

    events: raw_ref, host (not null), pid, ppid, at. Each hop takes the parent as of the event's own time. Chains grow by
    doubling: what 2**k hops reach is joined to itself, so there are log2(most) joins, whatever the depth. Reasons, in
    the order in which a hop is tested: parent_pid_zero, cycle_detected (a process id that the chain holds), depth_limit,
    parent_not_observed.
    """
    node = lambda ref: F.struct(F.col(ref).alias("ref"), F.col("pid").alias("pid"), F.col("ppid").alias("ppid"))
    own = cut(events.where("pid is not null and raw_ref is not null").select("raw_ref", "host", "pid", "ppid", "at"), "own")
    # a row of a chain holds up to `most` nodes, so fewer rows make a partition
    rows, long = own.count(), most // 4 + 1
    up = cut(_parent_events(own), "hops", 2 * rows)
    free(own)
    # line: the nodes that 2**k hops pass, the event itself first; next: where they lead
    line = up.select("raw_ref", F.array(node("raw_ref")).alias("line"), F.col("parent").alias("next"))
    n, held = 1, up
    while n < most:
        other = line.select(F.col("raw_ref").alias("next"), F.col("line").alias("more"), F.col("next").alias("then"))
        grown = line.where("next is not null").join(other, "next", "left")
        grown = grown.select("raw_ref", F.when(F.col("more").isNull(), F.col("line")).otherwise(F.concat("line", "more")).alias("line"), F.when(F.col("more").isNotNull(), F.col("then")).alias("next"))
        line = cut(grown.unionByName(line.where("next is null")), "chains", rows * min(2 * n, long))  # chains that have ended stay out of the shuffle
        free(held)
        n, held = 2 * n, line
    l = F.slice("line", 1, most)
    at = lambda i: F.get(F.col("l"), i)
    before = lambda i: F.transform(F.slice(F.col("l"), 1, i + 1), lambda x: x["pid"])
    why = lambda i: (
        F.when(at(i)["ppid"].isNull() | (at(i)["ppid"] == 0), "parent_pid_zero").when(F.array_contains(before(i), at(i)["ppid"]), "cycle_detected").when(i + 1 >= most, "depth_limit").when(i + 1 >= F.size("l"), "parent_not_observed")
    )
    steps = F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.struct(i.alias("i"), why(i).alias("why")))
    stop = F.get(F.filter(steps, lambda x: x["why"].isNotNull()), F.lit(0))
    found = line.select("raw_ref", l.alias("l")).withColumn("stop", stop)
    kept = F.slice("l", F.lit(1), F.col("stop.i") + 1)
    return found.select("raw_ref", F.transform(kept, lambda x: x["ref"]).alias("chain"), F.transform(kept, lambda x: x["pid"]).alias("pids"), F.col("stop.why").alias("stop_reason"))


def lineage_status(stop_reason: Column) -> Column:
    """inferred for a chain that reaches a root, else partial."""
    return F.when(stop_reason == "parent_pid_zero", "inferred").otherwise("partial")


def ancestors(nodes: DataFrame, node: str = "id", parent: str = "parent", depth: int = 32) -> DataFrame:
    """(id, ancestor, depth): every node's chain of parents, at most `depth` long, ended by roots and by cycles.

    Chains grow by doubling, in log2(depth) joins. Nodes without a parent, or that are their own, have no rows.
    """
    line = nodes.where(F.col(parent).isNotNull() & (F.col(node) != F.col(parent))).select(F.col(node).alias("id"), F.array(parent).alias("line"))
    line = cut(line, "ancestors")
    for _ in range(max(1, (depth - 1).bit_length())):
        other = line.select(F.col("id").alias("_top"), F.col("line").alias("more"))
        grown = line.withColumn("_top", F.element_at("line", -1)).join(other, "_top", "left")
        line = cut(grown.select("id", F.when(F.col("more").isNull(), F.col("line")).otherwise(F.concat("line", "more")).alias("line")), "ancestors")
    rows = line.select("id", F.posexplode(F.slice("line", 1, depth)).alias("at", "ancestor"), "line")
    fresh = (F.col("ancestor") != F.col("id")) & (F.array_position("line", F.col("ancestor")) == F.col("at") + 1)
    closes = F.coalesce(F.nullif(F.array_position("line", F.col("id")), F.lit(0)), F.lit(depth + 1))
    return rows.where(fresh & (F.col("at") + 1 < closes)).select("id", "ancestor", (F.col("at") + 1).cast("long").alias("depth"))
