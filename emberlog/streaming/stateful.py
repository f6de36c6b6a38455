"""Stateful streaming: bursts by entity and the news of incidents, with state in RocksDB.

State that a key keeps is bounded: of hits only the last `least`, of an incident one row; timers of event time process
what had to wait for late rows, and drop what has expired.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_SECONDS = 24 * 3600


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB, as stateful processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class BurstRows(StatefulProcessor):
    """Hits that lie in a window of `width` microseconds with at least `least` hits, in the order of (at, ref).

    Hits wait until the watermark has passed them. A hit that makes a full window of the last `least` ones covers all of
    them; later hits are covered up to the width from that window's start. So the last `least` hits (and one before
    them) are all that a key has to keep of those it has passed.
    """

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, ref string")
        self.line = handle.getValueState("line", "ats array<long>, refs array<string>, covered array<boolean>, burst long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r.at, r.ref) for r in rows])
        return self._passed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._passed(key, timerValues.getCurrentWatermarkInMs())

    def _passed(self, key: tuple, watermark: int) -> Iterator[Row]:
        limit = watermark * 1000
        held = sorted((r[0], r[1]) for r in self.waiting.get())
        ready, later = [x for x in held if x[0] < limit], [x for x in held if x[0] >= limit]
        ats, refs, covered, burst, until = self.line.get() if self.line.exists() else ([], [], [], None, None)
        ats, refs, covered = list(ats), list(refs), list(covered)
        out = []
        for at, ref in ready:
            ats.append(at)
            refs.append(ref)
            covered.append(False)
            if len(ats) >= self.least and at - ats[-self.least] <= self.width:
                until, first = ats[-self.least] + self.width, len(ats) - self.least
            else:
                first = len(ats) - 1 if until is not None and at <= until else len(ats)
            for k in range(first, len(ats)):
                if not covered[k]:
                    if k == 0 or not covered[k - 1] or ats[k] - ats[k - 1] > self.width:
                        burst = ats[k]
                    covered[k] = True
                    out.append(Row(**dict(zip(self.keys, key, strict=True)), burst_at=burst, at=ats[k], ref=refs[k]))
            ats, refs, covered = (x[-self.least - 1 :] for x in (ats, refs, covered))
        if ready:
            self.line.update((ats, refs, covered, burst, until))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        elif ats:  # a quiet key's line is dropped once it can't cover anything any more
            end = (ats[-1] + self.width) // 1000 + 1
            if watermark >= end:
                self.line.clear()
            else:
                self.handle.registerTimer(end)
        yield from out


def stream_bursts(hits: DataFrame, keys: tuple[str, ...], ts: str, ref: str, width_seconds: int, least: int, late: str = "60 minutes") -> DataFrame:
    """(keys, burst_at, at, ref) for a stream of hits: a row for each hit of a burst, as soon as it is known.

    The same rows as burst_rows() gives for the whole table, of hits not later than `late`; a burst is named by its first
    hit's time. Refs come as rows, so a burst may have any number of them.
    """
    processor = BurstRows(width_seconds * 1_000_000, least)
    processor.keys = keys
    types = {f.name: f.dataType.simpleString() for f in hits.schema}
    rows = hits.withWatermark(ts, late).select(*keys, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(ref).cast("string").alias("ref"))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", burst_at long, at long, ref string"
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", "eventtime")


NEWS = "incident_key string, run_at timestamp, emit string, incident_id string, window_end timestamp, max_member_count long, priority string, triage_score long, route string, first_seen timestamp, last_emitted timestamp, n_emitted long"


def _utc(x):
    """Rows bring times with a zone, state brings them without."""
    return x.replace(tzinfo=UTC) if isinstance(x, datetime) and x.tzinfo is None else x


class News(StatefulProcessor):
    """What a run's incident is: new, update (a later end or more members than ever) or silent.

    The live row expires `ttl` seconds of event time after the key was last seen, then the key is new again. What the store
    keeps beyond that (first_seen, n_emitted) is in a second state that does not expire.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "window_end timestamp, max_member_count long, last_seen timestamp")
        self.kept = handle.getValueState("kept", "first_seen timestamp, last_emitted timestamp, n_emitted long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        live = tuple(map(_utc, self.live.get())) if self.live.exists() else None
        first, emitted, n = map(_utc, self.kept.get()) if self.kept.exists() else (None, None, 0)
        for r in sorted(rows, key=lambda r: r.run_at):
            run_at, window_end = _utc(r.run_at), _utc(r.window_end)
            if live is not None and (run_at - live[2]).total_seconds() > self.ttl:
                live = None
            end, most = (live[0], live[1]) if live else (None, 0)
            later = window_end is not None and (end is None or window_end > end)
            emit = "new" if live is None else "update" if later or r.member_count > most else "silent"
            live = (window_end if later else end, max(most, r.member_count), run_at)
            first = first or run_at
            if emit != "silent":
                emitted, n = run_at, n + 1
            yield Row(incident_key=key[0], run_at=run_at, emit=emit, incident_id=r.incident_id, window_end=live[0], max_member_count=live[1], priority=r.priority, triage_score=r.triage_score, route=r.route, first_seen=first, last_emitted=emitted, n_emitted=n)
        self.live.update(live)
        self.kept.update((first, emitted, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(live[2].timestamp() * 1000) + self.ttl * 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.live.exists():
            seen = _utc(self.live.get()[2])
            if timerValues.getCurrentWatermarkInMs() > int(seen.timestamp() * 1000) + self.ttl * 1000:
                self.live.clear()
        return iter(())


def news(found: DataFrame, ttl_seconds: int = DAY_SECONDS) -> DataFrame:
    """A stream of runs' incidents (incident_key, incident_id, window_end, member_count, priority, triage_score, route,
    run_at) with what each of them is; runs that come late by up to ttl_seconds are told in the order of run_at."""
    rows = found.withWatermark("run_at", "0 seconds")
    return rows.groupBy("incident_key").transformWithState(News(ttl_seconds), NEWS, "append", "eventtime")


