"""The detection chain as a stream: events in, news of incidents out (K1 to K4).

Each batch of events is added to a table by hour. The hours of the look-back are analysed by the same chain as a table
would be, and its incidents are added to a table of runs, which a second, stateful query turns into news. Both
queries have checkpoints of their own; a batch that runs again overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.plans.chain import detect_incidents
from emberlog.streaming.stateful import news, use_rocksdb

LOOK_BACK_SECONDS, HOUR = 3600, 3600
RUNS = "incident_key string, incident_id string, entity string, window_end timestamp, member_count long, layers array<string>, priority string, triage_score long, route string, members array<string>, run_at timestamp"


class Detection:
    """Tables of a detection below a shared folder: events by hour and batch, runs by batch, news."""

    def __init__(self, spark: SparkSession, folder: str, chain: Callable[[DataFrame], DataFrame] = detect_incidents, look_back_seconds: int = LOOK_BACK_SECONDS):
        self.spark, self.folder, self.chain, self.look_back = spark, folder.rstrip("/"), chain, look_back_seconds

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def clock_before(self, number: int) -> datetime | None:
        return self.spark.read.schema("at timestamp").parquet(f"{self.at('clock')}/batch={number - 1}").first()["at"] if number else None

    def window(self, clock: datetime, schema) -> DataFrame:
        """Events from look_back before the clock up to it; folders of other hours are not listed."""
        since = clock - timedelta(seconds=self.look_back)
        hours = range(int(since.timestamp()) // HOUR, int(clock.timestamp()) // HOUR + 1)
        rows = self.spark.read.schema(schema).parquet(f"{self.at('events')}/hour={{{','.join(map(str, hours))}}}")
        return rows.where((F.col("ts") >= F.lit(since)) & (F.col("ts") <= F.lit(clock)))

    def batch(self, df: DataFrame, number: int) -> None:
        """One micro-batch: a run over the look-back. The clock is the latest event so far; events before the look-back are kept, but not analysed."""
        hours = df.withColumns({"hour": F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / HOUR), "batch": F.lit(number)})
        hours.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(self.at("events"))
        own, before = df.agg(F.max("ts").cast("timestamp").alias("at")).first()["at"], self.clock_before(number)
        clock = max((x for x in (own, before) if x is not None), default=None)
        self.spark.createDataFrame([(clock,)], "at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.at('clock')}/batch={number}")
        if own is None or clock is None:
            found = self.spark.createDataFrame([], RUNS)
        else:
            found = self.chain(self.window(clock, df.schema)).select(*(F.col(c) if c not in ("window_end", "run_at") else {"window_end": F.col("last_ts").cast("timestamp"), "run_at": F.lit(clock)}[c].alias(c) for c in (x.split()[0] for x in RUNS.split(", "))))
        names = {f.name: f.dataType for f in self.spark.createDataFrame([], RUNS).schema}
        found.select(*(F.col(c).cast(t) for c, t in names.items())).write.mode("overwrite").parquet(f"{self.at('runs')}/batch={number}")

    def run(self, events: DataFrame, every: str | None = None) -> tuple[StreamingQuery, StreamingQuery]:
        """Start both queries; without a trigger interval what is there is run, and awaited."""
        use_rocksdb(self.spark)
        trigger = {"processingTime": every} if every else {"availableNow": True}
        one = events.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.at("checkpoints/runs")).trigger(**trigger).start()
        if not every:
            one.awaitTermination()
        runs = self.spark.readStream.schema(RUNS + ", batch long").parquet(self.at("runs"))
        two = news(runs).writeStream.format("parquet").option("checkpointLocation", self.at("checkpoints/news")).trigger(**trigger).start(self.at("news"))
        if not every:
            two.awaitTermination()
        return one, two

    def store(self) -> DataFrame:
        """The last news of every key ever seen, expired or not."""
        every = self.spark.read.parquet(self.at("news"))
        last = every.groupBy("incident_key").agg(F.max(F.struct("run_at", *(c for c in every.columns if c not in ("incident_key", "run_at")))).alias("s"))
        return last.select("incident_key", "s.*")
