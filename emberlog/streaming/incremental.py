"""Micro-batch analysis: the look-back is analysed anew, compared with the last snapshot, and a new one is written (K1 to K3, K9)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.burst import bursts
from emberlog.operators.queue import state_diff
from emberlog.operators.range_join import micros

STATE = "incident_key string, emit string, window_end timestamp, max_member_count bigint, last_seen timestamp"
LOOK_BACK_SECONDS = 3600


class Snapshots:
    """Numbered Parquet snapshots of the incident state below a shared folder; one stream writes them.

    A snapshot's number is its batch's, so a batch that runs again overwrites its own and the result is the same.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def at(self, batch: int) -> str:
        return f"{self.folder}/state/batch={batch}"

    def before(self, batch: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(self.at(batch - 1)) if batch > 0 else self.spark.createDataFrame([], STATE)

    def latest(self) -> DataFrame:
        every = self.spark.read.schema(f"{STATE}, batch bigint").parquet(f"{self.folder}/state")
        return every.join(every.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")


def run_bursts(stream: DataFrame, store: Snapshots, checkpoint: str, width_seconds: int = 300, least: int = 20, look_back_seconds: int = LOOK_BACK_SECONDS, every: str | None = None, keep: int = 100) -> StreamingQuery:
    """Bursts per user over a stream (event_id, user_id, ts); `every` is a trigger interval, else all that is there is run and awaited.

    Each batch is appended to a table of events under its number and the events' hours; then the rows of the last
    look_back_seconds of event time are analysed, so late rows inside that span count. The span is a literal, so hours
    before it are not read. Snapshots of more than `keep` batches ago are emptied.
    """

    def batch(df: DataFrame, number: int) -> None:
        path = f"{store.folder}/events"
        df.withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("long")).write.mode("overwrite").partitionBy("hour").parquet(f"{path}/batch={number}")
        events = store.spark.read.schema(f"{','.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch long, hour long").parquet(path)
        last = events.agg(F.max("hour")).first()[0]  # reads folder names only
        clock = events.where(F.col("hour") == last).agg(F.max("ts")).first()[0] if last is not None else None
        if clock is None:
            store.before(number).write.mode("overwrite").parquet(store.at(number))
            return
        since = clock - timedelta(seconds=look_back_seconds)
        recent = events.where((F.col("hour") >= last - look_back_seconds - 3600) & (F.col("ts") >= F.lit(since))).select("user_id", "event_id", micros("ts").alias("at"))
        found = bursts(recent, ("user_id",), "at", "event_id", width_seconds * 1_000_000, least)
        now = found.groupBy(F.col("user_id").cast("string").alias("incident_key")).agg(F.timestamp_micros(F.max("last_at")).alias("window_end"), F.sum("n_hits").alias("member_count"))
        state_diff(now, store.before(number).drop("emit"), F.lit(clock)).select("incident_key", "emit", "window_end", "max_member_count", "last_seen").write.mode("overwrite").parquet(store.at(number))
        if number >= keep:
            store.spark.createDataFrame([], STATE).write.mode("overwrite").parquet(store.at(number - keep))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_counts(stream: DataFrame, late: str = "60 minutes", size: str = "60 minutes", slide: str = "5 minutes") -> DataFrame:
    """Counts by type over sliding event-time windows, with a watermark for late rows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"))
