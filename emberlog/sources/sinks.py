"""Where results go and come back from: events by layer, incidents by run, metrics."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def write_events(events: DataFrame, folder: str) -> None:
    """Events as JSON lines in a folder for each layer."""
    events.write.mode("append").partitionBy("layer").json(folder)


def write_incidents(incidents: DataFrame, folder: str, run: str) -> None:
    """One run's incidents as JSON lines. A run that is written again takes the place of its first writing; readers see
    whole files only, as Spark commits a write's files at its end."""
    incidents.write.mode("overwrite").json(f"{folder.rstrip('/')}/run={run}")


def read_incidents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Incidents from JSON lines, from one object or from an array over many lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    whole = first is not None and not first["value"].rstrip().endswith(("}", "]"))
    return reader.json(path, multiLine=whole)


def append_metrics(spark: SparkSession, folder: str, rows: DataFrame) -> bool:
    """Add rows to a table of metrics; a failure is logged and never stops the run. Tells whether they were written."""
    try:
        rows.withColumn("written_at", F.current_timestamp()).write.mode("append").json(folder)
        return True
    except Exception:  # noqa: BLE001 (a metric must not cost a run)
        log.warning("metrics were not written to %s", folder, exc_info=True)
        return False


def evidence_line(layer: Column, ld: str = "ld") -> Column:
    """An event in one line, by layer (X12); missing fields are left out."""
    f = lambda *names: F.concat_ws(" ", *(F.col(f"{ld}.{n}").cast("string") for n in names))
    return (
        F.when(layer == "web", f("method", "path", "status", "user_agent")).when(layer == "system", f("user", "comm", "exec_args", "path")).when(layer == "auth", f("event", "result", "user", "src_user"))
        .otherwise(f("event_type", "signature", "method", "path", "status", "dest_ip"))
    )
