"""Session defaults and the shared folder in which intermediate tables are cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "emberlog", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster settings stay with spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (tests, one machine) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberlog-", dir=os.environ.get("TMPDIR")))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Folders of the tables that cut() wrote, for as long as their DataFrames live.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEAN, _PARTS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffle.partitions"
_MERGE, _SPLIT = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes"
_GUESSED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Rows of a shuffle partition at most, about, where the number of rows is known.
PART_ROWS = 500_000


def cut(df: DataFrame, name: str = "table", rows: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Unlike checkpoint() this computes df once, keeps it columnar and lets later filters reach the scan; a lost
    executor costs only the tasks it ran, as the files are not on its own disk. Shuffle files of the write go with it.
    If about so many `rows` meet in its joins and groups, they are dealt to partitions of PART_ROWS, so that the memory of a
    task does not grow with the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/emberlog-{name}-{uuid.uuid4().hex}"
    cut_to(df, path, rows)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def cut_to(df: DataFrame, path: str, rows: int = 0) -> None:
    """Write df as Parquet to path, over what is there; the shuffle files of the write go once it is done."""
    spark = df.sparkSession
    own = {_CLEAN: "true"}
    if (parts := rows // PART_ROWS + 1) > int(spark.conf.get(_PARTS)):
        own |= {_PARTS: str(parts), _MERGE: "false", _SPLIT: "16m"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.mode("overwrite").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def measured(spark: SparkSession) -> Iterator[None]:
    """Within, what is planned and run broadcasts only tables that a shuffle has measured to be small.

    Before a shuffle Spark guesses a table's size from its compressed files and the part of the columns that is read, which for a
    few columns of wide rows can be a hundredth of what the driver then has to hold.
    """
    guessed = spark.conf.get(_GUESSED)
    own = {_GUESSED: "-1", _MEASURED: spark.conf.get(_MEASURED, None) or guessed}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def free(*tables: DataFrame) -> None:
    """Empty the folders of tables that cut() gave, once what was made of them is written; others are left alone."""
    for t in tables:
        if path := _folders.pop(t, None):
            t.sparkSession.range(0).write.mode("overwrite").parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to all cores, for costly work on rows: a Parquet file of a single row group is read by one task, however many it is split into."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get(_PARTS)), spark.sparkContext.defaultParallelism), *keys)
