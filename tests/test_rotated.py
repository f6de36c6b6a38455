"""The rotated log as a data source: whole, by splits, by time, and followed over rotations and restarts."""

from __future__ import annotations

import gzip
import os
from collections import Counter

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from emberlog.sources import logs, rotated
from emberlog.sources.rotated import RotatedLog


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(RotatedLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.log").write_bytes(b"now 1\r\n\nnow 2\nnot ended")
    (tmp_path / "a.log.1").write_text("".join(f"one {k}\n" for k in range(200)))
    (tmp_path / "a.log.2.gz").write_bytes(gzip.compress("".join(f"two {k} é\n" for k in range(300)).encode()))
    (tmp_path / "a.log-20240501").write_text("dated\n")
    for other in ("a.log.1.bak", "a.log.old", "ba.log", "a.logx"):
        (tmp_path / other).write_text("other\n")
    return tmp_path


WANT = Counter(["now 1", "now 2", "not ended", "dated", *(f"one {k}" for k in range(200)), *(f"two {k} é" for k in range(300))])


def test_siblings(folder):
    assert [x.name for x in rotated.siblings(fs.LocalFileSystem(), str(folder / "a.log"))] == ["a.log-20240501", "a.log.2.gz", "a.log.1", "a.log"]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_batch(spark, folder, split):
    df = spark.read.format("rotated_log").option("split", split).load(str(folder / "a.log"))
    rows = df.collect()
    assert Counter(r.line for r in rows) == WANT
    text = (folder / "a.log.1").read_bytes()
    assert all(text[r.place :].startswith(r.line.encode() + b"\n") for r in rows if r.file == "a.log.1")
    assert df.rdd.getNumPartitions() > (30 if split == 7 else 3)


def test_lines_leave_out_other_names(spark, folder):
    assert Counter(r.line for r in logs.lines(spark, str(folder / "a.log")).collect()) == WANT


def test_time_filter_skips_files(spark, folder):
    for k, n in enumerate(("a.log-20240501", "a.log.2.gz", "a.log.1", "a.log")):
        os.utime(folder / n, (1_700_000_000 + 3600 * k,) * 2)
    df = spark.read.format("rotated_log").load(str(folder / "a.log")).where(F.col("modified") >= F.timestamp_seconds(F.lit(1_700_000_000 + 7200)))
    assert {r.file for r in df.collect()} == {"a.log.1", "a.log"} and df.rdd.getNumPartitions() == 2
    late = spark.read.format("rotated_log").option("since", "2023-11-15T01:00:00").load(str(folder / "a.log"))
    assert {r.file for r in late.collect()} == {"a.log"}


def test_nothing_there(spark, tmp_path):
    assert spark.read.format("rotated_log").load(str(tmp_path / "none.log")).count() == 0


def test_followed_over_rotations(spark, tmp_path):
    """Each line once, whatever happens to the file between two triggers and while the query is down; unfinished lines wait."""
    log, out = tmp_path / "b.log", tmp_path / "out"

    def follow():
        q = spark.readStream.format("rotated_log").option("split", 40).load(str(log)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(out))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return Counter(r.line for r in spark.read.schema("line string").parquet(str(out)).collect())

    first = [f"a {k}" for k in range(20)]
    log.write_text("\n".join(first) + "\nhalf")
    (tmp_path / "b.log.1.bak").write_text("other\n")
    assert follow() == Counter(first)
    with log.open("a") as f:
        f.write(" a line\nlast of a\n")
    log.rename(tmp_path / "b.log.1")  # rotated while the query is down, with lines that it has not seen
    log.write_text("b 0\nb 1\n")
    second = [*first, "half a line", "last of a", "b 0", "b 1"]
    assert follow() == Counter(second)
    (tmp_path / "b.log.2.gz").write_bytes(gzip.compress((tmp_path / "b.log.1").read_bytes() + b"after the last look\n"))
    os.remove(tmp_path / "b.log.1")  # packed
    log.rename(tmp_path / "b.log.1")
    log.write_text("c 0\n")
    assert follow() == Counter([*second, "after the last look", "c 0"])
    assert follow() == Counter([*second, "after the last look", "c 0"])
