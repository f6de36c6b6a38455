"""Every workload query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from emberlog import logqueries, processqueries, readerqueries, workload  # noqa: F401 (these add to the workload)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    got = workload.queries()[name](spark, sf_dir)
    want = duck.execute(workload.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def smallest_reachable(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def test_components_of_whole_table(spark, sf_dir, tmp_path):
    rows = [(s, 10 * s + k % 3, float(k % 50 + 1), 0.0) for s in range(1, 40) for k in range(6)] + [(1, 21, 3.0, 0.01), (2, 31, 7.0, 0.0)]
    small = tmp_path / "small"
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(str(small / "lineitem.parquet"))
    for d in (str(small), sf_dir):
        edges = [(r.l_suppkey, -r.l_partkey) for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()]
        got = {r.vertex: r.component for r in workload.queries()["components_whole"](spark, d).collect()}
        assert got == smallest_reachable(edges)


def test_whole_queries_keep_every_row(spark, sf_dir):
    q = workload.queries()
    assert q["link_equi_whole"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    keys = workload.events(spark, sf_dir).select("user_id", "k").distinct().count()
    state = q["state_diff_whole"](spark, sf_dir).collect()
    assert len(state) == keys == q["queue_upsert_whole"](spark, sf_dir).count()
    assert {r.emit for r in state} == {"new", "update", "silent", None}
